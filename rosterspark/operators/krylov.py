"""Ridge fits of any width: many systems and penalties by one conjugate-gradient run.

A design is packed once into blocks of rows. A system is a choice of rows with weights: all
rows but a fold's, the rows of a kind of shot, or a bootstrap draw. One pass over the blocks
multiplies the weighted designs of all systems with a vector each; systems that differ in
their penalty alone share these products, as their residuals stay parallel (multi-shift
recurrences). The driver holds vectors, columns times systems times penalties, where they
are small; others stay in tasks (``spread``).

A system's intercept has no penalty: designs are centred by their weighted means, which
enter the products as a rank-one term and never touch the sparse rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.sources.scratch import materialise

#: Rows of a block, numbers of a vector for all systems that are solved together, and sums at most in a row of what tasks hand on.
ROWS, NUMBERS, SUMS = 4096, 1 << 22, 16
#: Rows of a part at most, which a task holds when vectors come to the parts (``spread``), and numbers of a vector that the driver holds at each step.
PART_ROWS, HELD = 1 << 20, 1 << 18
#: Entries of a column in a block that are added in turns, and numbers that are worked on at once, which a core's cache holds.
TURNS, CELLS = 24, 1 << 15
KINDS = {"tag": np.int32, "grp": np.int64, "w": np.float64, "y": np.float64, "deep": np.int32, "c": np.int32, "v": np.float64, "cols": np.int32, "of": np.int32, "to": np.int32, "u": np.float64, "edges": np.int32, "turns": np.int32}
BLOCK = "part int, n int, " + ", ".join(f"{k} binary" for k in KINDS)
# The distribution of how often a group is drawn, to 12 times.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 13)]))


def _drawn(bits: np.ndarray) -> np.ndarray:
    """How often 53 random bits draw a group."""
    return np.searchsorted(_POISSON, bits / float(1 << 53), side="right")


#: The same from the leading sixteen bits, or 255 where they leave it open.
_ENDS = [_drawn((np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)) + np.uint64(x)) for x in (0, (1 << 37) - 1)]
_LEADING = np.where(_ENDS[0] == _ENDS[1], _ENDS[0], 255).astype(np.uint8)

#: Weights of a block's rows in all systems, from their tags and their groups' hashes.
Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Packed:
    """A design in blocks of rows, written once."""

    blocks: DataFrame
    n_cols: int

    @property
    def spark(self) -> SparkSession:
        return self.blocks.sparkSession


def pack(triplets: DataFrame, rows: DataFrame, n_cols: int, tag: Column | None = None, group: Column | None = None) -> Packed:
    """``triplets`` (row_id, col, value) and ``rows`` (row_id, y, w and what ``tag``, a small
    number, and ``group`` are made of) as blocks. Rows without entries stay; entries of one
    place add up."""
    own = rows.select("row_id", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), (F.lit(0) if tag is None else tag).cast("int").alias("tag"), F.xxhash64(F.lit(0) if group is None else group).alias("grp"))
    cells = triplets.groupBy("row_id", "col").agg(F.sum("value").cast("double").alias("v")).groupBy("row_id").agg(F.collect_list(F.struct(F.col("col").cast("int").alias("c"), "v")).alias("x"))
    met = own.join(cells, "row_id", "left").select("tag", "grp", "w", "y", F.coalesce("x.c", F.array().cast("array<int>")).alias("c"), F.coalesce("x.v", F.array().cast("array<double>")).alias("v"))

    names = ["part", "n", *KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                b = whole.slice(lo, ROWS)
                own = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("tag", "grp", "w", "y")}
                order, laid = _laid(pc.list_value_length(b.column("c")).to_numpy(), *(b.column(k).flatten().to_numpy() for k in ("c", "v")))
                seen += len(b)
                parts = {k: x[order] for k, x in own.items()} | laid
                numbers = [pa.array([TaskContext.get().partitionId() << 12 | seen // PART_ROWS], pa.int32()), pa.array([len(b)], pa.int32())]
                yield pa.RecordBatch.from_arrays([*numbers, *(pa.array([np.asarray(parts[k]).astype(KINDS[k]).tobytes()], pa.binary()) for k in KINDS)], names)

    # As many parts as the cluster has cores, for all passes to come; rows that begin with the
    # same columns lie together, so that a part hands on few columns where rows share them.
    met = met.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, F.array_min("c"), F.xxhash64("c", "y")).sortWithinPartitions(F.array_min("c"))
    return Packed(materialise(met.mapInArrow(run, BLOCK), "design"), n_cols)


def _laid(held: np.ndarray, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of a block's rows, of which each has ``held`` entries, and its entries, so
    laid that both products go by whole stretches. The longest rows come first: ``deep`` rows
    have a first entry, a second one, and so on, whose places among the columns ``cols`` are
    ``c``. For the transposed product, entries that go from rows ``of`` to columns ``to`` lie
    in turns in which a column occurs once; then, from the turn ``turns`` on, those of one
    column each that has many. Values are left out where all are 1."""
    order = np.argsort(-held, kind="stable")
    new = np.empty(len(held), np.int64)
    new[order] = np.arange(len(held))
    row = np.repeat(np.arange(len(held)), held)
    depth = np.arange(len(c)) - (np.cumsum(held) - held)[row]
    by_depth = np.lexsort((new[row], depth))
    cols, at = np.unique(c, return_inverse=True)
    at, row, v = at[by_depth], new[row][by_depth], v[by_depth]
    by_col = np.argsort(at, kind="stable")
    count = np.bincount(at, minlength=len(cols))
    turn = np.empty(len(at), np.int64)
    turn[by_col] = np.arange(len(at)) - (np.cumsum(count) - count)[at[by_col]]
    turn = np.where(count[at] > TURNS, TURNS + at, turn)
    by_turn = np.lexsort((at, turn))
    turn = turn[by_turn]
    edges = np.append(np.flatnonzero(np.diff(turn, prepend=-1)), len(turn))
    plain = bool((v == 1).all())
    return order, {
        "deep": np.bincount(depth), "c": at, "v": [] if plain else v, "cols": cols, "of": row[by_turn], "to": at[by_turn],
        "u": [] if plain else v[by_turn], "edges": edges, "turns": [np.searchsorted(turn[edges[:-1]], TURNS)],
    }


class Block:
    """A block of rows in a task."""

    def __init__(self, row, weigh: Weigh):
        for k, kind in KINDS.items():
            setattr(self, k, np.frombuffer(getattr(row, k), kind))
        #: Rows by systems.
        self.weights = self.w[:, None] * weigh(self.tag, self.grp)

    def times(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of the design times one vector a system."""
        width = vectors.shape[1]
        own, out = vectors[self.cols], np.zeros((len(self.w), width))
        step, starts = max(64, CELLS // width), np.cumsum(self.deep) - self.deep
        some = np.empty((min(step, len(out)), width))
        for lo in range(0, self.deep[0] if len(self.deep) else 0, step):
            for n, start in zip(self.deep, starts, strict=True):
                if n <= lo:
                    break
                at = slice(start + lo, start + min(n, lo + step))
                part = some[: at.stop - at.start]
                np.take(own, self.c[at], axis=0, out=part, mode="clip")
                if len(self.v):
                    part *= self.v[at, None]
                out[lo : lo + len(part)] += part
        return out

    def add_to(self, total: np.ndarray, by_row: np.ndarray) -> None:
        """Adds the transposed design times ``by_row`` to ``total``, columns by systems."""
        own, step = np.zeros((len(self.cols), by_row.shape[1])), max(64, CELLS // by_row.shape[1])
        for k, (start, end) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            for lo in range(start, end, step):
                at = slice(lo, min(end, lo + step))
                part = by_row.take(self.of[at], axis=0)
                if len(self.u):
                    part *= self.u[at, None]
                if k < self.turns[0]:
                    own[self.to[at]] += part
                else:
                    own[self.to[lo]] += part.sum(0)
        total[self.cols] += own


def _summed(design: Packed, weigh: Weigh, n_systems: int, vectors: np.ndarray | None, kernel: Callable[[Block, np.ndarray | None], list[np.ndarray]], n_extra: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums over all blocks: ``kernel`` gives rows-by-systems factors, of which each one's
    product with the transposed design is summed by column, and then ``n_extra`` numbers by
    system. The second part of the result is those, the first the columns' sums."""
    n = design.n_cols
    sent = design.spark.sparkContext.broadcast(vectors)  # columns times systems, as stated above
    n_factors = len(kernel(None, None))
    width = max(1, n_factors) * n_systems
    parts = -(-width // SUMS)
    # Rows of like length: a single system hands on one sum a column.
    sums = -(-width // parts)
    names = [f"s{k}" for k in range(sums)]

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, extra = [np.zeros((n, n_systems)) for _ in range(n_factors)], np.zeros((n_extra, n_systems))
        for b in rows:
            for row in b.itertuples():
                block = Block(row, weigh)
                found = kernel(block, sent.value)
                for total, factor in zip(totals, found, strict=False):
                    block.add_to(total, factor)
                for k in range(n_extra):
                    extra[k] += found[n_factors + k]
        # Numbers of whole systems stand below the columns, once for each factor.
        whole = np.vstack([np.concatenate(totals, axis=1) if totals else np.zeros((n, n_systems)), np.tile(extra, max(1, n_factors))])
        whole = np.pad(whole, ((0, 0), (0, parts * sums - width))).reshape(-1, sums)
        at = np.flatnonzero(whole.any(1))
        out = pd.DataFrame(whole[at], columns=names)
        out.insert(0, "place", at.astype(np.int64))
        yield out

    part = design.blocks.mapInPandas(run, "place long, " + ", ".join(f"{c} double" for c in names))
    found = part.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # columns and numbers by system, as stated above
    sent.destroy()
    whole = np.zeros(((n + n_extra) * parts, sums))
    if found.num_rows:
        whole[found.column("place").to_numpy()] = np.column_stack([found.column(c).to_numpy() for c in names])
    whole = whole.reshape(n + n_extra, parts * sums)[:, :width]
    return [whole[:n, k * n_systems : (k + 1) * n_systems] for k in range(n_factors)], whole[n:, :n_systems]


@dataclass
class Moments:
    """Weights and weighted sums of the systems: by column and system, or by system."""

    xw: np.ndarray
    xy: np.ndarray
    sw: np.ndarray
    sy: np.ndarray


def moments(design: Packed, weigh: Weigh, n_systems: int) -> Moments:
    def kernel(b: Block | None, _):
        return [None, None] if b is None else [b.weights, b.weights * b.y[:, None], b.weights.sum(0), (b.weights * b.y[:, None]).sum(0)]

    (xw, xy), (sw, sy) = _summed(design, weigh, n_systems, None, kernel, 2)
    return Moments(xw, xy, sw, sy)


def centred_product(design: Packed, weigh: Weigh, m: Moments, vectors: np.ndarray) -> np.ndarray:
    """Each system's centred normal equations times its vector."""

    def kernel(b: Block | None, v):
        return [None] if b is None else [b.weights * b.times(v)]

    (out,), _ = _summed(design, weigh, len(m.sw), vectors, kernel, 0)
    return out - m.xw * np.divide((m.xw * vectors).sum(0), m.sw, out=np.zeros_like(m.sw), where=m.sw > 0)


def fits(design: Packed, weigh: Weigh, n_systems: int, alphas: list[float], mu: np.ndarray | None = None, tolerance: float = 1e-12, steps: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (penalties, columns, systems) and intercepts (penalties, systems) of
    min sum w (y - b0 - x beta)^2 + alpha |beta - mu|^2 for all systems and penalties.

    The least penalty leads; the others follow by the ratios of their residuals to its.
    ``mu`` has a prior by column, for all systems, or by column and system. Where a vector of
    all systems is more than ``HELD`` numbers, vectors stay in tasks.
    """
    if design.n_cols * n_systems > HELD:
        from rosterspark.operators import spread

        return spread.fitted(design, weigh, n_systems, alphas, mu, tolerance, steps)
    m, n = moments(design, weigh, n_systems), design.n_cols
    shift = np.array(alphas) - min(alphas)
    prior = np.zeros((n, n_systems)) if mu is None else np.broadcast_to(np.reshape(mu, (n, -1)), (n, n_systems))
    mean = np.divide(m.sy, m.sw, out=np.zeros_like(m.sw), where=m.sw > 0)
    left = m.xy - m.xw * mean
    if mu is not None:
        left = left - centred_product(design, weigh, m, prior)
    x = np.zeros((len(alphas), n, n_systems))
    ahead, lead = np.repeat(left[None], len(alphas), axis=0), left.copy()
    size = (left * left).sum(0)
    goal = tolerance**2 * size
    ratio = before = np.ones((len(alphas), n_systems))
    step, slope = np.ones(n_systems), np.zeros(n_systems)
    for _ in range(steps):
        on = size > goal
        if not on.any():
            break
        moved = centred_product(design, weigh, m, lead) + min(alphas) * lead
        bend = (lead * moved).sum(0)
        last, step = step, np.divide(size, bend, out=np.zeros(n_systems), where=on & (bend > 0))
        under = last * before * (1 + step * shift[:, None]) + step * slope * (before - ratio)
        following = np.where(on, np.divide(ratio * before * last, under, out=np.zeros_like(ratio), where=under != 0), ratio)
        # A residual that has vanished stays so.
        change = np.divide(following, ratio, out=np.zeros_like(ratio), where=ratio != 0)
        x += (step * change)[:, None, :] * ahead
        left = left - step * moved
        grown = (left * left).sum(0)
        slope = np.where(on, np.divide(grown, size, out=np.zeros(n_systems), where=size > 0), 0.0)
        lead = left + slope * lead
        ahead = following[:, None, :] * left + (slope * change**2)[:, None, :] * ahead
        before, ratio, size = ratio, following, np.where(on, grown, size)
        step = np.where(on, step, 1.0)
    else:
        raise ArithmeticError(f"no solution within {steps} steps")
    beta = x + prior
    return beta, mean - np.divide((m.xw * beta).sum(1), m.sw, out=np.zeros((len(alphas), n_systems)), where=m.sw > 0)


def errors(design: Packed, judge: np.ndarray, beta: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Weighted mean square errors (penalties, systems) over the rows that ``judge`` (tags
    by systems, 0 or 1) names for a system."""
    sent = design.spark.sparkContext.broadcast((beta, intercept))  # penalties times columns times systems
    n_alphas, _, n_systems = beta.shape

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beta, intercept = sent.value
        total, weight = np.zeros((n_systems, n_alphas)), np.zeros(n_systems)
        for b in rows:
            for row in b.itertuples():
                block = Block(row, lambda tag, grp: judge[tag])
                for k in np.flatnonzero(block.weights.any(0)):
                    off = block.y[:, None] - intercept[:, k] - block.times(beta[:, :, k].T)
                    total[k] += block.weights[:, k] @ (off * off)
                    weight[k] += block.weights[:, k].sum()
        for k in np.flatnonzero(weight):
            yield pd.DataFrame({"k": k, "j": np.arange(n_alphas), "e": total[k], "w": weight[k]})

    found = design.blocks.mapInPandas(run, "k long, j long, e double, w double").groupBy("k", "j").agg((F.sum("e") / F.sum("w")).alias("e")).toArrow()
    sent.destroy()
    out = np.full((n_alphas, n_systems), np.nan)
    out[found.column("j").to_numpy(), found.column("k").to_numpy()] = found.column("e").to_numpy()
    return out


def tag_weights(table: np.ndarray) -> Weigh:
    """Weights by tag: ``table`` has tags by systems."""
    held = np.asarray(table, float)
    return lambda tag, grp: held[tag]


@dataclass
class Choice:
    """The penalty with the least mean error over folds, all errors, and whether the best
    lies at an edge of the grid, so that a better one may lie beyond."""

    alpha: float
    errors: dict[float, float]
    at_edge: bool


def choose(alphas: list[float], by_fold: np.ndarray, rmse: bool = False) -> Choice:
    """From mean square errors (penalties, folds); folds without rows do not count."""
    mean = np.nanmean(np.sqrt(by_fold) if rmse else by_fold, axis=1)
    found = dict(zip(map(float, alphas), mean.tolist(), strict=True))
    best = min(found, key=lambda a: (found[a], a))
    return Choice(best, found, best in (min(found), max(found)))


def cross_validate(design: Packed, n_folds: int, alphas: list[float], mu: np.ndarray | None = None, rmse: bool = False) -> Choice:
    """The penalty by folds, which are the design's tags: all folds' and penalties' fits in
    one run, then all their errors in one pass."""
    own = np.eye(n_folds)
    beta, intercept = fits(design, tag_weights(1 - own), n_folds, alphas, mu)
    return choose(alphas, errors(design, own, beta, intercept), rmse)


def poisson_weights(first: int, n: int, seed: int) -> Weigh:
    """How often each of ``n`` draws from ``first`` on takes a group, by a hash of group and
    draw: independent Poisson numbers of mean 1, which need no list of groups."""
    draws = np.arange(first, first + n, dtype=np.uint64)

    def mixed(x: np.ndarray) -> np.ndarray:
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        return x

    with np.errstate(over="ignore"):
        salt = mixed((draws + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def counts(groups: np.ndarray) -> np.ndarray:
        out, step = np.empty((len(groups), n)), max(1, CELLS // n)
        for lo in range(0, len(groups), step):
            x = mixed(groups[lo : lo + step, None] ^ salt[None, :])
            # Sixteen bits tell most counts, all of them the others.
            some = _LEADING[(x >> np.uint64(48)).view(np.int64)]
            row, col = np.divmod(np.flatnonzero(some == 255), n)
            some[row, col] = _drawn(x[row, col] >> np.uint64(11))
            out[lo : lo + step] = some
        return out

    def weigh(tag: np.ndarray, grp: np.ndarray) -> np.ndarray:
        groups, at = np.unique(grp, return_inverse=True)
        with np.errstate(over="ignore"):
            return counts(groups.view(np.uint64))[at] if 2 * len(groups) < len(grp) else counts(grp.view(np.uint64))

    return weigh


def poisson_bootstrap(design: Packed, alpha: float, n_draws: int = 200, seed: int = 42) -> np.ndarray:
    """Coefficients (draws, columns) of refits on groups drawn with replacement, several
    draws a pass. The driver holds draws times columns numbers."""
    out, together = np.zeros((n_draws, design.n_cols)), max(1, NUMBERS // max(1, design.n_cols))
    for first in range(0, n_draws, together):
        n = min(together, n_draws - first)
        beta, _ = fits(design, poisson_weights(first, n, seed), n, [alpha])
        out[first : first + n] = beta[0].T
    return out


def intervals(draws: np.ndarray, percent: float = 95.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, standard error) of each column over the draws."""
    tail = (100 - percent) / 2
    low, high = np.percentile(draws, [tail, 100 - tail], axis=0)
    return low, high, draws.std(axis=0, ddof=1)


def gradient(triplets: DataFrame, rows: DataFrame, coefs: DataFrame, intercept: float, alpha: float) -> DataFrame:
    """(col, gradient): half the derivative of the ridge's sum by each coefficient, over the
    root of the column's summed squares; 0 everywhere at the solution, and nowhere else.
    ``coefs`` has (col, beta, mu). Joins and sums alone: a check of any solver."""
    cells = triplets.groupBy("row_id", "col").agg(F.sum("value").alias("value"))
    fitted = cells.join(coefs.select("col", "beta"), "col").groupBy("row_id").agg(F.sum(F.col("value") * F.col("beta")).alias("f"))
    off = rows.join(fitted, "row_id", "left").select("row_id", "w", (F.col("w") * (F.col("y") - intercept - F.coalesce("f", F.lit(0.0)))).alias("off"))
    own = cells.join(off, "row_id").groupBy("col").agg(F.sum(F.col("value") * F.col("off")).alias("s"), F.sum(F.col("value") ** 2 * F.col("w")).alias("d"))
    both = coefs.join(own, "col", "left").na.fill(0.0, ["s", "d"])
    return both.select("col", ((alpha * (F.col("beta") - F.col("mu")) - F.col("s")) / F.greatest(F.sqrt("d"), F.lit(1.0))).alias("gradient"))
