"""Ridge fits whose vectors stay in tasks: the driver sees a few numbers of each system a step.

The same systems, penalties and recurrences as in ``krylov.fits``. Columns fall into chunks, a
row each of a table of vectors, and the design's blocks into parts that stay where they lie.
A step sends each chunk to the parts that hold its columns, multiplies there, and sums what
comes back by chunk. Steps and slopes need inner products alone, and these are what the driver
gets. Residuals of all steps are kept in the job's folder: from them all penalties' solutions
follow chunk by chunk, after the last step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.operators import krylov
from rosterspark.operators.krylov import Block, Packed, Weigh
from rosterspark.sources.scratch import materialise

#: Columns and numbers of a chunk at most, and numbers that a part holds for the draws solved together.
COLUMNS, CHUNK, PART = 1024, 1 << 15, 1 << 24
STATE = "chunk int, asks array<int>, xw binary, left binary, lead binary, moved binary, at int, dots binary"
# Inner products of a step, by system.
DOTS = ("left_left", "left_moved", "moved_moved", "lead_moved", "xw_left", "xw_moved", "xw_lead")


def _total(df: DataFrame, column: str = "dots") -> np.ndarray:
    """The sum of a column's numbers over all rows, from one row of each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for x in b[column]:
                total = np.frombuffer(x) + (0.0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({column: [total.tobytes()]})

    found = df.select(column).mapInPandas(run, f"{column} binary").collect()  # systems times a few, a row for each task
    return sum(np.frombuffer(r[0]) for r in found)


@dataclass
class Spread:
    """A design's blocks by part, for systems of one weighing."""

    design: Packed
    weigh: Weigh
    n_systems: int
    columns: int = 0
    blocks: DataFrame = field(init=False)
    base: DataFrame = field(init=False)

    def __post_init__(self):
        self.columns = self.columns or max(1, min(COLUMNS, CHUNK // self.n_systems))
        parts = sorted(r[0] for r in self.design.blocks.select("part").distinct().collect())  # a few for each core
        # Parts go to tasks by hash: by numbers whose hashes differ, one to each.
        spark, n_parts = self.design.spark, max(1, len(parts))
        by_place = spark.range(64 * n_parts).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n_parts))).agg(F.min("id").alias("id"))
        numbers = sorted(r["id"] for r in by_place.collect())
        numbers += [64 * n_parts + k for k in range(len(parts) - len(numbers))]
        named = spark.createDataFrame(list(zip(parts, numbers, strict=False)), "part int, number int")
        blocks = self.design.blocks.join(F.broadcast(named), "part").withColumn("part", F.col("number")).drop("number")
        self.blocks = blocks.repartition(n_parts, "part").sortWithinPartitions("part").persist(StorageLevel.DISK_ONLY)
        self.blocks.count()
        self.base = self._moments()
        sums = _total(self.base.where("chunk = -1"), "xy")
        self.sw, self.sy = sums.reshape(2, self.n_systems)
        self.base = self.base.where("chunk >= 0")

    @property
    def n_chunks(self) -> int:
        return -(-self.design.n_cols // self.columns)

    def close(self) -> None:
        self.blocks.unpersist()

    def _moments(self) -> DataFrame:
        """(chunk, asks, xw, xy): sums by column and system and the parts that hold entries;
        chunk -1 has the weights and the weighted sums of whole systems in place of xy."""
        weigh, size, n = self.weigh, self.columns, self.n_systems

        def run(b: pd.DataFrame) -> pd.DataFrame:
            blocks, chunks = _opened(b, weigh, size)
            xw, xy, whole = np.zeros((len(chunks) * size, n)), np.zeros((len(chunks) * size, n)), np.zeros((2, n))
            for block in blocks():
                wy = block.weights * block.y[:, None]
                block.add_to(xw, block.weights)
                block.add_to(xy, wy)
                whole += np.array([block.weights.sum(0), wy.sum(0)])
            rows = [(int(c), int(b["part"].iloc[0]), xw[k * size : (k + 1) * size].tobytes(), xy[k * size : (k + 1) * size].tobytes()) for k, c in enumerate(chunks)]
            return pd.DataFrame([*rows, (-1, -1, whole.tobytes(), whole.tobytes())], columns=["chunk", "part", "xw", "xy"])

        def add(b: pd.DataFrame) -> pd.DataFrame:
            own = b[b["xw"].notna()]
            zero = np.zeros((2 if b["chunk"].iloc[0] < 0 else size, n)).tobytes()
            xw, xy = (sum(map(np.frombuffer, own[c])).tobytes() if len(own) else zero for c in ("xw", "xy"))
            return pd.DataFrame([{"chunk": b["chunk"].iloc[0], "asks": sorted(own["part"].astype(int)), "xw": xw, "xy": xy}])

        parts = self.blocks.groupBy("part").applyInPandas(run, "chunk int, part int, xw binary, xy binary")
        # Every chunk has a row, with or without entries, and so have the sums.
        spark = self.design.spark
        every = spark.range(-1, self.n_chunks).select(F.col("id").cast("int").alias("chunk"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("xw"), F.lit(None).cast("binary").alias("xy"))
        found = parts.unionByName(every).groupBy("chunk").applyInPandas(add, "chunk int, asks array<int>, xw binary, xy binary")
        return materialise(found, "moments")

    def _asked(self, vectors: DataFrame) -> DataFrame:
        return vectors.select(F.explode("asks").alias("part"), "chunk", "v")

    def _products(self, vectors: DataFrame) -> DataFrame:
        """(chunk, v): each part's transposed weighted design times the design times
        ``vectors`` (chunk, asks, v)."""
        weigh, size, n = self.weigh, self.columns, self.n_systems

        def run(b: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(b) or not len(held):
                return pd.DataFrame({"chunk": [], "v": []})
            blocks, chunks = _opened(b, weigh, size)
            vector, total = _joined(held, chunks, (size, n)), np.zeros((len(chunks) * size, n))
            for block in blocks():
                block.add_to(total, block.weights * block.times(vector))
            return pd.DataFrame({"chunk": chunks, "v": [total[k * size : (k + 1) * size].tobytes() for k in range(len(chunks))]})

        return self.blocks.groupBy("part").cogroup(self._asked(vectors).groupBy("part")).applyInPandas(run, "chunk int, v binary")

    def step(self, state: DataFrame, at: int, step: np.ndarray, slope: np.ndarray, middle: np.ndarray, alpha: float) -> DataFrame:
        """The state after moving by ``step`` and turning by ``slope``: the new residuals and
        leads, the leads' products, and their inner products. ``middle`` are the leads' means."""
        n = self.n_systems

        def moved_on(row) -> tuple[np.ndarray, np.ndarray]:
            left = np.frombuffer(row.left).reshape(-1, n) - step * np.frombuffer(row.moved).reshape(-1, n)
            return left, left + slope * np.frombuffer(row.lead).reshape(-1, n)

        def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"chunk": b["chunk"], "asks": b["asks"], "v": [moved_on(r)[1].tobytes() for r in b.itertuples()]})

        def close(s: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            row = next(s.itertuples())
            left, lead = moved_on(row)
            out = sum(map(np.frombuffer, found["v"])).reshape(-1, n) if len(found) else np.zeros_like(left)
            xw = np.frombuffer(row.xw).reshape(-1, n)
            moved = out + alpha * lead - xw * middle
            dots = np.array([(a * b).sum(0) for a, b in ((left, left), (left, moved), (moved, moved), (lead, moved), (xw, left), (xw, moved), (xw, lead))])
            return pd.DataFrame([{"chunk": row.chunk, "asks": row.asks, "xw": row.xw, "left": left.tobytes(), "lead": lead.tobytes(), "moved": moved.tobytes(), "at": at, "dots": dots.tobytes()}])

        products = self._products(state.select("chunk", "asks", "left", "lead", "moved").mapInPandas(lead, "chunk int, asks array<int>, v binary"))
        return materialise(state.groupBy("chunk").cogroup(products.groupBy("chunk")).applyInPandas(close, STATE), "step")

    def start(self, mu: np.ndarray | None, of: np.ndarray | None) -> DataFrame:
        """The first residuals. ``mu`` has priors by column, ``of`` says which is a system's."""
        n, size, mean = self.n_systems, self.columns, self.mean
        prior = None if mu is None else self.design.spark.sparkContext.broadcast(mu)  # columns times kinds of priors

        def priors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(v=[_prior(prior.value, of, c, size).tobytes() for c in b["chunk"]])[["chunk", "asks", "v", "xw"]]

        base = self.base
        if mu is None:
            base = base.withColumn("out", F.lit(None).cast("binary"))
            middle = np.zeros(n)
        else:
            own = base.mapInPandas(priors, "chunk int, asks array<int>, v binary, xw binary")

            def dots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield pd.DataFrame({"dots": [(np.frombuffer(r.xw) * np.frombuffer(r.v)).reshape(-1, n).sum(0).tobytes() for r in b.itertuples()]})

            middle = self.by_weight(_total(own.mapInPandas(dots, "dots binary")))
            products = self._products(own.select("chunk", "asks", "v"))

            def add(b: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
                return b.assign(out=[sum(map(np.frombuffer, found["v"])).tobytes() if len(found) else None])

            base = base.groupBy("chunk").cogroup(products.groupBy("chunk")).applyInPandas(add, "chunk int, asks array<int>, xw binary, xy binary, out binary")

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for r in b.itertuples():
                    xw = np.frombuffer(r.xw).reshape(-1, n)
                    left = np.frombuffer(r.xy).reshape(-1, n) - xw * mean + xw * middle
                    if r.out is not None:
                        left = left - np.frombuffer(r.out).reshape(-1, n)
                    zero = np.zeros_like(left)
                    dots = np.array([(left * left).sum(0), *[np.zeros(n)] * 3, (xw * left).sum(0), *[np.zeros(n)] * 2])
                    rows.append({"chunk": r.chunk, "asks": r.asks, "xw": r.xw, "left": left.tobytes(), "lead": zero.tobytes(), "moved": zero.tobytes(), "at": 0, "dots": dots.tobytes()})
                yield pd.DataFrame(rows)

        found = materialise(base.mapInPandas(first, STATE), "step")
        if prior is not None:
            prior.unpersist()
        return found

    def by_weight(self, x: np.ndarray) -> np.ndarray:
        return np.divide(x, self.sw, out=np.zeros_like(self.sw), where=self.sw > 0)

    @property
    def mean(self) -> np.ndarray:
        return self.by_weight(self.sy)

    def size_after(self, state: DataFrame, step: np.ndarray) -> np.ndarray:
        """The squared length of the residuals after ``step``, from the residuals themselves."""
        n = self.n_systems

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"dots": [((np.frombuffer(r.left).reshape(-1, n) - step * np.frombuffer(r.moved).reshape(-1, n)) ** 2).sum(0).tobytes() for r in b.itertuples()]})

        return _total(state.select("left", "moved").mapInPandas(run, "dots binary"))


def _opened(b: pd.DataFrame, weigh: Weigh, size: int) -> tuple[Callable[[], Iterator[Block]], np.ndarray]:
    """A part's blocks, whose columns are places in its chunks in turn, and these chunks."""
    chunks = np.unique(np.concatenate([np.unique(np.frombuffer(x, np.int32) // size) for x in b["cols"]]))
    place = np.zeros(chunks[-1] + 1 if len(chunks) else 1, np.int64)
    place[chunks] = np.arange(len(chunks))

    def blocks() -> Iterator[Block]:
        for row in b.itertuples():
            block = Block(row, weigh)
            block.cols = place[block.cols // size] * size + block.cols % size
            yield block

    return blocks, chunks


def _joined(held: pd.DataFrame, chunks: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    by_chunk = dict(zip(held["chunk"], held["v"], strict=True))
    return np.concatenate([np.frombuffer(by_chunk[c]).reshape(shape) for c in chunks]) if len(chunks) else np.zeros((0, shape[1]))


def _prior(mu: np.ndarray, of: np.ndarray, chunk: int, size: int) -> np.ndarray:
    own = mu[chunk * size : (chunk + 1) * size][:, of]
    return np.pad(own, ((0, size - len(own)), (0, 0)))


@dataclass
class Solved:
    """Solutions by chunk: ``table`` has (chunk, asks, x), where x are penalties times columns
    times systems; intercepts by penalty and system are on the driver."""

    spread: Spread
    table: DataFrame
    alphas: list[float]
    intercept: np.ndarray

    def _slices(self, j: int, k: int | None = None) -> DataFrame:
        """(chunk, asks, v): one penalty's solutions, of all systems or of one."""
        shape = (len(self.alphas), self.spread.columns, self.spread.n_systems)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                cut = (np.frombuffer(x).reshape(shape)[j] for x in b["x"])
                yield pd.DataFrame({"chunk": b["chunk"], "asks": b["asks"], "v": [(x if k is None else x[:, k]).tobytes() for x in cut]})

        return self.table.mapInPandas(run, "chunk int, asks array<int>, v binary")

    def beta(self, j: int, k: int | None = None) -> np.ndarray:
        """One penalty's coefficients, by column and system or of one system: sent to the driver."""
        n = self.spread.n_systems if k is None else 1
        out = np.zeros((self.spread.n_chunks, self.spread.columns, n))
        for r in self._slices(j, k).select("chunk", "v").collect():  # columns times the systems asked for
            out[r["chunk"]] = np.frombuffer(r["v"]).reshape(-1, n)
        out = out.reshape(-1, n)[: self.spread.design.n_cols]
        return out if k is None else out[:, 0]

    def errors(self, judge: np.ndarray) -> np.ndarray:
        """As ``krylov.errors``, a penalty at a time: a part holds its columns of all systems."""
        s, out = self.spread, np.full(self.intercept.shape, np.nan)
        for j, intercept in enumerate(self.intercept):
            both = s.blocks.groupBy("part").cogroup(s._asked(self._slices(j)).groupBy("part"))
            total, weight = _total(both.applyInPandas(_judging(judge, intercept, s.columns), "dots binary")).reshape(2, -1)
            out[j] = np.divide(total, weight, out=np.full(s.n_systems, np.nan), where=weight > 0)
        return out


def _judging(judge: np.ndarray, intercept: np.ndarray, size: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A part's weighted square errors and weights, by system, of one penalty."""
    n = len(intercept)

    def run(b: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        total, weight = np.zeros(n), np.zeros(n)
        if len(b):
            blocks, chunks = _opened(b, lambda tag, grp: judge[tag], size)
            vector = _joined(held, chunks, (size, n))
            for block in blocks():
                for k in np.flatnonzero(block.weights.any(0)):
                    off = block.y - intercept[k] - block.times(vector[:, [k]])[:, 0]
                    total[k] += block.weights[:, k] @ (off * off)
                    weight[k] += block.weights[:, k].sum()
        return pd.DataFrame({"dots": [np.concatenate([total, weight]).tobytes()]})

    return run


def solve(spread: Spread, alphas: list[float], mu: np.ndarray | None = None, of: np.ndarray | None = None, tolerance: float = 1e-12, steps: int = 5000) -> Solved:
    """``krylov.fits`` with the vectors in tasks. ``mu`` has (columns, kinds of priors) and
    ``of`` each system's kind."""
    n, shift, least = spread.n_systems, np.array(alphas) - min(alphas), min(alphas)
    state = spread.start(mu, of)
    first = dict(zip(DOTS, _total(state).reshape(len(DOTS), n), strict=True))
    size, goal = first["left_left"], tolerance**2 * first["left_left"]
    ratio = before = np.ones((len(alphas), n))
    step, slope, turn, go = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    middle = spread.by_weight(first["xw_left"])
    history, moves = [], []
    for at in range(1, steps + 1):
        on = size > goal
        if not on.any():
            break
        state = spread.step(state, at, go, turn, middle, least)
        history.append(state.select("chunk", "at", "left"))
        d = dict(zip(DOTS, _total(state).reshape(len(DOTS), n), strict=True))
        size, bend = d["left_left"], d["lead_moved"]
        last, step = step, np.divide(size, bend, out=np.zeros(n), where=on & (bend > 0))
        under = last * before * (1 + step * shift[:, None]) + step * slope * (before - ratio)
        following = np.where(on, np.divide(ratio * before * last, under, out=np.zeros_like(ratio), where=under != 0), ratio)
        change = np.divide(following, ratio, out=np.zeros_like(ratio), where=ratio != 0)
        grown = size - 2 * step * d["left_moved"] + step * step * d["moved_moved"]
        if (on & (grown < 1e-8 * size)).any():  # too little is left of the sums
            grown = spread.size_after(state, step)
        slope = np.where(on, np.divide(grown, size, out=np.zeros(n), where=size > 0), 0.0)
        moves.append((step * change, following, slope * change**2))
        go, turn = step, slope
        middle = spread.by_weight(d["xw_left"] - step * d["xw_moved"] + slope * d["xw_lead"])
        before, ratio, size = ratio, following, np.where(on, grown, size)
        step = np.where(on, step, 1.0)
    else:
        raise ArithmeticError(f"no solution within {steps} steps")
    return _replayed(spread, alphas, history, moves, mu, of)


def _replayed(spread: Spread, alphas: list[float], history: list[DataFrame], moves: list, mu: np.ndarray | None, of: np.ndarray | None) -> Solved:
    """All penalties' solutions from the residuals of all steps, chunk by chunk."""
    n, size, spark = spread.n_systems, spread.columns, spread.design.spark
    sent = spark.sparkContext.broadcast((moves, mu))  # steps times penalties times systems; priors by column

    def run(base: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        row, (moves, mu) = next(base.itertuples()), sent.value
        x, ahead = np.zeros((len(alphas), size, n)), None
        past = past.sort_values("at")
        for k, left in enumerate(past["left"]):
            left = np.frombuffer(left).reshape(size, n)
            if ahead is None:
                ahead = np.repeat(left[None], len(alphas), axis=0)
            else:
                _, following, turn = moves[k - 1]
                ahead = following[:, None, :] * left + turn[:, None, :] * ahead
            x += moves[k][0][:, None, :] * ahead
        if mu is not None:
            x += _prior(mu, of, row.chunk, size)
        return pd.DataFrame([{"chunk": row.chunk, "asks": row.asks, "x": x.tobytes(), "dots": (np.frombuffer(row.xw).reshape(size, n) * x).sum(1).tobytes()}])

    past = history[0].sparkSession.read.schema(STATE).parquet(*[p for h in history for p in h.inputFiles()]).select("chunk", "at", "left") if history else spark.createDataFrame([], "chunk int, at int, left binary")
    table = materialise(spread.base.groupBy("chunk").cogroup(past.groupBy("chunk")).applyInPandas(run, "chunk int, asks array<int>, x binary, dots binary"), "solved")
    sent.destroy()
    intercept = spread.mean - np.array([spread.by_weight(x) for x in _total(table).reshape(len(alphas), n)])
    return Solved(spread, table, list(map(float, alphas)), intercept)


def poisson_draws(design: Packed, alpha: float, n_draws: int = 200, seed: int = 42) -> DataFrame:
    """(col, draws): ``krylov.poisson_bootstrap`` as a table, a row for each column."""
    columns = max(1, min(COLUMNS, CHUNK // n_draws))
    widest = design.blocks.select("part", F.length("cols").alias("b")).groupBy("part").agg(F.sum("b")).agg(F.max("sum(b)")).first()[0] or 0
    together = max(1, min(n_draws, PART // max(1, min(design.n_cols, widest // 4))))
    found = None
    for first in range(0, n_draws, together):
        n = min(together, n_draws - first)
        spread = Spread(design, krylov.poisson_weights(first, n, seed), n, columns)
        own = solve(spread, [alpha]).table.select("chunk", "x", F.lit(first).alias("first"))
        spread.close()
        found = own if found is None else found.unionByName(own)
    n_cols = design.n_cols

    def run(b: pd.DataFrame) -> pd.DataFrame:
        x = np.hstack([np.frombuffer(v).reshape(columns, -1) for v in b.sort_values("first")["x"]])
        col = b["chunk"].iloc[0] * columns + np.arange(columns)
        return pd.DataFrame({"col": col, "draws": list(x)})[col < n_cols]

    return found.groupBy("chunk").applyInPandas(run, "col int, draws array<double>")


def draws_of(design: Packed, alpha: float, n_draws: int = 200, seed: int = 42) -> DataFrame:
    """(col, draws), by way of the driver where all draws are few numbers."""
    if design.n_cols * n_draws > krylov.HELD:
        return poisson_draws(design, alpha, n_draws, seed)
    held = krylov.poisson_bootstrap(design, alpha, n_draws, seed)
    return design.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(held.T)], "col int, draws array<double>")


def fitted(design: Packed, weigh: Weigh, n_systems: int, alphas: list[float], mu: np.ndarray | None, tolerance: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The result of ``krylov.fits``: solutions come to the driver once, not at each step."""
    prior = None if mu is None else np.reshape(mu, (design.n_cols, -1)).astype(float)
    of = None if mu is None else np.arange(n_systems) % prior.shape[1]
    spread = Spread(design, weigh, n_systems)
    found = solve(spread, alphas, prior, of, tolerance, steps)
    spread.close()
    return np.array([found.beta(j) for j in range(len(alphas))]), found.intercept


def intervals(draws: DataFrame, percent: float = 95.0) -> DataFrame:
    """``draws`` (col, draws and others) with low, high and se in place of the draws."""
    kept = [c for c in draws.columns if c != "draws"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                low, high, se = krylov.intervals(np.vstack(b["draws"].to_list()).T, percent)
                yield b[kept].assign(low=low, high=high, se=se)

    kinds = ", ".join(f"`{c}` {draws.schema[c].dataType.simpleString()}" for c in kept)
    return draws.mapInPandas(run, f"{kinds}, low double, high double, se double")
