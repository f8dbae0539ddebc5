"""K-means for many numbers of clusters and starts, all in one pass an iteration.

Vectors are packed into blocks once. Each task holds its blocks against the centres of all
models that still move by one matrix product, adds rows up by another, and hands on counts
and sums of each centre; Spark adds them up, and the driver moves the centres. Starts
spread over a bounded sample of the table (k-means++), which only decides where a model
begins; every iteration reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.sources.scratch import materialise

#: Rows from which starts are drawn at most, and iterations.
SAMPLE, STEPS = 4096, 300
#: Rows that are held against all centres at once, whose distances stay in a core's cache,
#: centres whose sums travel together, and how far short numbers may be off, by dimension.
BLOCK, PART, ROUNDING = 512, 64, 2.0**-23


@dataclass
class Model:
    k: int
    start: int
    centres: np.ndarray
    cost: float = float("inf")
    moving: bool = True


def _spread(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows of the sample, each drawn by its squared distance to those before."""
    picked = [int(rng.integers(len(sample)))]
    far = ((sample - sample[picked[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        total = far.sum()
        picked.append(int(rng.choice(len(sample), p=far / total)) if total > 0 else int(rng.integers(len(sample))))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked].copy()


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _add(x: np.ndarray, weights: np.ndarray, spans: list[tuple[int, int, int]], total: np.ndarray) -> None:
    """Adds the rows of ``x`` to ``total``: for each centre the sum and the number of its
    rows, then, at each model's first centre, the squared distances of all rows. Weights are
    minus two times the centres, then their squares; a span (at, k, size) is ``size`` models
    of ``k`` centres, so laid that the least of ``k`` is taken over whole rows of numbers.
    Products of short numbers tell the nearest centre where it is nearer by more than they can
    be off; the others' distances are taken in full. Sums are those of the rows themselves."""
    p, square = np.column_stack([x, np.ones(len(x))]), (x * x).sum(1)
    # Of a size that short numbers hold; a power of two changes no digit.
    largest = max(np.abs(x).max(initial=0), np.sqrt(weights[:, -1].max(initial=0)))
    unit = float(np.ldexp(1.0, min(400, -int(np.frexp(largest)[1])))) if 0 < largest < np.inf else 1.0
    short = (weights * np.append(np.full(x.shape[1], unit), unit * unit)).astype(np.float32)
    far = short @ np.column_stack([x * unit, np.ones(len(x))]).astype(np.float32).T  # less the row's own square, which all centres share
    row_size, centre_size = (np.sqrt(z.max(initial=0)) * unit for z in (square, weights[:, -1]))
    room = np.float32(ROUNDING * (x.shape[1] + 8) * (2 * row_size + centre_size) * centre_size + 1e-30)
    mine = np.empty(far.shape)
    for at, k, size in spans:
        own, hit = (m[at : at + k * size].reshape(k, size, -1) for m in (far, mine))
        near = own <= own.min(0) + room
        hit[:] = near
        if np.count_nonzero(near) != size * len(x):
            model, row = np.divmod(np.flatnonzero(near.sum(0, dtype=np.uint16) != 1), len(x))
            centres = weights[at : at + k * size].reshape(k, size, -1)[:, model]
            nearest = (centres * p[row]).sum(2).argmin(0)  # of equally near centres the first
            hit[:, model, row] = nearest == np.arange(k)[:, None]
    sums = mine @ p
    total[:, :-1] += sums
    shares = (weights * sums).sum(1)
    for at, k, size in spans:
        total[at : at + size, -1] += np.maximum(shares[at : at + k * size].reshape(k, size).sum(0) + square.sum(), 0)


def fit(df: DataFrame, ident: str, vector: str, ks: list[int], starts: int = 25, seed: int = 42, steps: int = STEPS) -> dict[int, Model]:
    """The cheapest model of each number of clusters; of equals the first start. A cluster
    that loses its rows keeps its centre. Null vectors are left out."""
    rows = materialise(df.where(F.col(vector).isNotNull()).select(ident, F.col(vector).cast("array<double>").alias("v")), "vectors")
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64(ident, F.lit(seed)), ident).limit(SAMPLE).collect()])
    if not len(sample):
        return {}
    dims = sample.shape[1]
    models = [Model(k, s, _spread(sample, k, np.random.default_rng([seed, k, s]))) for k in ks for s in range(starts)]
    spark = rows.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            if (np.diff(v.offsets) != dims).any():
                raise ValueError(f"vectors of other lengths than {dims}")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for lo in range(0, len(x), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([x[lo : lo + BLOCK].tobytes()])], ["x"])

    blocks = materialise(rows.select("v").mapInArrow(pack, "x binary"), "vector-blocks")

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        return pa.table({"at": [key[0].as_py()], "sums": [sum(np.frombuffer(x.as_buffer()) for x in parts.column("sums")).tobytes()]})

    for _ in range(steps):
        groups = [g for k in dict.fromkeys(ks) if (g := [m for m in models if m.k == k and m.moving])]
        if not groups:
            break
        # First centres of all models of one number, then second ones, and so on.
        centres = np.vstack([c for g in groups for c in np.stack([m.centres for m in g], 1)])
        edges = np.cumsum([0, *[g[0].k * len(g) for g in groups]]).tolist()
        spans = [(lo, g[0].k, len(g)) for lo, g in zip(edges, groups, strict=False)]
        sent = spark.sparkContext.broadcast((np.column_stack([-2 * centres, (centres * centres).sum(1)]), spans))  # starts times clusters times dimensions

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(sent.value[0]), dims + 2))
            for b in batches:
                for x in b.column("x"):
                    _add(np.frombuffer(x.as_buffer()).reshape(-1, dims), *sent.value, total)
            at = [lo for lo in range(0, len(total), PART) if total[lo : lo + PART].any()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[lo : lo + PART].tobytes() for lo in at], pa.binary())], ["at", "sums"])

        total = np.zeros((len(centres), dims + 2))
        for r in blocks.mapInArrow(run, "at long, sums binary").groupBy("at").applyInArrow(add, "at long, sums binary").collect():  # a row for each centre, by PART
            total[r["at"] : r["at"] + PART] = np.frombuffer(r["sums"]).reshape(-1, dims + 2)
        sent.destroy()
        for g, (lo, k, size) in zip(groups, spans, strict=True):
            for i, m in enumerate(g):
                own = total[lo + i : lo + k * size : size]
                n = own[:, dims, None]
                moved = np.where(n > 0, own[:, :dims] / np.maximum(n, 1), m.centres)
                m.cost = float(own[0, -1])
                m.moving = not np.allclose(moved, m.centres, rtol=1e-9, atol=1e-12)
                m.centres = moved
    return {k: min((m for m in models if m.k == k), key=lambda m: (round(m.cost, 9), m.start)) for k in ks}


def assign(df: DataFrame, ident: str, vector: str, models: dict[int, Model]) -> DataFrame:
    """(ident, k, cluster) of every vector that is not null, by the nearest centre; clusters
    are numbered by their centres' first coordinates."""
    ordered = {k: m.centres[np.lexsort(m.centres.T[::-1])] for k, m in models.items()}
    sent = df.sparkSession.sparkContext.broadcast(ordered)
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["v"].to_list(), float)
                for k, c in sent.value.items():
                    yield pd.DataFrame({ident: b[ident], "k": k, "cluster": _distances(x, c).argmin(1)})

    rows = df.where(F.col(vector).isNotNull()).select(ident, F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, f"`{ident}` {kind}, k int, cluster int")


def adjusted_rand(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, adjusted_rand) of two labelings, from their contingency tables."""

    def pairs(n):
        return n * (n - 1) / 2

    cells = df.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("n"))
    both = cells.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    for side in ("_a", "_b"):
        own = cells.groupBy(*by, side).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(pairs(F.col("m"))).alias(f"s{side}"))
        both = both.join(own, by)
    expected = F.try_divide(F.col("s_a") * F.col("s_b"), pairs(F.col("n")))
    return both.select(*by, F.try_divide(F.col("s") - expected, (F.col("s_a") + F.col("s_b")) / 2 - expected).alias("adjusted_rand"))


def agreement(first: DataFrame, second: DataFrame, ident: str, vector: str, ks: list[int], starts: int = 25, seed: int = 42) -> DataFrame:
    """(k, n, adjusted_rand): for each number of clusters how alike two tables cluster the
    ids that both hold."""
    shared = first.select(ident).intersect(second.select(ident))
    labels = []
    for df in (first, second):
        own = materialise(df.join(shared, ident, "left_semi").select(ident, vector), "shared-vectors")
        labels.append(assign(own, ident, vector, fit(own, ident, vector, ks, starts, seed)))
    both = labels[0].withColumnRenamed("cluster", "a").join(labels[1].withColumnRenamed("cluster", "b"), [ident, "k"])
    return both.groupBy("k").agg(F.count("*").alias("n")).join(adjusted_rand(both, ["k"], "a", "b"), "k")
