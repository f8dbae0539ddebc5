"""Sparse designs and weighted ridge ratings.

A design is long: (row_id, col, value) triplets beside a table of rows (row_id, y,
w, group). One fit of any width is ``fit``; many at once, for folds, penalties and bootstrap
draws, are in ``krylov``. The products of columns can be had as a table (``products``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.operators import krylov
from rosterspark.operators.relational import require_none

# The penalties that cross-validation tries, 31.6 to 31,623 in sixteen steps of like ratio.
ALPHAS = tuple(float(a) for a in np.logspace(1.5, 4.5, 16))
# The penalties for fits that shrink to a prior.
SHRUNK_ALPHAS = (1.0, 3.16, 10.0, 31.6, 100.0, 316.0, 1000.0, 3162.0, 10000.0)
#: Points for a hundred possessions.
PER = 100.0


def player_index(df: DataFrame, arrays: list[str]) -> DataFrame:
    """(player, col): columns from 0 in the order of the ids."""
    ids = None
    for a in arrays:
        own = df.select(F.explode(a).alias("player"))
        ids = own if ids is None else ids.unionByName(own)
    ids = ids.where(F.col("player").isNotNull()).distinct()
    # As many rows as players: a column each, of whose sums the driver holds a vector in any fit.
    return ids.withColumn("col", (F.row_number().over(Window.orderBy("player")) - 1).cast("int"))


def require_index(index: DataFrame, n: int) -> DataFrame:
    """An index must hold each player once, and its columns must be 0 to ``n`` - 1."""
    require_none(index.groupBy("player").count().where("count > 1"), "player twice in the index")
    seen = index.agg(F.countDistinct("col").alias("d"), F.count("*").alias("n"), F.min("col").alias("lo"), F.max("col").alias("hi"))
    require_none(seen.where(f"n <> {n} OR d <> {n} OR (n > 0 AND (lo <> 0 OR hi <> {n - 1}))"), "columns are no permutation")
    return index


def two_sided_rows(df: DataFrame, key: str, home: str, away: str, group: str, prefix: str = "") -> DataFrame:
    """(row_id, side, y, w, group, offence, defence): each stint as the home team's attack
    (side 0) and the away team's (side 1); y is points per hundred possessions, w the
    possessions. A side without points or without possessions has no row."""
    sides = [F.struct(F.lit(k).alias("side"), F.col(f"{s}_pts").alias("pts"), F.col(f"{s}_poss").cast("double").alias("w"), F.col(off).alias("offence"), F.col(de).alias("defence")) for k, (s, off, de) in enumerate((("home", home, away), ("away", away, home)))]
    long = df.select(F.col(key).alias("stint"), F.col(group).alias("group"), F.explode(F.array(*sides)).alias("x")).select("stint", "group", "x.*")
    long = long.where(F.col("pts").isNotNull() & (F.col("w") > 0))
    return long.select(F.struct("stint", "side").alias("row_id"), "side", (PER * F.col("pts") / F.col("w")).alias("y"), "w", "group", "offence", "defence")


def two_sided_design(rows: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(row_id, col, value): the attacking five in the first ``n`` columns, the defending
    five in the next; a player counts once a row and side, unknown ones not at all."""
    sides = F.array(*[F.struct(F.lit(base).alias("base"), F.array_distinct(F.coalesce(side, F.array().cast("array<string>"))).alias("five")) for base, side in ((0, F.col("offence")), (n, F.col("defence")))])
    long = rows.select("row_id", F.explode(sides).alias("s")).select("row_id", "s.base", F.explode("s.five").alias("player"))
    # A row for each column, of which any fit holds vectors.
    return long.join(F.broadcast(index), "player").select("row_id", (F.col("col") + F.col("base")).alias("col"), F.lit(1.0).alias("value"))


def column_support(triplets: DataFrame, rows: DataFrame) -> DataFrame:
    """The weight behind each column."""
    return triplets.join(rows.select("row_id", "w"), "row_id").groupBy("col").agg(F.sum(F.col("value") * F.col("w")).alias("support"), F.count("*").alias("n_rows"))


def products(triplets: DataFrame, rows: DataFrame, n_cols: int, fold: str | None = None) -> DataFrame:
    """(fold, i, j, g), i <= j: the weighted products of all columns in one pass. Column
    ``n_cols`` is the constant 1 and column ``n_cols`` + 1 is y, so that sums are products too."""
    rows = rows.select("row_id", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))
    # Rows have few entries each (ten for two lineups of five), so pairs stay few.
    cells = triplets.groupBy("row_id", "col").agg(F.sum("value").alias("value")).groupBy("row_id").agg(F.collect_list(F.struct(F.col("col").cast("int").alias("c"), F.col("value").cast("double").alias("v"))).alias("cells"))
    own = F.array(F.struct(F.lit(n_cols).alias("c"), F.lit(1.0).alias("v")), F.struct(F.lit(n_cols + 1).alias("c"), F.col("y").alias("v")))
    kind = "array<struct<c:int,v:double>>"
    x = rows.join(cells, "row_id", "left").select("fold", "w", F.array_sort(F.concat(F.coalesce(F.col("cells"), F.array()).cast(kind), own.cast(kind))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, k: F.transform(F.slice("x", k + 1, F.size("x")), lambda b: F.struct(a["c"].alias("i"), b["c"].alias("j"), (a["v"] * b["v"]).alias("p")))))
    return x.select("fold", "w", F.explode(pairs).alias("e")).groupBy("fold", "e.i", "e.j").agg(F.sum(F.col("w") * F.col("e.p")).alias("g"))


def fit(triplets: DataFrame, rows: DataFrame, n_cols: int, alpha: float, mu: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """beta and intercept of min sum w (y - b0 - x beta)^2 + alpha |beta - mu|^2, by conjugate
    gradients at every width: the driver holds vectors of ``n_cols`` numbers alone."""
    beta, b0 = krylov.fits(krylov.pack(triplets, rows, n_cols), krylov.tag_weights(np.ones((1, 1))), 1, [alpha], mu)
    return beta[0, :, 0], float(b0[0, 0])


def balanced_folds(sizes: dict, n_folds: int = 5) -> dict:
    """Groups to folds: the largest group first, each to the lightest fold."""
    load, out = [0] * n_folds, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        k = load.index(min(load))
        out[g], load[k] = k, load[k] + sizes[g]
    return out


def fold_order(sizes: dict[int, int], n_folds: int = 5) -> list[tuple[int, list[int], list[int]]]:
    """Of each size of a group, which fold its groups go to in turn: a beginning, and what
    follows in cycles. ``sizes`` says how many groups have a size; the largest come first,
    each to the lightest fold."""
    load, out = [0] * n_folds, []
    for size in sorted(sizes, reverse=True):
        start: list[int] = []
        while len(start) < sizes[size] and max(load) - min(load) > size:
            k = load.index(min(load))
            start.append(k)
            load[k] += size
        cycle = sorted(range(n_folds), key=lambda k: (load[k], k))
        rounds, rest = divmod(sizes[size] - len(start), n_folds)
        for at, k in enumerate(cycle):
            load[k] += size * (rounds + (at < rest))
        out.append((size, start, cycle))
    return out


def assign_folds(rows: DataFrame, group: str, n_folds: int = 5, parts: int = 256) -> DataFrame:
    """``rows`` with a fold for each group, the largest group first and each to the lightest
    fold. The driver sees how many groups have a size; groups of one size are numbered by
    hash parts, behind the counts of the parts before, and take folds in turn."""
    groups = rows.groupBy(group).agg(F.count("*").alias("_size")).withColumn("_part", F.pmod(F.xxhash64(group), F.lit(parts)).cast("int"))
    counts = groups.groupBy("_size", "_part").agg(F.count("*").alias("_n"))
    sizes = {r[0]: r[1] for r in counts.groupBy("_size").agg(F.sum("_n")).collect()}  # a row for each size
    spark = rows.sparkSession
    order = spark.createDataFrame(fold_order(sizes, n_folds), "_size long, _start array<int>, _cycle array<int>")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).drop("_n")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_size", "_part").orderBy(group)) - 1
    later = (place - F.size("_start")) % n_folds
    fold = F.when(place < F.size("_start"), F.get("_start", place.cast("int"))).otherwise(F.get("_cycle", later.cast("int")))
    # Both have few rows, by size; without the hints all groups of one size meet in one task.
    table = groups.join(F.broadcast(counts), ["_size", "_part"]).join(F.broadcast(order), "_size").select(F.col(group).alias("_group"), fold.alias("fold"))
    return rows.join(table, rows[group].eqNullSafe(table["_group"])).drop("_group")


def leaderboard(spark, index: DataFrame, beta: np.ndarray) -> DataFrame:
    """(player, offence, defence, total): a good defence has a negative coefficient."""
    n = len(beta) // 2
    coefs = spark.createDataFrame([(i, float(beta[i]), -float(beta[n + i]), float(beta[i] - beta[n + i])) for i in range(n)], "col int, offence double, defence double, total double")
    return index.join(F.broadcast(coefs), "col").drop("col")


def calibrate_signs(beta: np.ndarray, offence: np.ndarray, defence: np.ndarray) -> tuple[int, int]:
    """Whether a probe fit's blocks rise or fall with known ratings; 1 where unclear."""

    def sign(a: np.ndarray, b: np.ndarray) -> int:
        if len(a) < 10 or a.std() == 0 or b.std() == 0:
            return 1
        return 1 if np.corrcoef(a, b)[0, 1] >= 0 else -1

    n = len(beta) // 2
    return sign(beta[:n], offence), sign(beta[n:], defence)
