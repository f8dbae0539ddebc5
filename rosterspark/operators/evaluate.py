"""Evaluation of ratings on held-out data, from sufficient statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.operators.selection import quantiles


def rating_sum(df: DataFrame, plus: str, minus: str, ratings: DataFrame, ident: str, value: str) -> DataFrame:
    """``df`` with ``x``, the ratings of one lineup less those of the other, and
    ``coverage``, the share of places that are rated. A row without anybody in either
    lineup has 0 in both; null places are places. Each different pair of lineups is summed
    once and met again by its sorted places, as a collected list comes in another order when
    it is computed again; of several ratings of one player the least counts."""
    pairs = df.select(F.array_sort(plus).alias("_plus"), F.array_sort(minus).alias("_minus")).distinct()
    side = lambda c, sign: F.transform(F.coalesce(F.col(c), F.array().cast(pairs.schema[c].dataType)), lambda p: F.struct(p.alias("id"), F.lit(sign).alias("sign")))
    slots = pairs.select("_plus", "_minus", F.explode(F.concat(side("_plus", 1.0), side("_minus", -1.0))).alias("s")).select("_plus", "_minus", "s.*")
    known = ratings.groupBy(F.col(ident).alias("id")).agg(F.min(value).alias("v"))
    rated = slots.join(known, "id", "left").groupBy("_plus", "_minus")
    sums = rated.agg(F.sum(F.col("sign") * F.coalesce("v", F.lit(0.0))).alias("x"), F.avg(F.col("v").isNotNull().cast("double")).alias("coverage"))
    met = df.join(sums, F.array_sort(df[plus]).eqNullSafe(sums["_plus"]) & F.array_sort(df[minus]).eqNullSafe(sums["_minus"]), "left")
    return met.select(*[df[c] for c in df.columns], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x", "coverage")])


def weighted_line(df: DataFrame, x: str, y: str, w: str, by: list[str] | None = None) -> DataFrame:
    """Intercept and slope of weighted least squares; no slope for a constant x."""
    x_, y_, w_ = F.col(x), F.col(y), F.col(w)
    s = df.groupBy(*(by or [])).agg(F.sum(w_).alias("sw"), F.sum(w_ * x_).alias("sx"), F.sum(w_ * y_).alias("sy"), F.sum(w_ * x_ * x_).alias("sxx"), F.sum(w_ * x_ * y_).alias("sxy"))
    spread = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(spread > 1e-9 * F.col("sw") * F.col("sxx"), F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), spread))
    s = s.withColumn("slope", slope)
    return s.select(*(by or []), "slope", F.try_divide(F.col("sy") - F.coalesce("slope", F.lit(0.0)) * F.col("sx"), F.col("sw")).alias("intercept"))


def error_metrics(y: Column, fitted: Column, w: Column) -> list[Column]:
    """Weighted RMSE, MAE and R2."""
    mean = F.try_divide(F.sum(w * y), F.sum(w))
    residual, total = F.sum(w * (y - fitted) ** 2), F.sum(w * y * y) - mean * mean * F.sum(w)
    return [F.sqrt(F.try_divide(residual, F.sum(w))).alias("rmse"), F.try_divide(F.sum(w * F.abs(y - fitted)), F.sum(w)).alias("mae"), (1 - F.try_divide(residual, total)).alias("r2")]


def arm_score(y: Column, fitted: Column) -> list[Column]:
    """RMSE, correlation, share of right signs and R2 of one arm's predictions."""
    residual = F.sum((y - fitted) ** 2)
    return [
        F.sqrt(F.avg((y - fitted) ** 2)).alias("rmse"), F.corr(y, fitted).alias("corr"),
        F.avg((F.signum(y) == F.signum(fitted)).cast("double")).alias("sign_hit"), (1 - F.try_divide(residual, F.var_pop(y) * F.count(y))).alias("r2"),
    ]


def calibration(df: DataFrame, fitted: str, y: str, w: str, order: list[str], bins: int = 10) -> DataFrame:
    """Weighted means of prediction and outcome in bins of like size, the larger first.

    A row's rank is the number of rows in lower ranges plus its rank in its own, so
    that no task sorts more than a range of the predictions; a prediction that many
    rows share is parted by ranges of ``order[0]``, a number.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.array(*[F.lit(i / parts) for i in range(1, max(parts, 2))])
    cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at).alias(c) for c in (fitted, order[0])]).collect()[0]  # one row of at most ``parts`` numbers each
    first, second = (F.array(*[F.lit(float(x)) for x in sorted(set(cuts[c] or []))]).cast("array<double>") for c in (fitted, order[0]))
    below = F.size(F.filter(first, lambda b: b < F.col(fitted)))
    inside = F.when(F.array_contains(first, F.col(fitted).cast("double")), F.size(F.filter(second, lambda b: b < F.col(order[0]))) + 1).otherwise(0)
    # Rows below a cut come after those of the cut before it.
    df = df.withColumn("_part", F.struct((2 * below + (inside > 0).cast("int")).alias("a"), inside.alias("b")))
    counts = df.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(fitted, *order)) - 1
    df = df.withColumn("_rank", rank).join(F.broadcast(counts), "_part").withColumn("_rank", F.col("_rank") + F.col("_before"))
    size, larger = F.floor(F.col("_all") / bins), F.col("_all") % bins
    wide = larger * (size + 1)
    slot = F.when(F.col("_rank") < wide, F.floor(F.col("_rank") / (size + 1))).otherwise(larger + F.floor(F.try_divide(F.col("_rank") - wide, size)))
    return df.groupBy((slot + 1).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col(w) * F.col(fitted)), F.sum(w)).alias("mean_fitted"), F.try_divide(F.sum(F.col(w) * F.col(y)), F.sum(w)).alias("mean_y"))


def threshold_search(df: DataFrame, value: str, is_a: Column, low: float, high: float, steps: int) -> DataFrame:
    """The cut of a grid that best parts the two classes, in either direction.

    Each row falls between two cuts; counts by interval and their running sums give
    every cut's agreement, so rows are read once and never paired with the grid.
    """
    width = (high - low) / (steps - 1)
    v = F.col(value)
    slot = F.when(v < low, 0).when(v >= high, steps).otherwise((F.floor((v - low) / width) + 1).cast("int"))
    counts = df.where(v.isNotNull()).groupBy(slot.alias("slot")).agg(F.count_if(is_a).alias("a"), F.count_if(~is_a).alias("b"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("slot"))  # as many rows as the grid has
    counts = grid.join(counts, "slot", "left").na.fill(0)
    so_far, whole = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    below_a, below_b = F.sum("a").over(so_far), F.sum("b").over(so_far)
    total_a, total_b = F.sum("a").over(whole), F.sum("b").over(whole)
    first, second = below_a + (total_b - below_b), below_b + (total_a - below_a)
    cuts = counts.select("slot", first.alias("up"), second.alias("down"), (total_a + total_b).alias("n")).where(F.col("slot") < steps)
    cuts = cuts.select((F.lit(low) + F.col("slot") * width).alias("cut"), F.greatest("up", "down").alias("hits"), (F.col("up") >= F.col("down")).alias("a_below"), "n")
    best = cuts.agg(F.max_by(F.struct("cut", "a_below", "hits", "n"), F.struct("hits", -F.col("cut"))).alias("m")).select("m.*")
    return best.select("cut", (F.col("hits") / F.col("n")).alias("agreement"), "a_below")


def rule_agreement(df: DataFrame, label: str, rules: dict[str, Column]) -> DataFrame:
    """Share of rows whose stored label each rule set gives, one pass for all."""
    hits = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(label).eqNullSafe(c)).alias(k) for k, c in rules.items()])
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("hits")) for k in rules]))
    out = hits.select("n", long.alias("x")).select("x.rule", F.try_divide(F.col("x.hits"), F.col("n")).alias("agreement"))
    return out.withColumn("tied_best", F.col("agreement") == F.max("agreement").over(Window.partitionBy()))


def corner_search(df: DataFrame, x: Column, y: Column, wanted: Column, steps: int = 60) -> tuple[float, float, float]:
    """(x from, y up to, agreement) of the rule ``x >= a and y <= b`` that agrees best with
    ``wanted``, over grids of ``steps`` quantiles; of equal rules the first.

    Rows are counted once by the grid cells that they fall in; the rules are compared
    on those counts, of which there are at most 2 * (steps + 1) ** 2.
    """
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"), F.coalesce(wanted, F.lit(False)).alias("w")).where("x IS NOT NULL AND y IS NOT NULL")
    # The grids are quantiles from 50 to 99.5 and from 0.5 to 60 percent.
    fractions = [np.linspace(50, 99.5, steps) / 100, np.linspace(0.5, 60, steps) / 100]
    grids = {c: sorted(r["quantile"] for r in quantiles(rows, [], c, f.tolist()).collect()) for c, f in zip("xy", fractions, strict=True)}  # ``steps`` numbers each
    if not grids["x"]:
        return float("nan"), float("nan"), float("nan")
    reached = F.size(F.filter(F.array(*map(F.lit, grids["x"])), lambda g: g <= F.col("x")))
    passed = F.size(F.filter(F.array(*map(F.lit, grids["y"])), lambda g: g < F.col("y")))
    cells = rows.groupBy(reached.alias("i"), passed.alias("j"), "w").agg(F.count("*").alias("n")).collect()
    inside, total, right = np.zeros((2, steps + 1, steps + 1)), 0, 0
    for r in cells:
        inside[int(r["w"]), r["i"], r["j"]] += r["n"]
        total, right = total + r["n"], right + (0 if r["w"] else r["n"])
    # A row is in the rule of cell (a, b) if it reached more than a and passed at most b.
    covered = inside[:, ::-1].cumsum(1)[:, ::-1].cumsum(2)[:, 1:, :steps]
    agreement = (right - covered[0] + covered[1]) / total
    a, b = np.unravel_index(int(agreement.argmax()), agreement.shape)
    return float(grids["x"][a]), float(grids["y"][b]), float(agreement[a, b])
