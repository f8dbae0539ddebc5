"""Relational operators: modal and latest values, shares, guards, splices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.operators.selection import quantiles
from rosterspark.sources.scratch import materialise


class GuardError(ValueError):
    """An invariant of the data does not hold."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if absent := [n for n in names if n not in df.columns]:
        raise GuardError(f"absent columns: {absent}")
    return df


def require_none(bad: DataFrame, what: str) -> None:
    """Raises with one example if ``bad`` has any row."""
    if found := bad.take(1):
        raise GuardError(f"{what}, e.g. {found[0].asDict()}")


def require_share(df: DataFrame, good: Column, by: list[str], least: float) -> DataFrame:
    """Share of good rows by group; raises if a group has less than ``least``."""
    shares = df.groupBy(*by).agg(F.avg(good.cast("double")).alias("share"), F.count("*").alias("n"))
    require_none(shares.where(F.col("share") < least), f"share of good rows under {least}")
    return shares


def modal_value(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value of each group; of equals the smallest."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    rank = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return counts.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def latest_value(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Rows without a value count with no weight; null where no weight is left."""
    kept = value.isNotNull()
    return F.try_divide(F.sum(F.when(kept, value * weight)), F.sum(F.when(kept, weight)))


def share_of_group(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Counts by ``by`` and their share of the counts of ``within``."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def pivot_counts(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of each value, 0 where there are none; the values are given, not looked up."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def z_score(df: DataFrame, value: str, by: list[str], name: str = "z") -> DataFrame:
    """``df`` with each value less its group's mean over its sample deviation. Groups are
    summed first and their few rows meet the table, so that no group is one task."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    stats = stats.withColumnsRenamed({c: f"_by_{c}" for c in by})
    joined = df.join(stats, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]))
    return joined.withColumn(name, F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd", *[f"_by_{c}" for c in by])


def missing_keys(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def splice(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the groups that ``new`` holds replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


# Numeric types from narrow to wide, each holding those before it.
WIDER = ("tinyint", "smallint", "int", "bigint", "float", "double")


def common_type(kinds: set[str]) -> str:
    """The type that a column with these types takes: the widest of numbers, else string."""
    known = kinds - {"void"}
    if len(known) == 1:
        return next(iter(known))
    if known and known <= set(WIDER):
        return "double" if known & {"float", "double"} else max(known, key=WIDER.index)
    return "string"


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null. Numbers of drifting types take the
    widest, any other drift becomes strings."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    wanted = {n: common_type(k) for n, k in kinds.items() if len(k) > 1 or k == {"void"}}
    frames = [f.withColumns({n: F.col(n).cast(wanted[n]) for n in f.columns if n in wanted}) if wanted.keys() & set(f.columns) else f for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def nearest_quantile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The value at rank round(q (n - 1)) of each group, an element, not an interpolation."""
    return quantiles(df, by, value, [q], between=False).drop("fraction")


def sample_groups(df: DataFrame, by: list[str], order: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each group, the same ones at every run: those with the least hashes of
    ``order`` and the seed."""
    said = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order], F.lit(str(seed)))
    rank = Window.partitionBy(*by).orderBy(F.md5(said), *order)
    return df.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= n).drop("_r")


def consecutive(df: DataFrame, by: list[str], year: str) -> DataFrame:
    """Whether the years of a group have no gap."""
    return df.groupBy(*by).agg((F.max(year) - F.min(year) + 1 == F.countDistinct(year)).alias("contiguous"), F.countDistinct(year).alias("n_years"))


def one_id_per_key(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Keys with more than one id; an identity map must have none."""
    return df.groupBy(*keys).agg(F.countDistinct(ident).alias("n_ids"), F.array_sort(F.collect_set(ident)).alias("ids")).where("n_ids > 1")


def triage_collisions(per_id: DataFrame, name: str = "name", ident: str = "id", norm: str = "id_norm") -> DataFrame:
    """Verdict for each name that has several ids, from its ids' seasons and teams.

    MERGE_FORMAT if the ids differ in form only, MERGE_DISJOINT if no two share a
    season, REVIEW_OVERLAP_SAMETEAM if two share one and two share a team, else
    KEEP_SEPARATE_HOMONYM.

    No pairs are made: an index of (name, season) and (name, team) says how many ids each
    entry holds, and two ids share one where it holds two.
    """
    ids = per_id.select(F.col(name).alias("_name"), F.col(ident).alias("_id"), F.col(norm).alias("_norm"), "seasons", "teams")
    shared = None
    for kind, of in (("overlap", "seasons"), ("same_team", "teams")):
        entries = ids.select("_name", F.explode(F.array_distinct(of)).alias("_entry")).where(F.col("_entry").isNotNull())
        own = entries.groupBy("_name", "_entry").agg(F.count("*").alias("_n")).groupBy("_name").agg((F.max("_n") > 1).alias(kind))
        shared = own if shared is None else shared.join(own, "_name", "full")
    names = ids.groupBy("_name").agg(F.count("*").alias("n_ids"), F.countDistinct("_norm").alias("n_norms")).where("n_ids > 1")
    label = F.when(F.col("n_norms") == 1, "MERGE_FORMAT").when(~F.coalesce("overlap", F.lit(False)), "MERGE_DISJOINT").when(F.coalesce("same_team", F.lit(False)), "REVIEW_OVERLAP_SAMETEAM")
    return names.join(shared, "_name", "left").select(F.col("_name").alias(name), "n_ids", label.otherwise("KEEP_SEPARATE_HOMONYM").alias("verdict"))


def merge_proposal(per_id: DataFrame, verdicts: DataFrame, name: str = "name", ident: str = "id", rows: str = "n_rows") -> DataFrame:
    """(name, from_id, to_id): of mergeable ids the one with the most rows wins, of equals
    the least id."""
    mergeable = per_id.join(verdicts.where(F.col("verdict").startswith("MERGE")), name, "left_semi").select(name, F.col(ident).alias("from_id"), F.col(rows).alias("_n"))
    most = mergeable.groupBy(name).agg(F.min(F.struct((-F.col("_n")).alias("n"), "from_id")).alias("_best")).select(name, F.col("_best.from_id").alias("to_id"))
    return mergeable.join(most, name).where("from_id <> to_id").select(name, "from_id", "to_id")


def rewrite_ids(df: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """Ids that ``merges`` (from_id, to_id) names are rewritten, others pass."""
    joined = df.join(merges.select(F.col("from_id").alias("_from"), "to_id"), F.col(column) == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("to_id", column)).drop("_from", "to_id")


def count_distinct_tuples(*cols: str) -> Column:
    """Distinct tuples, those with nulls among them."""
    return F.count_distinct(F.struct(*cols))


def row_index(df: DataFrame, order: str, name: str = "row", parts: int = 64) -> DataFrame:
    """``df`` with rows numbered from 0 in the order of a numeric column without ties.

    Ranges of ``order`` are numbered apart, behind the counts of those before, so that no
    task holds all rows.
    """
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts))).collect()[0][0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy("_b").agg(F.count("*").alias("n"))  # ``parts`` rows at most
    before = sizes.select(F.col("_b").alias("_k"), F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return df.join(F.broadcast(before), F.col("_b") == F.col("_k")).withColumn(name, F.col("_before") + within).drop("_b", "_k", "_before")


def joined_once(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], report_by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Left join by keys with names of their own on both sides, of which the right ones go,
    and what it missed: (report_by, n, n_met) of the left rows.

    The right side must hold each key once, so that no left row comes twice; keys with a
    null meet nothing, and do not count.
    """
    again = right.where(reduce(lambda a, b: a & b, [F.col(r).isNotNull() for _, r in keys])).groupBy(*[r for _, r in keys]).count().where("count > 1")
    require_none(again, "key twice on the right side")
    marked = right.withColumn("_met", F.lit(True))
    both = left.join(marked, reduce(lambda a, b: a & b, [left[x] == marked[y] for x, y in keys]), "left").drop(*[marked[y] for _, y in keys])
    report = both.groupBy(*report_by).agg(F.count("*").alias("n"), F.count("_met").alias("n_met"))
    return both.drop("_met"), report


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its rows numbered from 1 in an order without ties. Sorted ranges are
    written with their own numbers and counted; the counts of the ranges before, of which
    there are as many as partitions, are added. No task holds more than a range."""
    parts = materialise(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.join(F.broadcast(counts), part == F.col("_part")).select(*[parts[c] for c in df.columns], place.alias(name))


def head_and_tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first and the last ``n`` rows, with ``end`` saying which."""
    first = df.orderBy(*order).limit(n).withColumn("end", F.lit("head"))
    return first.unionByName(df.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("end", F.lit("tail")))


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def linear_quantile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The quantile of each group, between its neighbours in proportion."""
    return quantiles(df, by, value, [q]).drop("fraction")


def find_columns(df: DataFrame, hints: list[str]) -> list[str]:
    """The columns whose names hold any of the hints, in any case."""
    return [c for c in df.columns if any(h.lower() in c.lower() for h in hints)]
