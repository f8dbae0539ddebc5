"""Exact order statistics by repeated range narrowing.

A value's key is a whole number in the order of the values. Values are counted by the
leading bits of their keys; the running counts of a group say in which range each wanted
rank lies, and only the values of those ranges are counted again by the next bits, until a
range holds one value. So no task holds a group or a column, ties need no care, and after
four rounds every rank is known; most are after two.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterspark.sources.scratch import materialise

#: Bits of a key, and how many of them a round tells apart.
KEY_BITS, STEP = 64, 16


@F.pandas_udf(T.LongType())
def _float_key(v: pd.Series) -> pd.Series:
    """The bits of a double as a whole number in the same order; both zeros are one, and
    numbers that are none come last."""
    x = v.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


def order_key(df: DataFrame, value: str) -> Column:
    """A whole number for each value that is not null, in the order of the values."""
    kind = df.schema[value].dataType.typeName()
    return F.col(value).cast("long") if kind in ("byte", "short", "integer", "long") else _float_key(F.col(value).cast("double"))


def _on(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(by, wanted, value): the value at each wanted rank of each group. ``ranks`` has (by,
    wanted, rank), where ``wanted`` names a rank, from 0 within its group; nulls have none.

    What is written between rounds has a row for each range that holds a wanted rank.
    """
    spare = "_k" if "_k" not in by else "_k2"
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), order_key(df, value).alias(spare))
    open_ = materialise(ranks.groupBy(*by).agg(F.collect_list(F.struct("wanted", F.col("rank").cast("long").alias("rank"))).alias("ranks")), "ranks")
    at: list[str] = []
    found = []
    for level in range(KEY_BITS // STEP):
        part = f"_p{level}"
        # The sign stands in the first part: shifting keeps it.
        cut = F.shiftright(spare, KEY_BITS - STEP * (level + 1))
        held = by + at
        met = rows.join(open_.select(*held), _on(rows, open_, held), "left_semi") if held else rows
        counts = met.groupBy(*held, cut.alias(part)).agg(F.count("*").alias("n"), F.min(spare).alias("low"), F.max(spare).alias("high"), F.min("_v").alias("v"))
        so_far = Window.partitionBy(*held).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
        wanted = open_.select(*[F.col(c).alias(f"_o{c}") for c in held], "ranks")
        both = counts.join(wanted, reduce(lambda x, y: x & y, [counts[c].eqNullSafe(wanted[f"_o{c}"]) for c in held])) if held else counts.crossJoin(F.broadcast(wanted))  # a single row of ranks
        inside = F.transform(F.filter("ranks", lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("n"))), lambda r: F.struct(r["wanted"].alias("wanted"), (r["rank"] - F.col("before")).alias("rank")))
        both = materialise(both.withColumn("ranks", inside).where(F.size("ranks") > 0).select(*held, part, "low", "high", "v", "ranks"), "ranges")
        found.append(both.where("low = high").select(*by, F.explode("ranks.wanted").alias("wanted"), F.col("v").alias("value")))
        open_ = both.where("low < high").select(*held, part, "ranks")
        if not open_.take(1):
            break
        at.append(part)
        rows = rows.withColumn(part, cut)
    return reduce(DataFrame.unionByName, found)


def quantiles(df: DataFrame, by: list[str], value: str, fractions: list[float], between: bool = True) -> DataFrame:
    """(by, fraction, quantile): of each group the values at the given fractions of its
    rows, in proportion between their neighbours, or else the nearest row's (halves go
    up). A group whose values are all null has none."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 0")
    sizes = materialise(sizes, "group-sizes")
    each = sizes.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    place = F.col("fraction") * (F.col("_n") - 1)
    if not between:
        ranks = each.select(*by, F.col("fraction").alias("wanted"), F.round(place).cast("long").alias("rank"))
        return order_statistics(df, by, value, ranks).select(*by, F.col("wanted").alias("fraction"), F.col("value").alias("quantile"))
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("end"), f(place).cast("long").alias("rank")) for k, f in ((0, F.floor), (1, F.ceil))])).alias("e")
    ranks = each.select(*by, "fraction", ends).select(*by, F.struct("fraction", "e.end").alias("wanted"), "e.rank")
    got = order_statistics(df, by, value, ranks).select(*by, "wanted.fraction", "wanted.end", F.col("value").cast("double").alias("value"))
    ends_of = got.groupBy(*by, "fraction").agg(F.max(F.when(F.col("end") == 0, F.col("value"))).alias("_low"), F.max(F.when(F.col("end") == 1, F.col("value"))).alias("_high"))
    both = ends_of.join(sizes, _on(ends_of, sizes, by)).select(*[ends_of[c] for c in by], "fraction", "_low", "_high", "_n") if by else ends_of.crossJoin(F.broadcast(sizes))  # a single row
    share = place - F.floor(place)
    # Equal neighbours are the quantile itself, infinite ones too.
    mid = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + share * (F.col("_high") - F.col("_low")))
    return both.select(*by, "fraction", mid.alias("quantile"))
