"""Column functions on arrays such as lineups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_size(arr: Column) -> Column:
    """Number of different elements; nulls count as one."""
    return F.size(F.array_distinct(arr))


def is_full_lineup(arr: Column, size: int = 5) -> Column:
    return F.coalesce((F.size(arr) == size) & (distinct_size(arr) == size), F.lit(False))


def lineup_key(arr: Column) -> Column:
    """A lineup without its order: the sorted array itself, nulls last, so that no two
    lineups share a key."""
    return F.array_sort(arr)


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def remap_list(df: DataFrame, arr: str, table: DataFrame, frm: str, to: str, also: list[str] | None = None) -> DataFrame:
    """``df`` with each element of ``arr`` replaced by its value in ``table``; places stay,
    and what ``table`` lacks is a null in its place. ``also`` names columns of both, such as
    the season, that must agree too; of several values the least counts.

    All rows and columns stay: null and empty lists as they are, repeated rows as often.
    Each different list is looked up once and met again by itself, so rows need no number.
    """
    keys = also or []
    lists = df.select(*keys, F.col(arr).alias("_list")).where(F.size(arr) > 0).distinct()
    items = lists.select(*keys, "_list", F.posexplode("_list").alias("_pos", "_item"))
    known = table.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col(frm).alias("_from")).agg(F.min(to).alias("_to"))
    same = F.col("_item") == F.col("_from")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = items.join(known, same, "left").groupBy(*keys, "_list").agg(F.array_sort(F.collect_list(F.struct("_pos", "_to"))).alias("_new"))
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_list"), F.transform("_new", lambda x: x["_to"]).alias("_new"))
    met = df[arr].eqNullSafe(found["_list"])
    for k in keys:
        met = met & df[k].eqNullSafe(found[f"_{k}"])
    kind = f"array<{table.schema[to].dataType.simpleString()}>"
    new = F.when(F.size(df[arr]) > 0, F.col("_new")).when(df[arr].isNotNull(), F.array().cast(kind))
    return df.join(found, met, "left").select(*[new.alias(c) if c == arr else df[c] for c in df.columns])


def overlap_pairs(df: DataFrame, name: str, ident: str, sets: list[str]) -> DataFrame:
    """Pairs of different ids under one name, and whether their sets overlap."""
    a = df.select(F.col(name), F.col(ident).alias("id_a"), *[F.col(s).alias(f"{s}_a") for s in sets])
    b = df.select(F.col(name), F.col(ident).alias("id_b"), *[F.col(s).alias(f"{s}_b") for s in sets])
    pairs = a.join(b, name).where(F.col("id_a") < F.col("id_b"))
    return pairs.select(name, "id_a", "id_b", *[F.arrays_overlap(f"{s}_a", f"{s}_b").alias(f"same_{s}") for s in sets])


def shared_entries(df: DataFrame, name: str, ident: str, sets: list[str]) -> DataFrame:
    """(name, kind, entry, id, n_ids, first_id): the entries of the columns ``sets`` that several
    ids of a name hold, a row for each id that holds one, by an index of (name, kind, entry).

    ``n_ids`` says how many ids share the entry and ``first_id`` is the least of them, so that
    all pairs that ``overlap_pairs`` finds overlapping follow from these rows, which are as many
    as there are entries at most. Null entries are shared by nobody; an id that says an entry
    twice, or in several rows, holds it once.
    """
    held = None
    for s in sets:
        own = df.select(F.col(name), F.lit(s).alias("kind"), F.explode(s).alias("entry"), F.col(ident).alias("id"))
        own = own.withColumn("entry", F.col("entry").cast("string"))
        held = own if held is None else held.unionByName(own)
    held = held.where(F.col("entry").isNotNull() & F.col("id").isNotNull()).distinct()
    index = held.groupBy(F.col(name).alias("_name"), F.col("kind").alias("_kind"), F.col("entry").alias("_entry")).agg(F.count("*").alias("n_ids"), F.min("id").alias("first_id"))
    same = held[name].eqNullSafe(F.col("_name")) & (held["kind"] == F.col("_kind")) & (held["entry"] == F.col("_entry"))
    return held.join(index.where("n_ids > 1"), same).drop("_name", "_kind", "_entry")


def place_in_group(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Rows numbered from 0 within their group."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
