"""Whether two large tables hold the same rows, by digests that come in any order.

A row's hash says which chunk it is in. A chunk's digest is its count and the sums of parts
of two hashes, so tasks add them up and only digests are shuffled. Chunks whose digests
differ are cut finer by other bits of the hash; rows are compared, and moved, only where
the finest digests differ. Equal tables move no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks at each level.
CHUNKS = 4096


def _hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with two hashes of each row; a struct tells nulls of different columns apart."""
    row = F.struct(*[F.coalesce(F.col(c).isNull(), F.lit(True)) for c in columns])
    return df.select(*columns, F.xxhash64(*columns, row, F.lit(0)).alias("_h"), F.xxhash64(row, *columns, F.lit(1)).alias("_g"))


def chunk_digests(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, digest): sums of 33 bits stay whole for a thousand million rows a chunk."""
    parts = [F.sum(F.shiftrightunsigned(h, 33)) for h in ("_h", "_g")] + [F.sum(F.col(h).bitwiseAND(F.lit((1 << 33) - 1))) for h in ("_h", "_g")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.struct(*[p.alias(f"s{k}") for k, p in enumerate(parts)]).alias("digest"))


def _differing(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    x, y = chunk_digests(a, by), chunk_digests(b, by)
    both = x.unionByName(y).groupBy(*by).agg(F.count("*").alias("sides"), F.min(F.struct("n", "digest")).alias("low"), F.max(F.struct("n", "digest")).alias("high"))
    return both.where((F.col("sides") < 2) | (F.col("low") != F.col("high"))).select(*by)


def differing_rows(a: DataFrame, b: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """(columns, n_a, n_b): rows that two frames hold unequally often. ``b`` may have the
    columns in another order, and types that ``a``'s hold."""
    columns = a.columns
    x = _hashed(a, columns)
    y = _hashed(b.select(*[F.col(c).cast(a.schema[c].dataType).alias(c) for c in columns]), columns)
    first, second = F.pmod("_h", F.lit(chunks)).cast("int"), F.pmod(F.floor(F.col("_h") / chunks), F.lit(chunks)).cast("int")
    x, y = (f.withColumn("_c", first).withColumn("_d", second) for f in (x, y))
    at = [r[0] for r in _differing(x, y, ["_c"]).collect()]  # ``chunks`` numbers at most
    x, y = (f.where(F.col("_c").isin(at) if at else F.lit(False)) for f in (x, y))
    found = _differing(x, y, ["_c", "_d"])
    x, y = (f.join(found, ["_c", "_d"], "left_semi") for f in (x, y))
    counts = x.select(*columns, F.lit(1).alias("_s")).unionByName(y.select(*columns, F.lit(2).alias("_s")))
    counts = counts.groupBy(*columns).agg(F.count_if(F.col("_s") == 1).alias("n_a"), F.count_if(F.col("_s") == 2).alias("n_b"))
    return counts.where("n_a <> n_b")


def same(a: DataFrame, b: DataFrame, chunks: int = CHUNKS) -> bool:
    """Whether two frames hold the same rows equally often; no row is moved."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    x = _hashed(a, a.columns)
    y = _hashed(b.select(*[F.col(c).cast(a.schema[c].dataType).alias(c) for c in a.columns]), a.columns)
    chunk = F.pmod("_h", F.lit(chunks)).cast("int").alias("_c")
    return not _differing(x.withColumn("_c", chunk), y.withColumn("_c", chunk), ["_c"]).take(1)
