"""Readers for per-game shards: Parquet whose types drift, and CSV of strings."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterspark.operators.relational import union_by_name
from rosterspark.sources.scratch import materialise

#: Where Spark keeps its own types in a footer.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def read_shards(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """All Parquet files below ``root``. Directory names are not read as columns: a
    ``season=`` directory would silently replace a data column ``Season``."""
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", False)
    return (reader.schema(schema) if schema else reader).parquet(root)


def _layout(source) -> str | None:
    """The columns and types in a footer, of which only the file's end is read; null without one."""
    try:
        schema = pq.read_schema(source)
    except (pa.ArrowException, OSError):
        return None
    return str((schema.remove_metadata(), (schema.metadata or {}).get(SPARK_SCHEMA)))


def _by_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Footers of files in a store that Arrow opens; ``opened`` is false in any other."""
    for b in batches:
        found, opened = [], []
        for path in b["path"]:
            try:
                store, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with store.open_input_file(name) as source:
                    found.append(_layout(source))
                opened.append(True)
            except (pa.ArrowException, OSError):
                found.append(None)
                opened.append(False)
        yield pd.DataFrame({"path": b["path"], "layout": found, "opened": opened})


def _by_content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"path": b["path"], "layout": [_layout(BytesIO(c)) for c in b["content"]], "opened": True})


def shard_layouts(spark: SparkSession, root: str, by_range: bool = True) -> DataFrame:
    """(path, layout) of the Parquet files below ``root``: the columns and types of their
    footers, null without a readable one; written. Tasks read the ends of the files alone.
    Files in a store that only Spark opens are read whole instead, as they are without
    ``by_range``; each must then fit in a task. A file of no bytes is no shard: no scan of
    Spark's lists it."""
    kind = "path string, layout string, opened boolean"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    if not by_range:
        return materialise(listed.select("path", "content").mapInPandas(_by_content, kind).drop("opened"), "layouts")
    found = materialise(listed.select("path").mapInPandas(_by_range, kind), "footers")
    if found.where("NOT opened").isEmpty():
        return found.drop("opened")
    closed = found.where("NOT opened").select("path")
    rest = listed.select("path", "content").join(closed, "path", "left_semi").mapInPandas(_by_content, kind)
    return materialise(found.where("opened").unionByName(rest).drop("opened"), "layouts")


def _shards_by_layout(spark: SparkSession, root: str) -> tuple[list[DataFrame], list[str]]:
    """A frame of each layout below ``root``, and the files without a readable footer.

    The driver sees the distinct layouts; paths come to it only where there are several,
    as Spark's own list of the files to read, and those of unreadable files.
    """
    layouts = shard_layouts(spark, root)
    kinds = layouts.groupBy("layout").agg(F.min("path").alias("path")).orderBy("path").collect()
    if len(kinds) == 1 and kinds[0]["layout"] is not None:
        return [spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)], []
    frames, unread = [], []
    for k in kinds:
        own = [r["path"] for r in layouts.where(F.col("layout").eqNullSafe(F.lit(k["layout"]))).select("path").orderBy("path").collect()]
        if k["layout"] is None:
            unread = own
        else:
            frames.append(spark.read.parquet(*own))
    return frames, unread


def read_drifting(spark: SparkSession, root: str, as_strings: tuple[str, ...] = ()) -> DataFrame:
    """Shards whose columns come and go or change type, as one frame.

    Shards are grouped by the schema of their footers and each group is read once;
    drifting columns and ``as_strings`` become strings, absent ones null. A shard
    that can't be read is an error.
    """
    frames, unread = _shards_by_layout(spark, root)
    if unread:
        raise OSError(f"no readable footer: {unread[:5]}")
    if not frames:
        raise FileNotFoundError(f"no Parquet files below {root}")
    frames = [f.withColumns({c: F.col(c).cast("string") for c in as_strings if c in f.columns}) if as_strings else f for f in frames]
    return union_by_name(frames)


def read_tolerant(spark: SparkSession, root: str, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """The named columns as strings, and the shards that were left out: those without a
    readable footer. Shards are read by their own types, so that none is lost to a schema
    that is not its own; columns that a shard lacks are null."""
    frames, unread = _shards_by_layout(spark, root)
    wanted = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    out = spark.createDataFrame([], wanted)
    for shards in frames:
        out = out.unionByName(shards.select(*[F.col(c).cast("string").alias(c) if c in shards.columns else F.lit(None).cast("string").alias(c) for c in columns]))
    return out, unread


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header and ``#`` comment lines, all strings: ids such as 001720 keep their zeros."""
    return spark.read.option("header", True).option("comment", "#").option("inferSchema", False).csv(path)


def path_value(key: str) -> Column:
    """The value of ``key=value`` in the path of a row's file, or null."""
    return F.nullif(F.regexp_extract(F.col("_metadata.file_path"), rf"(?:^|/){key}=([^/]*)", 1), F.lit(""))


def shard_counts(spark: SparkSession, root: str) -> DataFrame:
    """(path, n) of the shards below ``root``; no data column is read."""
    shards = read_shards(spark, root)
    return shards.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def schema_drift(a: DataFrame, b: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """Columns whose type differs between two frames: (name, type in a, type in b)."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return [(n, x.get(n), y.get(n)) for n in sorted(x.keys() | y.keys()) if x.get(n) != y.get(n)]
