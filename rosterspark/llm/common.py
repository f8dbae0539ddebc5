"""Shared helpers; tables that a query writes for itself are in ``rosterspark.sources.scratch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.sources.scratch import materialise, new_path, shared_dir

__all__ = ["materialise", "new_path", "shared_dir"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, body):
    """Bind ``value`` once for ``body``, a Column function.

    Catalyst may copy a projected expression into each lambda that uses it and
    then compute it again for every element; a one-element array binds it once.
    """
    return F.transform(F.array(value), body)[0]


def unused(columns: list[str]) -> str:
    """A prefix that no column has, for columns beside those of an input."""
    return next(k for k in (f"_b{i}_" for i in range(len(columns) + 1)) if not any(c.lower().startswith(k) for c in columns))


def lower_ascii(col):
    """Lower-case A-Z and leave every other letter as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, upper, upper.lower())).otherwise(F.lower(col))


def held_out(doc_id):
    """True for the rows whose labels may never be learnt from."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4) == 2
