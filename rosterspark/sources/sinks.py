"""Writers: partitions that are spliced, appended once, or checked for completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.operators.relational import GuardError, missing_keys, require_none


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that ``df`` holds and leaves all others: idempotent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], by: list[str], overwrite: bool = False) -> DataFrame:
    """Writes the keys that ``path`` does not hold yet, or all with ``overwrite``; returns what was new."""
    spark = df.sparkSession
    if overwrite:
        overwrite_partitions(df, path, by)
        return df
    try:
        present = spark.read.parquet(path).select(*keys).distinct()
    except Exception as absent:
        if "PATH_NOT_FOUND" not in str(absent) and "UNABLE_TO_INFER_SCHEMA" not in str(absent):
            raise
        present = df.select(*keys).limit(0)
    new = df.join(present, keys, "left_anti")
    new.write.mode("append").partitionBy(*by).parquet(path)
    return new


def completeness(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys are expected, how many are missing, and whether all are there."""
    wanted = expected.select(*keys).distinct().agg(F.count("*").alias("expected"))
    gone = missing_keys(expected, present, keys).agg(F.count("*").alias("missing"))
    return wanted.crossJoin(gone).withColumn("complete", F.col("missing") == 0)  # single rows


def publish(df: DataFrame, path: str, columns: list[str], least_rows: int = 1) -> None:
    """Parquet and CSV twins, after a check of columns and size."""
    if absent := [c for c in columns if c not in df.columns]:
        raise GuardError(f"absent columns: {absent}")
    if len(df.take(least_rows)) < least_rows:
        raise GuardError(f"fewer than {least_rows} rows")
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.select(*columns).write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def overwrite_window(df: DataFrame, path: str, by: list[str], known: list[tuple]) -> None:
    """Replaces all partitions of a window, so that none of a group that is no longer
    ``known`` stays behind; rows of an unknown group are an error."""
    allowed = df.sparkSession.createDataFrame(known, df.select(*by).schema)
    require_none(df.select(*by).join(F.broadcast(allowed), by, "left_anti"), "group that is not known")
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def write_design(triplets: DataFrame, rows: DataFrame, index: DataFrame, path: str) -> None:
    """A design as three Parquet tables: what is not zero, the rows, the columns' players."""
    for name, part in (("triplets", triplets), ("rows", rows), ("index", index)):
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def read_design(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("triplets", "rows", "index"))
