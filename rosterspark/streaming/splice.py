"""New shards as a stream: each batch replaces the partitions that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rosterspark.sources.sinks import overwrite_partitions


def splice_stream(spark: SparkSession, source: str, schema: T.StructType, target: str, by: list[str], checkpoint: str) -> StreamingQuery:
    """Runs over the files of ``source`` that are new since the last call, then ends.

    A batch that is run again after a failure writes the same partitions again.
    """

    def write(batch: DataFrame, _: int) -> None:
        overwrite_partitions(batch, target, by)

    shards = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
    return shards.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
