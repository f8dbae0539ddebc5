"""The corpus pipeline: five training-data operators in a row over ``documents``.

Each stage takes what its predecessor kept. The first four return the columns of
``documents``; the last one returns the pieces of the packed windows.

Cases: null and empty texts are scored like others and, where they are kept, pass line
dedup, near dedup and decontamination as they are, and are packed as their end id alone;
rows without an id are never near copies; rows that repeat an id are one document to near
dedup, which keeps or removes all of them; of equal texts the smallest id stays; an empty
table stays empty through every stage; columns beside those of ``documents`` pass through
the first four stages, but for ``n_lines`` and ``n_removed``, which line dedup replaces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rosterspark.llm import decontaminate, line_dedup, near_dedup, packing, quality
from rosterspark.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites leave the texts, but for whole copies of documents;
    ``n_chars`` follows."""
    cleaned = line_dedup.remove_spread_lines(docs, spare_copies=True)
    return line_dedup.with_length(cleaned).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest is packed into windows."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL has no quality model and no tokenizer; tests/llm hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
