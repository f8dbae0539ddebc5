"""Rows that repeat an id, or have none, are many: no single range may hold them all."""

import hashlib
import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterspark.llm import syncmers, token_store


def many_rows(spark):
    rng = random.Random(2)
    ids = [7] * 300 + [None] * 300 + list(range(200)) + [199] * 3
    rows = [(i, None if k % 97 == 0 else " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(12)))) for k, i in enumerate(ids)]
    rows += rows[:4] + [r for r in rows if r[0] is None][:4]  # repeated rows
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_next_documents_of_repeated_ids(spark):
    rows, docs = many_rows(spark)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    known = sorted(map(tuple, base.select("doc_id", "row", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for k, (i, _, text) in enumerate(known):
        half, following = len(text) // 2, known[(k + 1) % len(known)][2]
        want[i, hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()] += 1
    found = syncmers.edited_fingerprints(docs).select("doc_id", "edited_sha256")
    assert Counter(map(tuple, found.collect())) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    led = syncmers.with_next(base, {}, ["text"]).withColumn("at", F.spark_partition_id())
    held = {i: [r["n"] for r in led.where(F.col("doc_id").eqNullSafe(F.lit(i).cast(T.LongType()))).groupBy("at").agg(F.count("*").alias("n")).collect()] for i in (7, None)}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(len(n) > 1 and max(n) < 250 for n in held.values()), held


def test_store_of_repeated_ids(spark):
    rows, docs = many_rows(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = token_store.new_path(spark, "repeated")
    token_store.write_store(docs, path, tokenizer)
    found = token_store.read_store(spark, path).orderBy("start").collect()
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(rows)
    assert [r["start"] for r in found] == [sum(r["n_tokens"] for r in found[:k]) for k in range(len(found))]
    single = token_store.store_and_read(docs.where("doc_id <> 7").select((F.col("doc_id") + 1000).alias("doc_id"), "text"), tokenizer).collect()
    assert Counter((r["doc_id"] - 1000, r["n_tokens"], r["ids_crc32"]) for r in single) == Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found if r["doc_id"] not in (None, 7))
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_docs").alias("n")).collect()
    assert max(r["n"] for r in parts) < 350
