"""Mixing sources to target weights by hash thresholds, without sorting documents.

A document's key is a hash of its id and text. Words are summed by source and by the key's
leading bits; the running sums of these histograms say in which bucket of a source a word
budget is reached. All lower buckets are in and all higher ones are out; only the rows of
the boundary bucket are looked at again, by the key's next bits, until one key is left. A
filter on the key then takes the documents. Thresholds are nested: what a smaller budget
takes, a larger one takes too, and a budget above a source's size takes every document once
before it takes any twice.

Documents are joined with their source's decision by source and leading bits, so that a
source with a third of all rows is dealt out over as many keys as any other.

Cases: a null text has no words and is never short of them; a null source is a source of
its own, after all others; rows that repeat an id and a text share one key and are taken
alike; the document at the boundary is taken if that brings its source nearer to the
target; an empty table gives an empty table; other columns of the input pass through
``mixed_documents`` unchanged, those of the decision are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import materialise, unused

#: Weights of the sources in order, share of all words to take, and how often a word may be taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of a key, and how many of them a histogram tells apart.
KEY_BITS, STEP = 60, 12
BUCKETS = 1 << STEP


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_key(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of id and text."""
    said = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, KEY_BITS // 4), 16, 10).cast("long")


def leading(key: str, level: int = 0) -> Column:
    return F.shiftright(key, KEY_BITS - STEP * (level + 1)) % BUCKETS


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size): ``share`` of all words by
    weight, where no source gives more than ``most`` times its size and the excess goes to
    the others by weight.

    In the order of size by weight, a source is at its limit if the level that is left
    for it and those after it is not below that limit; the others share the highest such
    level. One row for each source is in the windows.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn % len(weights)))
    whole, before = Window.partitionBy(), Window.orderBy("limit", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("limit", float(most) * F.col("source_size") / F.col("weight"))
    spent = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(most)
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * share - spent) / left)
    s = s.withColumn("full", F.col("limit") <= F.col("level"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    target = F.when(F.col("full"), F.col("source_size") * float(most)).otherwise(shared * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _by_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _edges(histogram: DataFrame, need: DataFrame) -> DataFrame:
    """The bucket of each source in which its words reach ``rest``, ``before`` of them coming earlier."""
    both = histogram.join(need, _by_source(histogram, need)).drop(need["source"])
    earlier = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("before", F.col("before") + F.coalesce(earlier, F.lit(0)))
    return both.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, bucket, source_size, target, passes, limit) of written rows (source, size,
    key): each document of a source is taken ``passes`` times, and once more if its key is
    ``limit`` at most."""

    def histogram(rows: DataFrame, level: int) -> DataFrame:
        counts = rows.groupBy("source", leading("key", level).alias("bucket"))
        return counts.agg(F.sum("size").alias("words"), F.min("key").alias("low"), F.max("key").alias("high"))

    first = materialise(histogram(sized, 0), "mix-histogram")
    sizes = first.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    passes = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    targets = materialise(targets.withColumn("passes", passes), "mix-targets")
    need = targets.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("before")).where("rest > 0")

    rows, counted, limits = sized, first, None
    for level in range(KEY_BITS // STEP):
        edges = materialise(_edges(counted, need), f"mix-edge-{level}")  # a row for each source at most
        nearer = F.col("before") + F.col("words") - F.col("rest") <= F.col("rest") - F.col("before")
        known = edges.where("low = high").select("source", (F.col("low") - F.when(nearer, 0).otherwise(1)).alias("limit"))
        limits = known if limits is None else limits.unionByName(known)
        open_ = edges.where("low < high")
        if not open_.take(1):
            break
        at = rows.withColumn("bucket", leading("key", level))
        at = at.join(open_.select("source", "bucket"), _by_source(at, open_) & (at["bucket"] == open_["bucket"]), "left_semi")
        rows = materialise(at.select("source", "size", "key"), f"mix-rows-{level}")
        counted, need = histogram(rows, level + 1), open_.select("source", "rest", "before")

    decided = targets.join(limits, _by_source(targets, limits), "left").drop(limits["source"])
    places = first.select("source", "bucket").join(decided, _by_source(first, decided)).drop(decided["source"])
    return places.withColumn("limit", F.coalesce("limit", F.lit(-1).cast("long")))


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key) of every document, written: texts are read once."""
    text = F.col("text")
    return materialise(docs.select("doc_id", "source", n_words(text).alias("size"), document_key(F.col("doc_id"), text).alias("key")), "mix-sizes")


def _with_decision(rows: DataFrame, size: str, key: str, found: DataFrame, free: str) -> DataFrame:
    """``rows`` with what ``found`` says of each, how often it is taken and with how many
    words, in columns that begin with ``free``."""
    found = found.select(*[F.col(c).alias(free + c) for c in found.columns])
    both = rows.join(found, rows["source"].eqNullSafe(F.col(f"{free}source")) & (leading(key) == F.col(f"{free}bucket")))
    times = F.col(f"{free}passes") + (F.col(key) <= F.col(f"{free}limit")).cast("long")
    return both.withColumn(f"{free}times", times).withColumn(f"{free}taken", times * F.col(size))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, times, taken) of every document."""
    sized = sized_documents(docs)
    out = _with_decision(sized, "size", "key", thresholds(sized, weights, share, most), "its_")
    return out.select("doc_id", "size", *[F.col(f"its_{c}").alias(c) for c in ("source_size", "target", "times", "taken")])


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    free = unused(docs.columns)
    rows = docs.withColumn(f"{free}own", n_words(docs["text"])).withColumn(f"{free}key", document_key(docs["doc_id"], docs["text"]))
    out = _with_decision(rows, f"{free}own", f"{free}key", thresholds(sized_documents(docs), weights, share, most), free)
    copies = F.sequence(F.lit(1).cast("long"), F.col(f"{free}times"))
    return out.where(F.col(f"{free}times") > 0).withColumn(f"{free}copy", F.explode(copies)).select(*docs.columns)
