"""Benchmark decontamination by winnowing.

Documents and benchmark items become sequences of words. Every ``GRAM``
consecutive words are hashed, and of each ``WINDOW - GRAM + 1`` consecutive
hashes the smallest is a fingerprint. Two texts that share ``WINDOW`` words share
one of these runs of hashes and so its smallest: joining the fingerprints finds
every shared window. For the documents that share a fingerprint the match is
then extended by comparing the words themselves, so the result is exact. Items
shorter than a window are one window of their own and are found by hashing every
run of their length; there are at most ``WINDOW - 1`` such lengths, and only
those that occur are tried. Everything is a DataFrame expression.

The hashes are of upper-cased words: words that agree once A-Z are lower-cased
agree in upper case too, as upper case needs no context. What upper case alone
makes equal falls in the comparison.

Cases: a null text, or one without words, has no words and is never
contaminated; repeated items count once per item id; repeated rows of a document
give equal rows; an empty table on either side gives no hits; other columns are
not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import let, lower_ascii, materialise

WINDOW, GRAM = 10, 5
#: Fingerprints of items that may be sent to every executor (24 bytes each, and
#: their neighbouring words); with more, both sides are shuffled.
BROADCAST_ROWS = 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_UPPER = r"[\x00-\x2F\x3A-\x40\x5B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; an empty array for a null text."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def word_hashes(text: Column) -> Column:
    """A hash of each word in upper case, in order."""
    parts = F.array_remove(F.split(F.upper(F.coalesce(text, F.lit(""))), SEPARATORS_UPPER), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _runs(hashes: Column, k: int) -> Column:
    """Hash of each run of ``k`` words, by its first position from 0."""
    at = F.sequence(F.lit(0), F.greatest(F.size(hashes) - k, F.lit(0)))
    runs = F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))
    return F.when(F.size(hashes) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def winnowed(hashes: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """The distinct fingerprints of an array of word hashes."""
    width = window - gram + 1

    def pick(runs: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(runs) - width, F.lit(0)))
        least = F.transform(at, lambda i: F.least(*[F.get(runs, i + j) for j in range(width)]))
        return F.when(F.size(runs) > 0, F.array_distinct(least)).otherwise(runs)

    return let(_runs(hashes, gram), pick)


def item_fingerprints(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(hash, item_id, ctx, back, len): each fingerprint with the words about it, how
    many of them precede it, and the length of the window that must agree."""
    bench = items.select("item_id", words_of(F.col("text")).alias("w"), word_hashes(F.col("text")).alias("h")).where(F.size("w") > 0)
    reach = window - gram
    picks = let(F.col("h"), lambda h: let(_runs(h, gram), lambda g: let(winnowed(h, window, gram), lambda m: F.filter(F.transform(g, lambda x, i: F.struct(x.alias("hash"), i.alias("q"))), lambda x: F.array_contains(m, x["hash"])))))
    long = bench.where(F.size("w") >= window).select("item_id", "w", F.explode(picks).alias("f"))
    back = F.least(F.col("f.q"), F.lit(reach))
    long = long.select(F.col("f.hash").alias("hash"), "item_id", F.slice("w", F.col("f.q") - back + 1, F.lit(2 * window)).alias("ctx"), back.cast("int").alias("back"), F.lit(window).alias("len"))
    short = bench.where(F.size("w") < window)
    parts = [long]
    for k in range(1, window):
        own = short.where(F.size("w") == k)
        parts.append(own.select(F.explode(_runs(F.col("h"), k)).alias("hash"), "item_id", F.col("w").alias("ctx"), F.lit(0).alias("back"), F.lit(k).alias("len")))
    return reduce(DataFrame.unionByName, parts)


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, row (a hash of the text), n_words, and hits (first, length, item_id), one for
    each occurrence of a window; null without any."""
    index = materialise(item_fingerprints(items, window, gram), "benchmark-fingerprints")
    by_len = {r["len"]: r["n"] for r in index.groupBy("len").agg(F.count("*").alias("n")).collect()}  # a row for each of at most WINDOW lengths
    short = sorted(k for k in by_len if k < window)
    keys = index.select("hash").distinct()
    small = sum(by_len.values()) <= BROADCAST_ROWS
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))

    def marks(h: Column) -> Column:
        prints = F.concat(winnowed(h, window, gram), *[_runs(h, k) for k in short])
        own = F.struct(F.xxhash64("doc_id", "row").alias("hash"), F.size(h).alias("n"))
        return F.concat(F.array(own), F.transform(prints, lambda x: F.struct(x.alias("hash"), F.lit(None).cast("int").alias("n"))))

    # Each row of docs says its number of words once, beside its fingerprints.
    said = docs.select("doc_id", "row", F.explode(let(word_hashes(F.col("text")), marks)).alias("f")).select("doc_id", "row", "f.hash", "f.n")
    known = keys.withColumn("known", F.lit(True))
    said = said.join(F.broadcast(known) if small else known, "hash", "left").where(F.col("n").isNotNull() | F.col("known"))
    own = said.groupBy("doc_id", "row").agg(F.max("n").alias("n_words"), F.count("n").alias("copies"), F.collect_set(F.when(F.col("n").isNull(), F.col("hash"))).alias("hashes"))
    own = materialise(own, "fingerprint-matches")
    met = own.where(F.size("hashes") > 0)
    pairs = met.select("doc_id", "row", F.explode("hashes").alias("hash")).join(F.broadcast(index) if small else index, "hash")
    pairs = pairs.groupBy("doc_id", "row").agg(F.collect_list(F.struct("hash", "item_id", "ctx", "back", "len")).alias("m"))
    keyed = pairs.select(F.col("doc_id").alias("id"), F.col("row").alias("r"), "m")
    texts = docs.join(keyed, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("row").eqNullSafe(F.col("r")))

    def windows(w: Column, p: Column, m: Column) -> Column:
        tried = F.sequence(F.lit(0), F.when(m["len"] < window, F.lit(0)).otherwise(m["back"]))
        tried = F.filter(tried, lambda b: (p >= b) & (m["back"] - b + m["len"] <= F.size(m["ctx"])))
        tried = F.filter(tried, lambda b: F.slice(w, p - b + 1, m["len"]) == F.slice(m["ctx"], m["back"] - b + 1, m["len"]))
        return F.transform(tried, lambda b: F.struct((p - b).alias("first"), m["len"].alias("length"), m["item_id"].alias("item_id")))

    def hits_for(k: int, size: int) -> Column:
        def body(w: Column, h: Column) -> Column:
            return let(
                F.filter("m", lambda m: m["len"] == size),
                lambda mine: let(
                    F.transform(mine, lambda m: m["hash"]),
                    lambda wanted: F.flatten(F.transform(
                        F.filter(F.transform(_runs(h, k), lambda x, i: F.struct(x.alias("hash"), i.alias("p"))), lambda x: F.array_contains(wanted, x["hash"])),
                        lambda x: F.flatten(F.transform(F.filter(mine, lambda m: m["hash"] == x["hash"]), lambda m: windows(w, x["p"], m))),
                    )),
                ),
            )

        return let(words_of(F.col("text")), lambda w: let(word_hashes(F.col("text")), lambda h: body(w, h)))

    hits = F.concat(hits_for(gram, window), *[hits_for(k, k) for k in short])
    found = texts.select("id", "r", F.array_distinct(hits).alias("hits")).where(F.size("hits") > 0).dropDuplicates(["id", "r"])
    own = own.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("row").eqNullSafe(F.col("r")), "left")
    own = own.select("doc_id", "row", F.col("n_words").cast("long").alias("n_words"), "hits", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return own.drop("copy")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: its words, how many are hit, and which items occur."""
    found = find_hits(docs, items, window, gram)
    spots = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["first"], h["first"] + h["length"] - 1))))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string"))))
    found = found.select("doc_id", "n_words", F.coalesce(F.size(spots), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without the documents in which a window of an item occurs."""
    bad = find_hits(docs, items, window, gram).where(F.size("hits") > 0)
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("row").alias("bad_row")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_row"]), "left_anti")
