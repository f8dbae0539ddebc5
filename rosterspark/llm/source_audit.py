"""Source divergence audit: how differently the sources of a language use its words.

Tasks count terms by language and source while they read, and write their counts when they
hold many; Spark adds them up. A language keeps the terms of enough documents. Its kept
terms are dealt into blocks, its sources too, and a task turns a block of terms and two
blocks of sources into dense int64 matrices of counts, then of scaled shares: broadcasting
gives the differences of all pairs of sources at once, whose sums are a partial pair matrix,
and each source's terms above the language's share give a heap of the best. Spark adds the
partial matrices and merges the heaps by rank.

All arithmetic is exact: shares are floors of integer quotients, found digit by digit so
that no product passes 63 bits while a language holds fewer than 9.2e15 words.

Cases: a null text, language or source is an empty string, which is a language or source
like others; a source without terms counts as one whose shares are all smoothed zeros; a
language without kept terms gives differences of 0; a language with one source has no
pairs; repeated rows are documents of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import materialise

#: Documents of a language that must hold a term, smoothing of a count, scale of a share, terms of a source that are told.
LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms and sources in a tile, differences in memory at once, and counts that a task holds before it writes them.
TERMS, SOURCES, CELLS, HELD = 4096, 256, 1 << 22, 400_000
COUNTS = "lang string, source string, term binary, docs long, n long"
TILES = "lang string, i int, j int, term binary, value long"
#: A-Z become a-z, letters and all bytes of other characters stay, the rest parts terms.
FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def count_terms(docs: DataFrame, held_most: int = HELD) -> DataFrame:
    """(lang, source, term, docs, n): in how many documents a term occurs and how often,
    with a row without term for each source; sums of a task's rows, to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("n", pa.int64())])
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def written() -> pa.RecordBatch:
            rows = [(lang, source, None, 0, 0) for lang, source in held]
            rows += [(lang, source, term, k, n[term]) for (lang, source), (d, n) in held.items() for term, k in d.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                d, n = held[lang, source]
                words = terms_of(text)
                n.update(words)
                d.update(set(words))
            if sum(len(d) for d, _ in held.values()) > held_most:
                yield written()
                held.clear()
        if held:
            yield written()

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], text.alias("text"))
    return read.mapInArrow(run, COUNTS)


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first), written: the kept terms' counts by source and
    in the whole language, ``first`` once a term; and a row without term for each source.

    One shuffle, by language and term: a term has as many rows as tasks met it by source.
    """
    counts = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    all_of = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"lang_docs": F.sum("docs").over(all_of), "lang_n": F.sum("n").over(all_of), "first": F.col("source") == F.min("source").over(all_of)})
    return materialise(counts.where((F.col("lang_docs") >= least_docs) | F.col("term").isNull()).select("lang", "source", "term", "n", "lang_n", "first"), "audit-counts")


def source_groups(kept: DataFrame) -> DataFrame:
    """(lang, source, at, words, lang_words, terms, sources), written: each source's place
    in its language, the words of either and the language's numbers of terms and sources."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count_if(F.col("term").isNotNull() & F.col("first")).alias("firsts"))
    whole = Window.partitionBy("lang")
    groups = groups.withColumn("at", (F.row_number().over(whole.orderBy("source")) - 1).cast("int"))
    sums = {"lang_words": F.sum("words").over(whole), "terms": F.sum("firsts").over(whole), "sources": F.count("*").over(whole)}
    return materialise(groups.withColumns(sums).drop("firsts"), "audit-groups")


def shares(counts: np.ndarray, words: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (words + SMOOTH * terms)), three digits a step."""
    whole = words + SMOOTH * terms
    rest, out = counts + SMOOTH, np.zeros_like(counts)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums over columns of the differences of all rows of ``a`` and ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    step = max(1, CELLS // max(1, out.size))
    for k in range(0, a.shape[1], step):
        out += np.abs(a[:, None, k : k + step] - b[None, :, k : k + step]).sum(2)
    return out


def best_terms(own: np.ndarray, all_: np.ndarray, counts: np.ndarray, terms: list[bytes], top: int) -> list[tuple[int, bytes]]:
    """The ``top`` terms that a source has and uses more than its language, as (gain, term)."""
    found = np.flatnonzero((counts > 0) & (own > all_))
    heap = heapq.nsmallest(top, ((-int(own[k] - all_[k]), terms[k]) for k in found))
    return [(-gain, term) for gain, term in heap]


def tile(key: tuple, table: pa.Table, top: int = TOP) -> pa.Table:
    """The partial pair matrix of two blocks of sources over a block of terms, and, where
    the blocks are one, the best terms of each source."""
    lang, _, first, second = (k.as_py() for k in key)
    is_head = pc.is_null(table["term"])
    head, cells = table.filter(is_head).sort_by("at"), table.filter(pc.invert(is_head))
    at, block = head["at"].to_numpy(), head["source_block"].to_numpy()
    words, lang_words, terms = head["words"].to_numpy(), head["lang_words"][0].as_py(), head["terms"][0].as_py()
    coded = cells["term"].combine_chunks().dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    counts = np.zeros((len(at), len(names)), np.int64)
    counts[np.searchsorted(at, cells["at"].to_numpy()), code] = cells["n"].to_numpy()
    own = shares(counts, words[:, None], terms)
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    sums = pair_sums(own[a], own[b])
    x, y = np.nonzero(at[a][:, None] < at[b][None, :])
    out = [(lang, int(at[a[i]]), int(at[b[j]]), None, int(sums[i, j])) for i, j in zip(x, y, strict=True)]
    if first == second:
        lang_counts = np.zeros(len(names), np.int64)
        lang_counts[code] = cells["lang_n"].to_numpy()
        all_ = shares(lang_counts, np.int64(lang_words), terms)
        for i in a:
            out += [(lang, int(at[i]), None, term, gain) for gain, term in best_terms(own[i], all_, counts[i], names, top)]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
    return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(("lang", "i", "j", "term", "value"), kinds, strict=True))})


def tiles(kept: DataFrame, groups: DataFrame, top: int = TOP, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, i, j, term, value) of all tiles, written: partial sums of pairs of sources, and heaps."""
    blocks = F.greatest(F.ceil(F.col("terms") / terms), F.lit(1)).cast("int")
    own = (F.col("at") / sources).cast("int")
    groups = groups.withColumns({"blocks": blocks, "source_block": own, "source_blocks": F.ceil(F.col("sources") / sources).cast("int")})
    head = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    head = head.select("lang", "block", "at", "source_block", "source_blocks", "words", "lang_words", "terms", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"))
    cells = kept.where("term IS NOT NULL").join(groups.select("lang", "source", "at", "source_block", "source_blocks", "blocks"), ["lang", "source"])
    cells = cells.withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    rows = head.unionByName(cells.select("lang", "block", "at", "source_block", "source_blocks", "term", "n", "lang_n"), allowMissingColumns=True)
    # A row meets every block of sources once, its own too.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1))).drop("source_blocks")
    rows = rows.withColumns({"first": F.least("source_block", "other"), "second": F.greatest("source_block", "other")}).drop("other")
    return materialise(rows.groupBy("lang", "block", "first", "second").applyInArrow(lambda k, t: tile(k, t, top), TILES), "audit-tiles")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the
    language and how far apart the two are, part ``term`` the terms that the source uses
    most beyond its language."""
    kept = kept_counts(docs, least_docs)
    groups = source_groups(kept)
    found = tiles(kept, groups, top)
    names = groups.select("lang", F.col("at").alias("i"), "source")
    sums = found.where("j IS NOT NULL").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")).select("lang", "value", "p.*")
    pairs = both.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    heaps = found.where("j IS NULL").join(names, ["lang", "i"]).withColumn("item", F.col("term").cast("string"))

    def ranked(df: DataFrame, part: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(heaps, "term").where(F.col("rank") <= top))
