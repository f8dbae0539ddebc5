"""Lexical retrieval packing: windows filled with a seed's BM25 neighbours.

Documents are encoded once and written with their ids. The counts that BM25 needs,
in how many documents each id of the vocabulary occurs and how long documents are,
come from all documents. Documents are then dealt out to shards of about
``SHARD_TOKENS`` tokens by their content: the key is the least hash of the pairs of
neighbouring ids in a document, so that two documents meet in one shard as often as
such pairs are common to them, and copies always do. A key with more tokens than a
shard is dealt on by ids, so that no group of copies is one task. Each shard holds
an inverted index of all its documents; a window's first document asks it with all
of its ids, and the best unused neighbours fill the window in order. What does not
fit is cut and opens the next window, so only a shard's last window is not full.
Neighbours are those of the shard: a document elsewhere is not found.

Cases: a null or empty text is only its end id; rows with equal ids are packed
one by one, in the order of their checksums; a document longer than a window spans
several; without neighbours the next unused document follows; an empty table gives
no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import materialise, shuffle_partitions
from rosterspark.llm.tokens import byte_encoder

WINDOW, END_ID, VOCABULARY = 2048, 1, 50_257
SHARD_TOKENS = 1 << 21
#: Tasks among which shards are dealt at most; with more shards, a task packs several in turn.
TASKS = 1 << 15
#: Neighbours fetched at once, and BM25's constants.
FETCHED, K1, B = 32, 1.2, 0.75
ENCODED = "doc_id long, n long, key long, ids binary, df_id array<int>, df_n array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def content_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The least hash of the pairs of neighbouring ids of each document, end id included."""
    n = np.array([len(x) for x in ids])
    flat = np.concatenate([*ids, np.zeros(1, np.uint16)]).astype(np.uint32)
    pair = (flat[:-1] << np.uint32(16)) | flat[1:]
    pair *= np.uint32(0x85EBCA6B)
    pair ^= pair >> np.uint32(13)
    pair *= np.uint32(0xC2B2AE35)
    pair ^= pair >> np.uint32(16)
    ends = np.cumsum(n)
    # The end id has no neighbour; alone it is its own key.
    pair[ends - 1] = np.where(n > 1, np.iinfo(np.uint32).max, flat[:-1][ends - 1])
    return np.minimum.reduceat(pair, ends - n).astype(np.int64)


def encode_documents(docs: DataFrame, tokenizer: str, ranks: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, ids) per document, and a row of each task with the ids it met and in
    how many documents; written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(tokenizer, ranks)
        df = np.zeros(VOCABULARY, np.int64)
        end = np.array([end_id], np.uint16)
        for b in batches:
            for lo in range(0, len(b), 500):
                ids = [np.concatenate([x, end]) for x in encoder.encode([t or "" for t in b["text"].iloc[lo : lo + 500]])]
                # Each document's distinct ids, all documents at once.
                key = np.sort((np.repeat(np.arange(len(ids), dtype=np.uint32), [len(x) for x in ids]) << np.uint32(16)) | np.concatenate(ids))
                own = key[np.append(True, key[1:] != key[:-1])]
                df += np.bincount(own & np.uint32(0xFFFF), minlength=VOCABULARY)[:VOCABULARY]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo : lo + 500].astype("Int64").array, "n": [len(x) for x in ids], "key": content_keys(ids), "ids": [x.tobytes() for x in ids], "df_id": None, "df_n": None})
        at = np.flatnonzero(df)
        if len(at):
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "n": pd.array([None], "Int64"), "key": pd.array([None], "Int64"), "ids": [None], "df_id": [at.tolist()], "df_n": [df[at].tolist()]})

    return materialise(docs.select("doc_id", "text").mapInPandas(run, ENCODED), "encoded")


class Index:
    """A shard's inverted index: for each id its documents and BM25 weights."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        n = np.array([len(x) for x in ids])
        wide = np.uint64 if len(ids) > 65_535 else np.uint32
        doc = np.repeat(np.arange(len(ids), dtype=wide), n)
        key = np.sort((np.concatenate(ids).astype(wide) << wide(32 if wide is np.uint64 else 16)) | doc)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(first, len(key)))
        key = key[first]
        self.doc = (key & wide(0xFFFFFFFF if wide is np.uint64 else 0xFFFF)).astype(np.int64)
        term = (key >> wide(32 if wide is np.uint64 else 16)).astype(np.int64)
        norm = K1 * (1 - B + B * n / mean_length)
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.at = np.searchsorted(term, np.arange(VOCABULARY + 1))
        # The same postings by document: the ids that each one asks with.
        order = np.argsort(self.doc, kind="stable")
        start = np.searchsorted(self.doc[order], np.arange(len(ids) + 1))
        self.asked = [term[order[start[d] : start[d + 1]]] for d in range(len(ids))]
        self.size = len(ids)
        # Ids that an eighth of the documents hold have a row over all of them: eight times
        # as many numbers as there are postings, at most.
        often = np.flatnonzero(8 * np.diff(self.at) > self.size)
        self.row = np.full(VOCABULARY, -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.size), np.float32)
        own = self.row[term] >= 0
        self.rows[self.row[term[own]], self.doc[own]] = self.weight[own]

    def scores(self, seed: int) -> np.ndarray:
        asked = self.asked[seed]
        row = self.row[asked]
        s = self.rows[row[row >= 0]].sum(0)
        spans = [(self.at[t], self.at[t + 1]) for t in asked[row < 0].tolist()]
        if spans:
            doc, weight = (np.concatenate([x[i:j] for i, j in spans]) for x in (self.doc, self.weight))
            s += np.bincount(doc, weight, self.size).astype(np.float32)
        return s


def plan_windows(lengths: np.ndarray, index: Index, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) of each piece, in order."""
    used = np.zeros(len(lengths), bool)
    number, offset, following = 0, 0, 0
    scores: np.ndarray | None = None
    fetched: list[int] = []
    doc, done = -1, 0
    while True:
        if doc < 0 or done == lengths[doc]:  # the next document
            doc, done = -1, 0
            while offset and scores is not None and doc < 0:
                while fetched and doc < 0:
                    d = fetched.pop()
                    doc = d if not used[d] else -1
                if doc < 0:
                    scores[used] = 0
                    k = min(FETCHED, len(scores))
                    best = np.argpartition(scores, -k)[-k:]
                    best = best[scores[best] > 0]
                    fetched = best[np.lexsort((-best, scores[best]))].tolist()
                    if not fetched:
                        scores = None
            if doc < 0:
                while following < len(used) and used[following]:
                    following += 1
                if following == len(used):
                    return
                doc = following
            used[doc] = True
        if offset == 0:  # whatever opens a window asks for its neighbours
            fetched, scores = [], None
            if lengths[doc] - done < window:
                scores = index.scores(doc)
        take = int(min(window - offset, lengths[doc] - done))
        yield doc, done, take, number, offset
        done, offset = done + take, offset + take
        if offset == window:
            number, offset = number + 1, 0


def pack(docs: DataFrame, tokenizer: str, ranks: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) in windows; ``with_ids`` adds their ids."""
    spark = docs.sparkSession
    encoded = encode_documents(docs, tokenizer, ranks)
    counts = encoded.where("df_id IS NOT NULL").select(F.explode(F.arrays_zip("df_id", "df_n")).alias("x")).groupBy("x.df_id").agg(F.sum("x.df_n").alias("n"))
    df = np.zeros(VOCABULARY)
    for r in counts.collect():  # VOCABULARY rows at most
        df[r["df_id"]] = r["n"]
    documents = encoded.where("ids IS NOT NULL").select("doc_id", "ids", "n", "key")
    total = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).collect()[0]
    shards = max(1, -(-total["tokens"] // shard_tokens))
    mean_length = max(1.0, total["tokens"] / max(1, total["n"]))
    idf = np.log1p((total["n"] - df + 0.5) / (df + 0.5)).clip(0)
    sent = spark.sparkContext.broadcast(idf)  # VOCABULARY values

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        crc = [zlib.crc32(x) for x in group["ids"]]
        group = group.assign(crc=crc).sort_values(["doc_id", "crc"], kind="stable", na_position="first")
        ids = [np.frombuffer(x, np.uint16) for x in group["ids"]]
        lengths, known = np.array([len(x) for x in ids]), group["doc_id"].array
        index = Index(ids, sent.value, mean_length)
        raw: list[memoryview | None] = [None] * len(ids)
        rows, pieces = [], []
        for doc, start, length, number, offset in plan_windows(lengths, index, window):
            if raw[doc] is None:
                raw[doc] = memoryview(ids[doc].astype("<u4").tobytes())
            piece = raw[doc][4 * start : 4 * (start + length)]
            rows.append((doc, start, length, zlib.crc32(piece), int(lengths[doc]), (int(key[0]) << 32) + number, offset))
            if with_ids:
                pieces.append(piece.tobytes())
            if start + length == lengths[doc]:
                raw[doc] = None
        out = pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        out.insert(0, "doc_id", known[out.pop("doc").to_numpy()])
        return out.assign(ids=pieces) if with_ids else out

    # Keys that fill a shard by themselves: fewer than there are shards.
    hot = documents.groupBy("key").agg(F.ceil(F.sum("n") / shard_tokens).cast("int").alias("parts")).where("parts > 1").select(F.col("key").alias("_key"), "parts")
    dealt = documents.join(materialise(hot, "hot-keys"), F.col("key") == F.col("_key"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.col("parts")), F.lit(0))
    dealt = dealt.select("doc_id", "ids", F.pmod(F.xxhash64("key", part), F.lit(shards)).alias("shard"))
    if shards > shuffle_partitions(spark):  # what a task reads doesn't grow with the input
        dealt = dealt.repartition(min(shards, TASKS), "shard")
    return dealt.groupBy("shard").applyInPandas(run, PIECES + (", ids binary" if with_ids else ""))
