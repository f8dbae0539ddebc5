"""Token-id files compressed by Re-Pair grammars.

Documents are dealt out by ranges of ``doc_id`` and encoded in that order. Each
run of about ``BLOCK_TOKENS`` ids is a block with a grammar of its own: again and
again all pairs of neighbouring symbols are counted and those that occur ``LEAST``
times or more give way to nonterminals, in one round (the textbook form replaces
one pair at a time), until no pair is that frequent or symbols of 16 bits run out,
of which the most frequent pairs have the first choice. A block's row holds its rules as pairs
of symbols, the length each nonterminal expands to, the remaining sequence, and
the ids and ends of its documents. The lengths give the place of any token, so
``decode_range`` expands only what it is asked for. Blocks are rows of Parquet
files in the shared folder, written and read by Spark.

Cases: a null or empty text is only its end id; rows with equal ids follow each
other by a hash of their texts; a null id comes first; a document longer than a
block is a block of its own; an empty table gives an empty store; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import new_path, shuffle_partitions
from rosterspark.llm.tokens import word_encoder

END_ID, VOCABULARY = 2, 49_408
BLOCK_TOKENS = 1 << 19
#: The least count of a pair that becomes a rule: a rule is stored in four symbols' room.
LEAST = 16
#: Bits of the table that finds a round's pairs; of pairs with one place in it the most
#: frequent goes first, the others in a later round.
BITS = 18
BLOCK = "part int, seq long, n_tokens long, n_docs long, doc_ids binary, null_ids binary, ends binary, rules binary, lengths binary, symbols binary"


def _place(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _frequent(pairs: np.ndarray, least: int, room: int) -> np.ndarray:
    """The pairs that occur ``least`` times or more, the most frequent first, of different places."""
    ordered = np.sort(pairs)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(first, len(ordered)))
    top = np.flatnonzero(count >= least)
    chosen = ordered[first[top[np.lexsort((top, -count[top]))]]]
    return chosen[np.sort(np.unique(_place(chosen), return_index=True)[1])][:room]


def build_grammar(ids: np.ndarray, vocabulary: int = VOCABULARY, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): rule r stands for symbol vocabulary + r and is two symbols."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = 0
    while len(seq) > 1 and (room := (1 << 16) - vocabulary - made) > 0:
        pairs = (seq[:-1] << np.uint32(16)) | seq[1:]
        chosen = _frequent(pairs, least, room)
        if not len(chosen):
            break
        wanted, rule = np.zeros(1 << BITS, np.uint32), np.full(1 << BITS, -1, np.int32)
        wanted[_place(chosen)], rule[_place(chosen)] = chosen, np.arange(len(chosen))
        at = _place(pairs)
        hit = np.flatnonzero((wanted[at] == pairs) & (rule[at] >= 0))
        # Of occurrences that overlap, every other one from the left.
        first = np.ones(len(hit), bool)
        first[1:] = hit[1:] - hit[:-1] > 1
        if not first.all():
            start = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
        own = rule[at[hit]]
        # A pair whose occurrences all fell to its neighbours is counted again.
        useful = np.bincount(own, minlength=len(chosen)) > 1
        if not useful.any():
            break
        number, kept = np.cumsum(useful) - 1, useful[own]
        hit, own = hit[kept], own[kept]
        seq[hit] = vocabulary + made + number[own]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        chosen = chosen[useful].astype(np.int64)
        rules.append(np.stack([chosen >> 16, chosen & 0xFFFF], 1))
        made += len(chosen)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), seq


def expansion_lengths(rules: np.ndarray, vocabulary: int = VOCABULARY) -> np.ndarray:
    """How many ids each nonterminal stands for; a rule names earlier symbols only."""
    size = np.ones(vocabulary + len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        size[vocabulary + r] = size[a] + size[b]
    return size[vocabulary:]


def _expand_rules(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of all nonterminals, one after the other: pairs go in their places."""
    seq = np.arange(vocabulary, vocabulary + len(rules))
    while len(seq) and seq.max() >= vocabulary:
        deep = seq >= vocabulary
        out = np.repeat(seq, 1 + deep)
        at = np.cumsum(1 + deep)[deep] - 2
        pair = rules[seq[deep] - vocabulary]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def expand(symbols: np.ndarray, rules: np.ndarray, vocabulary: int = VOCABULARY) -> np.ndarray:
    """The ids that symbols stand for."""
    if not len(rules):
        return symbols.astype(np.int64)
    lengths = expansion_lengths(rules, vocabulary)
    flat = np.concatenate([np.arange(vocabulary), _expand_rules(rules, vocabulary)]).astype(np.int32)
    size = np.concatenate([np.ones(vocabulary, np.int64), lengths])
    start = np.cumsum(size) - size
    n = size[symbols]
    return flat[np.repeat(start[symbols] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def decode_range(block: dict, first: int, last: int, vocabulary: int = VOCABULARY) -> np.ndarray:
    """Ids ``first`` to ``last`` (not included) of a block, expanding only their symbols."""
    rules = np.frombuffer(block["rules"], "<u2").reshape(-1, 2).astype(np.int64)
    size = np.concatenate([np.ones(vocabulary, np.int64), np.frombuffer(block["lengths"], "<u4").astype(np.int64)])
    symbols = np.frombuffer(block["symbols"], "<u2").astype(np.int64)
    ends = np.cumsum(size[symbols])
    i, j = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
    begin = int(ends[i - 1]) if i else 0
    return expand(symbols[i:j], rules, vocabulary)[first - begin : last - begin]


def _block(part: int, seq: int, docs: list, parts: list[np.ndarray]) -> dict:
    ids = np.concatenate(parts)
    rules, symbols = build_grammar(ids)
    return {
        "part": part, "seq": seq, "n_tokens": len(ids), "n_docs": len(docs),
        "doc_ids": np.array([0 if d is None else d for d in docs], "<i8").tobytes(), "null_ids": np.packbits([d is None for d in docs]).tobytes(),
        "ends": np.cumsum([len(p) for p in parts]).astype("<i8").tobytes(), "rules": rules.astype("<u2").tobytes(),
        "lengths": expansion_lengths(rules).astype("<u4").tobytes(), "symbols": symbols.astype("<u2").tobytes(),
    }


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes (doc_id, text) in ascending order of doc_id and writes the blocks."""
    n = shuffle_partitions(docs.sparkSession)
    # By the text's hash too: many rows with one id, or without any, are several ranges.
    order = "doc_id", F.xxhash64("text")
    sorted_docs = docs.select("doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seq = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0
        end = np.array([end_id], np.uint16)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for lo in range(0, len(texts), 500):
                for d, own in zip(b["doc_id"].iloc[lo : lo + 500], encoder.encode(texts[lo : lo + 500]), strict=True):
                    ids.append(None if pd.isna(d) else int(d))
                    parts.append(np.concatenate([own, end]))
                    held += len(parts[-1])
                    if held >= block_tokens:
                        yield pd.DataFrame([_block(part, seq, ids, parts)])
                        ids, parts, held, seq = [], [], 0, seq + 1
        if ids:
            yield pd.DataFrame([_block(part, seq, ids, parts)])

    sorted_docs.mapInPandas(run, BLOCK).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens and the checksum of its ids."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    # A row for each written partition, then the blocks of each.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("p"), before.alias("before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = blocks.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside")).join(parts, F.col("part") == F.col("p"))
    at = at.select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("before") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                rules = np.frombuffer(r["rules"], "<u2").reshape(-1, 2).astype(np.int64)
                ids = expand(np.frombuffer(r["symbols"], "<u2"), rules).astype("<u4")
                ends = np.frombuffer(r["ends"], "<i8")
                starts = np.concatenate([[0], ends[:-1]])
                known, null = np.frombuffer(r["doc_ids"], "<i8"), np.unpackbits(np.frombuffer(r["null_ids"], np.uint8))[: len(ends)]
                view = memoryview(ids.tobytes())
                sums = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(np.where(null, 0, known), "Int64").copy() if not null.any() else pd.Series(known, dtype="Int64").mask(null.astype(bool)), "part": r["part"], "seq": r["seq"], "begin": starts, "n_tokens": ends - starts, "ids_crc32": sums})

    read = blocks.mapInPandas(run, "doc_id long, part int, seq long, begin long, n_tokens long, ids_crc32 long")
    read = read.join(at, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    return read.select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = new_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer)
    return read_store(docs.sparkSession, path)
