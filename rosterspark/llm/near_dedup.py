"""Near-duplicate documents by circulant MinHash.

A document's set holds the 64-bit hashes of its distinct shingles of ``SHINGLE``
words (the whole sequence, with fewer words). One permutation scatters the set;
a second one, shifted circularly by k, gives the k-th of ``COORDINATES`` minima,
so two permutations serve all of them. ``ROWS`` minima make a band. Equal sets
collapse first; the others that share a band are compared with leading members of
their buckets, not with each other: the leader of a bucket is the member whose
buckets are largest, a typical one, its head, and in each further round the leading
member of what is not yet connected with the head. After ``ROUNDS`` rounds whatever
is still apart from the head leads: of two members of different components one is
apart, so every pair is compared or connected already. As a bucket may hold many
documents that share a passage and little else, these leaders meet those members
with whom they share one of ``KEYS`` finer keys, each of as many coordinates as the
threshold allows (``key_rows``); of
a key with more than ``FEW`` members, block by block within a task, where links
alone come out. Signatures and sizes rule out pairs far from the threshold; every
link is confirmed on the full sets. Links become components by spreading the
smallest id.

A bucket of m members makes at most m pairs a round, a finer key at most ``FEW``
pairs a member, and texts, sets and pairs are dealt out by document or by bounded
chunk, so that no group of copies meets in one task.

Cases: a null text, or one without words, has the empty set and is linked with
nothing; repeated rows of an id are one document; rows with a null id are linked
with nothing and keep a null component; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import materialise

#: ROUNDS: with one leader a bucket; in a last one all that is not connected leads.
SHINGLE, COORDINATES, ROWS, ROUNDS = 5, 125, 5, 2
#: Keys of the last round, and the share of pairs at the threshold that may share none.
KEYS, MISS = 64, 1e-4
#: Similarity in hundredths from which on documents are linked.
PERCENT = 80
#: Pairs whose signatures agree less than this far below the threshold are dropped:
#: five standard errors of 125 coordinates.
MARGIN = 0.17
CHUNK = 64
#: Members up to which a finer key makes pairs; with more, members of it that a task
#: compares with as many others at once.
FEW, BLOCK = 8, 256
#: Bits of the filter that spares texts without a partner: a fixed size for any input.
BITS = 1 << 24

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 1 << 64, size=(64, 256), dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_ORDERED = np.array([_rng.permutation(COORDINATES) for _ in range(KEYS)])


def missed(percent: int, rows: int) -> float:
    """The share of pairs at ``percent`` that share none of ``KEYS`` keys of ``rows`` coordinates,
    over how many coordinates of their signatures agree."""
    p, n = percent / 100, COORDINATES
    return sum(comb(n, a) * p**a * (1 - p) ** (n - a) * (1 - comb(a, rows) / comb(n, rows)) ** KEYS for a in range(n + 1))


def key_rows(percent: int) -> int:
    """The most coordinates in a finer key with which at most ``MISS`` of the pairs at ``percent`` are missed."""
    return max((r for r in range(1, 17) if missed(percent, r) <= MISS), default=1)


KEY_ROWS = key_rows(PERCENT)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case, in order."""
    b = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = ~_BLANK[b]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    b = b[at]
    first = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    value = _TABLE[place & 63, b]
    if place.max() > 63:
        value = value * (2 * (place >> 6) + 1).astype(np.uint64)
    return _mix(np.add.reduceat(value, first))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w = word_hashes(text or "")
    n = len(w)
    if n == 0:
        return w
    k = min(n, shingle)
    if n < shingle:
        return _mix(np.array([(w * _ODD[:n]).sum() + np.uint64(n)], np.uint64))
    total = w[: n - k + 1] * _ODD[0]
    for j in range(1, k):
        total = total + w[j : n - k + 1 + j] * _ODD[j]
    return np.unique(_mix(total))


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """The circulant minima of each set, a row each; sets must not be empty."""
    out = np.empty((len(sets), coordinates), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= 60_000):
            total += len(sets[hi])
            hi += 1
        # The first permutation; its upper half is a place among 2**32.
        place = (_mix(np.concatenate(sets[lo:hi]) ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        x, y = np.empty_like(place), np.empty_like(place)
        for k in range(coordinates):
            # The second permutation, shifted circularly by k.
            np.subtract(place, np.uint32(k), out=x)
            np.right_shift(x, 16, out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x7FEB352D), out=x)
            np.right_shift(x, 15, out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x846CA68B), out=x)
            np.right_shift(x, 16, out=y)
            np.bitwise_xor(x, y, out=x)
            out[lo:hi, k] = np.minimum.reduceat(x, starts)
        lo = hi
    return out


def bands_of(minima: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band, with the band's number in it."""
    bands = minima.reshape(len(minima), -1, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for r in range(rows):
        key = _mix(key * np.uint64(0x100000001B3) + bands[:, :, r])
    return key.view(np.int64)


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lo in range(0, len(b), 1000):
            part = b.iloc[lo : lo + 1000]
            sets = [shingle_set(t) for t in part["text"]]
            full = [s for s in sets if len(s)]
            minima = signatures(full) if full else np.zeros((0, COORDINATES), np.uint32)
            keys, low = bands_of(minima), minima.astype(np.uint8)
            at, rows = 0, []
            for d, s in zip(part["doc_id"], sets, strict=True):
                if len(s):
                    rows.append((d, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys[at], low[at].tobytes()))
                    at += 1
                else:
                    rows.append((d, 0, None, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "bands", "sig"]).astype({"doc_id": "Int64"})


def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series(((x == y).mean(1) - 1 / 256) * 256 / 255)


def _finer(sig: pd.Series, rows: int = KEY_ROWS) -> pd.Series:
    """The finer keys of signatures."""
    x = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)
    key = np.broadcast_to(np.arange(KEYS, dtype=np.uint64), (len(x), KEYS))
    for r in range(rows):
        key = _mix(key * np.uint64(0x100000001B3) + x[:, _ORDERED[:, r]])
    return pd.Series(list(key.view(np.int64)))


def _verify(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked."""
    agreeing = F.pandas_udf(_agreeing, "double")
    sig_a = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")).hint("merge")
    sig_b = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")).hint("merge")
    pairs = pairs.join(sig_a, "a").join(sig_b, "b")
    pairs = materialise(pairs.where(agreeing("sig_a", "sig_b") >= percent / 100 - MARGIN).select("a", "b"), "pairs")
    # Each chunk holds a leader and at most about CHUNK members.
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"))
    dealt = pairs.join(size, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("n")).alias("chunk"))
    rows = dealt.select("b", "chunk", F.col("a").alias("id")).unionByName(dealt.select("b", "chunk", F.col("b").alias("id")).distinct())
    rows = rows.join(sets.hint("merge"), F.col("id") == F.col("doc_id")).select("b", "chunk", "id", "hashes")

    def confirm(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = {i: np.frombuffer(h, np.uint64) for i, h in zip(group["id"], group["hashes"], strict=True)}
        leader = own.pop(key[0])
        found = []
        for i, s in own.items():
            both = len(np.intersect1d(leader, s, assume_unique=True))
            if 100 * both >= percent * (len(leader) + len(s) - both):
                found.append(i)
        return pd.DataFrame({"a": found, "b": key[0]}).astype({"a": "int64", "b": "int64"})

    return rows.groupBy("b", "chunk").applyInPandas(confirm, "a long, b long")


def _signed_blocks(band: int, block: tuple[int, int], group: pd.DataFrame, percent: int, rows: int = KEY_ROWS) -> list[tuple[int, int]]:
    """Links between two chunks of a finer key, or within one; each pair is looked at
    under the first key that it shares."""
    sigs = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(group), -1)
    ids, own, apart, part, n = (group[c].to_numpy() for c in ("doc_id", "own", "apart", "part", "n_shingles"))
    sets = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
    keys = np.array(_finer(group["sig"], rows).tolist())
    least = percent / 100 - MARGIN
    found = []
    for x in np.flatnonzero(part == block[0]):
        other = (own != own[x]) & (apart | apart[x]) & (part == block[1]) & (percent * np.maximum(n, n[x]) <= 100 * np.minimum(n, n[x]))
        if block[0] == block[1]:
            other &= ids > ids[x]
        at = np.flatnonzero(other)
        at = at[((sigs[at] == sigs[x]).mean(1) - 1 / 256) * 256 / 255 >= least]
        shared = keys[at] == keys[x]
        for y in at[keys[x][shared.argmax(1)] == band] if len(at) else ():
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (n[x] + n[y] - both):
                found.append((ids[x], ids[y]))
    return found


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs that were compared in neither order."""
    both = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def _close(members: DataFrame, left: DataFrame, labels: DataFrame, sigs: DataFrame, sets: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """The links of what is apart from its heads with members of other components."""
    apart = left.select("doc_id").distinct().withColumn("apart", F.lit(True))
    near = members.join(left.select("band").distinct(), "band", "left_semi").select("doc_id", "n_shingles").distinct()
    near = near.join(apart, "doc_id", "left").join(labels, F.col("doc_id") == F.col("id"), "left").join(sigs.hint("merge"), "doc_id")
    rows = key_rows(percent)

    @F.pandas_udf("array<long>")
    def finer(sig: pd.Series) -> pd.Series:
        return _finer(sig, rows)

    keys = F.explode(finer("sig"))
    near = near.select("doc_id", "n_shingles", F.coalesce("apart", F.lit(False)).alias("apart"), F.coalesce("component", "doc_id").alias("own"), keys.alias("band"))
    near = materialise(near, "finer")
    size = near.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    # A band can need comparing only if it holds one that is apart and two components.
    mixed = near.groupBy("band").agg(F.bool_or("apart").alias("any"), F.min("own").alias("lo"), F.max("own").alias("hi")).where("any AND lo <> hi").select("band")
    near = materialise(near.join(size.join(mixed, "band"), "band"), "finer-shared")
    few = near.where(F.col("size") <= FEW)
    a = few.select("band", F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("own").alias("own_a"), F.col("apart").alias("apart_a"))
    b = few.where("apart").select(F.col("band").alias("band_b"), F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("own").alias("own_b"))
    like = percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")
    pairs = a.join(b, (F.col("band") == F.col("band_b")) & (F.col("own_a") != F.col("own_b")) & (~F.col("apart_a") | (F.col("a") < F.col("b"))) & like)
    pairs = pairs.select("a", "b").distinct()
    pairs = _untried(pairs, tried)
    found = _verify(materialise(pairs, "round"), sigs, sets, percent)

    # Signatures and sets are met once a row, before rows are repeated for their blocks.
    many = near.where(F.col("size") > FEW).join(sigs.hint("merge"), "doc_id").join(sets.hint("merge"), "doc_id")
    many = many.withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    many = many.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).select("band", "i", "j", "doc_id", "n_shingles", "own", "apart", "part", "sig", "hashes")

    def links(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_signed_blocks(int(key[0]), (int(key[1]), int(key[2])), group, percent, rows), columns=["a", "b"]).astype("int64")

    return found.unionByName(many.groupBy("band", "i", "j").applyInPandas(links, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", "component", F.least("component", "near").alias("least"))
        # A label's own label may be smaller still.
        ahead = labels.select(F.col("id").alias("i"), F.col("component").alias("ahead"))
        step = step.join(ahead, F.col("least") == F.col("i"), "left").select("id", "component", F.least("least", "ahead").alias("next"))
        step = materialise(step, "labels")
        if not step.where(F.col("next") < F.col("component")).limit(1).count():
            return step.select("id", "component")
        labels = step.select("id", F.col("next").alias("component"))


def _bit():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BITS))


def _bitmap(ids: DataFrame) -> bytes:
    """``BITS`` bits, of which those of the hashes of ``ids`` are set."""
    place = _bit()
    parts = ids.groupBy(F.bitmap_bucket_number(place + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
    out = bytearray(BITS // 8)
    for r in parts.collect():  # BITS / 32768 rows at most
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] = r["bits"]
    return bytes(out)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept; ``rounds`` is 1 or more."""
    signed = materialise(docs.select("doc_id", "text").mapInPandas(_sign, SIGNED), "signatures")
    known = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # Equal sets are one class with one representative.
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    # Joins of tables that grow with the input are merges at every size.
    classes = classes.hint("merge")
    reps = known.join(classes, (known["digest"] == classes["digest"]) & (known["doc_id"] == classes["rep"]), "left_semi").dropDuplicates(["doc_id"])
    spread = reps.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(spread.join(shared.hint("merge"), "band"), "buckets")
    weight = members.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    members = materialise(members.join(weight.hint("merge"), "doc_id").select("band", "doc_id", "n_shingles", "weight"), "members")
    needed = members.select("doc_id").distinct()
    sigs = materialise(reps.select("doc_id", "sig").join(needed.hint("merge"), "doc_id", "left_semi"), "shared-signatures")

    bits = _bitmap(needed)
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # BITS / 8 bytes

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").view(bool)
        for b in batches:
            b = b[mine[b["bit"].to_numpy()]]
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"], "hashes": [shingle_set(t).tobytes() for t in part["text"]]})

    # The bitmap lets each needed document pass, and few others, before texts are hashed again.
    some = docs.where("doc_id IS NOT NULL").select("doc_id", "text", _bit().alias("bit"))
    sets = materialise(some.mapInPandas(hashes, "doc_id long, hashes binary"), "sets")
    leader = F.max_by(F.struct("doc_id", "n_shingles"), F.struct("weight", -F.col("doc_id")))
    heads = materialise(members.groupBy("band").agg(leader.alias("l")).select("band", F.col("l.doc_id").alias("b"), F.col("l.n_shingles").alias("n_b")), "heads")
    links, labels, tried, left, leaders = None, None, None, members, heads
    for k in range(rounds):
        if k:
            leaders = left.groupBy("band").agg(leader.alias("l")).select("band", F.col("l.doc_id").alias("b"), F.col("l.n_shingles").alias("n_b"))
        like = percent * F.greatest("n_shingles", "n_b") <= 100 * F.least("n_shingles", "n_b")
        pairs = members.join(leaders, "band").where((F.col("doc_id") != F.col("b")) & like).select(F.col("doc_id").alias("a"), "b").distinct()
        if labels is not None:
            own, theirs = (labels.select(F.col("id").alias(i), F.col("component").alias(c)) for i, c in (("i", "own"), ("j", "theirs")))
            pairs = pairs.join(own, F.col("a") == F.col("i"), "left").join(theirs, F.col("b") == F.col("j"), "left")
            pairs = pairs.where(F.coalesce("own", "a") != F.coalesce("theirs", "b")).select("a", "b")
            pairs = _untried(pairs, tried)
        pairs = materialise(pairs, "round")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = materialise(_verify(pairs, sigs, sets, percent), "found")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        # What is not connected with its bucket's head, and has not led, is left.
        at = labels.select(F.col("id").alias("i"), F.col("component").alias("c"))
        main = heads.join(at, F.col("b") == F.col("i"), "left").select("band", F.coalesce("c", "b").alias("main"))
        left = left.join(leaders.select("band", F.col("b").alias("doc_id")), ["band", "doc_id"], "left_anti")
        left = left.join(at, F.col("doc_id") == F.col("i"), "left").select("band", "doc_id", "n_shingles", "weight", F.coalesce("c", "doc_id").alias("own"))
        left = materialise(left.join(main, "band").where(F.col("own") != F.col("main")).select("band", "doc_id", "n_shingles", "weight"), "left")
    closing = materialise(_close(members, left, labels, sigs, sets, tried, percent), "found")
    labels = components(links.unionByName(closing))
    final = classes.join(labels, F.col("rep") == F.col("id"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component"))
    out = signed.join(final.hint("merge"), F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` without the documents of a group but the one with the smallest id."""
    gone = near_duplicates(docs, percent, rounds).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
