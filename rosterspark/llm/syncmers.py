"""Document fingerprints from closed syncmers.

A text is a sequence of words, of whatever length; each Han, Kana or Hangul letter,
which no spaces part, is a unit of its own. Of every ``K`` consecutive units the
``S``-unit runs inside are hashed; the k-mer is chosen if its smallest inner run
stands at either edge. The choice depends on the k-mer alone, so an edit moves no
anchor beyond its reach.

A fingerprint is all anchors of a text in order, each as the step from the one
before and its hash. Two fingerprints are compared by position: anchors with one
hash that occur once in each text are matched, and a match counts if it continues
the match before it, that is if its place in the other text is further on. The
likeness is the share of both texts' anchors that counted matches make up; anchors
that a text repeats speak by whether the other text holds them. Everything is a
DataFrame expression, linear in the anchors but for sorting.

Cases: a null text counts as empty; no units give the empty fingerprint; fewer
than ``K`` units are one k-mer; equal fingerprints, empty ones too, are alike 1;
rows with equal ids follow each other by a hash of their texts, repeats too; a
lone document follows itself; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import let, shuffle_partitions

K, S = 5, 2
#: Ranges of ids for each shuffle partition, so that they even out.
RANGES, CHUNK = 4, 64
UNSPACED = r"[぀-ヿ㐀-鿿가-힯]"


def units(text: Column) -> Column:
    """A hash of each unit of a text."""
    parted = F.regexp_replace(text, UNSPACED, " $0 ")
    words = F.array_remove(F.split(parted, r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of a text as structs (pos, hash)."""

    def choose(h: Column) -> Column:
        n = F.size(h)
        at = F.sequence(F.lit(0), F.greatest(n - s, F.lit(0)))
        inner = F.transform(at, lambda i: F.xxhash64(F.lit(s), *[F.get(h, i + j) for j in range(s)]))
        starts = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))

        def at_edge(m: Column, i: Column) -> Column:
            return F.least(F.get(m, i), F.get(m, i + (k - s))) <= F.least(*[F.get(m, i + j) for j in range(1, k - s)])

        closed = let(inner, lambda m: F.filter(starts, lambda i: at_edge(m, i)))
        full = F.transform(closed, lambda i: F.struct(i.alias("pos"), F.hash(F.lit(k), *[F.get(h, i + j) for j in range(k)]).alias("hash")))
        whole = F.array(F.struct(F.lit(0).alias("pos"), F.hash(h).alias("hash")))
        return F.when(n >= k, full).when(n > 0, whole).otherwise(F.slice(whole, 1, 0))

    return let(units(text), choose)


HASH = 0xFFFFFFFF


def packed(text: Column, k: int = K, s: int = S) -> Column:
    """All anchors of a text in order, each as one number: its position and its hash."""
    return F.transform(anchors(text, k, s), lambda a: F.shiftleft(a["pos"].cast("long"), 32).bitwiseOR(a["hash"].cast("long").bitwiseAND(F.lit(HASH))))


def fingerprint(own: Column) -> Column:
    """Packed anchors as a string: of each the step from the one before, a digit (closed
    syncmers are at most K - S apart), and 8 hexadecimal digits of hash."""

    def step(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.shiftright(F.get(own, i - 1), 32)).otherwise(F.lit(-1))
        return F.hex(F.shiftleft(F.shiftright(x, 32) - before, 32).bitwiseOR(x.bitwiseAND(F.lit(HASH))))

    return F.array_join(F.transform(own, step), "")


def likeness(a: Column, b: Column) -> Column:
    """Of the hashes in either of two packed fingerprints the share that is in both and in place.

    A hash that occurs once in each is in place if its position in ``b`` lies behind
    that of the hash before it in ``a`` that does so too.
    """

    def side(own: Column, k: int) -> Column:  # hash, side and position, from the upper bit
        return F.transform(own, lambda x: F.shiftleft(x, 32).bitwiseOR(F.lit(k << 31)).bitwiseOR(F.shiftright(x, 32)))

    def of(s: Column, i: Column) -> Column:  # hash and side
        return F.shiftright(F.get(s, i), 31)

    def compare(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        both = F.filter(at, lambda i: (F.get(s, i).bitwiseAND(F.lit(1 << 31)) == 0) & F.coalesce(of(s, i + 1) == of(s, i) + 1, F.lit(False)))
        every = F.size(F.array_distinct(F.transform(s, lambda x: F.shiftright(x, 32))))

        def once(i: Column) -> Column:
            return F.coalesce(of(s, F.greatest(i - 1, F.lit(0))) != of(s, i), F.lit(True)) | (i == 0)

        def share(c: Column) -> Column:
            single = F.filter(c, lambda i: once(i) & F.coalesce(of(s, i + 2) != of(s, i) + 1, F.lit(True)))
            low = F.lit((1 << 31) - 1)
            places = F.sort_array(F.transform(single, lambda i: F.shiftleft(F.get(s, i).bitwiseAND(low), 32).bitwiseOR(F.get(s, i + 1).bitwiseAND(low))))
            back = let(places, lambda p: F.size(F.filter(F.transform(p, lambda x, i: (i > 0) & (x.bitwiseAND(low) < F.get(p, F.greatest(i - 1, F.lit(0))).bitwiseAND(low))), lambda x: x)))
            return F.try_divide(F.size(c) - back, every)

        return let(both, share)

    alike = let(F.sort_array(F.concat(side(a, 0), side(b, 1))), compare)
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(alike)


def matching_positions(a: Column, b: Column) -> Column:
    """Pairs (a, b) of the positions of equal anchors, in the order of ``a``; with an
    anchor that ``b`` holds twice, its first position."""
    first = let(F.transform(b, lambda y: y["hash"]), lambda h: F.transform(a, lambda x: F.struct(x["pos"].alias("a"), F.get(b, F.array_position(h, x["hash"]).cast("int") - 1)["pos"].alias("b"))))
    return F.filter(first, lambda x: x["b"].isNotNull())


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ids that part the documents into at most ``parts`` ranges of like size, in order; an id
    that fills several ranges stands there as often."""
    at = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), F.lit(10 * parts)).alias("p")).collect()[0]["p"] if at else []
    return sorted(found or [])


def _within(row: Column, n: Column) -> Column:
    """Which of ``n`` ranges of like size a hash falls in, in its order."""
    return F.least(F.floor((row / F.lit(2.0**64) + 0.5) * n), n - 1)


def with_next(docs: DataFrame, derived: dict[str, Column], columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, row, ...), ``derived`` and next_<column> of the document that
    follows in ascending order of doc_id; the first follows the last.

    Ranges of ids are sorted apart. The first document of each range is also sent to
    the range before it, so that each row finds its follower within its range; the
    texts are dealt out once. Rows of an id that fills several ranges, and rows without
    an id, are dealt on by the hashes of their texts, which are their order.
    """
    spark = docs.sparkSession
    bounds = _bounds(docs, RANGES * shuffle_partitions(spark))
    steps = [F.array(*[F.lit(b) for b in bounds[i : i + CHUNK]]) for i in range(0, len(bounds), CHUNK)]
    below = [F.size(F.filter(x, lambda b: b < F.col("doc_id"))) for x in steps]
    part = reduce(lambda a, b: a + b, below) if below else F.lit(0)
    if repeated := [(b, n) for b, n in Counter(bounds).items() if n > 1]:
        several = F.create_map(*[F.lit(x).cast("long") for pair in repeated for x in pair])
        part = part + F.coalesce(_within(F.col("row"), F.try_element_at(several, F.col("doc_id"))), F.lit(0))
    # Rows without an id come first, in as many ranges again.
    part = F.when(F.col("doc_id").isNull(), _within(F.col("row"), F.lit(len(bounds) + 1)) - len(bounds) - 1).otherwise(part)
    docs = docs.withColumn("part", part.cast("int"))
    # One row for each range, of which there are at most 2 * len(bounds) + 2.
    heads = [(r["part"], *r["head"]) for r in docs.groupBy("part").agg(F.min(F.struct("doc_id", "row")).alias("head")).orderBy("part").collect()]
    before = [(heads[i - 1][0], heads[i][1], heads[i][2]) for i in range(len(heads))]
    sent = F.broadcast(spark.createDataFrame(before, "to int, h_id long, h_row long"))
    first = docs.join(sent, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("row") == F.col("h_row"))).withColumn("part", F.col("to")).drop("to", "h_id", "h_row")
    # Columns are derived here, once a row: they do not travel.
    both = docs.withColumn("guest", F.lit(0)).unionByName(first.withColumn("guest", F.lit(1))).repartition("part").withColumns(derived)
    order = Window.partitionBy("part").orderBy("guest", "doc_id", "row")
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("guest = 0").drop("part", "guest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of the text whose last half gives way to the
    beginning of the next document, and how alike they and the next one's are."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    led = with_next(base, {"own": packed(F.col("text"))}, ["text", "own"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    led = led.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    led = led.select("doc_id", "n_chars", "own", "next_own", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("edited")).alias("changed"))
    return led.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
