"""Line dedup: how many distinct sites a line is spread over decides its fate.

Each line's hash carries a HyperLogLog sketch of the sites it occurs on; the
sketches merge by partial aggregation, so a line that a third of all documents
share costs one small state per task. Lines whose estimate lies within the
sketch's error of the threshold get an exact distinct count.

A line on enough sites leaves every document. Copies of a whole document spread their
lines over sites too, and would lose all of them; ``spare_copies`` leaves confirmed
copies as they are, which near dedup then deals with: documents whose characters are
nearly all (``COPIED``) in spread lines, of which another such document has nearly the
same (``ALIKE``, by set). Documents meet by the least hash of their spread lines and are
held against the one that has most of them. Boilerplate on pages that hold little else
leaves them unless pages are alike as a whole. The pipeline asks for this.

Cases: a null text stays null with no lines; blank lines are never boilerplate;
a null source counts as no site; a line repeated within a document counts its
site once and leaves at every place; a class needs two documents, and rows that repeat
an id and a text are one; an empty table gives an empty table; columns ``n_lines`` and
``n_removed`` of the input are replaced, other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import materialise, unused

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 12
#: Relative standard error of the sketches, and how many of them count as near.
RSD, NEAR = 0.1, 5
#: Share of a document's characters in spread lines from which on it may be a copy, and of
#: two documents' spread lines from which on they are copies.
COPIED, ALIKE = 0.8, 0.8


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line_hash) of the lines found on at least ``min_sites`` distinct sites."""
    lines = docs.select("source", F.explode(lines_of(F.col("text"))).alias("line")).where(F.trim("line") != "")
    lines = lines.select("source", line_key(F.col("line")).alias("line_hash"))
    sketched = lines.groupBy("line_hash").agg(F.approx_count_distinct("source", RSD).alias("sites"), F.count("source").alias("n"))
    low, high = min_sites * (1 - NEAR * RSD), min_sites * (1 + NEAR * RSD)
    wide = sketched.where((F.col("n") >= min_sites) & (F.col("sites") >= low)).select("line_hash", (F.col("sites") > high).alias("sure"))
    # Written first, so that Spark knows the size of what many lines are to meet.
    wide = materialise(wide, "wide-lines")
    near = lines.join(wide.where(~F.col("sure")), "line_hash", "left_semi").distinct()
    exact = near.groupBy("line_hash").agg(F.count("source").alias("sites")).where(F.col("sites") >= min_sites)
    return wide.where("sure").select("line_hash").unionByName(exact.select("line_hash"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, spare_copies: bool = False) -> DataFrame:
    """(doc_id, row, hashes): of each document, by its id and a hash of its text, the
    spread lines that leave it."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), F.char_length("text").alias("chars"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).where(F.trim("line") != "")
    lines = lines.select("doc_id", "row", "chars", "pos", F.char_length("line").alias("n"), line_key(F.col("line")).alias("line_hash"))
    spread = materialise(spread_lines(docs, min_sites), "spread-lines")
    places = lines.join(spread, "line_hash")
    if not spare_copies:
        return places.groupBy("doc_id", "row").agg(F.collect_set("line_hash").alias("hashes"))
    # Rows that repeat an id and a text hold the same places: one counts.
    own = places.groupBy("doc_id", "row", "pos").agg(F.first("n").alias("n"), F.first("chars").alias("chars"), F.first("line_hash").alias("line_hash"))
    found = own.groupBy("doc_id", "row").agg(F.collect_set("line_hash").alias("hashes"), F.sum("n").alias("n"), F.max("chars").alias("chars"), F.min("line_hash").alias("least"))
    found = materialise(found, "spread-places")
    copies = found.where(F.col("n") >= COPIED * F.col("chars"))
    first = copies.groupBy("least").agg(F.count("*").alias("docs"), F.max_by("hashes", F.struct("n", -F.col("doc_id"), "row")).alias("most")).where("docs > 1")
    # A row for each class, written first, so that Spark knows its size.
    first = materialise(first.select("least", "most"), "copy-classes")
    alike = F.size(F.array_intersect("hashes", "most")) >= ALIKE * F.size(F.array_union("hashes", "most"))
    kept = (F.col("n") >= COPIED * F.col("chars")) & F.coalesce(alike, F.lit(False))
    return found.join(first, "least", "left").where(~kept).select("doc_id", "row", "hashes")


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, spare_copies: bool = False) -> DataFrame:
    """``docs`` with its texts freed of boilerplate, and n_lines, n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    free = unused(docs.columns)
    hashes, kept = f"{free}hashes", f"{free}kept"
    found = boilerplate(docs, min_sites, spare_copies).select(F.col("doc_id").alias(f"{free}id"), F.col("row").alias(f"{free}row"), F.col("hashes").alias(hashes))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(f"{free}id")) & (F.xxhash64(docs["text"]) == F.col(f"{free}row")), "left").drop(f"{free}id", f"{free}row")
    lines = lines_of(F.col("text"))
    rest = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(hashes), line_key(x)))
    joined = joined.withColumn(kept, F.when(F.col(hashes).isNotNull(), rest)).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    removed = F.when(F.col(kept).isNotNull(), F.col("n_lines") - F.size(kept)).otherwise(0).cast("long")
    joined = joined.withColumn("n_removed", removed).withColumn("text", F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")))
    return joined.drop(hashes, kept)


def with_length(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where it has such a column, as long as the text is now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
