"""Rating tables: floors, shrunk location ratings, identifiability, data-quality shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.functions.scalar import borderline, code_class, lookup, not_blank, pinned_verdict, signal_of, verdict
from rosterspark.operators.relational import ranked, require_none


def floors(board: DataFrame, support: DataFrame, ident: str, least: float, games: int = 0) -> DataFrame:
    """Leaderboard rows with enough support and games, ranked from 1 by ``total``."""
    kept = board.join(support, ident).where((F.col("support") >= least) & (F.col("n_games") >= games))
    return ranked(kept, [F.desc("total"), F.asc(ident)]).withColumn("rank", F.col("rank").cast("int"))


def long_ratings(coefs: DataFrame, ident: str, least_support: float = 150.0) -> DataFrame:
    """(ident, bucket, end, value, prior, deviation, support, reliable): both ends of each
    bucket's coefficients, with a good defence positive."""
    ends = [F.struct(F.lit(e).alias("end"), (sign * F.col(f"{e}_beta")).alias("value"), (sign * F.col(f"{e}_prior")).alias("prior"), F.col(f"{e}_support").alias("support")) for e, sign in (("off", 1), ("def", -1))]
    long = coefs.select(ident, "bucket", F.explode(F.array(*ends)).alias("x")).select(ident, "bucket", "x.*")
    return long.withColumn("deviation", F.col("value") - F.col("prior")).withColumn("reliable", F.col("support") >= least_support)


def require_priors(long: DataFrame, board: DataFrame, ident: str, tolerance: float = 1e-4) -> None:
    """Each prior must be the leaderboard's rating of its end."""
    rated = long.join(board, ident).withColumn("wanted", F.when(F.col("end") == "off", F.col("offence")).otherwise(F.col("defence")))
    require_none(rated.where(F.abs(F.col("prior") - F.col("wanted")) > tolerance), "prior differs from the leaderboard")


def identifiability(rows: DataFrame, long: DataFrame, corrs: DataFrame, pins: dict[str, str] | None = None) -> DataFrame:
    """Per bucket, whether its ratings can be told from noise.

    ``rows`` (bucket, y, w) is the design, ``long`` (id, bucket, deviation) the ratings,
    ``corrs`` (bucket, corr_off, corr_def) the unshrunk fit's agreement with the overall
    ratings. The noise is the weighted deviation of y over the root of the attempts a
    player; pinned verdicts win.
    """
    mean = F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w"))
    spread = F.sqrt(F.greatest(F.try_divide(F.sum(F.col("w") * F.col("y") * F.col("y")), F.sum("w")) - mean * mean, F.lit(0.0)))
    design = rows.groupBy("bucket").agg(F.sum("w").alias("attempts"), spread.alias("y_sd"))
    dev = long.groupBy("bucket").agg(F.stddev_pop("deviation").alias("dev_sd"), F.countDistinct("id").alias("players"))
    joined = design.join(dev, "bucket").join(corrs, "bucket", "left").withColumn("s", signal_of(F.col("corr_off"), F.col("corr_def")))
    pin = lookup(F.col("bucket"), pins or {}, None).cast("string")
    joined = joined.withColumn("att_per_player", F.try_divide("attempts", "players"))
    norm = F.try_divide("dev_sd", F.try_divide("y_sd", F.sqrt("att_per_player")))
    joined = joined.withColumn("p", pinned_verdict(verdict(F.col("s.signal")), pin))
    return joined.select("bucket", "attempts", "att_per_player", "y_sd", "dev_sd", norm.alias("dev_norm"), "s.signal", "s.driver", "s.right_sign", borderline(F.col("s.signal")).alias("borderline"), "p.verdict", "p.drifted")


def composite(long: DataFrame, shares: DataFrame) -> DataFrame:
    """(id, composite): each player's ratings of all buckets by the buckets' shares of
    attempts; a bucket without a signal counts with its prior."""
    total = shares.agg(F.sum("w").alias("_all"))
    weights = shares.groupBy("bucket").agg(F.sum("w").alias("_w")).crossJoin(F.broadcast(total))  # a single row
    effect = F.when(F.col("verdict") == "NONE", F.col("prior")).otherwise(F.col("value"))
    return long.join(weights, "bucket", "left").groupBy("id").agg(F.sum(effect * F.coalesce(F.try_divide("_w", "_all"), F.lit(0.0))).alias("composite"))


def bucket_rows(shots: DataFrame, index: DataFrame, offence: str, defence: str, size: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bucket, offence, defence, attempts, y): shots of each bucket by both lineups, with
    points per hundred attempts. Lineups must have ``size`` different players whom
    ``index`` knows; their order does not matter."""
    sides = shots.select("shot", F.explode(F.array(F.struct(F.lit("o").alias("side"), F.col(offence).alias("five")), F.struct(F.lit("d").alias("side"), F.col(defence).alias("five")))).alias("s"))
    named = sides.select("shot", "s.side", F.explode("s.five").alias("player")).join(index.select("player"), "player").distinct()
    fives = named.groupBy("shot", "side").agg(F.array_sort(F.collect_set("player")).alias("five")).where(F.size("five") == size)
    both = fives.groupBy("shot").agg(F.max(F.when(F.col("side") == "o", F.col("five"))).alias("o"), F.max(F.when(F.col("side") == "d", F.col("five"))).alias("d")).where("o IS NOT NULL AND d IS NOT NULL")
    full = (F.size(offence) == size) & (F.size(defence) == size)
    met = shots.where(full & F.col("bucket").isNotNull()).join(both, "shot")
    agg = met.groupBy(*by, "bucket", F.col("o").alias("offence"), F.col("d").alias("defence")).agg(F.count("*").alias("attempts"), F.sum("points").alias("points"))
    return agg.select(*by, "bucket", "offence", "defence", "attempts", (100.0 * F.col("points") / F.col("attempts")).alias("y"))


def common_support(df: DataFrame, coverages: list[str], least: float = 0.85) -> DataFrame:
    """Rows that every arm covers well enough."""
    return df.where(F.least(*[F.coalesce(F.col(c), F.lit(0.0)) for c in coverages]) >= least) if len(coverages) > 1 else df.where(F.coalesce(F.col(coverages[0]), F.lit(0.0)) >= least)


def require_predictor(df: DataFrame, x: str, coverage: str, least: float = 0.5) -> DataFrame:
    """(coverage, sd) of a predictor; raises where ids do not meet: too few rows are rated,
    or every row has one value."""
    found = df.agg(F.avg(coverage).alias("coverage"), F.stddev_pop(x).alias("sd"))
    require_none(found.where((F.col("coverage") < least) | (F.col("sd") == 0)), "predictor without ratings or without spread")
    return found


def recomputed(df: DataFrame, by: list[str], supplied: str, own: Column) -> DataFrame:
    """Per group: rows, rows whose supplied value differs from the own one, and by how much at most."""
    far = F.abs(F.col(supplied) - own)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(far > 1e-9).alias("n_off"), F.max(far).alias("worst"))


def attribution_split(df: DataFrame, by: list[str], code: Column, actor: Column, valid: Column) -> DataFrame:
    """Of the rows flagged invalid: how many by class of code and whether an actor is named."""
    bad = df.where(~F.coalesce(valid, F.lit(False)))
    who = F.when(not_blank(actor), "named").otherwise("team")
    return bad.groupBy(*by, code_class(code).alias("code_class"), who.alias("actor")).agg(F.count("*").alias("n"))


def coordinate_integrity(df: DataFrame, by: list[str], is_three: Column, x: Column, y: Column, inside: float = 660.0, beyond: float = 675.0) -> DataFrame:
    """Per group: rows, share without coordinates, of threes inside the arc, of twos beyond
    it, and of either; and the farthest shot."""
    r = F.hypot(x, y)
    wrong = (is_three & (r < inside)) | (~is_three & (r > beyond))
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), share(x.isNull() | y.isNull()).alias("no_coordinates"), share(F.when(is_three, r < inside)).alias("three_inside"), share(F.when(~is_three, r > beyond)).alias("two_beyond"), share(wrong).alias("wrong"), F.max(r).alias("farthest"))


def lineup_shares(df: DataFrame, by: list[str], home: Column, away: Column, valid: Column, size: int = 5) -> DataFrame:
    """Per group: shares of rows whose lineups are full, flagged valid, and empty."""
    full = (F.size(F.array_distinct(home)) == size) & (F.size(F.array_distinct(away)) == size)
    empty = (F.coalesce(F.size(home), F.lit(0)) <= 0) | (F.coalesce(F.size(away), F.lit(0)) <= 0)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), share(full).alias("full"), share(valid).alias("valid"), share(empty).alias("empty"))


def orientation(df: DataFrame, actor: Column, home: Column, away: Column) -> DataFrame:
    """``df`` with ``side``: which of the two lineups holds the actor; null for neither or both."""
    a, b = F.coalesce(F.array_contains(home, actor), F.lit(False)), F.coalesce(F.array_contains(away, actor), F.lit(False))
    return df.withColumn("side", F.when(a & ~b, "home").when(b & ~a, "away"))
