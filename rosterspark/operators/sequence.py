"""Operators on ordered event logs: segments, trip ends, possessions.

Each works per game on rows in the order of ``order`` by window functions; all use
the same window, so a log is shuffled and sorted once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Log:
    """Names of a log's columns."""

    game: tuple[str, ...] = ("game",)
    order: str = "n"
    team: str = "team"
    code: str = "code"

    @property
    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.game).orderBy(self.order)

    @property
    def so_far(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Codes:
    """What the codes of a log mean."""

    made: tuple[str, ...]
    turnover: tuple[str, ...]
    defensive_rebound: tuple[str, ...]
    free_throw_made: tuple[str, ...]
    free_throw: tuple[str, ...]
    period_end: tuple[str, ...]
    neutral: tuple[str, ...]


def segment_ids(df: DataFrame, keys: list[Column], log: Log = Log(), name: str = "stint_id") -> DataFrame:
    """Numbers maximal runs of rows whose keys all stay the same, from 0."""
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~k.eqNullSafe(F.lag(k).over(log.rows))
    first = F.row_number().over(log.rows) == 1
    df = df.withColumn("_step", F.when(first, 0).otherwise(changed.cast("int")))
    return df.withColumn(name, F.sum("_step").over(log.so_far)).drop("_step")


def trip_end(codes: Codes, log: Log = Log()) -> Column:
    """A made free throw ends its trip unless the next row is a free throw too."""
    code = F.col(log.code)
    following = F.lead(log.code).over(log.rows)
    return code.isin(*codes.free_throw_made) & F.coalesce(~following.isin(*codes.free_throw), F.lit(True))


def possession_ends(df: DataFrame, teams: tuple[Column, Column], codes: Codes, log: Log = Log()) -> DataFrame:
    """``df`` with ``ends`` (the row ends a possession) and ``credited`` (whose it was).

    A made goal, a turnover and the end of a trip end the team's own possession, a
    defensive rebound the other team's, the end of a period that of whoever has the
    ball: the team after the last end in the period, else the first team with a
    non-neutral row. A made goal and its free throw count twice. Rows that end a
    possession must name a team.
    """
    code, team = F.col(log.code), F.col(log.team)
    a, b = teams
    other = F.when(team == a, b).when(team == b, a)
    df = df.withColumn("_trip", trip_end(codes, log))
    own = code.isin(*codes.made, *codes.turnover) | F.col("_trip")
    stolen, period = code.isin(*codes.defensive_rebound), code.isin(*codes.period_end)
    df = df.withColumn("_end", own | stolen | period)
    df = df.withColumn("_own", F.when(own, team).when(stolen, other)).withColumn("_after", F.when(own, other).when(stolen, team))
    df = df.withColumn("_seed", F.when(~code.isin(*codes.neutral, *codes.period_end) & (F.coalesce(team, F.lit("")) != ""), team))
    df = df.withColumn("_period", F.coalesce(F.sum(period.cast("int")).over(log.rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy(*log.game, "_period").orderBy(log.order).rowsBetween(Window.unboundedPreceding, 0)
    holder = F.coalesce(F.last("_after", ignorenulls=True).over(within), F.first("_seed", ignorenulls=True).over(within))
    df = df.withColumn("credited", F.when(period, holder).when(F.col("_end"), F.col("_own")))
    return df.withColumn("ends", F.col("_end") & F.col("credited").isNotNull()).drop("_trip", "_end", "_own", "_after", "_seed", "_period")


def home_team(df: DataFrame, actor: str, lineup: str, log: Log = Log()) -> DataFrame:
    """Per game, the team whose actors are most often in ``lineup``; of equals the one
    that got a vote first. A game without votes has no row."""
    named = (F.coalesce(F.col(log.team), F.lit("")) != "") & (F.coalesce(F.col(actor).cast("string"), F.lit("")) != "")
    votes = df.where(named & F.array_contains(F.col(lineup), F.col(actor))).groupBy(*log.game, log.team)
    votes = votes.agg(F.count("*").alias("votes"), F.min(log.order).alias("seen"))
    return votes.groupBy(*log.game).agg(F.max_by(log.team, F.struct("votes", -F.col("seen"))).alias("home_team"), F.max("votes").alias("votes"))


def aggregate_segments(df: DataFrame, home: Column, points: Column, is_three: Column, log: Log = Log(), segment: str = "stint_id") -> DataFrame:
    """Points, threes, other points and possessions of both sides in each segment."""
    is_home = F.col(log.team) == home
    sides = (("home", is_home, F.col("credited") == home), ("away", ~is_home, F.col("credited") != home))
    out = []
    for side, scores, has in sides:
        out += [
            F.coalesce(F.sum(F.when(scores, points)), F.lit(0.0)).alias(f"{side}_pts"),
            F.coalesce(F.sum(F.when(scores & is_three, 1)), F.lit(0)).alias(f"{side}_3pa"),
            F.coalesce(F.sum(F.when(scores & ~is_three, points)), F.lit(0.0)).alias(f"{side}_non3_pts"),
            F.coalesce(F.sum(F.when(F.col("ends") & has, 1)), F.lit(0)).alias(f"{side}_poss"),
        ]
    agg = df.groupBy(*log.game, segment).agg(*out)
    return agg.withColumn("poss", (F.col("home_poss") + F.col("away_poss")) / 2).withColumn("margin", F.col("home_pts") - F.col("away_pts"))


def expected_points(df: DataFrame, rates: DataFrame, season: str, rate: str, non3: str, threes: str, name: str) -> DataFrame:
    """Points with each three at its season's rate; null where the season has none."""
    return df.join(rates.select(season, rate), season, "left").withColumn(name, F.col(non3) + 3 * F.col(threes) * F.col(rate))
