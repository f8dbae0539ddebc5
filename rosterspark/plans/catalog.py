"""Named queries over the driver's tables, with the SQL that must agree.

None of the tables holds basketball, so each query applies an operator to columns
that play the same part: users stand for games, event types for play codes,
suppliers of an order for a lineup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.functions import arrays, scalar
from rosterspark.operators import evaluate, krylov, relational, ridge, sequence, similarity, spread
from rosterspark.sources import scratch

CODES = sequence.Codes(("MADE",), ("TO",), ("D",), ("FTM",), ("FTM", "FTA"), ("EP",), ("EP", "NEUTRAL"))
LOG = sequence.Log()
FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lng(c):
    return c.cast("long")


LOG_SQL = """log AS (SELECT user_id AS game, event_id AS n, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS team,
  CASE event_type WHEN 'signup' THEN 'EP' WHEN 'purchase' THEN 'MADE' WHEN 'error' THEN 'TO' WHEN 'click' THEN 'D' ELSE 'NEUTRAL' END AS code,
  event_type, value FROM events)"""
WALK_SQL = f"""{LOG_SQL},
w0 AS (SELECT *, CASE WHEN team = 'A' THEN 'B' ELSE 'A' END AS other,
  coalesce(sum(CASE WHEN code = 'EP' THEN 1 ELSE 0 END) OVER (PARTITION BY game ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS per FROM log),
w1 AS (SELECT *, CASE WHEN code IN ('MADE', 'TO') THEN other WHEN code = 'D' THEN team END AS aft,
  CASE WHEN code IN ('MADE', 'TO') THEN team WHEN code = 'D' THEN other END AS own,
  CASE WHEN code NOT IN ('EP', 'NEUTRAL') THEN team END AS seed FROM w0),
w2 AS (SELECT *, last_value(aft IGNORE NULLS) OVER p AS la, first_value(seed IGNORE NULLS) OVER p AS fs FROM w1
  WINDOW p AS (PARTITION BY game, per ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
walk AS (SELECT game, n, team, code, event_type, value, CASE WHEN code = 'EP' THEN coalesce(la, fs) ELSE own END AS credited FROM w2)"""
STINT_SQL = """seg0 AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY game ORDER BY n) IS DISTINCT FROM event_type
  AND lag(n) OVER (PARTITION BY game ORDER BY n) IS NOT NULL THEN 1 ELSE 0 END AS step FROM walk),
seg AS (SELECT *, CAST(sum(step) OVER (PARTITION BY game ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stint_id FROM seg0)"""


def log_of(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"signup": "EP", "purchase": "MADE", "error": "TO", "click": "D"}
    code = scalar.lookup(F.col("event_type"), kinds, "NEUTRAL")
    team = F.when(F.col("event_id") % 2 == 0, "A").otherwise("B")
    return t(spark, d, "events").select(F.col("user_id").alias("game"), F.col("event_id").alias("n"), team.alias("team"), code.alias("code"), "event_type", "value")


def walk_of(spark: SparkSession, d: str) -> DataFrame:
    return sequence.possession_ends(log_of(spark, d), (F.lit("A"), F.lit("B")), CODES)


def lineups(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of each order, in order; they stand for lineups."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("five"), F.sum("l_quantity").alias("w"), F.sum("l_extendedprice").alias("y"))
    return lines.select(F.col("l_orderkey").alias("okey"), "five", "w", "y")


LINEUP_SQL = "lu AS (SELECT l_orderkey AS okey, list(l_suppkey ORDER BY l_suppkey) AS five FROM lineitem GROUP BY 1)"


@query("""SELECT CAST(year(ts) * 100 + month(ts) AS BIGINT) AS ym, count(*) FILTER (event_type = 'purchase') AS made, count(*) AS attempts,
  round(count(*) FILTER (event_type = 'purchase') * 100.0 / count(*), 6) AS pct FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1""")
def league_rate(spark, d):
    e = t(spark, d, "events").where(F.col("event_type").isin("purchase", "click"))
    made = F.count_if(F.col("event_type") == "purchase")
    e = e.groupBy((F.year("ts") * 100 + F.month("ts")).cast("long").alias("ym")).agg(made.alias("made"), F.count("*").alias("attempts"))
    return e.withColumn("pct", F.round(scalar.ratio(F.col("made"), F.col("attempts"), 100.0), 6))


@query(f"WITH {LINEUP_SQL} SELECT okey, len(list_distinct(five)) AS n_distinct FROM lu WHERE len(five) >= 3 AND len(list_distinct(five)) = len(five)")
def clean_view(spark, d):
    lu = lineups(spark, d).where((F.size("five") >= 3) & (arrays.distinct_size(F.col("five")) == F.size("five")))
    return lu.select("okey", F.size("five").cast("long").alias("n_distinct"))


@query("""SELECT o_orderkey, o_orderstatus FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS v,
  CASE WHEN o_custkey % 3 = 0 THEN '  ' ELSE 'x' END AS id FROM orders) WHERE v = TRUE OR nullif(trim(id), '') IS NULL""")
def poss_view(spark, d):
    v = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    ident = F.when(F.col("o_custkey") % 3 == 0, "  ").otherwise("x")
    return t(spark, d, "orders").where((v == F.lit(True)) | F.nullif(F.trim(ident), F.lit("")).isNull()).select("o_orderkey", "o_orderstatus")


@query(f"WITH {WALK_SQL}, {STINT_SQL} SELECT game, n, stint_id FROM seg")
def stint_ids(spark, d):
    return sequence.segment_ids(log_of(spark, d), [F.col("event_type")]).select("game", "n", lng(F.col("stint_id")).alias("stint_id"))


@query("""WITH f AS (SELECT user_id AS game, event_id AS n, CASE event_type WHEN 'purchase' THEN 'FTM' WHEN 'click' THEN 'FTA' ELSE 'X' END AS code FROM events)
SELECT game, n, code = 'FTM' AND coalesce(lead(code) OVER (PARTITION BY game ORDER BY n) NOT IN ('FTM', 'FTA'), TRUE) AS trip_end FROM f""")
def lead_trip_end(spark, d):
    log = log_of(spark, d).withColumn("code", scalar.lookup(F.col("event_type"), {"purchase": "FTM", "click": "FTA"}, "X"))
    return log.select("game", "n", sequence.trip_end(CODES).alias("trip_end"))


@query(f"WITH {WALK_SQL} SELECT game, n, credited FROM walk WHERE credited IS NOT NULL")
def possession_walk(spark, d):
    return walk_of(spark, d).where("ends").select("game", "n", "credited")


@query(f"""WITH {WALK_SQL}, {STINT_SQL} SELECT game, stint_id,
  round(coalesce(sum(value) FILTER (team = 'A'), 0), 4) AS home_pts, round(coalesce(sum(value) FILTER (team <> 'A'), 0), 4) AS away_pts,
  count(*) FILTER (team = 'A' AND code = 'MADE') AS home_3pa, count(*) FILTER (team <> 'A' AND code = 'MADE') AS away_3pa,
  count(*) FILTER (credited = 'A') AS home_poss, count(*) FILTER (credited <> 'A') AS away_poss, count(*) FILTER (credited IS NOT NULL) / 2.0 AS poss
  FROM seg GROUP BY 1, 2""")
def stint_aggregate(spark, d):
    seg = sequence.segment_ids(walk_of(spark, d), [F.col("event_type")])
    agg = sequence.aggregate_segments(seg, F.lit("A"), F.col("value"), F.col("code") == "MADE")
    ints = ["home_3pa", "away_3pa", "home_poss", "away_poss"]
    return agg.select("game", lng(F.col("stint_id")).alias("stint_id"), F.round("home_pts", 4).alias("home_pts"), F.round("away_pts", 4).alias("away_pts"), *[lng(F.col(c)).alias(c) for c in ints], "poss")


@query("""WITH v AS (SELECT user_id AS game, CASE WHEN event_id % 3 = 0 THEN 'A' WHEN event_id % 3 = 1 THEN 'B' ELSE '' END AS team, event_id AS n, event_type FROM events),
g AS (SELECT game, team, count(*) AS votes, min(n) AS seen FROM v WHERE team <> '' AND event_type IN ('click', 'view') GROUP BY 1, 2)
SELECT game, team AS home_team, votes FROM g QUALIFY row_number() OVER (PARTITION BY game ORDER BY votes DESC, seen) = 1""")
def home_vote(spark, d):
    k = F.col("n") % 3
    log = log_of(spark, d).withColumn("team", F.when(k == 0, "A").when(k == 1, "B").otherwise("")).withColumn("five", F.array(F.lit("click"), F.lit("view")))
    return sequence.home_team(log, "event_type", "five").select("game", "home_team", "votes")


@query("""WITH r AS (SELECT CAST(month(ts) AS BIGINT) AS season, count(*) FILTER (event_type = 'purchase') * 1.0 / count(*) AS rate FROM events WHERE event_type IN ('purchase', 'click') AND month(ts) <> 2 GROUP BY 1),
g AS (SELECT CAST(month(ts) AS BIGINT) AS season, user_id, sum(value) AS non3, count(*) FILTER (event_type = 'click') AS threes FROM events GROUP BY 1, 2)
SELECT g.season, user_id, round(non3 + 3 * threes * rate, 4) AS xpts FROM g LEFT JOIN r USING (season)""")
def expected_points(spark, d):
    e = t(spark, d, "events").withColumn("season", F.month("ts").cast("long"))
    known = e.where(F.col("event_type").isin("purchase", "click") & (F.col("season") != 2))
    rates = known.groupBy("season").agg(F.avg((F.col("event_type") == "purchase").cast("double")).alias("rate"))
    games = e.groupBy("season", "user_id").agg(F.sum("value").alias("non3"), F.count_if(F.col("event_type") == "click").alias("threes"))
    return sequence.expected_points(games, rates, "season", "rate", "non3", "threes", "x").select("season", "user_id", F.round("x", 4).alias("xpts"))


@query(f"""WITH {LINEUP_SQL}, m AS (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 <> 0),
x AS (SELECT okey, unnest(five) AS s, generate_subscripts(five, 1) AS p FROM lu)
SELECT okey, string_agg(coalesce(s_name, '?'), ',' ORDER BY p) AS names, count(*) FILTER (s_name IS NULL) AS unmapped FROM x LEFT JOIN m ON s = s_suppkey GROUP BY 1""")
def list_remap(spark, d):
    known = t(spark, d, "supplier").where("s_suppkey % 4 <> 0")
    out = arrays.remap_list(lineups(spark, d), "five", known, "s_suppkey", "s_name")
    names = F.array_join(F.transform("five", lambda x: F.coalesce(x, F.lit("?"))), ",")
    return out.select("okey", names.alias("names"), lng(F.size(F.filter("five", lambda x: x.isNull()))).alias("unmapped"))


@query("""WITH x AS (SELECT l_orderkey AS okey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS sgn FROM lineitem)
SELECT okey, round(sum(sgn * coalesce(s_acctbal, 0)), 2) AS x, round(avg(CASE WHEN s_acctbal IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM x LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) ON l_suppkey = s_suppkey GROUP BY 1""")
def lineup_rating_sum(spark, d):
    li = t(spark, d, "lineitem")
    sides = li.groupBy(F.col("l_orderkey").alias("okey")).agg(*[F.collect_list(F.when(c, F.col("l_suppkey"))).alias(n) for n, c in (("home", F.col("l_linestatus") == "O"), ("away", F.col("l_linestatus") != "O"))])
    known = t(spark, d, "supplier").where("s_suppkey % 5 <> 0")
    out = evaluate.rating_sum(sides, "home", "away", known, "s_suppkey", "s_acctbal")
    return out.select("okey", F.round("x", 2).alias("x"), F.round("coverage", 6).alias("coverage"))


@query("""WITH lu AS (SELECT o_orderkey AS okey, year(o_orderdate) AS season, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS n FROM orders),
it AS (SELECT l_orderkey AS okey, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS p FROM lineitem WHERE l_linestatus = 'O'),
m AS (SELECT s_suppkey, y AS season, s_name || '/' || y AS name FROM supplier, range(1992, 1999) r(y) WHERE (s_suppkey + y) % 4 <> 0)
SELECT lu.okey, CASE WHEN okey % 7 = 0 THEN -1 ELSE any_value(n) END AS n_places, CASE WHEN okey % 7 = 0 THEN NULL ELSE coalesce(string_agg(coalesce(name, '?'), ',' ORDER BY p) FILTER (p IS NOT NULL), '') END AS names
FROM lu LEFT JOIN it USING (okey) LEFT JOIN m ON s = s_suppkey AND m.season = lu.season GROUP BY lu.okey""")
def season_remap(spark, d):
    """Lists by name and season; an order may have no list, an empty one, or names unknown in its season."""
    five = t(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("okey")).agg(F.array_sort(F.collect_list("l_suppkey")).alias("five"))
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("okey"), F.year("o_orderdate").alias("season")).join(five, "okey", "left")
    rows = rows.withColumn("five", F.when(F.col("okey") % 7 != 0, F.coalesce("five", F.array().cast("array<bigint>"))))
    known = t(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1992), F.lit(1998))).alias("season"), "s_name").where("(s_suppkey + season) % 4 <> 0")
    known = known.withColumn("name", F.concat_ws("/", "s_name", "season"))
    out = arrays.remap_list(rows, "five", known, "s_suppkey", "name", ["season"])
    names = F.array_join(F.transform("five", lambda x: F.coalesce(x, F.lit("?"))), ",")
    return out.select("okey", F.coalesce(F.size("five"), F.lit(-1)).cast("long").alias("n_places"), names.alias("names"))


@query("""WITH x AS (SELECT o_orderkey AS okey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS sgn FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 1)
SELECT okey, round(coalesce(sum(sgn * coalesce(s_acctbal, 0)) FILTER (l_suppkey IS NOT NULL), 0), 2) AS x, round(coalesce(avg(CASE WHEN s_acctbal IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (l_suppkey IS NOT NULL), 0), 6) AS coverage
FROM x LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) ON l_suppkey = s_suppkey GROUP BY 1""")
def rating_sum_of_all(spark, d):
    """Orders whose lineups are null or empty stay, with 0."""
    li = t(spark, d, "lineitem").where("l_linenumber > 1")
    sides = li.groupBy(F.col("l_orderkey").alias("okey")).agg(*[F.collect_list(F.when(c, F.col("l_suppkey"))).alias(n) for n, c in (("home", F.col("l_linestatus") == "O"), ("away", F.col("l_linestatus") != "O"))])
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("okey")).join(sides, "okey", "left")
    out = evaluate.rating_sum(rows, "home", "away", t(spark, d, "supplier").where("s_suppkey % 5 <> 0"), "s_suppkey", "s_acctbal")
    return out.select("okey", (F.round("x", 2) + 0.0).alias("x"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {LINEUP_SQL} SELECT count(*) AS n, count(*) FILTER (len(five) = 4 AND len(list_distinct(five)) = 4) AS kept, count(*) FILTER (NOT (len(five) = 4 AND len(list_distinct(five)) = 4)) AS dropped FROM lu")
def distinct_guard(spark, d):
    ok = arrays.is_full_lineup(F.col("five"), 4)
    return lineups(spark, d).agg(F.count("*").alias("n"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


SHOT_SQL = """sh AS (SELECT vec_id, CASE label % 6 WHEN 0 THEN '3FGM' WHEN 1 THEN '2FGA' WHEN 2 THEN 'LAYUPMD' WHEN 3 THEN 'FTM' WHEN 4 THEN '3FGA' ELSE '2FGM' END AS act, label = 4 AS fb, label = 7 AS sc,
  CASE WHEN vec_id % 11 <> 0 THEN CAST(embedding[1] AS DOUBLE) * 3000 END AS x, CAST(embedding[2] AS DOUBLE) * 1500 AS y FROM embeddings)"""


def bucket_sql(rim: str = "<=", always: bool = True, depth: int = 220) -> str:
    near = f"coalesce(sqrt(x * x + y * y) {rim} 200, FALSE)"
    at_rim = f"(act = 'LAYUPMD' OR {near})" if always else near
    return f"""CASE WHEN act = 'FTM' THEN NULL WHEN fb THEN 'transition' WHEN sc THEN 'second_chance'
  WHEN act LIKE '3%' THEN CASE WHEN coalesce(abs(x) >= 660 AND y <= {depth}, FALSE) THEN 'corner_three' ELSE 'above_break_three' END WHEN {at_rim} THEN 'at_rim' ELSE 'mid_range' END"""


def shots_of(spark, d):
    names = {0: "3FGM", 1: "2FGA", 2: "LAYUPMD", 3: "FTM", 4: "3FGA"}
    e = t(spark, d, "embeddings")
    x = F.when(F.col("vec_id") % 11 != 0, F.get("embedding", 0).cast("double") * 3000)
    return e.select("vec_id", scalar.lookup(F.col("label") % 6, names, "2FGM").alias("act"), (F.col("label") == 4).alias("fb"), (F.col("label") == 7).alias("sc"), x.alias("x"), (F.get("embedding", 1).cast("double") * 1500).alias("y"))


def bucket_of(**rules):
    return scalar.shot_bucket(F.col("act"), F.col("fb"), F.col("sc"), F.col("x"), F.col("y"), **rules)


@query(f"WITH {SHOT_SQL} SELECT vec_id, {bucket_sql()} AS bucket FROM sh")
def shot_classify(spark, d):
    return shots_of(spark, d).select("vec_id", bucket_of().alias("bucket"))


RULES = {f"depth{p}_{'le' if i else 'lt'}_{'always' if a else 'coords'}": (p, i, a) for p in (220, 225) for i in (True, False) for a in (True, False)}


@query(f"""WITH {SHOT_SQL}, b AS (SELECT *, {bucket_sql()} AS stored FROM sh), r AS ({' UNION ALL '.join(f"SELECT '{k}' AS rule, avg(CASE WHEN stored IS NOT DISTINCT FROM ({bucket_sql('<=' if i else '<', a, p)}) THEN 1.0 ELSE 0.0 END) AS agreement FROM b" for k, (p, i, a) in RULES.items())})
SELECT rule, round(agreement, 6) AS agreement, agreement = max(agreement) OVER () AS tied_best FROM r""")
def rule_recovery(spark, d):
    df = shots_of(spark, d).withColumn("stored", bucket_of())
    rules = {k: bucket_of(corner_y=float(p), rim_inclusive=i, rim_always=a) for k, (p, i, a) in RULES.items()}
    out = evaluate.rule_agreement(df, "stored", rules)
    return out.select("rule", F.round("agreement", 6).alias("agreement"), "tied_best")


@query("""WITH f AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' - ' WHEN 3 THEN 'None' WHEN 4 THEN '0.5' WHEN 5 THEN '1' WHEN 6 THEN 'true' WHEN 7 THEN '0.0' ELSE ' Yes' END AS raw FROM events)
SELECT event_id, CASE WHEN raw IS NULL OR trim(raw) IN ('', '-', 'None') THEN FALSE WHEN try_cast(trim(raw) AS DOUBLE) IS NOT NULL THEN trunc(try_cast(trim(raw) AS DOUBLE)) <> 0 ELSE lower(trim(raw)) IN ('true', 'y', 'yes') END AS flag FROM f""")
def flag_parse(spark, d):
    raw = scalar.lookup(F.col("event_id") % 9, {1: "", 2: " - ", 3: "None", 4: "0.5", 5: "1", 6: "true", 7: "0.0", 8: " Yes"}, None)
    return t(spark, d, "events").select("event_id", scalar.parse_flag(raw.cast("string")).alias("flag"))


@query("""SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 40 + (event_id % 60) / 60.0 END, 6) AS minutes FROM events""")
def minutes_parse(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 10 == 0, "DNP").when(i % 10 == 5, "").otherwise(F.format_string("%02d:%02d", i % 40, i % 60))
    return t(spark, d, "events").select("event_id", F.round(scalar.minutes(raw), 6).alias("minutes"))


@query("""WITH i AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' p00' || c_custkey WHEN 1 THEN '000' || c_custkey WHEN 2 THEN 'Pavd' || c_custkey ELSE 'P' || c_custkey END AS raw FROM customer),
u AS (SELECT c_custkey, upper(trim(raw)) AS u FROM i), v AS (SELECT c_custkey, CASE WHEN regexp_matches(u, '^P[0-9]') THEN substr(u, 2) ELSE u END AS u FROM u),
w AS (SELECT c_custkey, CASE WHEN regexp_matches(u, '^P[A-Z]{2,}') THEN substr(u, 2) ELSE u END AS u FROM v)
SELECT c_custkey, ltrim(u, '0') AS id_norm FROM w""")
def id_normalise(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" p00"), k)).when(k % 4 == 1, F.concat(F.lit("000"), k)).when(k % 4 == 2, F.concat(F.lit("Pavd"), k)).otherwise(F.concat(F.lit("P"), k))
    return t(spark, d, "customer").select("c_custkey", scalar.normal_id(raw).alias("id_norm"))


@query("""SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""")
def modal_value(spark, d):
    return relational.modal_value(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_value(spark, d):
    return relational.latest_value(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderdate", "o_orderkey"])


@query("""SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 5) AS z FROM orders WINDOW w AS (PARTITION BY o_orderstatus)""")
def zscore_by_group(spark, d):
    return relational.z_score(t(spark, d, "orders"), "o_totalprice", ["o_orderstatus"]).select("o_orderkey", F.round("z", 5).alias("z"))


@query("""WITH x AS (SELECT l_returnflag, nullif(l_discount, 0.05) AS v, l_quantity AS w FROM lineitem)
SELECT l_returnflag, round(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 6) AS mean FROM x GROUP BY 1""")
def weighted_mean_skipnull(spark, d):
    v = F.nullif(F.col("l_discount"), F.lit(0.05))
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(relational.weighted_mean(v, F.col("l_quantity")), 6).alias("mean"))


@query("""WITH c AS (SELECT CAST(month(ts) AS BIGINT) AS m, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT m, event_type, n, round(n * 1.0 / sum(n) OVER (PARTITION BY m), 6) AS share FROM c""")
def share_of_group(spark, d):
    e = t(spark, d, "events").withColumn("m", F.month("ts").cast("long"))
    return relational.share_of_group(e, ["m", "event_type"], ["m"]).withColumn("share", F.round("share", 6))


KINDS = ("click", "error", "purchase", "signup", "view")


@query(f"SELECT user_id, {', '.join(f'''count(*) FILTER (event_type = '{k}') AS {k}''' for k in KINDS)} FROM events GROUP BY 1")
def pivot_counts(spark, d):
    return relational.pivot_counts(t(spark, d, "events"), ["user_id"], "event_type", list(KINDS))


PER_ID_SQL = """per AS (SELECT p_brand AS name, p_type || '-' || CAST(p_size % 7 AS VARCHAR) AS id, list_distinct(list(p_size)) AS seasons, list_distinct(list(CAST(p_partkey % 3 AS BIGINT))) AS teams, count(*) AS n_rows FROM part GROUP BY 1, 2)"""


def per_id_of(spark, d):
    p = t(spark, d, "part").withColumn("id", F.concat("p_type", F.lit("-"), (F.col("p_size") % 7).cast("string")))
    per = p.groupBy(F.col("p_brand").alias("name"), "id").agg(F.collect_set("p_size").alias("seasons"), F.collect_set(F.col("p_partkey") % 3).alias("teams"), F.count("*").alias("n_rows"))
    return per.withColumn("id_norm", F.upper("id"))


@query(f"""WITH {PER_ID_SQL}, pr AS (SELECT a.name, bool_or(list_has_any(a.seasons, b.seasons)) AS ov, bool_or(list_has_any(a.teams, b.teams)) AS tm FROM per a JOIN per b ON a.name = b.name AND a.id < b.id GROUP BY 1)
SELECT n.name, n_ids, CASE WHEN norms = 1 THEN 'MERGE_FORMAT' WHEN NOT ov THEN 'MERGE_DISJOINT' WHEN tm THEN 'REVIEW_OVERLAP_SAMETEAM' ELSE 'KEEP_SEPARATE_HOMONYM' END AS verdict
FROM (SELECT name, count(*) AS n_ids, count(DISTINCT upper(id)) AS norms FROM per GROUP BY 1 HAVING count(*) > 1) n LEFT JOIN pr ON n.name = pr.name""")
def collision_triage(spark, d):
    return relational.triage_collisions(per_id_of(spark, d))


@query(f"""WITH {PER_ID_SQL}, r AS (SELECT name, id, first_value(id) OVER (PARTITION BY name ORDER BY n_rows DESC, id) AS to_id FROM per WHERE name < 'Brand#4') SELECT name, id AS from_id, to_id FROM r WHERE id <> to_id""")
def merge_proposal(spark, d):
    per = per_id_of(spark, d)
    label = F.when(F.col("name") < "Brand#3", "MERGE_FORMAT").when(F.col("name") < "Brand#4", "MERGE_DISJOINT").otherwise("KEEP_SEPARATE_HOMONYM")
    return relational.merge_proposal(per, per.select("name", label.alias("verdict")).distinct())


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_missing(spark, d):
    return relational.missing_keys(t(spark, d, "customer"), t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("""WITH o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS season, o_orderkey, o_totalprice FROM orders), nw AS (SELECT season, o_orderkey, round(o_totalprice * 2, 2) AS o_totalprice FROM o WHERE season = (SELECT max(season) FROM o) AND o_orderkey % 2 = 0)
SELECT season, count(*) AS n, round(sum(p), 1) AS total FROM (SELECT season, o_totalprice AS p FROM o WHERE season NOT IN (SELECT season FROM nw) UNION ALL SELECT season, o_totalprice FROM nw) GROUP BY 1""")
def season_splice(spark, d):
    o = t(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("season"), "o_orderkey", "o_totalprice")
    last = o.agg(F.max("season").alias("last"))
    new = o.join(F.broadcast(last), F.col("season") == F.col("last")).where("o_orderkey % 2 = 0").select("season", "o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"))
    return relational.splice(o, new, "season").groupBy("season").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s, NULL AS extra FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'c' || c_custkey, NULL, c_mktsegment FROM customer""")
def union_by_name(spark, d):
    a = t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("k"), F.col("c_mktsegment").alias("extra"))
    return relational.union_by_name([a, b]).select("k", "s", "extra")


@query("""WITH g AS (SELECT 1 + i * 49.0 / 48 AS cut FROM range(49) r(i)), v AS (SELECT l_quantity AS q, l_returnflag = 'A' AS a FROM lineitem),
s AS (SELECT cut, count(*) FILTER ((q < cut) = a) AS up, count(*) FILTER ((q < cut) <> a) AS down, count(*) AS n FROM g, v GROUP BY 1)
SELECT round(cut, 6) AS cut, round(greatest(up, down) * 1.0 / n, 6) AS agreement, up >= down AS a_below FROM s ORDER BY greatest(up, down) DESC, cut LIMIT 1""")
def threshold_search(spark, d):
    out = evaluate.threshold_search(t(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "A", 1.0, 50.0, 49)
    return out.select(F.round("cut", 6).alias("cut"), F.round("agreement", 6).alias("agreement"), "a_below")


@query("""WITH s AS (SELECT l_returnflag, sum(l_tax + 1) sw, sum((l_tax + 1) * l_quantity) sx, sum((l_tax + 1) * l_extendedprice) sy, sum((l_tax + 1) * l_quantity * l_quantity) sxx, sum((l_tax + 1) * l_quantity * l_extendedprice) sxy FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 3) AS slope, round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 2) AS intercept FROM s""")
def wls_fit(spark, d):
    li = t(spark, d, "lineitem").withColumn("w", F.col("l_tax") + 1)
    out = evaluate.weighted_line(li, "l_quantity", "l_extendedprice", "w", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def ols_fit(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return t(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.regr_slope(y, x), 3).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"))


@query("""WITH tr AS (SELECT regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a FROM lineitem WHERE l_orderkey % 4 <> 0),
p AS (SELECT l_extendedprice y, a + b * l_quantity f, l_tax + 1 w FROM lineitem, tr WHERE l_orderkey % 4 = 0), m AS (SELECT sum(w * y) / sum(w) mu FROM p)
SELECT round(sqrt(sum(w * (y - f) * (y - f)) / sum(w)), 2) AS rmse, round(sum(w * abs(y - f)) / sum(w), 2) AS mae, round(1 - sum(w * (y - f) * (y - f)) / sum(w * (y - mu) * (y - mu)), 5) AS r2 FROM p, m""")
def holdout_metrics(spark, d):
    li = t(spark, d, "lineitem").withColumn("w", F.col("l_tax") + 1)
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    line = li.where("l_orderkey % 4 <> 0").agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    test = li.where("l_orderkey % 4 = 0").crossJoin(F.broadcast(line)).withColumn("f", F.col("a") + F.col("b") * x)  # a single row
    out = test.agg(*evaluate.error_metrics(y, F.col("f"), F.col("w")))
    return out.select(F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"), F.round("r2", 5).alias("r2"))


@query("""WITH r AS (SELECT o_totalprice f, o_custkey * 1.0 y, 1.0 + o_orderkey % 3 w, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS bin FROM orders)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(sum(w * f) / sum(w), 3) AS mean_fitted, round(sum(w * y) / sum(w), 4) AS mean_y FROM r GROUP BY 1""")
def calibration_deciles(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("f"), (F.col("o_custkey") * F.lit(1.0)).alias("y"), (1.0 + F.col("o_orderkey") % 3).alias("w"))
    out = evaluate.calibration(o, "f", "y", "w", ["o_orderkey"])
    return out.select("bin", "n", F.round("mean_fitted", 3).alias("mean_fitted"), F.round("mean_y", 4).alias("mean_y"))


@query("""WITH g AS (SELECT o_custkey, avg(o_totalprice) - 150000 AS y, avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) - 150000 AS f FROM orders GROUP BY 1), h AS (SELECT * FROM g WHERE f IS NOT NULL), m AS (SELECT avg(y) mu FROM h)
SELECT round(sqrt(avg((y - f) * (y - f))), 2) AS rmse, round(corr(y, f), 6) AS corr, round(avg(CASE WHEN sign(y) = sign(f) THEN 1.0 ELSE 0.0 END), 6) AS sign_hit, round(1 - sum((y - f) * (y - f)) / sum((y - mu) * (y - mu)), 5) AS r2 FROM h, m""")
def game_eval(spark, d):
    price = F.col("o_totalprice")
    g = t(spark, d, "orders").groupBy("o_custkey").agg((F.avg(price) - 150000).alias("y"), (F.avg(F.when(F.col("o_orderkey") % 2 == 0, price)) - 150000).alias("f")).where("f IS NOT NULL")
    out = g.agg(*evaluate.arm_score(F.col("y"), F.col("f")))
    return out.select(F.round("rmse", 2).alias("rmse"), F.round("corr", 6).alias("corr"), F.round("sign_hit", 6).alias("sign_hit"), F.round("r2", 5).alias("r2"))


DIMS = 64


@query(f"""WITH s AS (SELECT {', '.join(f'avg(embedding[{i}]) m{i}, stddev_samp(CAST(embedding[{i}] AS DOUBLE)) s{i}' for i in range(1, DIMS + 1))} FROM embeddings)
SELECT vec_id, {', '.join(f'round((CAST(embedding[{i}] AS DOUBLE) - m{i}) / s{i}, 4) AS z{i}' for i in range(1, DIMS + 1))} FROM embeddings, s""")
def zscore_vectors(spark, d):
    z = similarity.column_z_scores(wide_of(spark, d), "vec_id", [f"d{i}" for i in range(1, DIMS + 1)])
    return z.select("vec_id", *[F.round(F.get("z", i - 1), 4).alias(f"z{i}") for i in range(1, DIMS + 1)])


def wide_of(spark, d):
    return t(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", i - 1).cast("double").alias(f"d{i}") for i in range(1, DIMS + 1)])


def vectors_of(spark, d):
    return t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def knn_sql(dist: str, asks: str = " WHERE q.vec_id % 100 = 0") -> str:
    return f"""e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT q.vec_id, t.vec_id AS neighbour, {dist} AS distance FROM e q JOIN e t ON q.vec_id <> t.vec_id{asks}),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM p QUALIFY rank <= 10)"""


def neighbours(spark, d, metric):
    v = vectors_of(spark, d)
    return similarity.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "v", 10, metric)


def neighbours_of_all(spark, d, metric):
    """The same with every row as a query, in larger tiles."""
    v = vectors_of(spark, d)
    return similarity.nearest(v, v, "vec_id", "v", 10, metric, similarity.WIDE, similarity.WIDE)


@query(f"WITH {knn_sql('list_distance(q.v, t.v)')} SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 5) AS distance FROM k")
def knn_euclid(spark, d):
    return neighbours(spark, d, "euclid").withColumn("distance", F.round("distance", 5))


@query(f"WITH {knn_sql('1 - list_cosine_similarity(q.v, t.v)')} SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 5) AS distance FROM k")
def knn_cosine(spark, d):
    return neighbours(spark, d, "cosine").withColumn("distance", F.round("distance", 5))


@query(f"""WITH a AS (WITH {knn_sql('list_distance(q.v, t.v)', '')} SELECT vec_id, list(neighbour) l, arg_min(neighbour, rank) f FROM k GROUP BY 1),
b AS (WITH {knn_sql('1 - list_cosine_similarity(q.v, t.v)', '')} SELECT vec_id, list(neighbour) l, arg_min(neighbour, rank) f FROM k GROUP BY 1)
SELECT vec_id, round(len(list_intersect(a.l, b.l)) * 1.0 / len(list_distinct(list_concat(a.l, b.l))), 6) AS jaccard, a.f = b.f AS same_first FROM a JOIN b USING (vec_id)""")
def jaccard_at_k(spark, d):
    return similarity.agreement_at_k(neighbours_of_all(spark, d, "euclid"), neighbours_of_all(spark, d, "cosine"), "vec_id").withColumn("jaccard", F.round("jaccard", 6))


@query("""WITH l AS (SELECT label % 3 AS a, (label + vec_id % 2) % 3 AS b FROM embeddings), c AS (SELECT a, b, count(*) n FROM l GROUP BY 1, 2),
s AS (SELECT sum(n * (n - 1) / 2.0) s, sum(n) n FROM c), x AS (SELECT sum(n * (n - 1) / 2.0) sa FROM (SELECT sum(n) n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2.0) sb FROM (SELECT sum(n) n FROM c GROUP BY b))
SELECT round((s - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)), 6) AS adjusted_rand FROM s, x, y""")
def adjusted_rand(spark, d):
    e = t(spark, d, "embeddings").select((F.col("label") % 3).alias("a"), ((F.col("label") + F.col("vec_id") % 2) % 3).alias("b"))
    return similarity.adjusted_rand(e, "a", "b").select(F.round("adjusted_rand", 6).alias("adjusted_rand"))


@query("""WITH c AS (SELECT o_custkey, avg(o_totalprice) AS v, count(*) AS w FROM orders GROUP BY 1), n AS (SELECT c_nationkey, sum(v * w) / sum(w) AS rating, avg(c_acctbal) AS outcome FROM customer JOIN c ON c_custkey = o_custkey GROUP BY 1)
SELECT count(*) AS n, round(corr(rating, outcome), 5) AS corr FROM n""")
def team_agg_corr(spark, d):
    c = t(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"), F.count("*").alias("w"))
    teams = t(spark, d, "customer").join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(relational.weighted_mean(F.col("v"), F.col("w")).alias("rating"), F.avg("c_acctbal").alias("outcome"))
    return teams.agg(F.count("*").alias("n"), F.round(F.corr("rating", "outcome"), 5).alias("corr"))


@query(f"WITH {LINEUP_SQL} SELECT array_to_string(five, '|') AS lineup, count(*) AS n_orders, count(DISTINCT okey % 7) AS n_groups FROM lu WHERE len(five) >= 2 GROUP BY 1")
def bucket_design(spark, d):
    lu = lineups(spark, d).where(F.size("five") >= 2).select("okey", arrays.lineup_key(F.reverse("five")).alias("key"))
    out = lu.groupBy("key").agg(F.count("*").alias("n_orders"), F.countDistinct(F.col("okey") % 7).alias("n_groups"))
    return out.select(F.array_join("key", "|").alias("lineup"), "n_orders", "n_groups")


@query("""WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), w AS (SELECT l_orderkey, sum(l_quantity) AS w FROM lineitem GROUP BY 1)
SELECT l_suppkey AS player, round(sum(w), 2) AS support, count(*) AS n_rows FROM x JOIN w USING (l_orderkey) GROUP BY 1""")
def player_support(spark, d):
    lu = lineups(spark, d)
    index = ridge.player_index(lu, ["five"])
    triplets = lu.select(F.col("okey").alias("row_id"), F.explode(F.array_distinct("five")).alias("player")).join(F.broadcast(index), "player").select("row_id", "col", F.lit(1.0).alias("value"))
    support = ridge.column_support(triplets, lu.select(F.col("okey").alias("row_id"), "w"))
    return support.join(index, "col").select("player", F.round("support", 2).alias("support"), "n_rows")


def design_of(spark, d):
    """A design of all suppliers; an order stands for a game and is a group of its own."""
    lu = scratch.materialise(lineups(spark, d), "lineups")  # several steps read them
    index = scratch.materialise(ridge.player_index(lu, ["five"]), "players")
    triplets = lu.select(F.col("okey").alias("row_id"), F.explode(F.array_distinct("five")).alias("player")).join(F.broadcast(index), "player").select("row_id", "col", F.lit(1.0).alias("value"))
    rows = lu.select(F.col("okey").alias("row_id"), (F.col("y") / F.col("w") / 100).alias("y"), "w", F.col("okey").alias("grp"))
    return index, triplets, rows, index.count()


def ratings_of(spark, index, beta):
    coefs = spark.createDataFrame([(i, round(float(b), 6)) for i, b in enumerate(beta)], "col int, rating double")
    return index.join(coefs, "col").select("player", "rating")


def prior_of(n):
    import numpy as np

    return np.linspace(-1, 1, n)


@query()
def ridge_ratings(spark, d):
    index, triplets, rows, n = design_of(spark, d)
    beta, _ = ridge.fit(triplets, rows, n, 1000.0)
    return ratings_of(spark, index, beta)


@query()
def ridge_shrunk(spark, d):
    index, triplets, rows, n = design_of(spark, d)
    beta, _ = ridge.fit(triplets, rows, n, 3162.0, prior_of(n))
    return ratings_of(spark, index, beta)


def certificate(spark, index, triplets, rows, n, alpha, mu=None):
    """(player, gradient) at the solution of the conjugate gradients, by joins and sums."""
    beta, b0 = krylov.fits(krylov.pack(triplets, rows, n), krylov.tag_weights([[1.0]]), 1, [alpha], mu)
    coefs = spark.createDataFrame([(i, float(b), 0.0 if mu is None else float(mu[i])) for i, b in enumerate(beta[0, :, 0])], "col int, beta double, mu double")
    found = krylov.gradient(triplets, rows, coefs, float(b0[0, 0]), alpha)
    return found.select("col", (F.round("gradient", 6) + 0.0).alias("gradient"))


@query("SELECT DISTINCT l_suppkey AS player, CAST(0 AS DOUBLE) AS gradient FROM lineitem")
def ridge_gradient(spark, d):
    """The derivative of the ridge's sum at its solution: 0 for every player."""
    index, triplets, rows, n = design_of(spark, d)
    return certificate(spark, index, triplets, rows, n, 1000.0).join(index, "col").select("player", "gradient")


@query("SELECT DISTINCT l_suppkey AS player, CAST(0 AS DOUBLE) AS gradient FROM lineitem")
def shrunk_gradient(spark, d):
    index, triplets, rows, n = design_of(spark, d)
    return certificate(spark, index, triplets, rows, n, 3162.0, prior_of(n)).join(index, "col").select("player", "gradient")


def choice_of(spark, found):
    rows = [(a, round(e, 6), a == found.alpha, found.at_edge) for a, e in found.errors.items()]
    return spark.createDataFrame(rows, "alpha double, error double, chosen boolean, at_edge boolean")


def folded_design(spark, d):
    _, triplets, rows, n = design_of(spark, d)
    return krylov.pack(triplets, ridge.assign_folds(rows, "grp"), n, tag=F.col("fold")), n


@query()
def alpha_cv(spark, d):
    """The penalty by the mean of the folds' mean square errors; folds by order."""
    design, _ = folded_design(spark, d)
    return choice_of(spark, krylov.cross_validate(design, 5, list(ridge.ALPHAS)))


@query()
def shrunk_cv(spark, d):
    """The same for fits that shrink to a prior, by mean root errors; an end of the grid is told."""
    design, n = folded_design(spark, d)
    return choice_of(spark, krylov.cross_validate(design, 5, list(ridge.SHRUNK_ALPHAS), prior_of(n), rmse=True))


@query("SELECT CAST(l_orderkey AS BIGINT) AS grp, 1 AS n_folds FROM lineitem GROUP BY 1")
def game_folds(spark, d):
    _, _, rows, _ = design_of(spark, d)
    found = ridge.assign_folds(rows, "grp")
    return found.groupBy("grp").agg(F.countDistinct("fold").cast("int").alias("n_folds"))


@query("WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT 5 AS n_folds, CAST(sum(n) AS BIGINT) AS n_rows, TRUE AS balanced FROM g")
def fold_balance(spark, d):
    """Folds of whole orders differ by less than the largest order has lines."""
    sizes = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"))
    load = ridge.assign_folds(sizes, "grp").groupBy("fold").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("grp").count().agg(F.max("count").alias("most"))
    out = load.agg(F.count("*").cast("int").alias("n_folds"), F.sum("n").alias("n_rows"), F.max("n").alias("hi"), F.min("n").alias("lo")).crossJoin(largest)  # single rows
    return out.select("n_folds", "n_rows", (F.col("hi") - F.col("lo") <= F.col("most")).alias("balanced"))


def interval_rows(index, draws):
    """``draws`` (col, draws and others) by player: low, high and standard error of each row."""
    ci = spread.intervals(draws)
    return index.join(ci.select("col", *[c for c in draws.columns if c not in ("col", "draws")], *[(F.round(c, 6) + 0.0).alias(c) for c in ("low", "high", "se")]), "col").drop("col")


@query()
def bootstrap_ci(spark, d):
    """95 % intervals over refits on orders drawn with replacement."""
    index, triplets, rows, n = design_of(spark, d)
    return interval_rows(index, spread.draws_of(krylov.pack(triplets, rows, n, group=F.col("grp")), 1000.0))


@query()
def pca(spark, d):
    out, _, _ = similarity.principal_axes(vectors_of(spark, d), "vec_id", "v", 2)
    return out.select("vec_id", F.round(F.get("projection", 0), 6).alias("pc1"), F.round(F.get("projection", 1), 6).alias("pc2"))


@query()
def kmeans(spark, d):
    return similarity.best_kmeans(vectors_of(spark, d), "vec_id", "v", 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from rosterspark.plans import ratings_catalog  # noqa: F401  adds its queries to FOUND

    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in FOUND.items() if s}
