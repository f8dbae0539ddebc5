"""More named queries: designs, rating tables, guards and searches, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rosterspark.functions import arrays, scalar
from rosterspark.operators import clusters, digest, evaluate, krylov, neighbours, ratings, relational, ridge, shot_context, similarity, spread
from rosterspark.plans.catalog import KINDS, SHOT_SQL, bucket_of, bucket_sql, certificate, interval_rows, lng, log_of, per_id_of, query, shots_of, t, vectors_of, wide_of
from rosterspark.sources import publish, scratch


@query("SELECT count(DISTINCT (o_custkey, nullif(o_orderstatus, 'P'))) AS n_tuples FROM orders")
def distinct_tuples(spark, d):
    o = t(spark, d, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    return o.agg(relational.count_distinct_tuples("o_custkey", "s").alias("n_tuples"))


@query("SELECT o_custkey, bool_and(o_totalprice > 50000) AS all_large, bool_or(o_orderstatus = 'P') AS any_pending FROM orders GROUP BY 1")
def all_in_group(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.every(F.col("o_totalprice") > 50000).alias("all_large"), F.some(F.col("o_orderstatus") == "P").alias("any_pending"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders")
def row_index(spark, d):
    return relational.row_index(t(spark, d, "orders"), "o_orderkey").select("o_orderkey", lng(F.col("row")).alias("row"))


@query("""SELECT * FROM (SELECT o_orderkey, o_totalprice, 'head' AS "end" FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7)
UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice, 'tail' AS "end" FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7)""")
def head_and_tail(spark, d):
    return relational.head_and_tail(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 7)


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1")
def shared_players(spark, d):
    li = t(spark, d, "lineitem")
    return relational.shared_keys(li.where("l_returnflag = 'A'"), li.where("l_discount >= 0.1"), ["l_suppkey"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '1') AND contains(lower(p_type), 'an')")
def name_search(spark, d):
    return t(spark, d, "part").where(scalar.contains_text(F.col("p_name"), "1") & scalar.contains_text(F.col("p_type"), "AN")).select("p_partkey", "p_name")


CODE_SQL = """CASE event_id % 7 WHEN 0 THEN ' TOUT' WHEN 1 THEN '2FGM' WHEN 2 THEN 'RV ' WHEN 3 THEN 'EP' WHEN 4 THEN NULL WHEN 5 THEN 'XX' ELSE 'AS' END"""
CLASS_SQL = """CASE WHEN trim(coalesce(code, '')) IN ('TOUT', 'EP') THEN 'benign' WHEN trim(coalesce(code, '')) IN ('2FGM', 'RV', 'AS') THEN 'player_action' ELSE 'unclassified' END"""


def codes_of(spark, d):
    code = scalar.lookup(F.col("event_id") % 7, {0: " TOUT", 1: "2FGM", 2: "RV ", 3: "EP", 5: "XX", 6: "AS"}, None)
    code = F.when(F.col("event_id") % 7 == 4, F.lit(None)).otherwise(code)
    return t(spark, d, "events").select("event_id", "user_id", "event_type", code.cast("string").alias("code"))


@query(f"WITH e AS (SELECT event_id, {CODE_SQL} AS code FROM events) SELECT event_id, {CLASS_SQL} AS kind FROM e")
def code_classes(spark, d):
    return codes_of(spark, d).select("event_id", scalar.code_class(F.col("code")).alias("kind"))


@query(f"""WITH e AS (SELECT user_id, {CODE_SQL} AS code, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'p' END AS actor, CASE WHEN event_id % 5 = 0 THEN TRUE WHEN event_id % 5 = 1 THEN NULL ELSE FALSE END AS valid FROM events)
SELECT user_id % 10 AS team, {CLASS_SQL} AS code_class, CASE WHEN trim(actor) <> '' THEN 'named' ELSE 'team' END AS actor, count(*) AS n FROM e WHERE valid IS DISTINCT FROM TRUE GROUP BY 1, 2, 3""")
def attribution_split(spark, d):
    k = F.col("event_id") % 5
    e = codes_of(spark, d).withColumn("team", F.col("user_id") % 10).withColumn("who", F.when(F.col("event_id") % 2 == 0, " ").otherwise("p"))
    e = e.withColumn("valid", F.when(k == 0, True).when(k == 1, F.lit(None).cast("boolean")).otherwise(False))
    return ratings.attribution_split(e, ["team"], F.col("code"), F.col("who"), F.col("valid"))


BOX = {"points": "40 + l_quantity", "rebounds": "l_linenumber * 2", "assists": "l_orderkey % 9", "steals": "l_partkey % 4", "blocks": "l_suppkey % 3", "fouls_drawn": "l_partkey % 5", "fg2a": "l_orderkey % 11 + 3", "fg2m": "l_orderkey % 3", "fg3a": "l_partkey % 6 + 2", "fg3m": "l_partkey % 2", "fta": "l_suppkey % 7 + 1", "ftm": "l_suppkey % 2", "turnovers": "l_orderkey % 4", "blocked": "l_partkey % 3", "fouls": "l_suppkey % 5"}
PIR_SQL = "points + rebounds + assists + steals + blocks + fouls_drawn - (fg2a - fg2m) - (fg3a - fg3m) - (fta - ftm) - turnovers - blocked - fouls"


def box_of(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *[F.expr(x).alias(k) for k, x in BOX.items()])


BOX_SQL = f"box AS (SELECT l_orderkey, l_linenumber, l_returnflag, {', '.join(f'{x} AS {k}' for k, x in BOX.items())} FROM lineitem)"


@query(f"""WITH {BOX_SQL} SELECT l_orderkey, l_linenumber, round({PIR_SQL}, 4) AS pir,
round(points + rebounds + steals + 0.5 * assists + 0.5 * blocks - fg2a - fg3a - turnovers - 0.5 * fta - 0.5 * fouls, 4) AS win_score FROM box""")
def box_scores(spark, d):
    c = {k: F.col(k) for k in BOX}
    return box_of(spark, d).select("l_orderkey", "l_linenumber", F.round(scalar.efficiency(c), 4).alias("pir"), F.round(scalar.win_score(c), 4).alias("win_score"))


@query(f"""WITH {BOX_SQL}, s AS (SELECT l_returnflag, {PIR_SQL} AS own, {PIR_SQL} + CASE WHEN l_orderkey % 10 = 0 THEN l_linenumber ELSE 0 END AS supplied FROM box)
SELECT l_returnflag, count(*) AS n, count(*) FILTER (abs(supplied - own) > 1e-9) AS n_off, max(abs(supplied - own)) AS worst FROM s GROUP BY 1""")
def supplied_against_own(spark, d):
    own = scalar.efficiency({k: F.col(k) for k in BOX})
    supplied = own + F.when(F.col("l_orderkey") % 10 == 0, F.col("l_linenumber")).otherwise(0)
    return ratings.recomputed(box_of(spark, d).withColumn("supplied", supplied), ["l_returnflag"], "supplied", own)


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT a.l_returnflag, nearest, linear FROM (SELECT l_returnflag, v AS nearest FROM r WHERE k = round(0.83 * (n - 1))) a
JOIN (SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.83), 4) AS linear FROM lineitem GROUP BY 1) b ON a.l_returnflag = b.l_returnflag""")
def quantiles(spark, d):
    li = t(spark, d, "lineitem")
    near = relational.nearest_quantile(li, ["l_returnflag"], "l_extendedprice", 0.83).withColumnRenamed("quantile", "nearest")
    return near.join(relational.linear_quantile(li, ["l_returnflag"], "l_extendedprice", 0.83).withColumnRenamed("quantile", "linear"), "l_returnflag").withColumn("linear", F.round("linear", 4))


@query("SELECT o_custkey, max(year(o_orderdate)) - min(year(o_orderdate)) + 1 = count(DISTINCT year(o_orderdate)) AS contiguous, count(DISTINCT year(o_orderdate)) AS n_years FROM orders GROUP BY 1")
def contiguous_years(spark, d):
    return relational.consecutive(t(spark, d, "orders").withColumn("y", F.year("o_orderdate")), ["o_custkey"], "y")


@query("""WITH s AS (SELECT o_custkey AS id, sum(o_totalprice) AS support, count(*) AS n_games FROM orders GROUP BY 1)
SELECT c_custkey AS id, c_acctbal AS total, round(support, 2) AS support, n_games, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer JOIN s ON c_custkey = id WHERE support >= 400000 AND n_games >= 4""")
def ranked_board(spark, d):
    support = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("support"), F.count("*").alias("n_games"))
    board = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("total"))
    return ratings.floors(board, support, "id", 400000, 4).select("id", "total", F.round("support", 2).alias("support"), "n_games", "rank")


STINT_SQL = """st AS (SELECT l_orderkey AS okey, list_distinct(list(CAST(l_suppkey AS VARCHAR)) FILTER (l_linestatus = 'O')) AS h, list_distinct(list(CAST(l_suppkey AS VARCHAR)) FILTER (l_linestatus <> 'O')) AS a,
  sum(l_quantity) FILTER (l_linestatus = 'O') AS hp, sum(l_quantity) FILTER (l_linestatus <> 'O') AS ap, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS hq, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS aq FROM lineitem GROUP BY 1),
ob AS (SELECT okey, 0 AS side, 100 * hp / hq AS y, CAST(hq AS DOUBLE) AS w, h AS o, a AS d FROM st WHERE hp IS NOT NULL AND hq > 0 UNION ALL SELECT okey, 1, 100 * ap / aq, CAST(aq AS DOUBLE), a, h FROM st WHERE ap IS NOT NULL AND aq > 0),
ix AS (SELECT player, row_number() OVER (ORDER BY player) - 1 AS col, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS player FROM lineitem)),
tr AS (SELECT okey, side, col FROM (SELECT okey, side, unnest(o) AS player FROM ob) JOIN ix USING (player) UNION ALL SELECT okey, side, col + n FROM (SELECT okey, side, unnest(d) AS player FROM ob) JOIN ix USING (player))"""


def two_sided_of(spark, d):
    """Orders as stints: suppliers of open lines at home, of others away."""
    li, home = t(spark, d, "lineitem"), F.col("l_linestatus") == "O"
    five = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_suppkey").cast("string"))))
    st = li.groupBy("l_orderkey").agg(five(home).alias("home"), five(~home).alias("away"), F.sum(F.when(home, F.col("l_quantity"))).alias("home_pts"), F.sum(F.when(~home, F.col("l_quantity"))).alias("away_pts"), F.count_if(F.col("l_returnflag") == "A").alias("home_poss"), F.count_if(F.col("l_returnflag") == "R").alias("away_poss"))
    st = scratch.materialise(st, "stints")  # several steps read them
    index = scratch.materialise(ridge.player_index(st, ["home", "away"]), "players")
    n = index.count()
    rows = ridge.two_sided_rows(st, "l_orderkey", "home", "away", "l_orderkey")
    return ridge.require_index(index, n), rows, ridge.two_sided_design(rows, index, n), n


@query(f"WITH {STINT_SQL} SELECT okey, CAST(side AS INTEGER) AS side, round(y, 5) AS y, w, count(col) AS n_entries, coalesce(CAST(sum(col) AS BIGINT), 0) AS col_sum FROM ob LEFT JOIN tr USING (okey, side) GROUP BY ALL")
def two_sided_design(spark, d):
    _, rows, triplets, _ = two_sided_of(spark, d)
    held = triplets.groupBy("row_id").agg(F.count("*").alias("n_entries"), F.sum("col").alias("col_sum"))
    out = rows.join(held, "row_id", "left")
    return out.select(F.col("row_id.stint").alias("okey"), "side", F.round("y", 5).alias("y"), "w", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("col_sum", F.lit(0)).cast("long").alias("col_sum"))


@query(f"""WITH {STINT_SQL}, x AS (SELECT okey, side, CAST(col AS BIGINT) AS c, 1.0 AS v FROM tr UNION ALL SELECT okey, side, 2 * (SELECT max(n) FROM ix), 1.0 FROM ob UNION ALL SELECT okey, side, 2 * (SELECT max(n) FROM ix) + 1, y FROM ob)
SELECT CAST(a.c AS INTEGER) AS i, CAST(b.c AS INTEGER) AS j, round(sum(a.v * b.v * w), 2) AS g FROM x a JOIN x b ON a.okey = b.okey AND a.side = b.side AND a.c <= b.c JOIN ob ON ob.okey = a.okey AND ob.side = a.side GROUP BY 1, 2""")
def normal_equations(spark, d):
    _, rows, triplets, n = two_sided_of(spark, d)
    return ridge.products(triplets, rows, 2 * n).select("i", "j", F.round("g", 2).alias("g"))


@query(f"WITH {STINT_SQL} SELECT CAST(col AS INTEGER) AS col, sum(w) AS support, count(*) AS n_rows FROM tr JOIN ob USING (okey, side) GROUP BY 1")
def design_support(spark, d):
    _, rows, triplets, _ = two_sided_of(spark, d)
    return ridge.column_support(triplets, rows)


@query()
def two_sided_board(spark, d):
    index, rows, triplets, n = two_sided_of(spark, d)
    beta, _ = ridge.fit(triplets, rows, 2 * n, 100.0)
    return ridge.leaderboard(spark, index, beta).select("player", *[F.round(c, 6).alias(c) for c in ("offence", "defence", "total")])


@query("SELECT player, CAST(side AS INTEGER) AS side, CAST(0 AS DOUBLE) AS gradient FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS player FROM lineitem), range(2) r(side)")
def two_sided_gradient(spark, d):
    index, rows, triplets, n = two_sided_of(spark, d)
    found = certificate(spark, index, triplets, rows, 2 * n, 100.0).withColumn("side", F.floor(F.col("col") / n).cast("int"))
    return found.withColumn("col", F.col("col") % n).join(index, "col").select("player", "side", "gradient")


@query()
def two_sided_intervals(spark, d):
    """95 % intervals and standard errors of both sides and their sum, over refits on drawn orders."""
    index, rows, triplets, n = two_sided_of(spark, d)
    draws = spread.draws_of(krylov.pack(triplets, rows, 2 * n, group=F.col("group")), 100.0)
    sides = F.collect_list(F.struct("side", "draws"))
    met = draws.select((F.col("col") % n).alias("col"), (F.col("col") >= n).cast("int").alias("side"), "draws").groupBy("col").agg(F.array_sort(sides).alias("x"))
    off, de = F.get("x", 0)["draws"], F.transform(F.get("x", 1)["draws"], lambda x: -x)
    ends = F.array(*[F.struct(F.lit(end).alias("end"), d.alias("draws")) for end, d in (("offence", off), ("defence", de), ("total", F.zip_with(off, de, lambda a, b: a + b)))])
    return interval_rows(index, met.select("col", F.inline(ends)))


@query()
def alpha_sweep(spark, d):
    """Each penalty's fit on three quarters of the stints, scored on the rest; all in one run."""
    _, rows, triplets, n = two_sided_of(spark, d)
    design = krylov.pack(triplets, rows, 2 * n, tag=(F.col("row_id.stint") % 4 == 0).cast("int"))
    beta, b0 = krylov.fits(design, krylov.tag_weights(np.array([[1.0], [0.0]])), 1, list(ridge.ALPHAS))
    errors = krylov.errors(design, np.array([[0.0], [1.0]]), beta, b0)[:, 0]
    return spark.createDataFrame([(a, round(float(e) ** 0.5, 6)) for a, e in zip(ridge.ALPHAS, errors, strict=True)], "alpha double, rmse double")


@query("""WITH s AS (SELECT l_orderkey AS shot, any_value(l_orderkey % 4) AS b, list_distinct(list(CAST(l_suppkey AS VARCHAR)) FILTER (l_linenumber <= 2)) AS o, list_distinct(list(CAST(l_suppkey AS VARCHAR)) FILTER (l_linenumber > 2 AND l_linenumber <= 4)) AS d,
  count(*) FILTER (l_linenumber <= 2) AS no, count(*) FILTER (l_linenumber > 2 AND l_linenumber <= 4) AS nd, sum(l_quantity) AS points FROM lineitem GROUP BY 1),
k AS (SELECT CAST(s_suppkey AS VARCHAR) AS p FROM supplier WHERE s_suppkey % 10 <> 0),
m AS (SELECT * FROM s WHERE b <> 3 AND no = 2 AND nd = 2 AND len(o) = 2 AND len(d) = 2 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(list_concat(o, d)) AS p) WHERE p NOT IN (SELECT p FROM k)))
SELECT CAST(b AS VARCHAR) AS bucket, array_to_string(list_sort(o), '|') AS offence, array_to_string(list_sort(d), '|') AS defence, count(*) AS attempts, round(100 * sum(points) / count(*), 4) AS y FROM m GROUP BY 1, 2, 3""")
def bucket_rows(spark, d):
    n, who = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    shots = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("shot")).agg(F.collect_list(F.when(n <= 2, who)).alias("off"), F.collect_list(F.when((n > 2) & (n <= 4), who)).alias("de"), F.sum("l_quantity").alias("points"))
    shots = shots.withColumn("bucket", F.when(F.col("shot") % 4 != 3, (F.col("shot") % 4).cast("string")))
    index = t(spark, d, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").cast("string").alias("player"))
    out = ratings.bucket_rows(shots, index, "off", "de", 2)
    return out.select("bucket", F.array_join("offence", "|").alias("offence"), F.array_join("defence", "|").alias("defence"), "attempts", F.round("y", 4).alias("y"))


COEF_SQL = """co AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, 'b' || CAST(s_nationkey % 3 AS VARCHAR) AS bucket, s_acctbal / 1000 AS ob, (s_suppkey % 7) / 3.0 AS op, CAST(s_suppkey % 400 AS DOUBLE) AS os, s_acctbal / 2000 - 1 AS db, (s_suppkey % 5) / 4.0 AS dp, CAST(s_suppkey % 300 AS DOUBLE) AS ds FROM supplier),
lg AS (SELECT id, bucket, 'off' AS "end", ob AS value, op AS prior, os AS support FROM co UNION ALL SELECT id, bucket, 'def', -db, -dp, ds FROM co)"""


def coefs_of(spark, d):
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    cols = {"off_beta": bal / 1000, "off_prior": (k % 7) / 3.0, "off_support": (k % 400).cast("double"), "def_beta": bal / 2000 - 1, "def_prior": (k % 5) / 4.0, "def_support": (k % 300).cast("double")}
    return t(spark, d, "supplier").select(k.cast("string").alias("id"), F.concat(F.lit("b"), (F.col("s_nationkey") % 3).cast("string")).alias("bucket"), *[c.alias(n) for n, c in cols.items()])


@query(f"""WITH {COEF_SQL} SELECT id, bucket, "end", round(value, 6) AS value, round(prior, 6) AS prior, round(value - prior, 6) AS deviation, support, support >= 150 AS reliable FROM lg""")
def long_ratings(spark, d):
    out = ratings.long_ratings(coefs_of(spark, d), "id")
    return out.select("id", "bucket", "end", *[F.round(c, 6).alias(c) for c in ("value", "prior", "deviation")], "support", "reliable")


VERDICT_SQL = "CASE bucket WHEN 'b0' THEN 'STRONG' WHEN 'b1' THEN 'WEAK' ELSE 'NONE' END"


def judged_of(spark, d):
    return ratings.long_ratings(coefs_of(spark, d), "id").withColumn("verdict", scalar.lookup(F.col("bucket"), {"b0": "STRONG", "b1": "WEAK"}, "NONE"))


@query(f"""WITH {COEF_SQL}, v AS (SELECT *, {VERDICT_SQL} AS verdict, support >= 150 AS reliable FROM lg)
SELECT id, bucket, "end", verdict <> 'NONE' AS identified, verdict = 'WEAK' AS weak, reliable AS enough, reliable AND verdict <> 'NONE' AS shown, verdict = 'NONE' AS pinned, round(CASE WHEN verdict = 'NONE' THEN prior WHEN reliable THEN value END, 6) AS plot_value FROM v""")
def display_gates(spark, d):
    out = judged_of(spark, d).select("id", "bucket", "end", *scalar.display_gates(F.col("verdict"), F.col("reliable"), F.col("value"), F.col("prior")))
    return out.withColumn("plot_value", F.round("plot_value", 6))


@query(f"""WITH {COEF_SQL}, w AS (SELECT 'b' || CAST(l_linenumber % 4 AS VARCHAR) AS bucket, sum(l_quantity) AS w FROM lineitem GROUP BY 1)
SELECT id, round(sum(CASE WHEN {VERDICT_SQL} = 'NONE' THEN prior ELSE value END * coalesce(w / (SELECT sum(w) FROM w), 0)), 5) AS composite FROM lg LEFT JOIN w USING (bucket) GROUP BY 1""")
def context_composite(spark, d):
    shares = t(spark, d, "lineitem").groupBy(F.concat(F.lit("b"), (F.col("l_linenumber") % 4).cast("string")).alias("bucket")).agg(F.sum("l_quantity").alias("w"))
    return ratings.composite(judged_of(spark, d), shares).withColumn("composite", F.round("composite", 5))


@query(f"""WITH {COEF_SQL}, r AS (SELECT 'b' || CAST(l_linenumber % 3 AS VARCHAR) AS bucket, l_extendedprice / 100 AS y, l_quantity AS w FROM lineitem),
de AS (SELECT bucket, sum(w) AS attempts, sqrt(sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) * (sum(w * y) / sum(w))) AS y_sd FROM r GROUP BY 1),
dv AS (SELECT bucket, stddev_pop(value - prior) AS dev_sd, count(DISTINCT id) AS players FROM lg GROUP BY 1),
cr AS (SELECT * FROM (VALUES ('b0', 0.30, -0.10), ('b1', 0.02, 0.11), ('b2', -0.05, -0.24)) c(bucket, o, d)),
j AS (SELECT *, greatest(abs(o), abs(d)) AS sig FROM de JOIN dv USING (bucket) JOIN cr USING (bucket))
SELECT bucket, attempts, round(attempts / players, 5) AS att_per_player, round(y_sd, 4) AS y_sd, round(dev_sd, 5) AS dev_sd, round(dev_sd / (y_sd / sqrt(attempts / players)), 5) AS dev_norm, CAST(sig AS DOUBLE) AS signal,
  CASE WHEN abs(o) >= abs(d) THEN 'off' ELSE 'def' END AS driver, CASE WHEN abs(o) >= abs(d) THEN o > 0 ELSE d < 0 END AS right_sign, CAST(CASE WHEN least(abs(sig - 0.25), abs(sig - 0.1)) <= 0.02 THEN least(abs(sig - 0.25), abs(sig - 0.1)) END AS DOUBLE) AS borderline,
  CASE WHEN bucket = 'b2' THEN 'NONE' WHEN sig >= 0.25 THEN 'STRONG' WHEN sig >= 0.1 THEN 'WEAK' ELSE 'NONE' END AS verdict, bucket = 'b2' AND sig >= 0.1 AS drifted FROM j""")
def identifiability(spark, d):
    rows = t(spark, d, "lineitem").select(F.concat(F.lit("b"), (F.col("l_linenumber") % 3).cast("string")).alias("bucket"), (F.col("l_extendedprice") / 100).alias("y"), F.col("l_quantity").alias("w"))
    corrs = spark.createDataFrame([("b0", 0.30, -0.10), ("b1", 0.02, 0.11), ("b2", -0.05, -0.24)], "bucket string, corr_off double, corr_def double")
    out = ratings.identifiability(rows, ratings.long_ratings(coefs_of(spark, d), "id"), corrs, {"b2": "NONE"})
    digits = {"att_per_player": 5, "y_sd": 4, "dev_sd": 5, "dev_norm": 5, "borderline": 6}
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


@query("""WITH p AS (SELECT q.s_suppkey AS a, r.s_suppkey AS b, abs(q.s_acctbal - r.s_acctbal) AS dp, sqrt(power(q.s_acctbal / 1000 - r.s_acctbal / 1000, 2) + power(q.s_nationkey - r.s_nationkey, 2)) AS dist FROM supplier q JOIN supplier r ON q.s_suppkey <> r.s_suppkey WHERE q.s_suppkey % 100 = 0)
SELECT count(*) AS n_pairs, round(corr(dist, dp), 6) AS corr FROM p""")
def distance_against_prior(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("v"), F.col("s_acctbal").alias("prior"))
    return similarity.distance_against(s.where("id % 100 = 0"), s, "id", "v", "prior").select("n_pairs", F.round("corr", 6).alias("corr"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal / 10000 >= 0.3 THEN 'archetypes' WHEN s_nationkey / 25.0 >= 0.4 THEN 'neighbours' ELSE 'cut' END AS decision FROM supplier""")
def format_decision(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", scalar.format_decision(F.col("s_acctbal") / 10000, F.col("s_nationkey") / 25.0).alias("decision"))


@query("""WITH g AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN o_orderkey % 10 > 0 THEN 1.0 ELSE 0.0 END) AS b, sum(o_totalprice) AS y FROM orders GROUP BY 1)
SELECT o_custkey, round(y, 2) AS y FROM g WHERE a >= 0.85 AND b >= 0.85""")
def common_support(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.avg((F.col("o_orderstatus") != "P").cast("double")).alias("a"), F.avg((F.col("o_orderkey") % 10 > 0).cast("double")).alias("b"), F.sum("o_totalprice").alias("y"))
    return ratings.common_support(g, ["a", "b"]).select("o_custkey", F.round("y", 2).alias("y"))


@query("""WITH tr AS (SELECT o_custkey, avg(o_totalprice) AS r, sum(o_totalprice) AS w FROM orders WHERE year(o_orderdate) < 1997 GROUP BY 1), te AS (SELECT o_custkey, avg(o_totalprice) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1),
m AS (SELECT c_nationkey, sum(r * n) FILTER (r IS NOT NULL) / sum(n) FILTER (r IS NOT NULL) AS rating, sum(y * n) / sum(n) AS outcome, avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM customer JOIN te ON c_custkey = te.o_custkey LEFT JOIN tr ON tr.o_custkey = te.o_custkey GROUP BY 1)
SELECT count(*) AS n, round(corr(rating, outcome), 5) AS corr, count(*) FILTER (coverage >= 0.85) AS n_common, round(corr(rating, outcome) FILTER (coverage >= 0.85), 5) AS corr_common FROM m""")
def team_corr_holdout(spark, d):
    o = t(spark, d, "orders")
    train = o.where(F.year("o_orderdate") < 1997).groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("r"))
    test = o.where(F.year("o_orderdate") >= 1997).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("y"), F.count("*").alias("n"))
    rated = t(spark, d, "customer").join(test, F.col("c_custkey") == F.col("o_custkey")).join(train, F.col("c_custkey") == F.col("k"), "left")
    teams = rated.groupBy("c_nationkey").agg(relational.weighted_mean(F.col("r"), F.col("n")).alias("rating"), relational.weighted_mean(F.col("y"), F.col("n")).alias("outcome"), F.avg(F.col("r").isNotNull().cast("double")).alias("coverage"))
    common = F.col("coverage") >= 0.85
    return teams.agg(F.count("*").alias("n"), F.round(F.corr("rating", "outcome"), 5).alias("corr"), F.count_if(common).alias("n_common"), F.round(F.corr(F.when(common, F.col("rating")), F.when(common, F.col("outcome"))), 5).alias("corr_common"))


@query(f"""WITH {SHOT_SQL}, r AS (SELECT abs(x) AS x, y, ({bucket_sql()}) IS NOT DISTINCT FROM 'corner_three' AS w FROM sh WHERE x IS NOT NULL AND y IS NOT NULL),
q AS (SELECT quantile_cont(x, [(50 + k * 49.5 / 59) / 100 FOR k IN range(60)]) AS qx, quantile_cont(y, [(0.5 + k * 59.5 / 59) / 100 FOR k IN range(60)]) AS qy FROM r),
gx AS (SELECT unnest(qx) AS a, unnest(range(60)) AS k FROM q), gy AS (SELECT unnest(qy) AS b, unnest(range(60)) AS k FROM q),
s AS (SELECT a, b, gx.k AS i, gy.k AS j, count(*) FILTER ((x >= a AND y <= b) = w) AS hits, count(*) AS n FROM gx, gy, r GROUP BY ALL)
SELECT round(a, 4) AS x_from, round(b, 4) AS y_to, round(hits / n, 6) AS agreement FROM s ORDER BY hits DESC, i, j LIMIT 1""")
def corner_search(spark, d):
    shots = shots_of(spark, d)
    found = evaluate.corner_search(shots, F.abs("x"), F.col("y"), bucket_of() == "corner_three")
    out = spark.createDataFrame([found], "x_from double, y_to double, agreement double")
    return out.select(F.round("x_from", 4).alias("x_from"), F.round("y_to", 4).alias("y_to"), F.round("agreement", 6).alias("agreement"))


@query(f"""WITH {SHOT_SQL}, g AS (SELECT vec_id % 5 AS season, act LIKE '3%' AS three, x, y, sqrt(x * x + y * y) AS r FROM sh)
SELECT season, count(*) AS n, round(avg(CASE WHEN x IS NULL OR y IS NULL THEN 1.0 ELSE 0.0 END), 6) AS no_coordinates, round(avg(CASE WHEN three AND r < 660 THEN 1.0 WHEN three AND r IS NOT NULL THEN 0.0 END), 6) AS three_inside,
  round(avg(CASE WHEN NOT three AND r > 675 THEN 1.0 WHEN NOT three AND r IS NOT NULL THEN 0.0 END), 6) AS two_beyond, round(avg(CASE WHEN r IS NOT NULL THEN CASE WHEN (three AND r < 660) OR (NOT three AND r > 675) THEN 1.0 ELSE 0.0 END END), 6) AS wrong, round(max(r), 4) AS farthest FROM g GROUP BY 1""")
def coordinate_integrity(spark, d):
    shots = shots_of(spark, d).withColumn("season", F.col("vec_id") % 5)
    out = ratings.coordinate_integrity(shots, ["season"], F.col("act").startswith("3"), F.col("x"), F.col("y"))
    return out.select("season", "n", *[F.round(c, 6).alias(c) for c in ("no_coordinates", "three_inside", "two_beyond", "wrong")], F.round("farthest", 4).alias("farthest"))


@query("SELECT round(avg(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(stddev_pop(s_acctbal), 4) AS sd FROM supplier")
def predictor_guard(spark, d):
    s = t(spark, d, "supplier").select("s_acctbal", (F.col("s_acctbal") > 0).cast("double").alias("rated"))
    return ratings.require_predictor(s, "s_acctbal", "rated", 0.1).select(F.round("coverage", 6).alias("coverage"), F.round("sd", 4).alias("sd"))


@query("SELECT p_brand AS k, count(DISTINCT p_size % 3) AS n_ids, array_to_string(list_sort(list_distinct(list(p_size % 3))), ',') AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 3) > 1")
def ids_per_key(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("k"), (F.col("p_size") % 3).alias("id"))
    return relational.one_id_per_key(p, ["k"], "id").withColumn("ids", F.array_join("ids", ","))



@query("""WITH s AS (SELECT l_orderkey, list(l_suppkey) FILTER (l_linestatus = 'O') AS h, list(l_suppkey) FILTER (l_linestatus <> 'O') AS a FROM lineitem GROUP BY 1), x AS (SELECT l.l_orderkey, l_linenumber, coalesce(list_contains(h, l_suppkey), FALSE) AS ih, coalesce(list_contains(a, l_suppkey + l_linenumber % 2 * 7), FALSE) AS ia FROM lineitem l JOIN s USING (l_orderkey))
SELECT l_orderkey, l_linenumber, CASE WHEN ih AND NOT ia THEN 'home' WHEN ia AND NOT ih THEN 'away' END AS side FROM x""")
def shooter_side(spark, d):
    li, home = t(spark, d, "lineitem"), F.col("l_linestatus") == "O"
    fives = li.groupBy("l_orderkey").agg(F.collect_list(F.when(home, F.col("l_suppkey"))).alias("h"), F.collect_list(F.when(~home, F.col("l_suppkey"))).alias("a"))
    rows = li.join(fives, "l_orderkey")
    away = F.transform("a", lambda x: x - F.col("l_linenumber") % 2 * 7)
    return ratings.orientation(rows, F.col("l_suppkey"), F.col("h"), away).select("l_orderkey", "l_linenumber", "side")


@query("""WITH s AS (SELECT l_orderkey, list(l_suppkey) FILTER (l_linestatus = 'O') AS h, list(l_suppkey) FILTER (l_linestatus <> 'O') AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey % 6 AS season, count(*) AS n, round(avg(CASE WHEN len(list_distinct(h)) = 2 AND len(list_distinct(a)) = 2 THEN 1.0 ELSE 0.0 END), 6) AS "full", round(avg(CASE WHEN l_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS valid, round(avg(CASE WHEN h IS NULL OR a IS NULL THEN 1.0 ELSE 0.0 END), 6) AS empty FROM s GROUP BY 1""")
def lineup_shares(spark, d):
    home = F.col("l_linestatus") == "O"
    s = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(home, F.col("l_suppkey"))).alias("h"), F.collect_list(F.when(~home, F.col("l_suppkey"))).alias("a")).withColumn("season", F.col("l_orderkey") % 6)
    out = ratings.lineup_shares(s, ["season"], F.col("h"), F.col("a"), F.col("l_orderkey") % 3 == 0, 2)
    return out.select("season", "n", *[F.round(c, 6).alias(c) for c in ("full", "valid", "empty")])


@query("""WITH a AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders), b AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders),
u AS (SELECT k, s, 1 AS x, 0 AS y FROM a UNION ALL SELECT k, s, 0, 1 FROM b) SELECT k, s, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b FROM u GROUP BY 1, 2 HAVING sum(x) <> sum(y)""")
def rows_that_differ(spark, d):
    o = t(spark, d, "orders")
    b = o.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return digest.differing_rows(o.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")), b)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders")
def rewrite_ids(spark, d):
    merges = t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("from_id"), (F.col("c_custkey") + 1000000).alias("to_id"))
    orders = t(spark, d, "orders").where("o_custkey IS NOT NULL").select("o_orderkey", "o_custkey")
    return relational.rewrite_ids(orders, merges, "o_custkey")


@query("""WITH f AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' - ' WHEN 2 THEN 'False' WHEN 3 THEN '0' ELSE ' x' END AS raw FROM events)
SELECT event_id, coalesce(trim(raw) NOT IN ('', '-', 'False'), FALSE) AS present FROM f""")
def flag_presence(spark, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 1, " - ").when(k == 2, "False").when(k == 3, "0").when(k == 4, " x")
    return t(spark, d, "events").select("event_id", scalar.flag_present(raw).alias("present"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN '[' || printf('%+.2f', s_acctbal / 1000) || ', ' || printf('%+.2f', s_acctbal / 500) || ']' ELSE '' END AS ci, s_suppkey % 4 <> 0 AND s_nationkey IS NOT NULL AS complete FROM supplier""")
def interval_labels(spark, d):
    high = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") / 500)
    return t(spark, d, "supplier").select("s_suppkey", scalar.interval_text(F.col("s_acctbal") / 1000, high).alias("ci"), scalar.all_present([high, F.col("s_nationkey")]).alias("complete"))


@query(f"""WITH w AS (SELECT user_id, {', '.join(f'''max(value) FILTER (event_type = '{k}' AND event_id % 2 = 0) AS "{k}__0"''' for k in KINDS)} FROM events GROUP BY 1)
SELECT * FROM w WHERE {' AND '.join(f'"{k}__0" IS NOT NULL' for k in KINDS)}""")
def wide_ratings(spark, d):
    e = t(spark, d, "events").withColumn("half", F.col("event_id") % 2)
    return similarity.wide_vectors(e, "user_id", ["event_type", "half"], [f"{k}__0" for k in KINDS], "value")


@query("""WITH e AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 9)] AS v FROM embeddings), x AS (SELECT vec_id, unnest(v) AS x, unnest(range(8)) AS i FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) AS k FROM x) SELECT vec_id, string_agg('d' || CAST(i + 1 AS VARCHAR), ',' ORDER BY k) AS top FROM r WHERE k <= 2 GROUP BY 1""")
def top_features(spark, d):
    names = [f"d{i}" for i in range(1, 9)]
    return wide_of(spark, d).select("vec_id", F.array_join(similarity.top_features(F.array(*names), names), ",").alias("top"))


@query("""WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events) SELECT * FROM c""")
def place_in_game(spark, d):
    return arrays.place_in_group(log_of(spark, d), ["game"], ["n"]).select(F.col("game").alias("user_id"), F.col("n").alias("event_id"), "pos")


@query("""WITH per AS (SELECT p_brand AS name, p_type || '-' || CAST(p_size % 7 AS VARCHAR) AS id, list_distinct(list(p_size)) AS seasons, list_distinct(list(CAST(p_partkey % 3 AS BIGINT))) AS teams FROM part GROUP BY 1, 2)
SELECT a.name, a.id AS id_a, b.id AS id_b, list_has_any(a.seasons, b.seasons) AS same_seasons, list_has_any(a.teams, b.teams) AS same_teams FROM per a JOIN per b ON a.name = b.name AND a.id < b.id""")
def overlapping_ids(spark, d):
    return arrays.overlap_pairs(per_id_of(spark, d), "name", "id", ["seasons", "teams"])


@query("""WITH per AS (SELECT p_brand AS name, p_type || '-' || CAST(p_size % 7 AS VARCHAR) AS id, list_distinct(list(p_size)) AS seasons, list_distinct(list(CAST(p_partkey % 3 AS BIGINT))) AS teams FROM part GROUP BY 1, 2),
e AS (SELECT name, 'seasons' AS kind, CAST(unnest(seasons) AS VARCHAR) AS entry, id FROM per UNION ALL SELECT name, 'teams', CAST(unnest(teams) AS VARCHAR), id FROM per)
SELECT name, kind, entry, id, count(*) OVER w AS n_ids, min(id) OVER w AS first_id FROM e WINDOW w AS (PARTITION BY name, kind, entry) QUALIFY count(*) OVER w > 1""")
def shared_entries(spark, d):
    return arrays.shared_entries(per_id_of(spark, d), "name", "id", ["seasons", "teams"])


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) * 100000 + o_custkey AS game, count(*) AS n FROM orders GROUP BY 1""")
def season_games(spark, d):
    """Orders by season and a code that repeats from season to season."""
    game = scalar.game_key(F.year("o_orderdate"), F.col("o_custkey"))
    return t(spark, d, "orders").groupBy(game.alias("game")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS s, avg(CASE WHEN o_totalprice > 1000 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM orders GROUP BY 1""")
def good_shares(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_orderstatus", "s")
    return relational.require_share(relational.require_columns(o, ["s", "o_totalprice"]), F.col("o_totalprice") > 1000, ["s"], 0.5)


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) <= 3""")
def sampled_rows(spark, d):
    return relational.sample_groups(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3)


@query("""WITH g AS (SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT k AS vec_id, round(list_inner_product(v, v), 4) AS length2 FROM g""")
def vector_length(spark, d):
    return vectors_of(spark, d).select("vec_id", F.round(similarity.dot(F.col("v"), F.col("v")), 4).alias("length2"))


@query("""WITH c AS (SELECT c_custkey FROM customer), o AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 3 <> 0)
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, (SELECT count(*) FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM o)) AS missing, FALSE AS complete FROM o JOIN c ON c_custkey = o_custkey GROUP BY 1""")
def published_keys(spark, d):
    """Orders by customer, published in two runs of which the second adds what is missing."""
    path = scratch.new_path(spark, "published")
    expected = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    orders = t(spark, d, "orders").where("o_custkey % 3 <> 0").select("o_custkey", "o_orderkey", "o_totalprice")
    guards = [publish.rows_at_least(1), publish.none_where("no_price", F.col("o_totalprice").isNull()), publish.spread("prices", F.col("o_totalprice"))]
    publish.publish_missing(orders.where("o_custkey % 2 = 0"), path, ["o_custkey"], expected, guards)
    publish.publish_missing(orders, path, ["o_custkey"], expected, guards)
    said = publish.manifest(spark, path)
    out = publish.read_published(spark, path).groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.withColumns({"missing": F.lit(said["missing"]).cast("long"), "complete": F.lit(said["complete"])})


@query("""SELECT count(*) AS n, count(*) FILTER (l_quantity < 1) AS below_one, round(avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END), 6) AS not_returned, round(stddev_pop(l_quantity), 6) AS quantity_sd FROM lineitem""")
def guard_measures(spark, d):
    """What guards measure in the pass that writes the rows."""
    good = F.col("l_returnflag") != "R"
    guards = [publish.rows_at_least(1), publish.none_where("below_one", F.col("l_quantity") < 1), publish.share_at_least("not_returned", good, 0.5), publish.spread("quantity_sd", F.col("l_quantity"))]
    found = publish.observed(t(spark, d, "lineitem"), guards, lambda rows: rows.write.format("noop").mode("overwrite").save())
    row = (found["rows"], found["below_one"], round(found["not_returned"], 6), round(found["quantity_sd"], 6))
    return spark.createDataFrame([row], "n long, below_one long, not_returned double, quantity_sd double")


@query("""SELECT year(o_orderdate) AS season, count(*) AS n, count(c_custkey) AS n_met, round(sum(CASE WHEN c_custkey IS NOT NULL THEN o_totalprice ELSE 0 END), 2) AS met_total
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON c_custkey = o_custkey AND c_nationkey % 5 = o_orderkey % 5 AND c_mktsegment IS NOT NULL GROUP BY 1""")
def joined_once(spark, d):
    """A left join by two keys of unlike names, and what it missed by season."""
    right = t(spark, d, "customer").where("c_custkey % 7 <> 0").select("c_custkey", (F.col("c_nationkey") % 5).cast("long").alias("kind"), "c_mktsegment")
    left = t(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 5).alias("of_kind"), F.year("o_orderdate").alias("season"), "o_totalprice")
    both, report = relational.joined_once(left, right, [("o_custkey", "c_custkey"), ("of_kind", "kind")], ["season"])
    met = both.groupBy("season").agg(F.round(F.sum(F.when(F.col("c_mktsegment").isNotNull(), F.col("o_totalprice")).otherwise(0.0)), 2).alias("met_total"))
    return report.join(met, "season")


@query("SELECT count(*) AS n_chunks, TRUE AS same FROM (SELECT DISTINCT o_custkey % 64 AS c FROM orders)")
def digests_agree(spark, d):
    """Digests of one table dealt out in two ways; orders fall into 64 chunks by customer."""
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    n = digest.chunk_digests(o.select(F.xxhash64("o_orderkey").alias("_h"), F.xxhash64("o_totalprice").alias("_g"), (F.col("o_custkey") % 64).alias("c")), ["c"]).count()
    return spark.createDataFrame([(n, digest.same(o, o.repartition("o_custkey")))], "n_chunks long, same boolean")


def contexts_of(spark, d):
    """Shots of three kinds by lineups of two; an order is a shot, its customer a game."""
    n, who = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    shots = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("shot")).agg(F.collect_list(F.when(n <= 2, who)).alias("off"), F.collect_list(F.when((n > 2) & (n <= 4), who)).alias("de"), F.sum("l_quantity").alias("points"))
    shots = shots.withColumn("bucket", F.when(F.col("shot") % 4 != 3, F.concat(F.lit("b"), (F.col("shot") % 4).cast("string"))))
    shots = shots.join(t(spark, d, "orders").select(F.col("o_orderkey").alias("shot"), F.col("o_custkey").alias("game")), "shot")
    shots = scratch.materialise(shots, "shots")  # several steps read them
    index = scratch.materialise(ridge.player_index(shots, ["off", "de"]), "players")
    size = index.count()
    rows = ratings.bucket_rows(shots, index, "off", "de", 2, ("game",))
    rows = ridge.assign_folds(rows, "game").withColumn("row_id", F.struct("game", "bucket", "offence", "defence")).withColumn("w", F.col("attempts").cast("double"))
    rows = shot_context.tagged(rows, "bucket", BUCKETS, "fold", 5)
    return index, size, rows, ridge.two_sided_design(rows, index, size)


BUCKETS = ["b0", "b1", "b2"]


def context_fits_of(spark, d):
    index, n, rows, triplets = contexts_of(spark, d)
    design = krylov.pack(triplets, rows, 2 * n, tag=F.col("tag"))
    # The overall ratings: one fit over all kinds.
    beta, _ = krylov.fits(design, krylov.tag_weights(np.ones((5 * len(BUCKETS), 1))), 1, [100.0])
    return index, rows, triplets, shot_context.fit_all(design, BUCKETS, 5, beta[0, :n, 0], -beta[0, n:, 0])


@query()
def context_fits(spark, d):
    """Each kind's penalty, errors, probe and signs."""
    found = shot_context.report(spark, context_fits_of(spark, d)[3])
    return found.select("bucket", "alpha", "at_edge", "sign_off", "sign_def", *[F.round(c, 5).alias(c) for c in ("rmse", "corr_off", "corr_def", "intercept")])


@query()
def context_verdicts(spark, d):
    """Whether each kind can be told from noise, from the correlations of its own fits."""
    _, rows, _, fits = context_fits_of(spark, d)
    out = shot_context.verdicts(rows, fits)
    return out.select("bucket", "alpha", "at_edge", "attempts", F.round("signal", 5).alias("signal"), "driver", "right_sign", "verdict")


@query("""SELECT 'b' || CAST(b AS VARCHAR) AS bucket, CAST(s AS INTEGER) AS side, player, CAST(0 AS DOUBLE) AS gradient FROM range(3) x(b), range(2) y(s),
(SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS player FROM lineitem WHERE l_linenumber <= 4)""")
def context_gradient(spark, d):
    """The derivative of each kind's sum at its chosen fit: 0 for every player and end."""
    index, rows, triplets, fits = context_fits_of(spark, d)
    n, out = len(fits[0].beta) // 2, None
    for f in fits:
        own = rows.where(F.col("bucket") == f.bucket)
        coefs = spark.createDataFrame([(i, float(b), float(m)) for i, (b, m) in enumerate(zip(f.beta, f.mu, strict=True))], "col int, beta double, mu double")
        found = krylov.gradient(triplets.join(own.select("row_id"), "row_id", "left_semi"), own, coefs, f.intercept, f.alpha).withColumn("bucket", F.lit(f.bucket))
        out = found if out is None else out.unionByName(found)
    out = out.withColumn("side", F.floor(F.col("col") / n).cast("int")).withColumn("col", F.col("col") % n)
    return out.join(index, "col").select("bucket", "side", "player", (F.round("gradient", 6) + 0.0).alias("gradient"))


KNN_ALL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT q.vec_id, t.vec_id AS neighbour, {} AS distance FROM e q JOIN e t ON q.vec_id <> t.vec_id)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS INTEGER) AS rank, neighbour, round(distance, 5) AS distance FROM p QUALIFY rank <= 10"""


@query(KNN_ALL.format("list_distance(q.v, t.v)"))
def knn_all(spark, d):
    """Ten neighbours of every row."""
    return neighbours.nearest_to_all(vectors_of(spark, d), "vec_id", "v", 10).withColumn("distance", F.round("distance", 5))


@query(KNN_ALL.format("1 - list_cosine_similarity(q.v, t.v)"))
def knn_all_cosine(spark, d):
    return neighbours.nearest_to_all(vectors_of(spark, d), "vec_id", "v", 10, "cosine").withColumn("distance", F.round("distance", 5))


@query()
def neighbour_stability(spark, d):
    """Neighbours by distance and by angle, for every row, against what chance would give."""
    v = vectors_of(spark, d)
    both = similarity.agreement_at_k(neighbours.nearest_to_all(v, "vec_id", "v", 10), neighbours.nearest_to_all(v, "vec_id", "v", 10, "cosine"), "vec_id")
    out = similarity.agreement_summary(both, v.count(), 10)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean_jaccard", "same_first", "chance")], "verdict")


@query()
def pca_structure(spark, d):
    """Shares of variance and loadings of three axes, and whether the first has one sign."""
    _, shares, loadings = similarity.principal_axes(vectors_of(spark, d), "vec_id", "v", 3)
    same, verdict = similarity.axis_structure(shares, loadings)
    rows = [(k + 1, round(float(shares[k]), 6), [round(float(x), 5) for x in loadings[:, k]], same, verdict) for k in range(3)]
    return spark.createDataFrame(rows, "axis int, share double, loadings array<double>, same_sign boolean, verdict string")


@query()
def kmeans_grid(spark, d):
    """The least cost for 3 to 8 clusters, 25 starts each, by one pass an iteration."""
    found = clusters.fit(vectors_of(spark, d), "vec_id", "v", list(range(3, 9)))
    return spark.createDataFrame([(k, round(m.cost, 4), m.start) for k, m in found.items()], "k int, cost double, start int")


@query()
def cluster_decision(spark, d):
    """Two halves of the vectors as two windows: how alike they cluster, and what to show."""
    v = vectors_of(spark, d)
    halves = [v.select("vec_id", F.slice("v", s, 32).alias("v")) for s in (1, 33)]
    by_k = clusters.agreement(*halves, "vec_id", "v", list(range(3, 9)))
    top3 = similarity.agreement_at_k(*[neighbours.nearest_to_all(h, "vec_id", "v", 3) for h in halves], "vec_id")
    best = by_k.agg(F.max("adjusted_rand").alias("ari")).crossJoin(top3.agg(F.avg("jaccard").alias("jaccard")))  # single rows
    out = by_k.crossJoin(F.broadcast(best))  # a single row
    return out.select("k", "n", F.round("adjusted_rand", 6).alias("adjusted_rand"), F.round("jaccard", 6).alias("jaccard"), scalar.format_decision(F.col("ari"), F.col("jaccard")).alias("decision"))


@query(f"""WITH {COEF_SQL}, v AS (SELECT *, support >= 30 AS reliable FROM lg WHERE bucket = 'b0'), k AS (SELECT * FROM v WHERE CAST(id AS BIGINT) % 11 <> 0),
g AS (SELECT id, min(support) AS min_support, sum(support) AS tot_support, max(value - prior) FILTER ("end" = 'off') AS off, max(value - prior) FILTER ("end" = 'def') AS def, max(prior) FILTER ("end" = 'off') AS prior, max(bucket) AS bucket FROM k GROUP BY 1 HAVING bool_and(reliable) AND min(support) >= 40)
SELECT id, min_support, tot_support, round(off, 6) AS "off", round(def, 6) AS "def", round(prior, 6) AS prior, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN s_name ELSE id END AS label FROM g JOIN supplier ON CAST(s_suppkey AS VARCHAR) = id WHERE bucket = 'b0'""")
def gated_vectors(spark, d):
    """Vectors of players who are known, reliable and supported in every cell of the bucket."""
    long = ratings.long_ratings(coefs_of(spark, d), "id", 30.0)
    names = t(spark, d, "supplier").where("s_suppkey % 11 <> 0").select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    out = similarity.rating_vectors(long, names, "id", ["b0"], True, 40.0)
    return out.select("id", "min_support", "tot_support", F.round("b0__off", 6).alias("off"), F.round("b0__def", 6).alias("def"), F.round("prior", 6).alias("prior"), "label")
