"""Operators on small fixtures worked out by hand or by NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterspark.functions import arrays, scalar
from rosterspark.operators import digest, evaluate, ratings, relational, ridge, sequence, similarity
from rosterspark.sources import files, sinks
from rosterspark.streaming.splice import splice_stream

CODES = sequence.Codes(("2FGM",), ("TO",), ("D",), ("FTM",), ("FTM", "FTA"), ("EP",), ("EP", "SUB"))


def ends(spark, log):
    df = spark.createDataFrame([("g", i, t, c) for i, (t, c) in enumerate(log)], "game string, n int, team string, code string")
    out = sequence.possession_ends(df, (F.lit("A"), F.lit("B")), CODES)
    return [r["credited"] if r["ends"] else None for r in out.orderBy("n").collect()]


def test_possessions(spark):
    # A goal and its free throw count twice; a trip ends at its last free throw.
    assert ends(spark, [("A", "2FGM"), ("A", "FTM"), ("B", "TO")]) == ["A", "A", "B"]
    assert ends(spark, [("A", "FTM"), ("A", "FTM"), ("A", "FTM"), ("", "SUB"), ("A", "FTM")]) == [None, None, "A", None, "A"]
    # The end of a period is credited to whoever has the ball, if anyone has.
    assert ends(spark, [("A", "D"), (None, "EP"), (None, "EP"), ("B", "X"), (None, "EP")]) == ["B", "A", None, None, "B"]


def test_scalars(spark):
    df = spark.createDataFrame([(None, "12:30"), (" - ", "DNP"), ("0.5", ""), ("1", "3:6"), ("yes", None), ("\ttrue", "7")], "f string, m string")
    out = df.select(scalar.parse_flag(F.col("f")).alias("f"), F.round(scalar.minutes(F.col("m")), 3).alias("m")).collect()
    assert [r["f"] for r in out] == [False, False, False, True, True, True]
    assert [r["m"] for r in out] == [12.5, 0.0, 0.0, 3.1, 0.0, 0.0]
    ids = spark.createDataFrame([("P001",), ("pABC",), ("007",), ("Pa1",)], "i string").select(scalar.normal_id(F.col("i"))).collect()
    assert [r[0] for r in ids] == ["1", "ABC", "7", "PA1"]


def test_list_remap_keeps_places_and_nulls(spark):
    lists = [(1, ["b", "x", "a"], 7), (1, ["b", "x", "a"], 7), (2, [], 7), (3, None, 7), (None, ["a", None, "a"], 8), (4, ["b", "x", "a"], None)]
    df = spark.createDataFrame(lists, "k int, five array<string>, season int")
    table = spark.createDataFrame([("a", "1", 7), ("b", "2", 7), ("a", "3", 8), ("b", "4", None), ("a", "2", 7)], "f string, t string, season int")
    found = arrays.remap_list(df, "five", table, "f", "t", ["season"])
    assert found.columns == df.columns
    wanted = [(1, ["2", None, "1"], 7), (1, ["2", None, "1"], 7), (2, [], 7), (3, None, 7), (None, ["3", None, "3"], 8), (4, ["4", None, None], None)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    plain = arrays.remap_list(df, "five", table.where("season = 7"), "f", "t").where("k = 4").collect()
    assert plain[0]["five"] == ["2", None, "1"]


def test_rating_sum_keeps_every_row(spark):
    rows = [(1, ["a", "b"], ["c"]), (1, ["a", "b"], ["c"]), (2, [], None), (3, None, None), (4, ["x", None], ["a"]), (5, [], [])]
    df = spark.createDataFrame(rows, "k int, h array<string>, w array<string>")
    known = spark.createDataFrame([("a", 1.5), ("b", 2.0), ("c", -1.0), ("d", None)], "id string, r double")
    found = sorted((r["k"], r["x"], round(r["coverage"], 6)) for r in evaluate.rating_sum(df, "h", "w", known, "id", "r").collect())
    assert found == [(1, 4.5, 1.0), (1, 4.5, 1.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, -1.5, 0.333333), (5, 0.0, 0.0)]


def test_interval_text_rounds_as_sql_does(spark, duck):
    ends = [0.125, 0.375, 1.005, 2.675, -0.125, -0.001, -0.0, 0.0, 12345.675, 1e15 + 0.125, 9.995, float("inf"), None]
    df = spark.createDataFrame([(x, -x if x is not None else 1.0) for x in ends], "low double, high double")
    found = [r[0] for r in df.select(scalar.interval_text(F.col("low"), F.col("high"))).collect()]
    sql = "SELECT coalesce('[' || printf('%+.2f', ?::DOUBLE) || ', ' || printf('%+.2f', ?::DOUBLE) || ']', '')"
    assert found == [duck.execute(sql, [x, -x if x is not None else 1.0]).fetchone()[0] for x in ends]


def test_ridge_agrees_with_closed_form(spark):
    rng = np.random.default_rng(1)
    x = np.array([[j in rng.choice(6, 3, replace=False) for j in range(6)] for _ in range(60)], float)
    y, w = rng.normal(size=60), rng.uniform(1, 5, 60)
    triplets = spark.createDataFrame([(i, int(j), 1.0) for i in range(60) for j in np.flatnonzero(x[i])], "row_id int, col int, value double")
    rows = spark.createDataFrame([(i, float(y[i]), float(w[i])) for i in range(60)], "row_id int, y double, w double")
    mu = rng.normal(size=6)
    beta, b0 = ridge.fit(triplets, rows, 6, 7.0, mu)
    xc, yc = x - w @ x / w.sum(), y - w @ y / w.sum()
    wanted = mu + np.linalg.solve(xc.T @ (w[:, None] * xc) + 7 * np.eye(6), xc.T @ (w * (yc - xc @ mu)))
    assert np.allclose(beta, wanted, atol=1e-9) and np.isclose(b0, w @ (y - x @ beta) / w.sum())
    # A column that no row has keeps its prior, and a row that has no cell counts for the intercept.
    more = rows.unionByName(spark.createDataFrame([(99, 2.0, 3.0)], rows.schema))
    beta, b0 = ridge.fit(triplets, more, 7, 7.0, np.append(mu, 0.5))
    x, y, w = np.hstack([np.vstack([x, np.zeros(6)]), np.zeros((61, 1))]), np.append(y, 2.0), np.append(w, 3.0)
    assert beta[6] == 0.5 and np.isclose(b0, w @ (y - x @ beta) / w.sum())


def test_calibration_with_ties(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 70 else float(i), float(i), 1.0) for i in range(100)], "k int, f double, y double, w double")
    out = evaluate.calibration(df, "f", "y", "w", ["k"]).orderBy("bin").collect()
    assert [r["n"] for r in out] == [10] * 10 and [r["mean_y"] for r in out] == [4.5 + 10 * i for i in range(10)]


def test_sources_and_sinks(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    spark.createDataFrame([(1, 5)], "k int, flag int").write.parquet(f"{root}/season=2007/a")
    spark.createDataFrame([(2, "x", 3)], "k int, flag string, extra int").write.parquet(f"{root}/season=2008/b")
    rows = {tuple(r) for r in files.read_drifting(spark, root).select("k", "flag", "extra").collect()}
    assert rows == {(1, "5", None), (2, "x", 3)}
    (tmp_path / "m.csv").write_text("# note\nfrom_id,to_id\n001,1\n")
    assert [tuple(r) for r in files.read_csv_strings(spark, f"file://{tmp_path}/m.csv").collect()] == [("001", "1")]
    assert files.shard_counts(spark, f"{root}/season=2007").agg(F.sum("n")).collect()[0][0] == 1
    out = f"file://{tmp_path}/out"
    games = spark.createDataFrame([(2007, 1, "a"), (2008, 1, "b")], "season int, game int, v string")
    assert sinks.append_new(games, out, ["season", "game"], ["season"]).columns == games.columns
    sinks.append_new(games.withColumn("v", F.lit("later")), out, ["season", "game"], ["season"])
    sinks.overwrite_partitions(games.where("season = 2008").withColumn("v", F.lit("c")), out, ["season"])
    assert sorted((r["season"], r["v"]) for r in spark.read.parquet(out).collect()) == [(2007, "a"), (2008, "c")]
    done = sinks.completeness(games, games.where("season = 2007"), ["season", "game"]).collect()[0]
    assert (done["expected"], done["missing"], done["complete"]) == (2, 1, False)
    with pytest.raises(relational.GuardError):
        sinks.publish(games, f"{out}-p", ["absent"])


def test_stream_splices(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "season int, v string")
    sinks.overwrite_partitions(rows, target, ["season"])
    rows.where("season = 2").withColumn("v", F.lit("new")).write.parquet(source)
    splice_stream(spark, source, rows.schema, target, ["season"], f"file://{tmp_path}/c").awaitTermination(60)
    assert sorted((r["season"], r["v"]) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "new")]


def test_ratings(spark):
    coefs = spark.createDataFrame([("p", "rim", 1.0, 0.5, 200.0, -2.0, -1.0, 100.0)], "id string, bucket string, off_beta double, off_prior double, off_support double, def_beta double, def_prior double, def_support double")
    long = ratings.long_ratings(coefs, "id")
    assert {(r["end"], r["value"], r["deviation"], r["reliable"]) for r in long.collect()} == {("off", 1.0, 0.5, True), ("def", 2.0, 1.0, False)}
    board = spark.createDataFrame([("p", 0.5, 1.5)], "id string, offence double, defence double")
    with pytest.raises(relational.GuardError):
        ratings.require_priors(long, board, "id")
    shots = spark.createDataFrame([("x", ["x"], ["y"]), ("x", ["x"], ["x"]), ("z", None, ["z"])], "who string, h array<string>, a array<string>")
    sides = [r["side"] for r in ratings.orientation(shots, F.col("who"), F.col("h"), F.col("a")).collect()]
    assert sides == ["home", None, "away"]
    one = spark.createDataFrame([(1,), (1,)], "v int")
    assert digest.differing_rows(one, one.limit(1)).count() == 1 and digest.differing_rows(one, one).count() == 0


def test_tolerant_read_keeps_every_readable_shard(spark, tmp_path):
    root = f"file://{tmp_path}/mixed"
    spark.createDataFrame([(1, 5)], "k long, flag int").write.parquet(f"{root}/a")
    spark.createDataFrame([("x", "y")], "k string, flag string").write.parquet(f"{root}/b")
    spark.createDataFrame([(2.5,)], "k double").write.parquet(f"{root}/c")
    (tmp_path / "mixed" / "broken.parquet").write_bytes(b"no parquet")
    rows, left_out = files.read_tolerant(spark, root, ["k", "flag"])
    assert {tuple(r) for r in rows.collect()} == {("1", "5"), ("x", "y"), ("2.5", None)}
    assert len(left_out) == 1 and left_out[0].endswith("broken.parquet")


def test_footers_by_range_equal_those_of_whole_files(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    spark.range(50_000).selectExpr("id AS k", "sha2(string(id), 512) AS v").coalesce(1).write.parquet(f"{root}/season=2001/a b%20c")
    spark.createDataFrame([(1, 2)], "k int, flag int").write.parquet(f"{root}/season=2002")
    (tmp_path / "shards" / "cut.parquet").write_bytes(b"PAR1 and no footer")
    (tmp_path / "shards" / "empty.parquet").write_bytes(b"")  # in no listing of Spark's
    (tmp_path / "shards" / "note.txt").write_text("no shard")
    near, whole = (sorted(map(tuple, files.shard_layouts(spark, root, by_range).collect())) for by_range in (True, False))
    assert near == whole
    assert sorted(p.rsplit("/", 1)[1] for p, layout in near if layout is None) == ["cut.parquet"]
    assert len({layout for _, layout in near}) == 3
    with pytest.raises(OSError, match="no readable footer"):
        files.read_drifting(spark, root)
    one = files.read_drifting(spark, f"{root}/season=2001")
    assert one.columns == ["k", "v"] and one.count() == 50_000
    assert files.read_drifting(spark, f"{root}/season=2002", ("flag",)).collect()[0]["flag"] == "2"


def test_footers_in_a_store_that_only_spark_opens(spark, tmp_path):
    spark.createDataFrame([(1, 5)], "k int, flag int").write.parquet(f"file://{tmp_path}/s/a")
    spark.createDataFrame([("x",)], "k string").write.parquet(f"file://{tmp_path}/s/b")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shards.link./s", f"file://{tmp_path}/s")
    rows, left_out = files.read_tolerant(spark, "viewfs://shards/s", ["k", "flag"])
    assert {tuple(r) for r in rows.collect()} == {("1", "5"), ("x", None)} and left_out == []


def test_types_widen(spark):
    a, b = spark.createDataFrame([(1, 1)], "n int, s int"), spark.createDataFrame([(0.5, "x")], "n double, s string")
    out = relational.union_by_name([a, b])
    assert dict(out.dtypes) == {"n": "double", "s": "string"} and {tuple(r) for r in out.collect()} == {(1.0, "1"), (0.5, "x")}


def test_home_vote_counts_votes_only(spark):
    log = [("g", 1, "A", "x"), ("g", 2, "B", "p"), ("g", 3, "A", "p"), ("h", 1, "A", "x"), ("i", 1, "", "p"), ("i", 2, "B", "p")]
    df = spark.createDataFrame(log, "game string, n int, team string, who string").withColumn("five", F.array(F.lit("p")))
    assert {r["game"]: r["home_team"] for r in sequence.home_team(df, "who", "five").collect()} == {"g": "B", "i": "B"}


def test_lineup_keys_differ(spark):
    df = spark.createDataFrame([(["a", "b", None],), (["b", "a"],), (["a|b"],), (["a", "b"],)], "five array<string>")
    assert df.groupBy(arrays.lineup_key(F.col("five")).alias("k")).count().count() == 3


def test_two_sided_design_drops_and_clamps(spark):
    stints = [(1, ["a", "a", "b"], ["c"], 3.0, 0.0, 2, 0, 7), (2, ["a"], None, None, 4.0, 5, 8, 7)]
    df = spark.createDataFrame(stints, "s int, h array<string>, a array<string>, home_pts double, away_pts double, home_poss int, away_poss int, game int")
    rows = ridge.two_sided_rows(df, "s", "h", "a", "game")
    assert {(r["row_id"]["stint"], r["side"], r["y"], r["w"]) for r in rows.collect()} == {(1, 0, 150.0, 2.0), (2, 1, 50.0, 8.0)}
    index = ridge.require_index(ridge.player_index(df, ["h", "a"]), 3)
    cells = {(r["row_id"]["stint"], r["col"], r["value"]) for r in ridge.two_sided_design(rows, index, 3).collect()}
    assert cells == {(1, 0, 1.0), (1, 1, 1.0), (1, 5, 1.0), (2, 3, 1.0)}
    with pytest.raises(relational.GuardError):
        ridge.require_index(index.withColumn("col", F.lit(1)), 3)


def test_sinks_of_designs_and_windows(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    both = spark.createDataFrame([("rim", 1), ("mid", 2)], "bucket string, v int")
    sinks.overwrite_window(both, path, ["bucket"], [("rim",), ("mid",)])
    sinks.overwrite_window(both.where("bucket = 'rim'"), path, ["bucket"], [("rim",)])
    assert [tuple(r) for r in spark.read.parquet(path).select("bucket", "v").collect()] == [("rim", 1)]
    with pytest.raises(relational.GuardError):
        sinks.overwrite_window(both, path, ["bucket"], [("rim",)])
    sinks.write_design(both, both, both, f"{path}-d")
    assert [p.count() for p in sinks.read_design(spark, f"{path}-d")] == [2, 2, 2]
    sinks.write_report(both, f"{path}-r")
    assert spark.read.json(f"{path}-r").count() == 2
    assert relational.find_columns(both, ["BUCK"]) == ["bucket"]


def test_guards_of_predictors_and_priors(spark):
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "x double, c double")
    with pytest.raises(relational.GuardError):
        ratings.require_predictor(same, "x", "c")
    assert ridge.calibrate_signs(np.r_[np.arange(12.0), -np.arange(12.0)], np.arange(12.0), np.arange(12.0)) == (1, -1)
    row = spark.range(1).select(scalar.signal_of(F.lit(float("nan")), F.lit(0.2)).alias("s"), scalar.borderline(F.lit(0.11)).alias("b")).collect()[0]
    assert (row["s"]["signal"], row["s"]["driver"], row["s"]["right_sign"]) == (0.2, "def", False) and abs(row["b"] - 0.01) < 1e-9
    drift = files.schema_drift(same, same.withColumn("x", F.lit("s")))
    assert drift == [("x", "double", "string")]


def test_joined_once(spark):
    left = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (2, 1, "d"), (1, 1, "e")], "season int, play int, v string")
    right = spark.createDataFrame([(1, 1, "x"), (2, 9, "y"), (1, None, "z"), (1, None, "z")], "season int, number int, team string")
    both, report = relational.joined_once(left, right, [("season", "season"), ("play", "number")], ["season"])
    assert sorted((r["season"], r["play"], r["v"], r["team"]) for r in both.where("play IS NOT NULL").collect()) == [(1, 1, "a", "x"), (1, 1, "e", "x"), (1, 2, "b", None), (2, 1, "d", None)]
    assert both.count() == 5 and both.columns == ["season", "play", "v", "team"]
    assert sorted(map(tuple, report.collect())) == [(1, 4, 2), (2, 1, 0)]
    with pytest.raises(relational.GuardError):
        relational.joined_once(left, right.unionByName(right), [("season", "season"), ("play", "number")], ["season"])


def test_gated_vectors(spark):
    cells = [("a", b, e, s, rel, 1.0 + k, 0.5, d) for k, (b, e) in enumerate((b, e) for b in ("rim", "mid") for e in ("off", "def")) for s, rel, d in ((200.0, True, float(k)),)]
    cells += [(p, *c[1:]) for p in ("b", "c", "unknown") for c in cells[:4]]
    rows = [c if not (c[0] == "b" and c[1] == "mid" and c[2] == "def") else (*c[:4], False, *c[5:]) for c in cells]
    rows = [c for c in rows if not (c[0] == "c" and c[1] == "mid" and c[2] == "off")] + [("a", "far", "off", 1.0, False, 0.0, 0.0, 9.0)]
    long = spark.createDataFrame([(p, b, e, s, r, pr, d) for p, b, e, s, r, pr, _, d in rows], "id string, bucket string, end string, support double, reliable boolean, prior double, deviation double")
    names = spark.createDataFrame([("a", "Ann"), ("a", "Ann"), ("b", "Bo"), ("c", None), ("d", "Di")], "id string, name string")
    got = similarity.rating_vectors(long, names, "id", ["rim", "mid"]).collect()
    assert [r.asDict() for r in got] == [{"id": "a", "rim__off": 0.0, "rim__def": 1.0, "mid__off": 2.0, "mid__def": 3.0, "min_support": 200.0, "tot_support": 800.0, "prior": 1.0, "label": "Ann"}]
    assert {r["id"] for r in similarity.rating_vectors(long, names, "id", ["rim", "mid"], reliable_only=False).collect()} == {"a", "b"}
    assert {(r["id"], r["label"]) for r in similarity.rating_vectors(long, names, "id", ["rim"]).collect()} == {("a", "Ann"), ("b", "Bo"), ("c", "c")}
    assert similarity.rating_vectors(long, names, "id", ["rim"], least_support=201.0).count() == 0
    with pytest.raises(relational.GuardError):
        similarity.require_spread(similarity.rating_vectors(long, names, "id", ["rim"]), ["rim__off"])


def test_agreement_summary_and_axes(spark):
    agreed = spark.createDataFrame([(i, 0.1 if i % 2 else 0.3, i % 4 == 0) for i in range(40)], "id int, jaccard double, same_first boolean")
    row = similarity.agreement_summary(agreed, 40, 10).first()
    assert (row["n"], round(row["mean_jaccard"], 6), row["same_first"], row["chance"], row["verdict"]) == (40, 0.2, 0.25, 0.25, "NONE")
    assert similarity.agreement_summary(agreed, 400, 10).first()["verdict"] == "WEAK"
    assert similarity.agreement_summary(agreed.where("id < 9"), 9, 10).first()["verdict"] == "INCONCLUSIVE"
    assert similarity.agreement_summary(agreed.where("id < 0"), 0, 10).first()["verdict"] == "INCONCLUSIVE"
    assert similarity.axis_structure(np.array([0.7, 0.3]), np.array([[-0.6, 1], [-0.8, -1]])) == (True, "ONE_AXIS")
    assert similarity.axis_structure(np.array([0.5, 0.5]), np.array([[0.6, 1], [0.8, -1]])) == (True, "SEVERAL")
    assert similarity.axis_structure(np.array([0.9, 0.1]), np.array([[0.6, 1], [-0.8, -1]])) == (False, "SEVERAL")
