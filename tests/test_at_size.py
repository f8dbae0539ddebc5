"""Results that hold however tables are dealt, and work that grows no faster than they do."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rosterspark.llm import quality
from rosterspark.operators import evaluate, neighbours, ridge, similarity
from rosterspark.plans import catalog, ratings_catalog  # noqa: F401
from rosterspark.sources import publish


def test_rating_sum_of_lists_without_order(spark):
    """Collected lists come in another order whenever they are computed again."""

    @F.udf("array<string>")
    def collected(k):
        import random

        return random.SystemRandom().sample([f"p{i}" for i in range(8)], 8) if k % 5 else None

    df = spark.range(200).select("id", collected.asNondeterministic()("id").alias("h"), F.array(F.lit("p1")).alias("w"))
    known = spark.createDataFrame([(f"p{i}", float(i)) for i in range(8)], "id string, r double")
    found = {(r["id"] % 5 == 0, r["x"], r["coverage"]) for r in evaluate.rating_sum(df, "h", "w", known, "id", "r").collect()}
    assert found == {(True, -1.0, 1.0), (False, 27.0, 1.0)}


def test_missing_keys_are_found_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        publish.publish_missing(spark.range(0, 1000, 2), f"file://{tmp_path}/t", ["id"], spark.range(1000), [])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert publish.manifest(spark, f"file://{tmp_path}/t")["missing"] == 500
    assert len(list(tmp_path.glob("t/missing/*/part-*.csv"))) > 1


def test_groups_of_one_size_are_not_met_by_their_size(spark):
    folds = ridge.assign_folds(spark.range(2000).withColumn("grp", F.col("id")), "grp")
    plan = folds._jdf.queryExecution().optimizedPlan().toString()
    hints = [line for line in plan.splitlines() if "Join Inner" in line and "_size" in line]
    assert len(hints) == 2 and all("strategy=broadcast" in line for line in hints)
    assert {r["count"] for r in folds.groupBy("fold").count().collect()} == {400}


def joined(df):
    """Operators of joins that hold each row against every other, in the executed plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [k for k in ("BroadcastNestedLoopJoin", "CartesianProduct") if k in plan]


@pytest.mark.parametrize("metric", ["euclid", "cosine"])
def test_queries_against_a_table_by_tiles(spark, metric):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(150, 5)), np.full((40, 5), 0.5), np.zeros((1, 5))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>")
    found = similarity.nearest(df.where("id % 10 = 0"), df, "id", "v", 6, metric, 8, 32)
    assert not joined(found)
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in found.collect()}
    with np.errstate(invalid="ignore", divide="ignore"):
        for q in range(0, len(x), 10):
            far = np.sqrt(((x - x[q]) ** 2).sum(1)) if metric == "euclid" else 1 - (x * x[q]).sum(1) / np.sqrt((x * x).sum(1) * (x[q] ** 2).sum())
            near = sorted((np.isnan(d), d, i) for i, d in enumerate(far) if i != q)[:6]
            assert [got[q, r][1] for r in range(1, 7)] == pytest.approx([d for _, d, _ in near], abs=1e-12, nan_ok=True)
            if metric == "euclid":
                assert [got[q, r][0] for r in range(1, 7)] == [i for _, _, i in near]
    assert [got[900, r] for r in range(1, 7)] == [(i, None) for i in range(6)]


def test_tiles_of_all_rows_meet_once(spark):
    """Vectors are not repeated for each block that they ask."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 16)))], "id long, v array<double>")
    written = {}
    keep = neighbours.materialise
    neighbours.materialise = lambda t, name: written.setdefault(name, keep(t, name))
    try:
        found = neighbours.nearest_to_all(df, "id", "v", 3, "euclid", 16).count()
    finally:
        neighbours.materialise = keep
    assert found == 1200 and written["asking"].columns == ["asks", "of"] and written["asking"].count() <= 25


def test_all_labelled_rows_teach_quality(spark, monkeypatch):
    """Each labelled row that is not held out is in the sums, and blocks may be dealt anyhow."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("These are plain words, number "), "id")).otherwise(F.concat(F.lit("!! BUY || NOW $$ @@ "), "id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    n, seen, sums = labels.where(~quality.held_out(F.col("doc_id"))).count(), [], quality._sums
    monkeypatch.setattr(quality, "BLOCK", 64)
    monkeypatch.setattr(quality, "_sums", lambda rows, of, width: (seen.append((rows.count(), rows.select("block").distinct().count())), sums(rows, of, width))[1])
    models = [quality.train(docs.repartition(k, "doc_id"), labels) for k in (2, 3)]
    assert set(seen) == {(n, min(-(-n // 64), seen[0][1]))} and seen[0][1] > 1
    assert all(np.array_equal(models[0][c], models[1][c]) for c in ("w", "mean", "sd", "cut"))
    x = np.array([quality.features("These are plain words, number 7"), quality.features("!! BUY || NOW $$ @@ 9")])
    good, bad = quality.score(x, models[0])
    assert good > quality.CUT > bad


def test_stints_are_made_once(spark):
    """All steps of a two-sided design read the written stints, not the lines again."""
    _, rows, _, _ = ratings_catalog.two_sided_of(spark, DATA)
    assert rows.inputFiles() and all("/stints-" in f for f in rows.inputFiles())
