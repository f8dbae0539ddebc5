"""Exact quantiles against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterspark.operators import evaluate, relational, selection


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([rng.gauss(0, 10**k) for k in range(-6, 9, 3)])) for g in ("a", "b") for _ in range(400)]
    rows += [("one", 5.0), (None, -1.5), (None, None), ("null", None), ("same", 2.0), ("same", 2.0), ("same", 2.0), ("zero", 0.0), ("zero", -0.0), ("wide", -1e308), ("wide", 1e308), ("wide", 5e-324), ("wide", -5e-324)]
    rows += [("hot", 7.25)] * 3000 + [("hot", float(k)) for k in range(50)]
    return spark.createDataFrame(rows, "g string, v double").repartition(5), rows


def test_quantiles_against_sorting(values):
    df, rows = values
    fractions = [0.0, 0.025, 0.5, 2 / 3, 0.975, 1.0]
    for between in (True, False):
        found = {(r["g"], r["fraction"]): r["quantile"] for r in selection.quantiles(df, ["g"], "v", fractions, between).collect()}
        groups = {g for g, v in rows if v is not None}
        assert set(found) == {(g, f) for g in groups for f in fractions}
        for g in groups:
            own = sorted(v for x, v in rows if x == g and v is not None)
            for f in fractions:
                at = f * (len(own) - 1)
                if between:
                    low, high = own[int(np.floor(at))], own[int(np.ceil(at))]
                    want = low if low == high else low + (at - np.floor(at)) * (high - low)
                else:
                    want = own[int(np.floor(at + 0.5))]
                assert found[g, f] == want, (g, f)


def test_quantiles_of_a_whole_column(spark, values):
    df, rows = values
    own = sorted(v for _, v in rows if v is not None)
    found = {r["fraction"]: r["quantile"] for r in selection.quantiles(df, [], "v", [0.25, 0.5]).collect()}
    assert found == {f: pytest.approx(np.quantile(own, f)) for f in (0.25, 0.5)}
    whole = spark.range(-500, 10_001).select((F.col("id") * 10**14).alias("v"))
    assert {r["quantile"] for r in selection.quantiles(whole, [], "v", [0.1, 0.9], between=False).collect()} == {550 * 10**14, 8950 * 10**14}
    assert selection.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0 == selection.quantiles(df.limit(0), [], "v", [0.5]).count()


def test_no_task_holds_a_group(spark, values):
    """Windows see ranges, not rows: a row for each range of a group."""
    df, _ = values
    got = relational.linear_quantile(df, ["g"], "v", 0.5).where("g = 'hot'").collect()
    assert got[0]["quantile"] == 7.25
    near = relational.nearest_quantile(df, ["g"], "v", 0.5).where("g = 'same'").collect()
    assert near[0]["quantile"] == 2.0 and near[0].asDict().keys() == {"g", "quantile"}


def test_corner_against_all_rules(spark):
    rng = np.random.default_rng(1)
    x, y = np.round(rng.uniform(0, 750, 300)), np.round(rng.uniform(-50, 900, 300))
    wanted = (x >= 600) & (y <= 210)
    df = spark.createDataFrame([(float(a), float(b), bool(w)) for a, b, w in zip(x, y, wanted, strict=True)] + [(None, 1.0, True)], "x double, y double, w boolean")
    steps = 12
    a, b, share = evaluate.corner_search(df, F.col("x"), F.col("y"), F.col("w"), steps)
    gx, gy = np.quantile(x, np.linspace(50, 99.5, steps) / 100), np.quantile(y, np.linspace(0.5, 60, steps) / 100)
    scores = [[np.mean(((x >= p) & (y <= q)) == wanted) for q in gy] for p in gx]
    best = np.max(scores)
    i, j = np.argwhere(np.array(scores) == best)[0]
    assert (a, b, share) == (pytest.approx(gx[i]), pytest.approx(gy[j]), pytest.approx(best))
    assert all(np.isnan(evaluate.corner_search(df.limit(0), F.col("x"), F.col("y"), F.col("w"), steps)))
