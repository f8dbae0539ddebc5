"""Fits whose vectors stay in tasks, against those that the driver holds."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterspark.operators import krylov, shot_context, spread


@pytest.fixture(scope="module")
def design(spark):
    """Rows in four tags; columns 40 to 59 have no entries."""
    n = 60
    triplets = spark.range(900).where("id % 50 <> 0").select(F.col("id").alias("row_id"), F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40)).cast("int") for k in range(3)])).alias("col"), F.lit(1.0).alias("value"))
    rows = spark.range(900).select(F.col("id").alias("row_id"), (F.xxhash64("id") % 100 / 10).alias("y"), (1 + F.col("id") % 3).alias("w"), (F.col("id") % 4).cast("int").alias("fold"), (F.col("id") % 90).alias("grp"))
    return krylov.pack(triplets, rows, n, tag=F.col("fold"), group=F.col("grp"))


def held(monkeypatch, numbers):
    monkeypatch.setattr(krylov, "HELD", numbers)


@pytest.mark.parametrize("columns", [7, 1024])
def test_spread_fits_are_those_of_the_driver(design, columns):
    weigh, alphas, judge = krylov.tag_weights(np.hstack([1 - np.eye(4), np.zeros((4, 1))])), [0.5, 30.0, 3000.0], np.hstack([np.eye(4), np.zeros((4, 1))])
    priors, of = np.column_stack([np.linspace(-1, 1, 60), np.linspace(2, 0, 60)]), np.array([0, 1, 0, 1, 1])
    for mu in (None, priors):
        beta, b0 = krylov.fits(design, weigh, 5, alphas, None if mu is None else mu[:, of])
        dealt = spread.Spread(design, weigh, 5, columns)
        found = spread.solve(dealt, alphas, mu, None if mu is None else of)
        for j in range(3):
            np.testing.assert_allclose(found.beta(j), beta[j], rtol=1e-9, atol=1e-10)
            np.testing.assert_allclose(found.beta(j, 2), beta[j, :, 2], rtol=1e-9, atol=1e-10)
        np.testing.assert_allclose(found.intercept, b0, rtol=1e-9)
        np.testing.assert_allclose(found.errors(judge), krylov.errors(design, judge, beta, b0), rtol=1e-9)
        dealt.close()


def test_spread_draws_and_intervals(design, monkeypatch):
    want = krylov.poisson_bootstrap(design, 30.0, 12, 5)
    monkeypatch.setattr(spread, "PART", 60 * 5)  # draws in several runs
    held(monkeypatch, 0)
    table = spread.draws_of(design, 30.0, 12, 5)
    found = {r["col"]: r["draws"] for r in table.collect()}
    np.testing.assert_allclose([found[c] for c in range(60)], want.T, rtol=1e-9, atol=1e-10)
    ends = {r["col"]: (r["low"], r["high"], r["se"]) for r in spread.intervals(table).collect()}
    np.testing.assert_allclose([ends[c] for c in range(60)], np.array(krylov.intervals(want)).T, rtol=1e-8, atol=1e-9)


def test_vectors_do_not_reach_the_driver(design, monkeypatch):
    """No step sends the columns' sums; only solutions that are asked for come, once."""
    sent = []
    monkeypatch.setattr(krylov, "_summed", lambda *a, **k: pytest.fail("columns' sums reached the driver"))
    held(monkeypatch, 0)
    beta = spread.Solved.beta
    monkeypatch.setattr(spread.Solved, "beta", lambda *a: (sent.append(a), beta(*a))[1])
    spread.draws_of(design, 30.0, 4).collect()
    assert not sent
    krylov.fits(design, krylov.tag_weights(np.ones((4, 1))), 1, [1.0, 5.0])
    assert len(sent) == 2


def test_kinds_of_shots_spread(design, monkeypatch):
    overall = np.linspace(-1, 1, 30)
    want = shot_context.fit_all(design, ["a", "b"], 2, overall, overall[::-1].copy(), (1.0, 30.0), forced=(1.0, -1.0))
    held(monkeypatch, 0)
    found = shot_context.fit_all(design, ["a", "b"], 2, overall, overall[::-1].copy(), (1.0, 30.0), forced=(1.0, -1.0))
    for a, b in zip(found, want, strict=True):
        assert (a.bucket, a.alpha, a.at_edge, a.signs) == (b.bucket, b.alpha, b.at_edge, b.signs)
        for x, y in ((a.rmse, b.rmse), (a.corr, b.corr), (a.beta, b.beta), (a.mu, b.mu), (a.support, b.support), (a.intercept, b.intercept)):
            np.testing.assert_allclose(x, y, rtol=1e-8, atol=1e-9)


def test_a_system_that_one_step_solves(spark, monkeypatch):
    triplets = spark.range(20).select(F.col("id").alias("row_id"), F.lit(0).alias("col"), (F.col("id") % 3).cast("double").alias("value"))
    rows = spark.range(20).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("y"), F.lit(1.0).alias("w"))
    design = krylov.pack(triplets, rows, 1)
    want, b0 = krylov.fits(design, krylov.tag_weights([[1.0]]), 1, [2.0])
    held(monkeypatch, 0)
    found, c0 = krylov.fits(design, krylov.tag_weights([[1.0]]), 1, [2.0])
    np.testing.assert_allclose(found, want)
    np.testing.assert_allclose(c0, b0)
    none = krylov.pack(triplets.limit(0), rows.limit(0), 4)
    assert not krylov.fits(none, krylov.tag_weights([[1.0]]), 1, [5.0])[0].any()


@pytest.mark.parametrize("plain", [True, False])
def test_products_of_a_block(plain):
    """rows of all lengths, a column that most rows hold, values that are 1 or not."""
    rng = np.random.default_rng(3)
    held = rng.integers(0, 7, 900)
    c = rng.integers(0, 50, held.sum()) * 3
    c[rng.random(len(c)) < 0.4] = 6
    v = np.ones(len(c)) if plain else rng.normal(size=len(c))
    dense = np.zeros((900, 150))
    np.add.at(dense, (np.repeat(np.arange(900), held), c), v)
    order, laid = krylov._laid(held, c, v)
    dense, numbers = dense[order], {"tag": np.zeros(900), "grp": np.arange(900), "w": np.ones(900), "y": np.zeros(900)}
    row = SimpleNamespace(n=900, **{k: np.asarray((numbers | laid)[k]).astype(kind).tobytes() for k, kind in krylov.KINDS.items()})
    assert bool(len(laid["v"])) != plain
    for systems in (1, 6):
        block = krylov.Block(row, lambda tag, grp, systems=systems: np.ones((len(tag), systems)))
        vectors, by_row, total = rng.normal(size=(150, systems)), rng.normal(size=(900, systems)), np.ones((150, systems))
        np.testing.assert_allclose(block.times(vectors), dense @ vectors, atol=1e-12)
        block.add_to(total, by_row)
        np.testing.assert_allclose(total, 1 + dense.T @ by_row, atol=1e-11)


def test_draws_by_leading_bits_are_those_of_all_bits():
    groups = np.random.default_rng(1).integers(-(2**62), 2**62, 3000)

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))

    with np.errstate(over="ignore"):
        salt = mixed(np.arange(5, 45, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
        u = (mixed(groups.view(np.uint64)[:, None] ^ salt) >> np.uint64(11)) / float(1 << 53)
    want = np.searchsorted(krylov._POISSON, u, side="right")
    weigh = krylov.poisson_weights(4, 40, 7)
    assert (weigh(None, groups) == want).all()
    assert (weigh(None, np.repeat(groups, 3)) == np.repeat(want, 3, axis=0)).all()


def test_each_part_has_a_task_of_its_own(design):
    dealt = spread.Spread(design, krylov.tag_weights(np.ones((4, 1))), 1)
    held = [r["n"] for r in dealt.blocks.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("part").alias("n")).collect()]
    assert set(held) == {1} and len(held) == dealt.blocks.rdd.getNumPartitions()
    dealt.close()
