"""Fits of any width against dense solutions, folds and bootstraps by hash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterspark.operators import krylov, ridge


def dense(x, y, w, alpha, mu):
    """Coefficients and intercept by the normal equations of the centred design."""
    xm, ym = w @ x / w.sum(), w @ y / w.sum()
    xc = x - xm
    beta = mu + np.linalg.solve(xc.T @ (w[:, None] * xc) + alpha * np.eye(x.shape[1]), xc.T @ (w * (y - ym - xc @ mu)))
    return beta, ym - xm @ beta


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n, p = 700, 23
    x = np.where(rng.random((n, p)) < 0.2, rng.normal(size=(n, p)), 0.0)
    x[:7] = 0  # rows without entries stay
    x[:, 20] *= 50  # columns of unlike sizes
    w, y, group = rng.random(n) + 0.1, rng.normal(size=n) + 5, rng.integers(0, 60, n)
    triplets = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "row_id long, col int, value double")
    rows = spark.createDataFrame([(i, float(y[i]), float(w[i]), int(group[i])) for i in range(n)], "row_id long, y double, w double, grp int")
    return x, y, w, group, triplets, rows


def test_all_folds_and_penalties_in_one_run(spark, data):
    x, y, w, group, triplets, rows = data
    design = krylov.pack(triplets, rows, 23, tag=F.col("grp") % 5)
    mu, alphas, fold = np.linspace(-1, 1, 23), [0.5, 30.0, 3000.0], group % 5
    for prior in (None, mu):
        beta, b0 = krylov.fits(design, krylov.tag_weights(1 - np.eye(5)), 5, alphas, prior)
        judged = krylov.errors(design, np.eye(5), beta, b0)
        for k in range(5):
            own = fold != k
            for j, alpha in enumerate(alphas):
                want, c = dense(x[own], y[own], w[own], alpha, np.zeros(23) if prior is None else prior)
                np.testing.assert_allclose(beta[j, :, k], want, rtol=1e-8, atol=1e-9)
                np.testing.assert_allclose(b0[j, k], c, rtol=1e-9)
                np.testing.assert_allclose(judged[j, k], np.average((y - c - x @ want)[~own] ** 2, weights=w[~own]), rtol=1e-8)


def test_choice_and_edge(spark, data):
    x, y, w, group, triplets, rows = data
    design = krylov.pack(triplets, rows, 23, tag=F.col("grp") % 5)
    alphas, own = [1.0, 10.0, 1e6], np.zeros((3, 5))
    for k in range(5):
        out = group % 5 == k
        for j, alpha in enumerate(alphas):
            beta, b0 = dense(x[~out], y[~out], w[~out], alpha, np.zeros(23))
            own[j, k] = np.average((y - b0 - x @ beta)[out] ** 2, weights=w[out])
    for rmse in (False, True):
        want = (np.sqrt(own) if rmse else own).mean(1)
        found = krylov.cross_validate(design, 5, alphas, rmse=rmse)
        best = alphas[int(want.argmin())]
        assert found.alpha == best and found.at_edge == (best in (1.0, 1e6))
        np.testing.assert_allclose(list(found.errors.values()), want, rtol=1e-9)
    assert krylov.choose([1.0, 2.0, 3.0], np.array([[3.0, np.nan], [1.0, np.nan], [2.0, np.nan]])).at_edge is False


def test_wide_fit_has_no_gradient(spark):
    n = 20_000
    triplets = spark.range(30_000).select(F.col("id").alias("row_id"), F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int") for k in range(5)])).alias("col"), F.lit(1.0).alias("value"))
    rows = spark.range(30_000).select(F.col("id").alias("row_id"), (F.xxhash64("id") % 100 / 10).alias("y"), (1 + F.col("id") % 3).alias("w"), (F.col("id") % 4).cast("int").alias("fold"))
    design = krylov.pack(triplets, rows, n, tag=F.col("fold"))
    table = np.vstack([np.ones(4), 1 - np.eye(4)]).T  # all rows, then all but a fold's
    beta, b0 = krylov.fits(design, krylov.tag_weights(table), 5, [3.0, 300.0])
    for k, own in ((0, rows), (2, rows.where("fold <> 1"))):
        for j, alpha in enumerate((3.0, 300.0)):
            coefs = spark.createDataFrame([(i, float(b), 0.0) for i, b in enumerate(beta[j, :, k])], "col int, beta double, mu double")
            kept = triplets.join(own.select("row_id"), "row_id", "left_semi")
            assert krylov.gradient(kept, own, coefs, float(b0[j, k]), alpha).agg(F.max(F.abs("gradient"))).first()[0] < 1e-7


def test_systems_without_rows_or_without_columns(spark, data):
    *_, triplets, rows = data
    design = krylov.pack(triplets, rows, 23)
    beta, b0 = krylov.fits(design, krylov.tag_weights(np.array([[1.0, 0.0]])), 2, [5.0])
    assert np.isfinite(beta).all() and not beta[0, :, 1].any() and b0[0, 1] == 0
    empty = krylov.pack(triplets.limit(0), rows, 4)
    beta, b0 = krylov.fits(empty, krylov.tag_weights(np.ones((1, 1))), 1, [5.0])
    assert not beta.any() and abs(b0[0, 0] - 5) < 0.2
    none = krylov.pack(triplets.limit(0), rows.limit(0), 4)
    assert not krylov.fits(none, krylov.tag_weights(np.ones((1, 1))), 1, [5.0])[0].any()


def test_poisson_bootstrap_against_refits(spark, data):
    x, y, w, group, triplets, rows = data
    design = krylov.pack(triplets, rows, 23, group=F.col("grp"))
    draws = krylov.poisson_bootstrap(design, 30.0, 40, seed=9)
    hashes = np.array([r[0] for r in rows.orderBy("row_id").select(F.xxhash64("grp")).collect()])
    times = krylov.poisson_weights(0, 40, 9)(np.zeros(len(hashes), int), hashes)
    assert all(len(np.unique(times[group == g], axis=0)) == 1 for g in np.unique(group))
    for k in (0, 17, 39):
        np.testing.assert_allclose(draws[k], dense(x, y, w * times[:, k], 30.0, np.zeros(23))[0], rtol=1e-8, atol=1e-9)
    # The same in parts, as wide designs take them.
    np.testing.assert_array_equal(times[:, 20:], krylov.poisson_weights(20, 20, 9)(np.zeros(len(hashes), int), hashes))
    # Poisson numbers of mean 1 and variance 1, and intervals like those of drawn groups.
    many = krylov.poisson_weights(0, 500, 1)(np.zeros(60, int), np.arange(60) * 7919)
    assert abs(many.mean() - 1) < 0.02 and abs(many.var() - 1) < 0.05
    low, high, se = krylov.intervals(krylov.poisson_bootstrap(design, 30.0, 300, seed=1))
    rng, sizes = np.random.default_rng(0), np.unique(group)
    drawn = []
    for _ in range(300):
        counts = np.bincount(rng.choice(len(sizes), len(sizes)), minlength=len(sizes))
        drawn.append(dense(x, y, w * counts[np.searchsorted(sizes, group)], 30.0, np.zeros(23))[0])
    _, _, want = krylov.intervals(np.array(drawn))
    assert np.median(se / want) == pytest.approx(1, abs=0.1) and (low < high).all()


def test_folds_without_a_list_of_groups(spark):
    rows = spark.range(3000).select((F.sqrt("id")).cast("int").alias("grp"), "id").unionByName(spark.range(900).select(F.lit(-7).alias("grp"), "id"))
    found = ridge.assign_folds(rows, "grp", 5)
    assert found.count() == 3900 and found.columns == ["grp", "id", "fold"]
    assert found.groupBy("grp").agg(F.countDistinct("fold").alias("n")).where("n <> 1").count() == 0
    load = {r["fold"]: r["count"] for r in found.groupBy("fold").count().collect()}
    sizes = {r["grp"]: r["count"] for r in rows.groupBy("grp").count().collect()}
    want = [0] * 5
    for g, k in ridge.balanced_folds(sizes).items():
        want[k] += sizes[g]
    assert sorted(load.values()) == sorted(want)
    assert ridge.assign_folds(rows.limit(0), "grp").count() == 0
