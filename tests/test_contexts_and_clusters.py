"""The chain of fits by kind of shot, and k-means of many models, against plain recomputation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterspark.operators import clusters, krylov, shot_context
from rosterspark.operators.relational import GuardError


def dense(x, y, w, alpha, mu):
    xm, ym = w @ x / w.sum(), w @ y / w.sum()
    xc = x - xm
    beta = mu + np.linalg.solve(xc.T @ (w[:, None] * xc) + alpha * np.eye(x.shape[1]), xc.T @ (w * (y - ym - xc @ mu)))
    return beta, ym - xm @ beta


def test_the_chain_of_fits(spark):
    rng, n, rows_n, folds = np.random.default_rng(6), 14, 1200, 3
    true = rng.normal(size=2 * n)
    x = np.zeros((rows_n, 2 * n))
    for r in range(rows_n):
        x[r, rng.choice(n, 3, replace=False)] = 1
        x[r, n + rng.choice(n, 3, replace=False)] = 1
    kind, fold, w = rng.integers(0, 2, rows_n), rng.integers(0, folds, rows_n), rng.uniform(1, 4, rows_n)
    y = x @ np.where(np.arange(2 * n) < n, true, -true) * np.where(kind == 0, 1, 0.5) + rng.normal(size=rows_n)
    triplets = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(x), strict=True)], "row_id long, col int, value double")
    rows = spark.createDataFrame([(i, float(y[i]), float(w[i]), ["rim", "mid"][kind[i]], int(fold[i])) for i in range(rows_n)], "row_id long, y double, w double, bucket string, fold int")
    rows = rows.unionByName(spark.createDataFrame([(9999, 1.0, 1.0, "other", 0), (9998, 1.0, 1.0, None, 0)], rows.schema))
    tagged = shot_context.tagged(rows, "bucket", ["rim", "mid"], "fold", folds)
    design = krylov.pack(triplets, tagged, 2 * n, tag=F.col("tag"))
    offence, defence, alphas = true[:n].copy(), true[n:].copy(), (0.1, 3.0, 100.0)
    offence[3] = np.nan  # a player whom the overall ratings lack shrinks to 0
    found = shot_context.fit_all(design, ["rim", "mid"], folds, offence, defence, alphas)
    for k, f in enumerate(found):
        own = kind == k
        probe, _ = dense(x[own], y[own], w[own], shot_context.PROBE, np.zeros(2 * n))
        known = np.isfinite(offence)
        want = np.corrcoef(probe[:n][known], offence[known])[0, 1], np.corrcoef(probe[n:], defence)[0, 1]
        np.testing.assert_allclose(f.corr, want, rtol=1e-6)
        assert f.signs == (1.0, -1.0)
        mu = np.concatenate([np.nan_to_num(offence), -defence])
        errors = []
        for alpha in alphas:
            roots = []
            for h in range(folds):
                beta, b0 = dense(x[own & (fold != h)], y[own & (fold != h)], w[own & (fold != h)], alpha, mu)
                held = own & (fold == h)
                roots.append(np.sqrt(np.average((y[held] - b0 - x[held] @ beta) ** 2, weights=w[held])))
            errors.append(np.mean(roots))
        assert f.alpha == alphas[int(np.argmin(errors))] and f.at_edge == (f.alpha != 3.0)
        assert f.rmse == pytest.approx(min(errors), rel=1e-8)
        beta, b0 = dense(x[own], y[own], w[own], f.alpha, mu)
        np.testing.assert_allclose(f.beta, beta, rtol=1e-7, atol=1e-9)
        assert f.intercept == pytest.approx(b0)
        np.testing.assert_allclose(f.support, w[own] @ x[own])
    coefs = shot_context.coefficients(spark, found).where("col = 3 AND bucket = 'mid'").first()
    assert coefs["off_prior"] == 0 and coefs["def_beta"] == found[1].beta[n + 3]
    said = {r["bucket"]: r for r in shot_context.verdicts(tagged, found).collect()}
    assert said["rim"]["verdict"] == "STRONG" and said["rim"]["right_sign"] and said["rim"]["alpha"] == found[0].alpha


def test_signs():
    assert shot_context.signs_of((0.3, 0.2)) == (1.0, 1.0) and shot_context.signs_of((-0.3, 0.04)) == (1.0, -1.0)
    assert shot_context.signs_of((-0.3, -0.2)) == (-1.0, -1.0) and shot_context.signs_of((0.3, 0.2), (1.0, -1.0)) == (1.0, -1.0)
    with pytest.raises(GuardError):
        shot_context.signs_of((0.3, float("nan")))
    assert np.isnan(shot_context.correlation(np.ones(12), np.arange(12.0))) and np.isnan(shot_context.correlation(np.arange(9.0), np.arange(9.0)))


def test_all_models_against_one_by_one(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.4, (50, 3)) for c in ([0, 0, 0], [4, 0, 0], [0, 5, 0], [3, 3, 3])] + [np.zeros((20, 3))])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(9999, None)], "id long, v array<double>")
    found = clusters.fit(df, "id", "v", [2, 4], starts=4, seed=7)
    sample = np.array([r["v"] for r in df.where("v IS NOT NULL").orderBy(F.xxhash64("id", F.lit(7)), "id").collect()])
    for k in (2, 4):
        best = None
        for start in range(4):
            c = clusters._spread(sample, k, np.random.default_rng([7, k, start]))
            for _ in range(300):
                far = ((x[:, None] - c) ** 2).sum(2)
                own, cost = far.argmin(1), far.min(1).sum()
                moved = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
                done, c = np.allclose(moved, c, rtol=1e-9, atol=1e-12), moved
                if done:
                    break
            if best is None or round(cost, 9) < round(best[0], 9):
                best = cost, c
        assert found[k].cost == pytest.approx(best[0])
        np.testing.assert_allclose(found[k].centres, best[1], atol=1e-6)
    labels = clusters.assign(df, "id", "v", found).where("k = 4").collect()
    assert len(labels) == 220 and len({r["cluster"] for r in labels if r["id"] < 50 or r["id"] >= 200}) == 1
    assert clusters.fit(df.limit(0), "id", "v", [2]) == {} and len(clusters.fit(df.where("id >= 200"), "id", "v", [3], 2)) == 1


def test_models_fit_on_packed_blocks(spark):
    """Iterations read blocks of rows, not rows, and Spark adds few rows of sums; a row that
    is as near to equal centres counts once, and vectors of other lengths are told."""
    rng = np.random.default_rng(4)
    x = np.vstack([np.repeat([[1.0, 2.0], [5.0, 5.0]], [700, 300], 0), rng.normal(9, 0.1, (3 * clusters.BLOCK + 5, 2))])
    total = np.zeros((5, 4))
    centres = np.array([[1.0, 2.0], [5.0, 5.0], [1.0, 2.0], [1.0, 2.0], [9.0, 9.0]])
    weights = np.column_stack([-2 * centres, (centres * centres).sum(1)])
    for lo in range(0, len(x), clusters.BLOCK):
        clusters._add(x[lo : lo + clusters.BLOCK], weights, [(0, 5, 1)], total)
    assert total[:, 2].tolist() == [700, 300, 0, 0, 3 * clusters.BLOCK + 5]
    np.testing.assert_allclose(total[[0, 1, 4], :2], [[700, 1400], [1500, 1500], x[1000:].sum(0)])
    assert total[0, 3] == pytest.approx(((x[1000:] - 9) ** 2).sum())
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    # Four clusters of three distinct places or noise: centres that meet leave one without rows.
    found = clusters.fit(df, "id", "v", [2, 4], starts=12, seed=3)
    assert found[4].cost <= found[2].cost and found[4].cost <= ((x[1000:] - x[1000:].mean(0)) ** 2).sum() + 1e-9
    with pytest.raises(Exception, match="inhomogeneous|other lengths"):
        clusters.fit(df.unionByName(spark.createDataFrame([(10**6 + i, [1.0] * n) for i, n in enumerate((1, 3))], df.schema)), "id", "v", [2], starts=1)


@pytest.mark.parametrize("size", [1.0, 1e-100, 1e100])
def test_short_numbers_choose_no_other_centre(size):
    """rows that are about as near to two centres, closer than short numbers tell, and
    sizes that they do not hold."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 2, 8))  # two models of five centres
    mean = (centres[0, 0] + centres[1, 0]) / 2
    x = np.vstack([rng.normal(size=(200, 8)), mean + 1e-9 * rng.normal(size=(100, 8)), centres[:, 1]]) * size
    c = (centres * size).reshape(10, 8)
    total, want = np.zeros((10, 10)), np.zeros((10, 10))
    clusters._add(x, np.column_stack([-2 * c, (c * c).sum(1)]), [(0, 5, 2)], total)
    for m in range(2):
        far = ((x[:, None] / size - centres[None, :, m]) ** 2).sum(2)
        own = far.argmin(1) * 2 + m
        np.add.at(want, own, np.column_stack([x, np.ones(len(x)), np.zeros(len(x))]))
        want[m, -1] = far.min(1).sum() * size**2
    assert (total[:, 8] == want[:, 8]).all()
    np.testing.assert_allclose(total / size, want / size, rtol=1e-9, atol=1e-12)


def test_agreement_of_clusterings(spark):
    rng = np.random.default_rng(2)
    where = rng.integers(0, 3, 90)
    a = spark.createDataFrame([(i, [float(10 * where[i] + rng.normal()), 0.0]) for i in range(90)], "id long, v array<double>")
    b = a.where("id >= 5").unionByName(spark.createDataFrame([(500, [1.0, 1.0])], a.schema))
    found = {r["k"]: r for r in clusters.agreement(a, b, "id", "v", [3, 4], 5).collect()}
    assert found[3]["n"] == 85 and found[3]["adjusted_rand"] == pytest.approx(1.0) and set(found) == {3, 4}
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 1, 1), (1, 1, 0), (2, 0, 1), (2, 1, 1)], "k int, a int, b int")
    got = {r["k"]: r["adjusted_rand"] for r in clusters.adjusted_rand(labels, ["k"], "a", "b").collect()}
    assert got[1] == pytest.approx((1 - 2 * 3 / 6) / ((2 + 3) / 2 - 2 * 3 / 6)) and got[2] == 0.0
