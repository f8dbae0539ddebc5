"""All rows' neighbours against all pairs."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rosterspark.operators import neighbours, similarity
from rosterspark.plans import catalog


def plain(ids, x, k, metric):
    out = []
    for a, v in zip(ids, x, strict=True):
        far = np.sqrt(((x - v) ** 2).sum(1)) if metric == "euclid" else 1 - (x @ v) / np.sqrt((x * x).sum(1) * (v @ v))
        near = sorted((round(float(d), 9) + 0.0, int(b)) for d, b in zip(far, ids, strict=True) if b != a)[:k]
        out += [(int(a), r, b, pytest.approx(d, abs=1e-7)) for r, (d, b) in enumerate(near, 1)]
    return out


@pytest.mark.parametrize(("metric", "block", "pivots"), [("euclid", 16, 40), ("euclid", 2048, 4096), ("euclid", 8, 3), ("cosine", 16, 100)])
def test_against_all_pairs(spark, metric, block, pivots):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(10 * c, 1, (60, 4)) for c in range(1, 5)] + [np.full((30, 4), 7.25), rng.normal(0, 50, (10, 4)), np.full((3, 4), -1.5)])
    ids = rng.permutation(len(x))
    rows = [(int(i), [float(a) for a in v], "x") for i, v in zip(ids, x, strict=True)] + [(5000, None, "x")]
    rows += [(6000, [0.0] * 4, "x")] if metric == "cosine" else []
    df = spark.createDataFrame(rows, "id long, v array<double>, rep string").repartition(3)
    got = sorted((r["id"], r["rank"], r["neighbour"], r["distance"]) for r in neighbours.nearest_to_all(df, "id", "v", 5, metric, block, pivots).collect())
    want = sorted(plain(ids, x, 5, metric), key=lambda r: r[:2])
    assert len(got) == len(want) == 5 * len(x)
    if metric == "euclid":
        assert got == want
    else:  # rounding of equal cosines may order them otherwise
        assert [(a, r, d) for a, r, _, d in got] == [(a, r, d) for a, r, _, d in want]


def test_few_rows_and_pruning(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [5.0, 5.0])], "id int, v array<double>")
    got = sorted(map(tuple, neighbours.nearest_to_all(df, "id", "v", 10).collect()))
    assert [(a, r, b) for a, r, b, _ in got] == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]
    assert neighbours.nearest_to_all(df.limit(0), "id", "v", 3).count() == 0
    assert neighbours.nearest_to_all(df.limit(1), "id", "v", 3).count() == 0
    same = spark.range(50).select("id", F.array(F.lit(1.0), F.lit(-0.0)).alias("v"))
    got = neighbours.nearest_to_all(same, "id", "v", 3).collect()
    assert len(got) == 150 and {r["neighbour"] for r in got if r["id"] > 3} == {0, 1, 2} and {r["distance"] for r in got} == {0.0}


def test_queries_in_blocks(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)], float(i % 7)) for i in range(60)], "id long, v array<double>, p double")
    asks = df.where("id % 4 = 0")
    whole, parts = (sorted(map(tuple, similarity.nearest(asks, df, "id", "v", 4, "cosine", n).collect())) for n in (4096, 4))
    assert whole == parts and len(whole) == 60
    one, many = (similarity.distance_against(asks, df, "id", "v", "p", n).first() for n in (4096, 4))
    assert one["n_pairs"] == many["n_pairs"] == 15 * 59 and one["corr"] == pytest.approx(many["corr"])


def test_every_row_asks_for_its_agreement(spark):
    """one row in a hundred asked before."""
    found = catalog.queries()["jaccard_at_k"](spark, DATA).select("vec_id")
    assert found.count() == found.distinct().count() == spark.read.parquet(f"{DATA}/embeddings.parquet").count()


@pytest.mark.parametrize(("size", "dims"), [(1.0, 64), (1e-180, 3), (1e150, 3), (0.0, 2)])
def test_short_numbers_lose_no_neighbour(size, dims):
    """Several stretches, ties, and sizes beyond what short numbers hold."""
    rng = np.random.default_rng(8)
    y = np.vstack([rng.normal(size=(4000, dims)), np.full((300, dims), 0.25), 1 + 1e-7 * rng.normal(size=(300, dims))]) * size
    x = np.vstack([y[::40], rng.normal(size=(10, dims)) * size])

    def exact(r, c):
        unit = size or 1.0
        return unit * np.sqrt(((x[r] / unit - y[c] / unit) ** 2).sum(1))

    row, col, far = neighbours.closest(x, y, 7, np.full(len(x), np.inf), exact)
    for i in range(len(x)):
        d = exact(np.full(len(y), i), np.arange(len(y)))
        want = np.lexsort((np.arange(len(y)), d))[:7]
        assert col[row == i].tolist() == want.tolist() and far[row == i].tolist() == d[want].tolist()
    rank = np.arange(len(y))[::-1]
    some = [(np.arange(0, len(x), 2), 0, 1000), (np.arange(len(x)), 1000, 4600)]
    row, col, _ = neighbours.closest(x, y, 7, np.full(len(x), np.inf), exact, some, rank)
    for i in range(len(x)):
        at = np.arange(1000 if i % 2 else 0, len(y))
        d = exact(np.full(len(at), i), at)
        assert col[row == i].tolist() == at[np.lexsort((rank[at], d))[:7]].tolist()
