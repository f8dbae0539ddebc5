"""Quality classifier: Bradley-Terry ranking from preference pairs.

A document is a short vector of surface shares (marks, capitals, repeats, word
lengths, line shapes). Pairs of a better and a worse labelled document teach a
weight vector: P(a before b) = sigmoid(w . (x_a - x_b)), fitted by logistic loss
on the differences. The resulting utilities are cut at the quantile of the
training scores that the share of worse labels gives; the score is a logistic
curve through that cut at ``CUT``.

Every labelled row that is not held out teaches: rows are dealt into blocks by
hashes of their ids, and in a block each better row is held against each worse
one. Blocks hand on sums, which are added exactly, so that their order tells
nothing; means, deviations and the cut are those of all these rows. Few rows
are one block, so all pairs. Scoring reads every row and whole texts.

Cases: a null or empty text has the vector of a text without words and gets a
score like any other; repeated rows are scored alike; labels that are null, or
of ids without a document, teach nothing; an empty table gives an empty table;
without both labels every score is 0.5; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import held_out, materialise
from rosterspark.operators.selection import quantiles

#: Rows of a block, about; the rarer label's in a block at least, about.
BLOCK, RARER = 1024, 16
PAIRS, STEPS, L2, SEED = 60_000, 60, 1e-4, 7
#: The score from which on a document is kept.
CUT = 0.7
FEATURES = ("mark", "bang", "bar", "capital", "digit", "stop", "beyond_ascii", "repeat", "same", "distinct", "word", "spread", "line", "length", "lower_start", "mark_words")

_CLASS = np.zeros(256, np.int64)  # 0 other marks, 1 lower, 2 upper, 3 digit, 4 blank, 5 newline, 6 . , ; : ' - ?, 7 beyond ASCII, 8 !, 9 |
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\r", 4), ("\n", 5), (".,;:'-?\"()", 6), ("!", 8), ("|", 9)):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 7


def features(text: str | None) -> np.ndarray:
    """The vector of one whole text."""
    text = text or ""
    words = text.split()
    n = len(words)
    count = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=10).astype(float)
    chars = max(count.sum(), 1.0)
    repeats = sum(map(eq, words, islice(words, 1, None)))
    distinct = len(set(words))
    marked = sum(not w[-1].isalnum() and not w[-2:-1].isalnum() for w in words)
    share = lambda x, of: np.sqrt(x / max(of, 1))
    letters = count[1] + count[2]
    return np.array([
        share(count[0], chars), share(count[8], n), share(count[9], n), share(count[2], letters), share(count[3], chars), share(count[6], n), share(count[7], chars),
        share(repeats, n), share(n - distinct, n), np.log1p(distinct) - 0.75 * np.log1p(n), min((chars - count[4] - count[5]) / max(n, 1), 40) / 10,
        np.log1p(letters) - np.log1p(chars), np.log1p(n / (count[5] + 1)), np.log1p(n), float(text[:1].islower()), share(marked, n),
    ])


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "x": [features(t).tolist() for t in b["text"]]})


def fit(good: np.ndarray, bad: np.ndarray) -> dict:
    """Weights from preference pairs (a row of ``good`` over a row of ``bad``)."""
    if not len(good) or not len(bad):
        return {"w": np.zeros(len(FEATURES)), "mean": np.zeros(len(FEATURES)), "sd": np.ones(len(FEATURES)), "cut": 0.0, "scale": 0.0}
    rng = np.random.default_rng(SEED)
    both = np.vstack([good, bad])
    mean, sd = both.mean(0), both.std(0) + 1e-6
    good, bad = (good - mean) / sd, (bad - mean) / sd
    d = good[rng.integers(len(good), size=PAIRS)] - bad[rng.integers(len(bad), size=PAIRS)]
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):  # Newton steps of the pairwise logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d.T @ p) / len(d) + L2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + (L2 + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return {"w": w, "mean": mean, "sd": sd, "good": good @ w, "bad": bad @ w}


def cut_by_quantile(model: dict, share_bad: float) -> dict:
    """Puts the cut at the quantile ``share_bad`` of the weighted training scores."""
    if "good" not in model:
        return model
    good, bad = model.pop("good"), model.pop("bad")
    scores = np.concatenate([good, bad])
    weights = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
    order = np.argsort(scores, kind="stable")
    reached = np.cumsum(weights[order])
    at = min(int(np.searchsorted(reached, share_bad)), len(scores) - 1)
    # Halfway between the scores about the quantile.
    return model | {"cut": float((scores[order][at] + scores[order][max(at - 1, 0)]) / 2), "scale": 1.0}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    utility = ((x - model["mean"]) / model["sd"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(model["scale"] * (utility - model["cut"]) + np.log(CUT / (1 - CUT)) * (model["scale"] > 0), -30, 30)))


def _sums(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sums of what ``of`` gives for each block's better and worse vectors, ``width`` numbers."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(b["x"].to_list()).reshape(-1, len(FEATURES)), b["label"].to_numpy()
        order = np.lexsort(x.T)  # rows come in no fixed order
        x, y = x[order], y[order]
        return pd.DataFrame({"at": np.arange(width), "s": of(x[y == 1], x[y == 0])})

    each = rows.groupBy("block").applyInPandas(run, "at int, s double")
    # Decimals add up to the same in any order.
    found = each.groupBy("at").agg(F.sum(F.round("s", 9).cast("decimal(38,9)")).cast("double").alias("s")).collect()  # ``width`` rows
    out = np.zeros(width)
    for r in found:
        out[r["at"]] = r["s"]
    return out


def _newton(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient, then Hessian, of the pairwise logistic loss over all pairs of a block."""
    if not len(good) or not len(bad):
        return np.zeros(len(w) * (len(w) + 1))
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30, 30)))
    gradient = bad.T @ p.sum(0) - good.T @ p.sum(1)
    q = p * (1 - p)
    mixed = good.T @ q @ bad
    hessian = (good * q.sum(1)[:, None]).T @ good + (bad * q.sum(0)[:, None]).T @ bad - mixed - mixed.T
    return np.concatenate([gradient, hessian.ravel()])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fits on all labelled rows that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    # Vectors are made before they meet labels: texts stay where they are.
    vectors = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text").mapInPandas(_vectors, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")
    rows = materialise(vectors.join(known, "doc_id").select("doc_id", "label", "x"), "quality-vectors")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row for each label
    k, n = len(FEATURES), sum(counts.values())
    if len(counts) < 2:
        return {"w": np.zeros(k), "mean": np.zeros(k), "sd": np.ones(k), "cut": 0.0, "scale": 0.0}
    blocks = max(1, min(-(-n // BLOCK), min(counts.values()) // RARER))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(blocks)))
    mean = _sums(rows, lambda good, bad: good.sum(0) + bad.sum(0), k) / n
    sd = np.sqrt(_sums(rows, lambda good, bad: ((good - mean) ** 2).sum(0) + ((bad - mean) ** 2).sum(0), k) / n) + 1e-6
    pairs = max(_sums(rows, lambda good, bad: np.array([float(len(good) * len(bad))]), 1)[0], 1.0)
    w = np.zeros(k)
    for _ in range(STEPS):
        found = _sums(rows, lambda good, bad, w=w: _newton((good - mean) / sd, (bad - mean) / sd, w), k * (k + 1)) / pairs
        gradient, hessian = found[:k] + L2 * w, found[k:].reshape(k, k) + (L2 + 1e-6) * np.eye(k)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break

    @F.pandas_udf("double")
    def utility(x: pd.Series) -> pd.Series:
        return pd.Series(((np.array(x.to_list()).reshape(-1, k) - mean) / sd) @ w)

    # Halfway between the scores about the quantile.
    scored = materialise(rows.select(utility("x").alias("u")), "quality-utilities")
    cut = quantiles(scored, [], "u", [(counts[0] - 0.5) / (n - 1)]).collect()[0]["quantile"]
    return {"w": w, "mean": mean, "sd": sd, "cut": float(cut), "scale": 1.0}


def score_column(model: dict):
    """A column function from a text to its score; other columns stay in the JVM."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(score(x, model))

    return scored


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column ``quality_score`` from 0 to 1."""
    return docs.withColumn("quality_score", score_column(model)("text"))


def keep_good(docs: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns."""
    return docs.where(score_column(model)("text") >= cut)
