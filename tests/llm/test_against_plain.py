"""Fits and decoders against exhaustive or direct solutions, and plans that large inputs take."""

import itertools
import random

import numpy as np
from conftest import DATA, assert_same

from rosterspark.llm import decontaminate, quality, queries, toxicity


def test_pairwise_fit_is_the_logistic_solution():
    rng = np.random.default_rng(1)
    k = len(quality.FEATURES)
    good, bad = rng.normal(0.3, 1, (400, k)), rng.normal(0, 1, (300, k))
    model = quality.fit(good, bad)
    # The pairs that the fit draws, and their loss.
    again = np.random.default_rng(quality.SEED)
    a, b = (good - model["mean"]) / model["sd"], (bad - model["mean"]) / model["sd"]
    d = a[again.integers(len(a), size=quality.PAIRS)] - b[again.integers(len(b), size=quality.PAIRS)]

    def loss(w):
        return np.logaddexp(0, -(d @ w)).mean() + quality.L2 / 2 * (w @ w)

    w, step = np.zeros(k), 0.2
    for _ in range(3000):  # plain descent
        p = 1 / (1 + np.exp(d @ w))
        w -= step * (-(d.T @ p) / len(d) + quality.L2 * w)
    np.testing.assert_allclose(model["w"], w, atol=2e-3)
    assert loss(model["w"]) <= loss(w) + 1e-9
    for _ in range(20):
        assert loss(model["w"]) <= loss(model["w"] + rng.normal(0, 0.05, k))


def readings(token):
    """Every reading of a token with what it costs before the character model."""
    apart = len(token) > 1 and toxicity._SPACED.fullmatch(token) is not None
    spans, i = [], 0
    while i < len(token):
        j = i + 1
        while j < len(token) and (token[j] == token[i] or (apart and token[i] in toxicity.SEPARATORS and token[j] in toxicity.SEPARATORS)):
            j += 1
        spans.append(token[i:j])
        i = j
    choices = []
    for s in spans:
        ch, run = s[0], len(s)
        if apart and ch in toxicity.SEPARATORS:
            choices.append([("", 0.0), (" ", toxicity.P_WIDE_END if run > 1 else toxicity.P_END)])
        elif ch in toxicity.LEET:
            choices.append([(x * n, toxicity.P_SIGN * run) for x in toxicity.LEET[ch] for n in ((run,) if run < 3 else (1, 2))] + [("", toxicity.P_DROP)])
        elif ch.isalpha():
            choices.append([(s, 0.0)] if run < 3 else [(ch, toxicity.P_STRETCH), (ch * 2, toxicity.P_STRETCH)])
        else:
            choices.append([("", toxicity.P_SIGN)])
    for way in itertools.product(*choices):
        yield "".join(x for x, _ in way), sum(c for _, c in way)


def test_viterbi_against_all_readings():
    rng = np.random.default_rng(5)
    logp = np.log(rng.dirichlet(np.full(toxicity.CODES, 0.3), (toxicity.CODES, toxicity.CODES)) + 1e-9).astype(np.float32)
    restorer = toxicity.Restorer(logp)
    pick = random.Random(3)
    signs = "".join(toxicity.LEET)
    tokens = ["i d 1 0 t", "k1lll", "a  s s", "$$$h", "b.a.d", "h3lllo", "y o u  b a d"] + ["".join(pick.choice("abest" + signs[:6]) for _ in range(pick.randrange(2, 7))) for _ in range(40)]

    def value(said, cost):
        a = b = 0
        for c in said:
            k = toxicity._code(c)
            cost += float(logp[a][b][k])
            a, b = b, k
        return cost + float(logp[a][b][0])

    for token in tokens:
        best = max(value(said, cost) for said, cost in readings(token))
        found = restorer._decode(token)
        assert max(value(said, cost) for said, cost in readings(token) if said == found) >= best - 1e-4, token


def test_decontamination_where_fingerprints_are_many(spark, duck, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert_same(queries.op6_decontaminate(spark, DATA), duck, queries.OP6_SQL)
