"""Ratings by kind of shot, from one chain: probe, signs, priors, penalty, fit, verdict.

All kinds are systems of one design: a row's tag is its kind and its game's fold. A first
run fits every kind without a prior; how these probes go with the overall ratings says
which sign each end has. A second run fits every kind, and every kind less each fold, for
all penalties at once, shrunk to the signed overall ratings; held-out root errors choose
each kind's penalty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.operators import krylov, ratings, spread
from rosterspark.operators.relational import GuardError
from rosterspark.operators.ridge import SHRUNK_ALPHAS

# The probe's penalty, players that a correlation needs, and how clear it must be.
PROBE, LEAST_PLAYERS, CLEAR = 100.0, 10, 0.05
#: Where the probe is not clear: good attack raises points, good defence lowers them.
EXPECTED = (1.0, -1.0)


def tagged(rows: DataFrame, bucket: str, buckets: list[str], fold: str, n_folds: int) -> DataFrame:
    """``rows`` of the given kinds with their tags."""
    place = F.array_position(F.array(*map(F.lit, buckets)), F.col(bucket)) - 1
    return rows.where(F.col(bucket).isin(*buckets)).withColumn("tag", (place * n_folds + F.col(fold)).cast("int"))


@dataclass
class Fit:
    """One kind's fit: coefficients and priors of both ends by player, and how it came about."""

    bucket: str
    alpha: float
    rmse: float
    at_edge: bool
    corr: tuple[float, float]
    signs: tuple[float, float]
    beta: np.ndarray
    mu: np.ndarray
    support: np.ndarray
    intercept: float


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """NaN for few players, or where either side is one value."""
    known = np.isfinite(a) & np.isfinite(b)
    a, b = a[known], b[known]
    return float("nan") if len(a) < LEAST_PLAYERS or a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])


def signs_of(corr: tuple[float, float], forced: tuple[float, float] | None = None) -> tuple[float, float]:
    """The signs of both ends' priors: as forced, as the probe says, or as expected where
    either end of the probe is not clear. A probe without any correlation is an error."""
    if not all(map(np.isfinite, corr)):
        raise GuardError(f"the probe has no correlation: {corr}")
    if forced is not None:
        return forced
    return EXPECTED if min(map(abs, corr)) < CLEAR else tuple(1.0 if c >= 0 else -1.0 for c in corr)


def fit_all(design: krylov.Packed, buckets: list[str], n_folds: int, offence: np.ndarray, defence: np.ndarray, alphas: tuple[float, ...] = SHRUNK_ALPHAS, probe: float = PROBE, forced: tuple[float, float] | None = None) -> list[Fit]:
    """The fits of all kinds. ``offence`` and ``defence`` are the overall ratings by column,
    NaN for players without one, who shrink to 0. Columns 0 to n - 1 are attacks."""
    n, k = len(offence), len(buckets)
    tag_bucket, tag_fold = np.divmod(np.arange(k * n_folds), n_folds)
    own = (tag_bucket[:, None] == np.arange(k)).astype(float)
    whole = krylov.moments(design, krylov.tag_weights(own), k)
    beta, _ = krylov.fits(design, krylov.tag_weights(own), k, [probe])
    corrs = [(correlation(beta[0, :n, b], offence), correlation(beta[0, n:, b], defence)) for b in range(k)]
    signs = [signs_of(c, forced) for c in corrs]
    mu = np.column_stack([np.nan_to_num(np.concatenate([s * offence, t * defence])) for s, t in signs])
    # Each kind, then each kind less each fold in turn.
    less = np.hstack([own[:, [b]] * (tag_fold[:, None] != np.arange(n_folds)) for b in range(k)])
    judge = np.hstack([np.zeros_like(own), *[own[:, [b]] * (tag_fold[:, None] == np.arange(n_folds)) for b in range(k)]])
    systems = np.hstack([own, less])
    of = np.concatenate([np.arange(k), np.repeat(np.arange(k), n_folds)])
    if design.n_cols * systems.shape[1] > krylov.HELD:
        dealt = spread.Spread(design, krylov.tag_weights(systems), systems.shape[1])
        solved = spread.solve(dealt, list(alphas), mu, of)
        errors, intercept, chosen = solved.errors(judge), solved.intercept, solved.beta
        dealt.close()
    else:
        beta, intercept = krylov.fits(design, krylov.tag_weights(systems), systems.shape[1], list(alphas), mu[:, of])
        errors = krylov.errors(design, judge, beta, intercept)

        def chosen(j: int, b: int) -> np.ndarray:
            return beta[j, :, b]

    out = []
    for b, bucket in enumerate(buckets):
        first = k + b * n_folds
        choice = krylov.choose(list(alphas), errors[:, first : first + n_folds], rmse=True)
        j = list(map(float, alphas)).index(choice.alpha)
        out.append(Fit(bucket, choice.alpha, choice.errors[choice.alpha], choice.at_edge, corrs[b], signs[b], chosen(j, b), mu[:, b], whole.xw[:, b], float(intercept[j, b])))
    return out


def coefficients(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """(col, bucket, off_beta, off_prior, off_support, def_beta, def_prior, def_support)."""
    rows = []
    for f in fits:
        n = len(f.beta) // 2
        cells = zip(*(x.tolist() for v in (f.beta, f.mu, f.support) for x in (v[:n], v[n:])), strict=True)
        rows += [(i, f.bucket, ob, op, os, db, dp, ds) for i, (ob, db, op, dp, os, ds) in enumerate(cells)]
    return spark.createDataFrame(rows, "col int, bucket string, off_beta double, off_prior double, off_support double, def_beta double, def_prior double, def_support double")


def report(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """A row for each kind: how its fit came about."""
    rows = [(f.bucket, f.alpha, f.rmse, f.at_edge, *f.corr, *f.signs, f.intercept) for f in fits]
    return spark.createDataFrame(rows, "bucket string, alpha double, rmse double, at_edge boolean, corr_off double, corr_def double, sign_off double, sign_def double, intercept double")


def verdicts(rows: DataFrame, fits: list[Fit], pins: dict[str, str] | None = None) -> DataFrame:
    """Whether each kind's ratings can be told from noise, by the probes' correlations."""
    spark = rows.sparkSession
    long = ratings.long_ratings(coefficients(spark, fits).withColumn("id", F.col("col")), "id")
    corrs = report(spark, fits).select("bucket", "corr_off", "corr_def")
    return ratings.identifiability(rows, long, corrs, pins).join(report(spark, fits).select("bucket", "alpha", "at_edge"), "bucket")
