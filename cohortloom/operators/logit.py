"""Logistic regression of the label on one score, all studies at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sigmoid
from .roc import KEYS, score_counts
from .scale import attach, keep

ITERATIONS = 25
TOLERANCE = 1e-8


def fit_logit(predictions: DataFrame, iterations: int = ITERATIONS, keys=KEYS) -> DataFrame:
    """(b0, b1, converged) per key by Newton steps; keys with one class only are left out.

    Rows enter as distinct scores with label counts. A step is one aggregate of
    five sums per key; the coefficients, one row per key, go back to the rows.
    Steps end when no key moves by more than ``TOLERANCE`` of its coefficients, or
    after ``iterations``. ``converged`` is false where that was not enough (separable
    classes) or a step had no solution (a constant score).
    """
    counts = keep(score_counts(predictions, keys))
    both = counts.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).filter("p > 0 and n > 0")
    coefficients = both.select(
        *keys, F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"), F.lit(None).cast("boolean").alias("converged")
    )
    for _ in range(iterations):
        coefficients = keep(newton_step(counts, coefficients, keys))
        if coefficients.filter("converged is null").isEmpty():
            break
    return coefficients.withColumn("converged", F.coalesce("converged", F.lit(False)))


def newton_step(counts: DataFrame, coefficients: DataFrame, keys=KEYS) -> DataFrame:
    """One step for every key whose ``converged`` is still unknown, from weighted sums over distinct scores."""
    x, n = F.col("score"), F.col("pos") + F.col("neg")
    rows = attach(counts, coefficients, keys).withColumn("_p", sigmoid(F.col("b0") + F.col("b1") * x))
    w, r = n * F.col("_p") * (F.lit(1.0) - F.col("_p")), F.col("pos") - n * F.col("_p")
    sums = rows.groupBy(*keys, "b0", "b1", "converged").agg(
        F.sum(w).alias("a"),
        F.sum(w * x).alias("b"),
        F.sum(w * x * x).alias("c"),
        F.sum(r).alias("u"),
        F.sum(r * x).alias("v"),
    )
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    # relative to its first term, so that neither few rows nor small scores matter
    solvable = det > F.lit(1e-12) * F.col("a") * F.col("c")
    moves = F.col("converged").isNull() & solvable
    d0 = F.when(moves, (F.col("c") * F.col("u") - F.col("b") * F.col("v")) / det).otherwise(F.lit(0.0))
    d1 = F.when(moves, (F.col("a") * F.col("v") - F.col("b") * F.col("u")) / det).otherwise(F.lit(0.0))
    still = lambda b, d: F.abs(d) <= F.lit(TOLERANCE) * (F.abs(b + d) + F.lit(0.1))
    known = F.when(~solvable, F.lit(False)).when(still(F.col("b0"), d0) & still(F.col("b1"), d1), F.lit(True))
    return sums.select(
        *keys,
        (F.col("b0") + d0).alias("b0"),
        (F.col("b1") + d1).alias("b1"),
        F.coalesce("converged", known).alias("converged"),
    )


def predict_logit(predictions: DataFrame, coefficients: DataFrame, keys=KEYS) -> DataFrame:
    """Replaces ``score`` by the fitted probability."""
    return (
        attach(predictions, coefficients, keys)
        .withColumn("score", sigmoid(F.col("b0") + F.col("b1") * F.col("score")))
        .drop("b0", "b1", "converged")
    )
