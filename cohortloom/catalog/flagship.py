"""AUC of each value-based signature per study, from raw tables to result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clinical as cl
from ..operators import features as ft
from ..operators import roc
from ..plans import derived as d
from . import sql as q
from .clinical import light_scores
from .scoring import r6


def signature_auc(spark, sf):
    """Gates, log, gene filter, scores, join with labels, rank-sum area."""
    valid = cl.drop_missing_response(d.basket_clinical(spark, sf))
    labelled = ft.join_response(light_scores(spark, sf), valid).withColumn("label", cl.encode_response())
    # scores are sums: samples with equal values may differ in the last digits
    labelled = labelled.withColumn("score", F.round("score", 9))
    ranked = roc.ranked_counts(labelled.withColumnRenamed("signature", "model_id"))
    return r6(roc.auc(ranked).withColumnRenamed("model_id", "signature"), "auc")


q.cte(
    "signature_counts",
    "light valid",
    q.counts_text(
        """(SELECT study, signature AS model_id, CASE response WHEN 'R' THEN 0 ELSE 1 END AS label, round(score, 9) AS score
        FROM light JOIN valid USING (study, sample_id))"""
    ),
)
QUERIES = {
    "signature_auc": (
        signature_auc,
        q.query(
            "signature_counts",
            f"SELECT study, model_id AS signature, round(auc, 6) AS auc FROM ({q.auc_text('signature_counts')})",
        ),
    ),
}
