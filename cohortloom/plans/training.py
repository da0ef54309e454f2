"""From cohorts to training features, and from features to local models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting as bo
from ..operators import clinical as cl
from ..operators import features as ft
from ..operators import roc
from ..operators import scoring as sc
from ..operators.scale import keep
from ..sources.cohorts import first_k_cohorts


def training_features(
    expression: DataFrame,
    clinical: DataFrame,
    signature: DataFrame,
    info: DataFrame,
    selected: DataFrame,
    cohorts: int | None = None,
    kcdf: str = "none",
) -> tuple[DataFrame, DataFrame]:
    """(scores, valid): complete scores of the features all studies share.

    ``expression`` is in TPM. Gates come before scoring and unselected signatures
    are not scored at all; signatures are scored independently, so the result is
    the same. All studies take part unless ``cohorts`` asks for the first few by name.
    """
    clinical = first_k_cohorts(clinical, cohorts) if cohorts else clinical
    valid = keep(cl.cohort_size_gate(cl.drop_missing_response(clinical.select("study", "sample_id", "response"))))
    logged = keep(sc.log_expr(cl.restrict_samples(expression, valid)))
    wanted = keep(ft.select_signatures(signature, selected))
    scores = sc.score_all(sc.gene_missing_filter(logged), wanted, info, kcdf)
    complete = keep(sc.drop_incomplete_signatures(keep(sc.score_assemble(valid, wanted, scores))))
    return ft.filter_common(complete, ft.common_features(complete)), valid


def train_local_models(
    scores: DataFrame, valid: DataFrame, grid: dict[str, list] = bo.GRID, bins: int = 256
) -> dict[str, DataFrame]:
    """Grid search per study and the chosen model: model, tree_node, importance, summary."""
    rows = scores.select("study", "sample_id", F.col("signature").alias("feature"), F.col("score").alias("value"))
    labels = valid.select("study", "sample_id", cl.encode_response().alias("label"))
    samples, lists = bo.prepare_samples(keep(rows), labels, bins)
    lists = keep(lists)
    studies = lists.select("study")
    seeds, settings = keep(bo.study_seeds(studies)), keep(bo.param_grid(studies, grid))
    nodes, margins = bo.train_per_study(samples, lists, settings, seeds)
    margins = keep(margins)
    best = keep(bo.select_best(bo.grid_auc(margins, settings), settings))
    nodes, margins = bo.chosen_models(nodes, margins, best, settings)
    tree_node = keep(nodes.withColumn("model_id", F.col("study")))
    predictions = margins.select(
        "study", "sample_id", "label", F.col("study").alias("model_id"), F.round(bo.sigmoid(F.col("margin")), 9).alias("score")
    )
    thresholds = roc.youden_threshold(roc.ranked_counts(predictions))
    model = best.select(
        F.col("study").alias("model_id"),
        "study",
        "config_id",
        F.lit(0.0).alias("base_margin"),
        F.col("nrounds").alias("n_trees"),
        "eta",
        "max_depth",
        "colsample",
        "subsample",
    )
    return {
        "model": model,
        "tree_node": tree_node.drop("study", "config_id"),
        "importance": bo.feature_importance(tree_node),
        "summary": bo.train_summary(best, thresholds),
    }
