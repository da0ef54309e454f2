"""Feature tables: selection, layout, common features, alignment to a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import attach, keep

SAMPLE = ["study", "sample_id"]


def select_signatures(scores: DataFrame, selected: DataFrame) -> DataFrame:
    return attach(scores, selected.select("signature").distinct(), ["signature"], "left_semi")


def pivot_scores(scores: DataFrame, features: list[str]) -> DataFrame:
    """One column per feature; the given list spares Spark a job to find them."""
    return scores.groupBy(*SAMPLE).pivot("signature", features).agg(F.first("score"))


def join_response(scores: DataFrame, valid: DataFrame) -> DataFrame:
    return scores.join(valid.select(*SAMPLE, "response"), SAMPLE)


def common_features(scores: DataFrame) -> DataFrame:
    """Features present in every study."""
    pairs = keep(scores.select("study", "signature").distinct())
    studies = pairs.agg(F.count_distinct("study").alias("n_studies"))
    return (
        pairs.groupBy("signature")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == studies.scalar())
        .select("signature")
    )


def filter_common(scores: DataFrame, common: DataFrame) -> DataFrame:
    return attach(scores, common.select("signature"), ["signature"], "left_semi")


def audit_columns(scores: DataFrame) -> DataFrame:
    """Feature count per study and whether its list equals the first study's."""
    lists = scores.groupBy("study").agg(F.sort_array(F.collect_set("signature")).alias("features"))
    lists = keep(lists)
    first = lists.agg(F.min_by("features", "study").alias("first"))
    return lists.select(
        "study",
        F.size("features").cast("bigint").alias("n_features"),
        (F.col("features") == first.scalar()).alias("same_as_first"),
    )


def features_vector(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature values in name order next to the label; NULL scores stay in place."""
    gathered = scores.groupBy(*SAMPLE).agg(
        F.sort_array(F.collect_list(F.struct("signature", F.col("score").cast("double").alias("score")))).alias("_f")
    )
    return gathered.join(labels, SAMPLE).select(*SAMPLE, F.col("_f.score").alias("features"), "label")


def model_features(tree_node: DataFrame) -> DataFrame:
    return tree_node.filter(F.col("feature").isNotNull()).select("model_id", "feature").distinct()


def feature_gap(model_feature: DataFrame, study_feature: DataFrame) -> DataFrame:
    """(model, study, feature) a model splits on and a study's data lacks.

    ``model_feature`` is (model_id, feature), ``study_feature`` (study, feature).
    Both are lists of names, so the studies ride along as one array per feature.
    """
    studies = study_feature.select("study").distinct().agg(F.collect_list("study").alias("s"))
    having = study_feature.groupBy("feature").agg(F.collect_set("study").alias("having"))
    wanted = model_feature.join(having, "feature", "left")
    lacking = F.array_except(studies.scalar(), F.coalesce("having", F.array().cast("array<string>")))
    return wanted.select("model_id", F.explode(lacking).alias("study"), "feature")


def align_features(scores: DataFrame, model_feature: DataFrame) -> DataFrame:
    """Every sample laid out on each model's feature list: features its study lacks are 0,
    values it lacks stay NULL, features the model does not know are dropped.

    A sample's scores are gathered in one map (bounded by the feature list) and
    read off along the model's list. A feature is absent if no row of the study has it.
    """
    having = study_features(scores)
    lists = model_feature.groupBy("model_id").agg(F.sort_array(F.collect_set("feature")).alias("list"))
    models = lists.agg(F.sort_array(F.collect_set("model_id")).alias("ids"))
    gathered = scores.groupBy(*SAMPLE).agg(
        F.map_from_entries(F.collect_list(F.struct("signature", "score"))).alias("_scores")
    )
    rows = gathered.withColumn("_ids", models.scalar()).select(
        *SAMPLE, "_scores", F.explode("_ids").alias("model_id")
    )
    here = F.array_contains("_having", F.col("feature"))
    value = F.when(here, F.col("_scores")[F.col("feature")]).otherwise(F.lit(0.0))
    return (
        attach(attach(rows, lists, ["model_id"], max_rows=20_000), having, ["study"], max_rows=20_000)
        .select(*SAMPLE, "_scores", "_having", "model_id", F.explode("list").alias("feature"))
        .select(*SAMPLE, "model_id", "feature", value.alias("value"))
    )


def study_features(scores: DataFrame) -> DataFrame:
    """The features that a study has rows of: one list of names per study."""
    return keep(scores.groupBy("study").agg(F.array_sort(F.collect_set("signature")).alias("_having")))


def fill_absent(vectors: DataFrame, scores: DataFrame, features: DataFrame, fill: float = 0.0) -> DataFrame:
    """``x`` with ``fill`` in the places of features that the sample's study lacks; a missing value stays NULL.

    ``x`` runs along the list of the one row of ``features``; a bitmap of that list per study tells which are present.
    """
    lists = study_features(scores).withColumn("_all", features.select("features").scalar())
    present = lists.select("study", F.transform("_all", lambda f: F.array_contains("_having", f)).alias("_present"))
    filled = F.zip_with("x", "_present", lambda v, here: F.when(here, v).otherwise(F.coalesce(v, F.lit(fill))))
    return attach(vectors, present, ["study"], "left", max_rows=20_000).withColumn("x", filled).drop("_present")
