"""Merging local models and judging them on held-out studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bootstrap as bs
from ..operators import clinical as cl
from ..operators import features as ft
from ..operators import forest as fo
from ..operators import logit as lo
from ..operators import roc
from ..operators.scale import keep

GLOBAL, SIGNATURE = "global", "signature"


def merge_models(model: DataFrame, tree_node: DataFrame, combine: str = "sum") -> tuple[DataFrame, DataFrame]:
    """(header, tree_node) of the global model; no sample row is read."""
    return fo.global_header(model, GLOBAL, combine), fo.merge_trees(model, tree_node, GLOBAL)


def predictions(
    scores: DataFrame, clinical: DataFrame, model: DataFrame, tree_node: DataFrame, signature: str, fill: float = 0.0
) -> DataFrame:
    """Local, global and single-signature predictions of labelled samples.

    Features a model expects and a study lacks are ``fill``; a value missing in a sample
    stays missing and takes the default side of every split.
    """
    labels = keep(
        cl.drop_missing_response(clinical.select("study", "sample_id", "response")).select(
            "study", "sample_id", cl.encode_response().alias("label")
        )
    )
    header, merged = merge_models(model, tree_node)
    columns = ["model_id", "tree_id", "node_id", "feature", "threshold", "left", "right", "default_left", "leaf_value"]
    nodes = keep(tree_node.select(*columns).unionByName(merged.select(*columns)))
    heads = model.select("model_id", "base_margin").unionByName(header.select("model_id", "base_margin"))
    vectors = ft.fill_absent(fo.sample_vectors(scores, nodes), scores, fo.feature_catalog(nodes), fill)
    trees = fo.predict_trees(vectors, nodes, heads).select("study", "sample_id", "model_id", "score")
    single = scores.filter(F.col("signature") == signature).select(
        "study", "sample_id", F.lit(SIGNATURE).alias("model_id"), "score"
    )
    single = keep(single.join(labels, ["study", "sample_id"]))
    fitted = lo.predict_logit(single, lo.fit_logit(single))
    return trees.join(labels, ["study", "sample_id"]).unionByName(fitted)


def labels(validated: dict[str, DataFrame], titles: DataFrame) -> DataFrame:
    """Three labels per study, each with an AUC and both its bounds: the local models' mean and quantiles, the merged and
    the signature model with their bootstrap interval. ``validated`` is a result of :func:`validate`."""
    local = validated["local_summary"].select(
        "study", F.lit("Local Mean").alias("name"), F.col("auc_mean").alias("auc"), F.col("auc_low").alias("low"), F.col("auc_high").alias("high")
    )
    names = F.create_map(F.lit(GLOBAL), F.lit("Distributed Model"), F.lit(SIGNATURE), F.lit("Signature Model"))
    single = validated["aucs"].filter(F.col("model_id").isin(GLOBAL, SIGNATURE))
    single = single.join(validated["intervals"], ["study", "model_id"], "left").select(
        "study", names[F.col("model_id")].alias("name"), "auc", "low", "high"
    )
    return roc.report_labels(local.unionByName(single), titles)


def validate(predicted: DataFrame, replicates: int = bs.REPLICATES) -> dict[str, DataFrame]:
    """auc_long, curves, intervals and local summary of :func:`predictions`."""
    predicted = keep(predicted)
    ranked = keep(roc.ranked_counts(predicted))
    aucs = keep(roc.roc_direction(ranked).select("study", "model_id", F.col("auc_auto").alias("auc")))
    local = ~F.col("model_id").isin(GLOBAL, SIGNATURE)
    only = lambda df, name: df.filter(F.col("model_id") == name)
    band = roc.mean_roc_band(roc.roc_interpolate(ranked.filter(local))).drop("i")
    curves = [
        roc.roc_curve(only(ranked, name)).select("study", "spec", "sens", F.lit(title).alias("model"))
        for name, title in ((GLOBAL, "Distributed Model"), (SIGNATURE, "Signature Model"))
    ]
    return {
        "aucs": aucs,
        "auc_long": roc.auc_long(aucs.filter(local), only(aucs, GLOBAL), only(aucs, SIGNATURE)),
        "curves": roc.stack_curves(band.withColumn("model", F.lit("Local Model")), *curves),
        "intervals": bs.bootstrap_auc_ci(predicted.filter(~local), replicates),
        "local_summary": roc.local_auc_summary(aucs.filter(local)),
    }
