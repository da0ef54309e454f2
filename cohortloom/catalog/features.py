"""Queries over feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clinical as cl
from ..operators import features as ft
from ..operators import scoring as sc
from ..plans import derived as d
from . import sql as q
from .clinical import NAMES, all_scores, each, gated, names_of, wide_columns
from .scoring import r6


def _select(spark, sf):
    return r6(ft.select_signatures(all_scores(spark, sf), d.basket_selected(spark, sf)), "score")


def _pivot(spark, sf):
    names = names_of(d.basket_signatures(spark, sf))
    wide = ft.pivot_scores(all_scores(spark, sf), names)
    return wide.select("study", "sample_id", *[F.round(c, 6).alias(c.lower()) for c in names])


def _response(spark, sf):
    return r6(ft.join_response(all_scores(spark, sf), gated(spark, sf)), "score")


def gene_scores(spark, sf, share=0.22):
    """Gene values of the basket as features; some genes are lost in some studies."""
    from .clinical import logged

    expr = sc.gene_missing_filter(sc.keep(logged(spark, sf)), share)
    return expr.select("study", "sample_id", F.col("gene_id").alias("signature"), F.col("value").alias("score"))


def _common(spark, sf):
    return ft.common_features(gene_scores(spark, sf))


def _filter_common(spark, sf):
    scores = sc.keep(gene_scores(spark, sf))
    return r6(ft.filter_common(scores, ft.common_features(scores)), "score")


def _audit(spark, sf):
    return ft.audit_columns(gene_scores(spark, sf))


def _vector(spark, sf):
    labels = gated(spark, sf).select("study", "sample_id", cl.encode_response().alias("label"))
    rows = ft.features_vector(all_scores(spark, sf), labels)
    text = F.array_join(F.transform("features", lambda v: F.when(v.isNotNull(), F.format_string("%.5f", F.round(v, 5) + F.lit(0.0)))), ",")
    return rows.select("study", "sample_id", text.alias("features"), "label")


def vec_scores(spark, sf):
    """Values of the genes whose study mean is positive: every study lacks some."""
    expr = d.vec_expression(spark, sf)
    used = expr.groupBy("study", "gene_id").agg(F.round(F.avg("value"), 9).alias("m")).filter("m > 0")
    return sc.attach(expr, used.select("study", "gene_id"), ["study", "gene_id"], "left_semi").select(
        "study", "sample_id", F.col("gene_id").alias("signature"), F.col("value").alias("score")
    )


def gappy_scores(spark, sf):
    """The same with every eleventh value missing."""
    missing = F.pmod(F.col("sample_id").cast("bigint") + F.expr("substring(signature, 2)").cast("bigint") * 7, F.lit(11)) == 0
    return vec_scores(spark, sf).withColumn("score", F.when(~missing, F.col("score")))


def _gap(spark, sf):
    _, tree_node = d.stump_models(spark, sf)
    has = vec_scores(spark, sf).select("study", F.col("signature").alias("feature")).distinct()
    return ft.feature_gap(ft.model_features(tree_node), has)


def _align(spark, sf):
    _, tree_node = d.stump_models(spark, sf)
    return r6(ft.align_features(sc.keep(gappy_scores(spark, sf)), ft.model_features(tree_node)), "value")


q.cte(
    "gene_score",
    "logx",
    f"SELECT study, sample_id, gene_id AS signature, value AS score FROM ({q.present_text('logx', 0.22)})",
)
q.cte(
    "common",
    "gene_score",
    """SELECT signature FROM gene_score GROUP BY signature
    HAVING count(DISTINCT study) = (SELECT count(DISTINCT study) FROM gene_score)""",
)
q.cte(
    "vscore",
    "vexpr",
    """SELECT study, sample_id, gene_id AS signature, value AS score FROM vexpr WHERE (study, gene_id) IN (
    SELECT (study, gene_id) FROM vexpr GROUP BY study, gene_id HAVING round(avg(value), 9) > 0)""",
)

QUERIES = {
    "select_signatures": (
        _select,
        q.query("scores", "SELECT study, sample_id, signature, round(score, 6) AS score FROM scores WHERE signature <> 'S4'"),
    ),
    "pivot_scores": (
        _pivot,
        q.query(
            "scores",
            f"SELECT study, sample_id, {each(NAMES, 'round({}, 6)')} FROM (SELECT study, sample_id, {wide_columns(NAMES)} FROM scores GROUP BY ALL)",
        ),
    ),
    "join_response": (
        _response,
        q.query(
            "scores gated",
            "SELECT study, sample_id, signature, round(score, 6) AS score, response FROM scores JOIN gated USING (study, sample_id)",
        ),
    ),
    "common_features": (_common, q.query("common", "SELECT * FROM common")),
    "filter_common": (
        _filter_common,
        q.query(
            "gene_score common",
            "SELECT study, sample_id, signature, round(score, 6) AS score FROM gene_score SEMI JOIN common USING (signature)",
        ),
    ),
    "audit_columns": (
        _audit,
        q.query(
            "gene_score",
            """SELECT study, CAST(len(l) AS BIGINT) AS n_features, l = first_value(l) OVER (ORDER BY study) AS same_as_first
            FROM (SELECT study, list_sort(list(DISTINCT signature)) AS l FROM gene_score GROUP BY study)""",
        ),
    ),
    "features_vector": (
        _vector,
        q.query(
            "scores gated",
            """SELECT study, sample_id, string_agg(printf('%.5f', round(score, 5) + 0.0::DOUBLE), ',' ORDER BY signature) AS features,
            CASE response WHEN 'R' THEN 0 WHEN 'NR' THEN 1 END AS label
            FROM scores JOIN gated USING (study, sample_id) GROUP BY study, sample_id, response""",
        ),
    ),
    "feature_gap": (
        _gap,
        q.query(
            "stump vscore",
            """SELECT m.model_id, s.study, m.feature FROM (SELECT DISTINCT model_id, feature FROM stump WHERE feature IS NOT NULL) m
            CROSS JOIN (SELECT DISTINCT study FROM vscore) s
            WHERE (s.study, m.feature) NOT IN (SELECT (study, signature) FROM vscore)""",
        ),
    ),
    "align_features": (
        _align,
        q.query(
            "stump vscore",
            """SELECT p.study, p.sample_id, m.model_id, m.feature, CASE WHEN s.signature IS NULL THEN 0.0::DOUBLE
             WHEN (CAST(p.sample_id AS BIGINT) + CAST(substr(m.feature, 2) AS BIGINT) * 7) % 11 <> 0 THEN round(s.score, 6) END AS value
            FROM (SELECT DISTINCT study, sample_id FROM vscore) p
            CROSS JOIN (SELECT DISTINCT model_id, feature FROM stump WHERE feature IS NOT NULL) m
            LEFT JOIN vscore s ON s.study = p.study AND s.sample_id = p.sample_id AND s.signature = m.feature""",
        ),
    ),
}
