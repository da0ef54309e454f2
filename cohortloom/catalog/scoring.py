"""Queries over signature scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as sc
from ..plans import derived as d
from . import sql as q
from .clinical import gated, logged


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _routed(spark, sf):
    return sc.score_dispatch(d.basket_signatures(spark, sf), d.basket_signature_info(spark))


def _inputs(spark, sf, branch):
    expr = sc.gene_missing_filter(sc.keep(logged(spark, sf)))
    return expr, sc.eligible_sets(expr, _routed(spark, sf).filter(F.col("branch") == branch))


def _out(df, *extra):
    return r6(df.select("study", "sample_id", "signature", *extra, "score"), "score")


def _log(spark, sf):
    return r6(sc.log_expr(d.basket_tpm(spark, sf)), "value")


def _missing(spark, sf):
    return r6(sc.gene_missing_filter(sc.keep(logged(spark, sf)), 0.22), "value")


def _coverage(spark, sf):
    genes = logged(spark, sf).select("study", "gene_id").distinct()
    return sc.signature_coverage_gate(d.basket_signatures(spark, sf), genes)


def _sample_gate(spark, sf):
    return r6(sc.signature_sample_gate(sc.keep(logged(spark, sf)), 270), "value")


def _dispatch(spark, sf):
    return _routed(spark, sf)


def _gsva(spark, sf):
    return _out(sc.gsva(*_inputs(spark, sf, "gsva")))


def _gsva_gaussian(spark, sf):
    expr = sc.keep(d.vec_expression(spark, sf))
    sets = (
        expr.select("gene_id").distinct()
        .withColumn("signature", F.concat(F.lit("D"), (F.substring("gene_id", 2, 2).cast("int") % 4).cast("string")))
        .withColumn("sub_signature", F.lit(""))
    )
    return _out(sc.gsva(expr, sets, "gaussian"))


def _ssgsea(spark, sf):
    return _out(sc.ssgsea(*_inputs(spark, sf, "ssgsea")))


def _mean(spark, sf):
    return _out(sc.weighted_mean(*_inputs(spark, sf, "mean")))


def _cox(spark, sf):
    return _out(sc.cox_is(*_inputs(spark, sf, "cox_is")))


def _ips(spark, sf):
    return _out(sc.ips(*_inputs(spark, sf, "ips")))


def _pio(spark, sf):
    return _out(sc.pio(*_inputs(spark, sf, "pio")))


def _ipres(spark, sf):
    return _out(sc.ipres(*_inputs(spark, sf, "ipres")))


def _passon(spark, sf):
    return _out(sc.passon(*_inputs(spark, sf, "passon")))


def _ipsov(spark, sf):
    return _out(sc.ipsov(*_inputs(spark, sf, "ipsov")))


def assembled(spark, sf):
    signature = d.basket_signatures(spark, sf)
    scores = sc.score_all(sc.gene_missing_filter(sc.keep(logged(spark, sf))), signature, d.basket_signature_info(spark))
    return sc.score_assemble(gated(spark, sf), signature, scores)


def _assemble(spark, sf):
    return _out(assembled(spark, sf))


def _complete(spark, sf):
    return _out(sc.drop_incomplete_signatures(sc.keep(assembled(spark, sf))))


def _score_sql(cte, where="TRUE"):
    return q.query(cte, f"SELECT study, sample_id, signature, round(score, 6) AS score FROM {cte.split()[0]} WHERE {where}")


def _branch_sql(cte, branch):
    return q.query(
        f"{cte} set_weight",
        f"""SELECT study, sample_id, signature, round(score, 6) AS score FROM {cte}
        JOIN set_weight USING (study, signature, sub_signature) WHERE branch = '{branch}'""",
    )


_KERNEL = f"""SELECT study, sample_id, gene_id, round(f / n, 9) AS f FROM (
 SELECT a.study, a.sample_id, a.gene_id, count(*) AS n, sum({q.normal_cdf('((a.value - b.value) / a.h)')}) AS f
 FROM (SELECT *, stddev_samp(value) OVER (PARTITION BY study, gene_id) / 4.0::DOUBLE AS h FROM vexpr) a
 JOIN vexpr b ON a.study = b.study AND a.gene_id = b.gene_id GROUP BY ALL)"""
_VSETS = """SELECT DISTINCT study, 'D' || CAST(CAST(substr(gene_id, 2) AS INTEGER) % 4 AS VARCHAR) AS signature, '' AS sub_signature, gene_id FROM vexpr"""

QUERIES = {
    "log_expr": (
        _log,
        q.query("tpm", "SELECT study, sample_id, gene_id, round(log2(value + 0.001::DOUBLE), 6) AS value FROM tpm"),
    ),
    "gene_missing_filter": (
        _missing,
        q.query(
            "logx",
            f"SELECT study, sample_id, gene_id, round(value, 6) AS value FROM ({q.present_text('logx', 0.22)})",
        ),
    ),
    "signature_coverage_gate": (
        _coverage,
        q.query(
            "signature logx",
            """SELECT g.study, s.signature FROM (SELECT DISTINCT signature, gene_id FROM signature) s
            JOIN (SELECT DISTINCT study, gene_id FROM logx) g USING (gene_id)
            JOIN (SELECT signature, count(DISTINCT gene_id) AS n FROM signature GROUP BY 1) z USING (signature)
            GROUP BY g.study, s.signature, z.n HAVING count(*) / CAST(z.n AS DOUBLE) > 0.8""",
        ),
    ),
    "signature_sample_gate": (
        _sample_gate,
        q.query(
            "logx",
            """SELECT study, sample_id, gene_id, round(value, 6) AS value FROM logx WHERE study IN (
            SELECT study FROM logx GROUP BY study HAVING count(DISTINCT sample_id) >= 270)""",
        ),
    ),
    "score_dispatch": (_dispatch, q.query("routed", "SELECT * FROM routed")),
    "score_gsva": (_gsva, _branch_sql("gs_score", "gsva")),
    "score_gsva_gaussian": (
        _gsva_gaussian,
        q.query(
            "vexpr",
            "SELECT study, sample_id, signature, round(score, 6) AS score FROM k_score",
            [("vsets", _VSETS), *q.gsva_ctes("vsets", _KERNEL, "k")],
        ),
    ),
    "score_ssgsea": (_ssgsea, _branch_sql("ss_score", "ssgsea")),
    "score_weighted_mean": (_mean, _score_sql("mean_score")),
    "score_cox_is": (_cox, _score_sql("cox_score")),
    "score_ips": (_ips, _score_sql("ips_score")),
    "score_pio": (_pio, _score_sql("pio_score")),
    "score_ipres": (_ipres, _score_sql("ipr_score")),
    "score_passon": (_passon, _score_sql("pas_score")),
    "score_ipsov": (_ipsov, _score_sql("ov_score")),
    "score_assemble": (_assemble, _score_sql("assembled")),
    "drop_incomplete_signatures": (_complete, _score_sql("complete")),
}
