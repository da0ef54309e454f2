"""Queries over predictions: curves, areas, intervals, thresholds, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import literal_rows, sigmoid
from ..operators import bootstrap as bs
from ..operators import clinical as cl
from ..operators import features as ft
from ..operators import forest as fo
from ..operators import logit as lo
from ..operators import roc
from ..operators.scale import keep
from ..plans import derived as d
from ..plans import validation as va
from ..session import scratch_path
from ..sources import training as tr
from . import sql as q
from .features import vec_scores
from .scoring import r6

REPLICATES = bs.REPLICATES


def docs(spark, sf):
    return d.doc_predictions(spark, sf)


def _ranked(spark, sf):
    return roc.ranked_counts(docs(spark, sf))


def _curve(spark, sf):
    return r6(roc.roc_curve(_ranked(spark, sf)), "sens", "spec")


def _auc(spark, sf):
    return r6(roc.auc(_ranked(spark, sf)), "auc")


def _direction(spark, sf):
    return r6(roc.roc_direction(_ranked(spark, sf)), "median_control", "median_case", "auc", "auc_auto")


def _bootstrap(spark, sf):
    return r6(bs.bootstrap_auc_ci(docs(spark, sf), REPLICATES), "low", "mid", "high")


def _youden(spark, sf):
    return r6(roc.youden_threshold(_ranked(spark, sf)), "threshold", "sens_plus_spec")


def _confusion(spark, sf):
    counts = keep(roc.score_counts(docs(spark, sf)))
    ranked = roc.cumulative(counts, roc.KEYS, "score", ["pos", "neg"])
    rows = roc.confusion_metrics(counts, roc.youden_threshold(ranked))
    return r6(rows, "accuracy", "precision", "recall", "f1")


def _fit(spark, sf):
    return r6(lo.fit_logit(docs(spark, sf)), "b0", "b1")


def _predict_logit(spark, sf):
    rows = keep(docs(spark, sf))
    return r6(lo.predict_logit(rows, lo.fit_logit(rows)), "score")


def stump_predictions(spark, sf, models=None):
    """Every study's stump model on every vec sample, features aligned to 0."""
    model, tree_node = models or d.stump_models(spark, sf)
    tree_node = keep(tree_node)
    scores = d.vec_expression(spark, sf).select(
        "study", "sample_id", F.col("gene_id").alias("signature"), F.col("value").alias("score")
    )
    predicted = fo.predict_trees(fo.sample_vectors(scores, tree_node), tree_node, model)
    rounded = predicted.withColumn("score", F.round("score", 9))  # margins are sums: their last digits may differ
    return rounded.join(d.vec_labels(spark, sf), ["study", "sample_id"])


def judged(spark, sf):
    """Predictions of every local model, of the merged model and of a logistic model of one feature."""
    model, tree_node = d.stump_models(spark, sf)
    local = stump_predictions(spark, sf, (model, tree_node)).select("study", "sample_id", "label", "model_id", "score")
    header, merged = va.merge_models(model, keep(tree_node))
    merged = keep(merged)
    scores = d.vec_expression(spark, sf).select(
        "study", "sample_id", F.col("gene_id").alias("signature"), F.col("value").alias("score")
    )
    whole = fo.predict_trees(fo.sample_vectors(scores, merged), merged, header).join(d.vec_labels(spark, sf), ["study", "sample_id"])
    first = keep(
        d.vec_samples(spark, sf).select(
            "study", "sample_id", "label", F.lit(va.SIGNATURE).alias("model_id"), F.element_at("values", 1).alias("score")
        )
    )
    fitted = lo.predict_logit(first, lo.fit_logit(first))
    rows = local
    for more in (whole, fitted):
        rows = rows.unionByName(more.select("study", "sample_id", "label", "model_id", F.round("score", 9).alias("score")))
    return keep(rows)


def validated(spark, sf):
    return va.validate(judged(spark, sf), REPLICATES)


def _local_models(spark, sf):
    """Lacking features count as 0, as the aligned matrix would have it."""
    model, tree_node = d.stump_models(spark, sf)
    tree_node = keep(tree_node)
    scores = keep(vec_scores(spark, sf))
    vectors = ft.fill_absent(fo.sample_vectors(scores, tree_node), scores, fo.feature_catalog(tree_node))
    return margins_and_scores(fo.predict_trees(vectors, tree_node, model))


def margins_and_scores(predicted):
    """Both to 6 digits from the unrounded margin."""
    return predicted.select(
        "study",
        "sample_id",
        "model_id",
        F.round("margin", 6).alias("margin"),
        F.round(sigmoid(F.col("margin")), 6).alias("score"),
    )


def _grid(spark, sf):
    return r6(roc.roc_interpolate(_ranked(spark, sf)), "spec", "sens")


def local_ranked(spark, sf):
    return roc.ranked_counts(stump_predictions(spark, sf))


def _band(spark, sf):
    rows = roc.mean_roc_band(roc.roc_interpolate(local_ranked(spark, sf)))
    return r6(rows, "spec", "sens", "sens_upper", "sens_lower")


def _summary(spark, sf):
    return r6(roc.local_auc_summary(roc.auc(local_ranked(spark, sf))), "auc_mean", "auc_low", "auc_high")


def _stack(spark, sf):
    rows = validated(spark, sf)["curves"]
    return r6(rows.select("study", "model", "spec", "sens", "sens_upper", "sens_lower"), "spec", "sens", "sens_upper", "sens_lower")


def _auc_long(spark, sf):
    return r6(validated(spark, sf)["auc_long"], "auc")


def _sink_eval(spark, sf):
    path = scratch_path(spark, "eval")
    tr.sink_eval(validated(spark, sf)["auc_long"], path)
    return r6(spark.read.parquet(path), "auc")


TITLES = [("V0", "First study"), ("V1", "Second study")]


def _labels(spark, sf):
    return va.labels(validated(spark, sf), literal_rows(spark, "study string, title string", TITLES))


def _pair(spark, sf):
    data = cl.drop_missing_response(d.basket_clinical(spark, sf))
    scores = d.terms(spark, sf).filter("cancer is not null").select(F.upper("treatment").alias("study"))
    scores = scores.unionByName(data.filter("response = 'R'").select("study")).filter("study is not null")
    return roc.pair_inputs(data, scores)


# ---- SQL ------------------------------------------------------------------------------

q.cte(
    "curve",
    "ranked",
    """SELECT study, model_id, score AS threshold, p - bp AS tp, n - bn AS fp, p, n FROM ranked
    UNION ALL SELECT study, model_id, CAST('Infinity' AS DOUBLE), 0, 0, max(p), max(n) FROM ranked GROUP BY ALL""",
)
q.cte(
    "roc",
    "curve",
    """SELECT study, model_id, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / nullif(CAST(p AS DOUBLE), 0) AS sens,
    1.0::DOUBLE - fp / nullif(CAST(n AS DOUBLE), 0) AS spec FROM curve""",
)
YOUDEN_TEXT = """SELECT study, model_id, avg(cut) AS threshold, max(j) / CAST(max(p * n) AS DOUBLE) AS sens_plus_spec FROM (
 SELECT *, rank() OVER (PARTITION BY study, model_id ORDER BY j DESC) AS r FROM (
  SELECT study, model_id, p, n, (p - bp) * n + bn * p AS j,
  CASE WHEN prev IS NULL THEN CAST('-Infinity' AS DOUBLE) ELSE (prev + score) / 2.0::DOUBLE END AS cut FROM ranked WHERE p > 0 AND n > 0
  UNION ALL SELECT study, model_id, max(p), max(n), max(n * p), CAST('Infinity' AS DOUBLE) FROM ranked WHERE p > 0 AND n > 0 GROUP BY 1, 2))
 WHERE r = 1 GROUP BY study, model_id"""
q.cte("youden", "ranked", YOUDEN_TEXT)


def grid_text(ranked: str) -> str:
    """Interpolation from the ROC points themselves, grid point by grid point."""
    return f"""SELECT l.study, l.model_id, g.i, g.i / 149.0::DOUBLE AS spec,
     CASE WHEN max(CASE WHEN l.tn * 149 = g.i * l.n THEN l.hi END) IS NOT NULL THEN max(CASE WHEN l.tn * 149 = g.i * l.n THEN l.hi END) / CAST(l.p AS DOUBLE)
     ELSE (arg_max(l.lo, l.tn) FILTER (l.tn * 149 < g.i * l.n) + (g.i * l.n / 149.0::DOUBLE - max(l.tn) FILTER (l.tn * 149 < g.i * l.n))
       / CAST(min(l.tn) FILTER (l.tn * 149 > g.i * l.n) - max(l.tn) FILTER (l.tn * 149 < g.i * l.n) AS DOUBLE)
       * (arg_min(l.hi, l.tn) FILTER (l.tn * 149 > g.i * l.n) - arg_max(l.lo, l.tn) FILTER (l.tn * 149 < g.i * l.n))) / CAST(l.p AS DOUBLE) END AS sens
    FROM (SELECT study, model_id, p, n, tn, max(tp) AS hi, min(tp) AS lo FROM (
      SELECT study, model_id, p, n, bn AS tn, p - bp AS tp FROM {ranked} WHERE p > 0 AND n > 0
      UNION ALL SELECT DISTINCT study, model_id, p, n, n, 0 FROM {ranked} WHERE p > 0 AND n > 0) GROUP BY ALL) l
    CROSS JOIN (SELECT unnest(range(0, 150)) AS i) g GROUP BY l.study, l.model_id, g.i, l.p, l.n"""


q.cte("grid150", "ranked", grid_text("ranked"))


def band_text(grid: str) -> str:
    return f"""SELECT study, i, max(spec) AS spec, avg(sens) AS sens, least(avg(sens) + stddev_samp(sens), 1.0::DOUBLE) AS sens_upper,
    greatest(avg(sens) - stddev_samp(sens), 0.0::DOUBLE) AS sens_lower FROM {grid} GROUP BY study, i"""


q.cte(
    "vpred",
    "stump_margin vec",
    f"SELECT study, sample_id, model_id, label, margin, round({q.sigmoid('margin')}, 9) AS score FROM stump_margin JOIN vec USING (study, sample_id)",
)
q.cte("vcounts", "vpred", q.counts_text("vpred"))
q.cte("vranked", "vcounts", q.ranked_text("vcounts"))
q.cte("vauc", "vcounts", q.auc_text("vcounts"))
q.cte("vgrid", "vranked", grid_text("vranked"))
def logit_ctes(counts: str, iterations: int = lo.ITERATIONS) -> list[tuple[str, str]]:
    out = [
        (
            "b_0",
            f"SELECT study, model_id, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM {counts} GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0",
        )
    ]
    for i in range(iterations):
        out.append(
            (
                f"b_{i + 1}",
                f"""SELECT study, model_id, b0 + (c * u - b * v) / (a * c - b * b) AS b0, b1 + (a * v - b * u) / (a * c - b * b) AS b1 FROM (
                SELECT study, model_id, b0, b1, sum(w) AS a, sum(w * score) AS b, sum(w * score * score) AS c, sum(r) AS u, sum(r * score) AS v FROM (
                 SELECT study, model_id, score, b0, b1, (pos + neg) * p * (1.0::DOUBLE - p) AS w, pos - (pos + neg) * p AS r FROM (
                  SELECT *, {q.sigmoid('b0 + b1 * score')} AS p FROM {counts} JOIN b_{i} USING (study, model_id))) GROUP BY ALL)""",
            )
        )
    return out


q.cte("first", "vec", "SELECT study, sample_id, 'signature' AS model_id, label, CAST(v[1] AS DOUBLE) AS score FROM vec")
q.cte("gcounts", "first", q.counts_text("first"))
for _i, (_name, _text) in enumerate(logit_ctes("gcounts")):
    q.cte(_name.replace("b_", "gb_"), "gcounts" if _i == 0 else f"gcounts gb_{_i - 1}", _text.replace(" b_", " gb_"), once=True)
q.cte(
    "judged",
    f"vpred stump_margin first gb_{lo.ITERATIONS}",
    f"""SELECT study, sample_id, label, model_id, score FROM vpred
    UNION ALL SELECT study, sample_id, any_value(label), 'global', round({q.sigmoid('sum(margin)')}, 9) FROM stump_margin JOIN vec USING (study, sample_id)
     GROUP BY study, sample_id
    UNION ALL SELECT study, sample_id, label, model_id, round({q.sigmoid('b0 + b1 * score')}, 9) FROM first JOIN gb_{lo.ITERATIONS} USING (study, model_id)""",
    once=True,
)
q.cte("jcounts", "judged", q.counts_text("judged"), once=True)
q.cte("jranked", "jcounts", q.ranked_text("jcounts"), once=True)
q.cte("jplain", "jcounts", q.auc_text("jcounts"))
q.cte(
    "jauc",
    "judged jplain",
    """SELECT study, model_id, CASE WHEN mc > mp THEN 1.0::DOUBLE - auc ELSE auc END AS auc FROM (
    SELECT study, model_id, quantile_cont(score, 0.5) FILTER (label = 0) AS mc, quantile_cont(score, 0.5) FILTER (label = 1) AS mp
    FROM judged GROUP BY ALL) JOIN jplain USING (study, model_id)""",
    once=True,
)
q.cte("jgrid", "jranked", grid_text("(SELECT * FROM jranked WHERE model_id NOT IN ('global', 'signature'))"))
q.cte(
    "aucs_long",
    "jauc",
    """SELECT study, CASE model_id WHEN 'global' THEN 'Distributed Model' WHEN 'signature' THEN 'Signature Model' ELSE 'Local Model' END AS model, auc FROM jauc""",
)

_LOGIT = logit_ctes("counts")
_B = f"b_{lo.ITERATIONS}"
_FIT_SQL = f"""SELECT study, model_id, round(n.b0, 6) AS b0, round(n.b1, 6) AS b1,
 abs(n.b0 - o.b0) <= 1e-8 * (abs(n.b0) + 0.1) AND abs(n.b1 - o.b1) <= 1e-8 * (abs(n.b1) + 0.1) AS converged
 FROM {_B} n JOIN b_{lo.ITERATIONS - 1} o USING (study, model_id)"""
_TWO = "regexp_replace(CAST(round({}, 2) AS VARCHAR), '\\.0$', '')"

#: Scores of a key in SQL: 2**_TOP at most.
_TOP = 15


def binomial(n: str, share: str, u: str, v: str) -> str:
    """A binomial number from two uniform ones, as the Spark side has it."""
    p, q_ = f"least({share}, 1.0::DOUBLE - {share})", f"(1.0::DOUBLE - least({share}, 1.0::DOUBLE - {share}))"
    step = f"a.m * ({n} - x.k + 1) / x.k * ({p} / {q_})"
    few = f"""list_reduce(list_prepend({{'k': 0::BIGINT, 'm': pow({q_}, {n}), 'c': pow({q_}, {n})}},
      list_transform(range(1, least({n}, {bs.STEPS}) + 1), lambda i: {{'k': i, 'm': 0.0::DOUBLE, 'c': 0.0::DOUBLE}})),
      lambda a, x: {{'k': CASE WHEN a.c < {u} THEN x.k ELSE a.k END, 'm': {step}, 'c': a.c + {step}}}).k"""
    z = f"(sqrt(-2.0::DOUBLE * ln(greatest({u}, 1.0::DOUBLE / 281474976710656.0::DOUBLE))) * cos(2.0::DOUBLE * pi() * {v}))"
    many = f"""CAST(least(greatest(floor({n} * {p} + sqrt({n} * {p} * {q_}) * {z} + ({q_} - {p}) * ({z} * {z} - 1.0::DOUBLE) / 6.0::DOUBLE + 0.5::DOUBLE), 0), {n}) AS BIGINT)"""
    k = f"(CASE WHEN {n} * {p} * {q_} <= {bs.EXACT} THEN {few} ELSE {many} END)"
    return f"(CASE WHEN {share} <= 0.5 THEN {k} ELSE {n} - {k} END)"


def _descent(height: int) -> tuple[str, str]:
    """Draws of ranges of 2**(height - 1) scores from those twice as wide."""
    tag = "study || '|' || model_id || '|' || label || '|' || replicate || '|' || " + f"'{height}|' || j"
    word = lambda a: f"CAST(CAST(concat('0x', substr(md5({tag}), {a}, 12)) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE"
    split = binomial("n", "p", "u", "v")
    return (
        f"lv_{height - 1}",
        f"""SELECT study, model_id, label, replicate, 2 * j + side AS j, CASE side WHEN 0 THEN k ELSE n - k END AS n FROM (
        SELECT *, CASE WHEN p >= 1 THEN n WHEN p <= 0 THEN 0 ELSE {split} END AS k FROM (
         SELECT d.*, l.c / CAST(w.c AS DOUBLE) AS p, {word(1)} AS u, {word(13)} AS v FROM lv_{height} d
         JOIN (SELECT study, model_id, label, i >> {height} AS j, sum(c) AS c FROM leafs GROUP BY ALL) w USING (study, model_id, label, j)
         JOIN (SELECT study, model_id, label, i >> {height} AS j, sum(CASE WHEN (i >> {height - 1}) & 1 = 0 THEN c ELSE 0 END) AS c
               FROM leafs GROUP BY ALL) l USING (study, model_id, label, j)))
        CROSS JOIN (SELECT unnest([0, 1]) AS side) WHERE CASE side WHEN 0 THEN k ELSE n - k END > 0""",
    )


def boot_ctes(counts: str) -> list[tuple[str, str]]:
    return [("leafs", _LEAFS.format(counts)), *_BOOT]


_LEAFS = """SELECT study, model_id, score, row_number() OVER (PARTITION BY study, model_id ORDER BY score) - 1 AS i, unnest([1, 0]) AS label,
        unnest([pos, neg]) AS c FROM {}"""
_BOOT = [
    (
        f"lv_{_TOP}",
        f"""SELECT study, model_id, label, CAST(unnest(range(1, {REPLICATES + 1})) AS INTEGER) AS replicate, CAST(0 AS BIGINT) AS j, CAST(sum(c) AS BIGINT) AS n
        FROM leafs GROUP BY study, model_id, label HAVING sum(c) > 0""",
    ),
    *[_descent(h) for h in range(_TOP, 0, -1)],
    (
        "bcounts",
        """SELECT study, model_id, replicate, j AS score, coalesce(sum(n) FILTER (label = 1), 0) AS pos, coalesce(sum(n) FILTER (label = 0), 0) AS neg
        FROM lv_0 GROUP BY ALL""",
    ),
    (
        "baucs",
        """SELECT study, model_id, replicate, sum(pos * (b + neg / 2.0::DOUBLE)) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0) AS auc FROM (
        SELECT *, coalesce(sum(neg) OVER (PARTITION BY study, model_id, replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
        FROM bcounts) GROUP BY ALL""",
    ),
]

QUERIES = {
    "sink_eval": (_sink_eval, q.query("aucs_long", "SELECT study, model, round(auc, 6) AS auc FROM aucs_long")),
    "roc_curve": (
        _curve,
        q.query("roc", "SELECT study, model_id, threshold, tp, fp, round(sens, 6) AS sens, round(spec, 6) AS spec FROM roc"),
    ),
    "auc": (_auc, q.query("aucs", "SELECT study, model_id, round(auc, 6) AS auc FROM aucs")),
    "roc_direction": (
        _direction,
        q.query(
            "doc aucs",
            """SELECT study, model_id, round(mc, 6) AS median_control, round(mp, 6) AS median_case, CASE WHEN mc > mp THEN '>' ELSE '<' END AS direction,
            round(auc, 6) AS auc, round(CASE WHEN mc > mp THEN 1.0::DOUBLE - auc ELSE auc END, 6) AS auc_auto FROM (
            SELECT study, model_id, quantile_cont(score, 0.5) FILTER (label = 0) AS mc, quantile_cont(score, 0.5) FILTER (label = 1) AS mp
            FROM doc GROUP BY ALL) JOIN aucs USING (study, model_id)""",
        ),
    ),
    "bootstrap_auc_ci": (
        _bootstrap,
        q.query(
            "counts",
            """SELECT study, model_id, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.5), 6) AS mid,
            round(quantile_cont(auc, 0.975), 6) AS high, count(auc) AS n FROM baucs WHERE auc IS NOT NULL GROUP BY study, model_id""",
            boot_ctes("counts"),
        ),
    ),
    "youden_threshold": (
        _youden,
        q.query("youden", "SELECT study, model_id, round(threshold, 6) AS threshold, round(sens_plus_spec, 6) AS sens_plus_spec FROM youden"),
    ),
    "confusion_metrics": (
        _confusion,
        q.query(
            "doc youden",
            """SELECT study, model_id, tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy,
            round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall,
            round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 6) AS f1 FROM (
            SELECT study, model_id, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp,
            count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 0 AND score < threshold) AS tn
            FROM doc JOIN youden USING (study, model_id) GROUP BY ALL)""",
        ),
    ),
    "fit_logit": (_fit, q.query("counts", _FIT_SQL, _LOGIT)),
    "predict_logit": (
        _predict_logit,
        q.query(
            "doc counts",
            f"SELECT study, sample_id, label, model_id, round({q.sigmoid('b0 + b1 * score')}, 6) AS score FROM doc JOIN {_B} USING (study, model_id)",
            _LOGIT,
        ),
    ),
    "score_local_models": (
        _local_models,
        q.query(
            "stump vexpr vscore",
            f"""SELECT study, sample_id, model_id, round(margin, 6) AS margin, round({q.sigmoid('margin')}, 6) AS score FROM (
            SELECT a.study, a.sample_id, r.model_id, sum(CASE WHEN a.value < r.threshold THEN l1.leaf_value
             WHEN b.value < s.threshold THEN l5.leaf_value ELSE l6.leaf_value END) AS margin
            FROM stump r JOIN stump s ON s.model_id = r.model_id AND s.tree_id = r.tree_id AND s.node_id = 2
            JOIN stump l1 ON l1.model_id = r.model_id AND l1.tree_id = r.tree_id AND l1.node_id = 1
            JOIN stump l5 ON l5.model_id = r.model_id AND l5.tree_id = r.tree_id AND l5.node_id = 5
            JOIN stump l6 ON l6.model_id = r.model_id AND l6.tree_id = r.tree_id AND l6.node_id = 6
            JOIN aligned a ON a.gene_id = r.feature JOIN aligned b ON b.study = a.study AND b.sample_id = a.sample_id AND b.gene_id = s.feature
            WHERE r.node_id = 0 GROUP BY ALL)""",
            [
                (
                    "aligned",
                    """SELECT v.study, v.sample_id, v.gene_id, coalesce(s.score, 0.0::DOUBLE) AS value FROM vexpr v
                    LEFT JOIN vscore s ON s.study = v.study AND s.sample_id = v.sample_id AND s.signature = v.gene_id""",
                )
            ],
        ),
    ),
    "roc_interpolate": (
        _grid,
        q.query("grid150", "SELECT study, model_id, CAST(i AS INTEGER) AS i, round(spec, 6) AS spec, round(sens, 6) AS sens FROM grid150"),
    ),
    "mean_roc_band": (
        _band,
        q.query(
            "vgrid",
            """SELECT study, CAST(i AS INTEGER) AS i, round(spec, 6) AS spec, round(sens, 6) AS sens, round(sens_upper, 6) AS sens_upper,
            round(sens_lower, 6) AS sens_lower FROM band""",
            [("band", band_text("vgrid"))],
        ),
    ),
    "local_auc_summary": (
        _summary,
        q.query(
            "vauc",
            """SELECT study, round(avg(auc), 6) AS auc_mean, round(quantile_cont(auc, 0.025), 6) AS auc_low,
            round(quantile_cont(auc, 0.975), 6) AS auc_high, count(auc) AS n_models FROM vauc GROUP BY study""",
        ),
    ),
    "stack_curves": (
        _stack,
        q.query(
            "jgrid jranked",
            """SELECT study, model, round(spec, 6) AS spec, round(sens, 6) AS sens, round(sens_upper, 6) AS sens_upper, round(sens_lower, 6) AS sens_lower FROM (
            SELECT study, 'Local Model' AS model, spec, sens, sens_upper, sens_lower FROM band
            UNION ALL SELECT study, CASE model_id WHEN 'global' THEN 'Distributed Model' ELSE 'Signature Model' END, 1.0::DOUBLE - fp / nullif(CAST(n AS DOUBLE), 0),
             tp / nullif(CAST(p AS DOUBLE), 0), NULL, NULL FROM jcurve WHERE model_id IN ('global', 'signature'))""",
            [
                ("band", band_text("jgrid")),
                (
                    "jcurve",
                    """SELECT study, model_id, p - bp AS tp, n - bn AS fp, p, n FROM jranked
                    UNION ALL SELECT study, model_id, 0, 0, max(p), max(n) FROM jranked GROUP BY ALL""",
                ),
            ],
        ),
    ),
    "auc_long": (_auc_long, q.query("aucs_long", "SELECT study, model, round(auc, 6) AS auc FROM aucs_long")),
    "report_labels": (
        _labels,
        q.query(
            "jauc jcounts",
            f"""SELECT study, CASE study WHEN 'V0' THEN 'First study' WHEN 'V1' THEN 'Second study' ELSE study END AS title, name,
            name || ' AUC: ' || {_TWO.format('auc')} || ' [' || {_TWO.format('low')} || '-' || {_TWO.format('high')} || ']' AS label FROM (
            SELECT study, 'Local Mean' AS name, avg(auc) AS auc, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high
             FROM jauc WHERE model_id NOT IN ('global', 'signature') GROUP BY study
            UNION ALL SELECT study, CASE model_id WHEN 'global' THEN 'Distributed Model' ELSE 'Signature Model' END, any_value(a.auc), quantile_cont(r.auc, 0.025),
             quantile_cont(r.auc, 0.975) FROM jauc a JOIN baucs r USING (study, model_id) GROUP BY study, model_id)""",
            boot_ctes("(SELECT * FROM jcounts WHERE model_id IN ('global', 'signature'))"),
        ),
    ),
    "pair_inputs": (
        _pair,
        q.query(
            "valid terms",
            """SELECT study, n_data, n_scores, CASE WHEN n_scores IS NULL THEN 'no scores' WHEN n_data IS NULL THEN 'no data' ELSE 'paired' END AS status
            FROM (SELECT study, count(*) AS n_data FROM valid GROUP BY study) FULL JOIN (SELECT study, count(*) AS n_scores FROM (
             SELECT upper(treatment) AS study FROM terms WHERE cancer IS NOT NULL UNION ALL SELECT study FROM valid WHERE response = 'R')
             WHERE study IS NOT NULL GROUP BY study) USING (study)""",
        ),
    ),
}
