"""Queries over tree training and federated models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as bo
from ..operators import forest as fo
from ..operators import roc
from ..operators.scale import attach, keep
from ..plans import derived as d
from ..session import scratch_path
from ..sources import models as mo
from ..sources import training as tr
from . import sql as q
from .clinical import gated
from .evaluation import YOUDEN_TEXT, margins_and_scores, stump_predictions
from .scoring import r6

#: The grid of the registered trainings: 360 settings in 45 runs a study, of 4 rounds and depth 3. More rounds take the
#: same time each.
TRAINED_GRID = bo.GRID | {"nrounds": [2, 4], "max_depth": [3]}
ROUNDS, DEPTH = max(TRAINED_GRID["nrounds"]), max(TRAINED_GRID["max_depth"])
BINS = 10
NODE = ["study", "config_id", "tree_id", "node_id"]


def studies(spark, sf):
    return d.vec_labels(spark, sf).select("study").distinct()


def vec_features(spark, sf):
    return d.vec_expression(spark, sf).withColumnRenamed("gene_id", "feature")


def seeds(spark, sf):
    return bo.study_seeds(studies(spark, sf))


def _grid(spark, sf):
    return bo.param_grid(gated(spark, sf).select("study").distinct())


def _bins(spark, sf):
    rows = keep(vec_features(spark, sf))
    return bo.bin_features(rows, bo.bin_cuts(rows, BINS)).select("study", "sample_id", "feature", "bin")


def _margin_rows(spark, sf):
    return d.vec_samples(spark, sf).select(
        "study", "sample_id", "label", (F.element_at("values", 1) * F.lit(4.0)).alias("margin")
    )


def _grad(spark, sf):
    return r6(bo.grad_hess(_margin_rows(spark, sf)).select("study", "sample_id", "g", "h"), "g", "h")


def _sampling(spark, sf):
    rows = attach(d.vec_samples(spark, sf), seeds(spark, sf), ["study"]).withColumn("subsample", F.lit(0.6))
    trees = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return bo.row_col_sampling(trees, F.col("tree")).select("study", "sample_id", "tree", "row_kept")


def _col_sampling(spark, sf):
    names = vec_features(spark, sf).groupBy("study").agg(F.sort_array(F.collect_set("feature")).alias("features"))
    rows = attach(names, seeds(spark, sf), ["study"]).withColumn("colsample", F.lit(0.6))
    trees = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return trees.withColumn("kept", bo.features_kept(F.col("tree"))).select(
        "study", "tree", F.explode("kept").alias("f")
    )


def training_inputs(spark, sf):
    samples, lists = bo.prepare_samples(d.vec_gappy(spark, sf), d.vec_labels(spark, sf), BINS)
    return samples, keep(lists)


def trained_grid(spark, sf):
    return bo.param_grid(studies(spark, sf), TRAINED_GRID)


def _second_level(spark, sf):
    """The first tree of every training, down to the sums and splits of its second level."""
    samples, lists = training_inputs(spark, sf)
    runs = bo.distinct_trainings(trained_grid(spark, sf)).filter("config_id = train_id").drop("train_id")
    table = bo.training_table(runs.withColumn("nrounds", F.lit(ROUNDS)), lists, seeds(spark, sf))
    run = bo.Growth(samples, table, DEPTH, 0.0)
    return run, run.level(0, 1, run.level(0, 0))


def _histogram(spark, sf):
    return r6(_second_level(spark, sf)[1], "g", "h")


def _best_split(spark, sf):
    splits = _second_level(spark, sf)[0].written(0).filter("level = 1")
    return r6(splits.drop("level", "small"), "gain", "cover", "leaf_value")


def trained(spark, sf):
    samples, lists = training_inputs(spark, sf)
    grid = trained_grid(spark, sf)
    nodes, margins = bo.train_per_study(samples, lists, grid, seeds(spark, sf))
    return samples, lists, grid, nodes, margins


NODE_COLUMNS = [*NODE, "feature", "threshold", "default_left", "leaf_value", "gain", "cover"]


def _nodes(df):
    return r6(df.select(*NODE_COLUMNS), "threshold", "leaf_value", "gain", "cover")


def _grow(spark, sf):
    return _nodes(trained(spark, sf)[3])


def _train_margins(spark, sf):
    margins = trained(spark, sf)[4]
    return r6(margins.select("study", "config_id", "nrounds", "sample_id", "margin"), "margin")


def _grid_auc(spark, sf):
    _, _, grid, _, margins = trained(spark, sf)
    return r6(bo.grid_auc(keep(margins), grid), "auc")


def best_of(spark, sf):
    _, _, grid, nodes, margins = trained(spark, sf)
    margins = keep(margins)
    return keep(bo.select_best(bo.grid_auc(margins, grid), grid)), grid, nodes, margins


def _best(spark, sf):
    return r6(best_of(spark, sf)[0], "auc")


def refitted(spark, sf):
    """The chosen model of every study, out of the search that grew it."""
    best, grid, nodes, margins = best_of(spark, sf)
    return best, *bo.chosen_models(nodes, margins, best, grid)


def _refit(spark, sf):
    return _nodes(refitted(spark, sf)[1])


def _importance(spark, sf):
    _, nodes, _ = refitted(spark, sf)
    return r6(bo.feature_importance(nodes, ("study",)), "gain", "cover", "frequency")


def _sink_importance(spark, sf):
    path = scratch_path(spark, "importance")
    _, tree_node = d.stump_models(spark, sf)
    rows = bo.feature_importance(keep(tree_node)).withColumnRenamed("model_id", "study")
    tr.sink_importance(rows, path)
    return r6(tr.scan_importance(spark, path).select("study", "feature", "gain", "cover", "frequency"), "gain", "cover", "frequency")


def _train_summary(spark, sf):
    best, _, margins = refitted(spark, sf)
    predictions = margins.withColumn("score", F.round(bo.sigmoid(F.col("margin")), 9)).withColumnRenamed("config_id", "model_id")
    return bo.train_summary(best, roc.youden_threshold(roc.ranked_counts(predictions))).drop("reported_at")


# ---- federated ------------------------------------------------------------------


def _stumps(spark, sf):
    model, tree_node = d.stump_models(spark, sf)
    return model, keep(tree_node)


def _counts(spark, sf):
    model, tree_node = mo.import_tree_model(spark, _round_trip(spark, sf))
    return fo.model_tree_counts(tree_node, model)


def _merge(spark, sf):
    merged = fo.merge_trees(*_stumps(spark, sf))
    columns = ["tree_id", "node_id", "source_model", "source_tree", "feature", "threshold", "leaf_value"]
    return r6(merged.select(*columns), "threshold", "leaf_value")


def _header(spark, sf):
    head = fo.global_header(d.stump_models(spark, sf)[0])
    return head.select(
        "model_id",
        "study",
        "base_margin",
        "n_trees",
        F.array_join(F.col("tree_info").cast("array<string>"), ",").alias("tree_info"),
        F.array_join(F.col("iteration_indptr").cast("array<string>"), ",").alias("iteration_indptr"),
    )


def _predict(spark, sf):
    return margins_and_scores(stump_predictions(spark, sf))


def _global_margins(spark, sf, head, merged):
    scores = d.vec_expression(spark, sf).select(
        "study", "sample_id", F.col("gene_id").alias("signature"), F.col("value").alias("score")
    )
    return margins_and_scores(fo.predict_trees(fo.sample_vectors(scores, merged), merged, head))


def _predict_global(spark, sf):
    model, tree_node = _stumps(spark, sf)
    return _global_margins(spark, sf, fo.global_header(model), keep(fo.merge_trees(model, tree_node)))


def _model_summary(spark, sf):
    """Read off documents: of every study, trained at a setting of its own, and of their merged model."""
    model, tree_node = _stumps(spark, sf)
    settings = bo.param_grid(model.select("study")).filter(F.col("config_id") == F.expr("1 + 500 * cast(substring(study, 2) as int)"))
    known = mo.with_settings(attach(model.drop("config_id"), settings, ["study"]), bo.L2, 0.0, "hist")
    path, merged_path = scratch_path(spark, "json"), scratch_path(spark, "merged-json")
    mo.export_tree_model(known, tree_node, path)
    local, nodes = mo.import_tree_model(spark, path)
    mo.export_tree_model(fo.global_header(local), fo.merge_trees(local, nodes), merged_path)
    whole, merged = mo.import_tree_model(spark, merged_path)
    return fo.model_summary(local, nodes).unionByName(fo.model_summary(whole, merged))


def _round_trip(spark, sf):
    model, tree_node = _stumps(spark, sf)
    path = scratch_path(spark, "json")
    mo.export_tree_model(model, tree_node, path)
    return path


def _merge_documents(spark, sf):
    """Local documents are read and merged; the merged document is written, read again and predicts."""
    local, local_nodes = mo.import_tree_model(spark, _round_trip(spark, sf))
    path = scratch_path(spark, "merged-json")
    mo.export_tree_model(fo.global_header(local), fo.merge_trees(local, local_nodes), path)
    head, nodes = mo.import_tree_model(spark, path)
    return _global_margins(spark, sf, head, keep(nodes))


_IMPORTED = ["model_id", "tree_id", "node_id", "feature", "threshold", "left", "right", "leaf_value", "gain", "cover"]


def _import(spark, sf):
    _, tree_node = mo.import_tree_model(spark, _round_trip(spark, sf))
    return r6(tree_node.select(*_IMPORTED), "threshold", "leaf_value", "gain", "cover")


def _import_lines(spark, sf):
    tree_node = mo.import_tree_lines(spark, _round_trip(spark, sf))
    return r6(tree_node.select(*_IMPORTED), "threshold", "leaf_value", "gain", "cover")


def _export(spark, sf):
    model, tree_node = mo.import_tree_model(spark, _round_trip(spark, sf))
    sums = tree_node.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.round(F.sum("leaf_value"), 6).alias("leaf_sum")
    )
    return model.join(sums, "model_id").select("model_id", "base_margin", "n_trees", "n_nodes", "leaf_sum")


# ---- SQL -----------------------------------------------------------------------------

_SHARES = ", ".join(repr(i / BINS) for i in range(1, BINS))


def cuts_text(source: str) -> str:
    return f"""SELECT study, feature, f, list_transform(quantile_cont(value, [{_SHARES}]), lambda x: round(x, 6)) AS cuts
    FROM {source} WHERE value IS NOT NULL GROUP BY ALL"""


def binned_text(source: str, cuts: str) -> str:
    return f"""SELECT e.study, e.sample_id, e.feature, e.f,
    CASE WHEN e.value IS NOT NULL THEN CAST(len(list_filter(c.cuts, lambda x: x <= e.value)) AS INTEGER) END AS bin
    FROM {source} e JOIN {cuts} c ON c.study = e.study AND c.feature = e.feature"""


q.cte("vfeature", "vexpr", "SELECT study, sample_id, gene_id AS feature, CAST(substr(gene_id, 2) AS INTEGER) + 1 AS f, value FROM vexpr")
q.cte("vcuts", "vfeature", cuts_text("vfeature"))
q.cte("vbinned", "vfeature vcuts", binned_text("vfeature", "vcuts"))
q.cte(
    "gappy",
    "vfeature",
    "SELECT study, sample_id, feature, f, CASE WHEN (CAST(sample_id AS BIGINT) + (f - 1) * 7) % 11 <> 0 THEN value END AS value FROM vfeature",
)
q.cte("cuts", "gappy", cuts_text("gappy"), once=True)
q.cte("binned", "gappy cuts", binned_text("gappy", "cuts"), once=True)
q.cte(
    "seeds",
    "vec",
    "SELECT study, CAST(135 + row_number() OVER (ORDER BY study) AS INTEGER) AS seed FROM (SELECT DISTINCT study FROM vec)",
)


def grid_text(study_source: str, grid: dict) -> str:
    """Nested loops over the parameter lists, first list fastest."""
    parts, number, stride = [], [], 1
    for name, values in grid.items():
        rows = ", ".join(f"({i}, CAST({v!r} AS {'INTEGER' if bo.GRID_TYPES[name] == 'int' else 'DOUBLE'}))" for i, v in enumerate(values))
        parts.append(f"(VALUES {rows}) {name}_t({name}_i, {name})")
        number.append(f"{name}_i * {stride}")
        stride *= len(values)
    return (
        f"SELECT study, CAST({' + '.join(number)} + 1 AS INTEGER) AS config_id, {', '.join(grid)} "
        f"FROM (SELECT DISTINCT study FROM {study_source}) CROSS JOIN " + " CROSS JOIN ".join(parts)
    )


q.cte("grid", "vec", grid_text("vec", TRAINED_GRID))
q.cte("full_grid", "vec", grid_text("vec", bo.GRID))
q.cte(
    "settings",
    "grid",
    "SELECT *, min(config_id) OVER (PARTITION BY study, eta, max_depth, colsample, subsample) AS train_id FROM grid",
)
q.cte(
    "runs",
    "settings seeds",
    """SELECT study, train_id AS config_id, eta, max_depth, colsample, subsample, max(nrounds) AS nrounds, seed
    FROM settings JOIN seeds USING (study) GROUP BY ALL""",
)
q.cte(
    "state_0",
    "vec runs",
    "SELECT v.study, r.config_id, v.sample_id, v.label, 0.0::DOUBLE AS margin FROM vec v JOIN runs r USING (study)",
)


def level_ctes(t: int, level: int) -> None:
    """Sums, tried cuts, splits and next nodes of one tree level, every node from its own rows."""
    tag, rows = f"{t}_{level}", f"rows_{t}_{level}"
    q.cte(
        f"hist_{tag}",
        f"{rows} binned kept_{t}",
        f"""SELECT r.study, r.config_id, r.node, b.f, b.bin, sum(r.g) AS g, sum(r.h) AS h, count(*) AS n
        FROM {rows} r JOIN kept_{t} k ON k.study = r.study AND k.config_id = r.config_id
        JOIN binned b ON b.study = r.study AND b.sample_id = r.sample_id AND b.f = k.f
        WHERE r.used AND NOT r.done GROUP BY ALL""",
        once=True,
    )
    q.cte(
        f"cell_{tag}",
        f"hist_{tag}",
        f"""SELECT study, config_id, node, f, bin, sum(CASE WHEN bin IS NOT NULL THEN g ELSE 0 END) OVER o AS gl,
        sum(CASE WHEN bin IS NOT NULL THEN h ELSE 0 END) OVER o AS hl, sum(CASE WHEN bin IS NULL THEN g ELSE 0 END) OVER a AS gm,
        sum(CASE WHEN bin IS NULL THEN h ELSE 0 END) OVER a AS hm, sum(CASE WHEN bin IS NULL THEN n ELSE 0 END) OVER a AS nm,
        sum(g) OVER a AS gt, sum(h) OVER a AS ht, sum(n) OVER a AS n
        FROM hist_{tag} WINDOW a AS (PARTITION BY study, config_id, node, f),
        o AS (PARTITION BY study, config_id, node, f ORDER BY bin NULLS FIRST ROWS UNBOUNDED PRECEDING)""",
        once=True,
    )
    q.cte(
        f"cand_{tag}",
        f"cell_{tag} runs",
        f"""SELECT *, floor(gain * 1e9::DOUBLE + 0.5::DOUBLE) AS units FROM (SELECT *,
         0.5::DOUBLE * (gl * gl / (hl + 1.0::DOUBLE) + (gt - gl) * (gt - gl) / (ht - hl + 1.0::DOUBLE) - gt * gt / (ht + 1.0::DOUBLE)) AS gain
        FROM (SELECT study, config_id, node, f, bin, TRUE AS dl, gl + gm AS gl, hl + hm AS hl, gt, ht FROM cell_{tag} WHERE bin IS NOT NULL
         UNION ALL SELECT study, config_id, node, f, bin, FALSE, gl, hl, gt, ht FROM cell_{tag} WHERE bin IS NOT NULL AND nm > 0)
        JOIN runs USING (study, config_id) WHERE bin < {BINS - 1} AND {level} < max_depth)""",
    )
    q.cte(
        f"split_{tag}",
        f"cand_{tag}",
        f"""SELECT t.study, t.config_id, t.node, b.f, b.bin AS split_bin, coalesce(b.dl, TRUE) AS default_left, b.gain, t.ht AS cover, CAST(t.n AS BIGINT) AS n,
        CASE WHEN b.f IS NULL THEN -t.eta * t.gt / (t.ht + 1.0::DOUBLE) END AS leaf_value
        FROM (SELECT * FROM cell_{tag} JOIN runs USING (study, config_id) QUALIFY row_number() OVER (PARTITION BY study, config_id, node ORDER BY f, bin) = 1) t
        LEFT JOIN (SELECT * FROM cand_{tag} WHERE units > 0 AND hl >= 1.0::DOUBLE - 5e-10::DOUBLE AND ht - hl >= 1.0::DOUBLE - 5e-10::DOUBLE
          QUALIFY row_number() OVER (PARTITION BY study, config_id, node ORDER BY units DESC, f, bin, dl DESC) = 1) b
        ON b.study = t.study AND b.config_id = t.config_id AND b.node = t.node""",
        once=True,
    )
    q.cte(
        f"rows_{t}_{level + 1}",
        f"{rows} split_{tag} binned",
        f"""SELECT r.study, r.config_id, r.sample_id, r.label, r.margin, r.g, r.h, r.used,
        CASE WHEN s.f IS NOT NULL THEN r.node * 2 + 1 + CASE WHEN b.bin IS NULL THEN CAST(NOT s.default_left AS INTEGER) WHEN b.bin > s.split_bin THEN 1 ELSE 0 END
         ELSE r.node END AS node,
        r.done OR s.f IS NULL AS done, coalesce(r.step, s.leaf_value) AS step
        FROM {rows} r LEFT JOIN split_{tag} s ON s.study = r.study AND s.config_id = r.config_id AND s.node = r.node
        LEFT JOIN binned b ON b.study = r.study AND b.sample_id = r.sample_id AND b.f = s.f""",
        once=True,
    )


for _t in range(ROUNDS):
    q.cte(
        f"kept_{_t}",
        "runs cuts",
        f"""SELECT study, config_id, f FROM (SELECT r.study, r.config_id, r.colsample, c.f,
        row_number() OVER (PARTITION BY r.study, r.config_id ORDER BY {q.unit_hash('r.seed', "'feature'", str(_t), 'c.feature')}, c.feature) AS o
        FROM runs r JOIN cuts c USING (study)) WHERE o <= greatest(1, floor(colsample * 64 + 1e-9))""",
        once=True,
    )
    q.cte(
        f"rows_{_t}_0",
        f"state_{_t} runs",
        f"""SELECT s.study, s.config_id, s.sample_id, s.label, s.margin, {q.sigmoid('s.margin')} - s.label AS g,
        {q.sigmoid('s.margin')} * (1.0::DOUBLE - {q.sigmoid('s.margin')}) AS h,
        {q.unit_hash('r.seed', "'row'", str(_t), 's.sample_id')} < r.subsample AS used, 0 AS node, FALSE AS done, NULL::DOUBLE AS step
        FROM state_{_t} s JOIN runs r USING (study, config_id)""",
        once=True,
    )
    for _level in range(DEPTH + 1):
        level_ctes(_t, _level)
    q.cte(
        f"state_{_t + 1}",
        f"rows_{_t}_{DEPTH + 1}",
        f"SELECT study, config_id, sample_id, label, margin + coalesce(step, 0.0::DOUBLE) AS margin FROM rows_{_t}_{DEPTH + 1}",
        once=True,
    )
_LEVELS = [(t, level) for t in range(ROUNDS) for level in range(DEPTH + 1)]
q.cte(
    "nodes",
    " ".join(f"split_{t}_{level}" for t, level in _LEVELS) + " cuts",
    f"""SELECT s.study, s.config_id, s.tree_id, CAST(s.node AS INTEGER) AS node_id, c.feature, c.cuts[s.split_bin + 1] AS threshold, s.default_left,
    s.leaf_value, s.gain, s.cover
    FROM ({' UNION ALL '.join(f'SELECT *, {t} AS tree_id FROM split_{t}_{level}' for t, level in _LEVELS)}) s
    LEFT JOIN cuts c ON c.study = s.study AND c.f = s.f""",
    once=True,
)
_POINTS = TRAINED_GRID["nrounds"]
q.cte(
    "margins",
    " ".join(f"state_{t}" for t in _POINTS),
    " UNION ALL ".join(f"SELECT *, {t} AS nrounds FROM state_{t}" for t in _POINTS),
    once=True,
)
q.cte(
    "gcount",
    "margins",
    q.counts_text(
        f"(SELECT study, config_id AS train_id, nrounds, label, round({q.sigmoid('margin')}, 9) AS score FROM margins)", "study, train_id, nrounds"
    ),
)
q.cte("train_auc", "gcount", q.auc_text("gcount", "study, train_id, nrounds"))
q.cte(
    "setting_auc",
    "settings train_auc",
    "SELECT study, config_id, auc FROM settings JOIN train_auc USING (study, train_id, nrounds)",
)
q.cte(
    "best",
    "setting_auc settings",
    """SELECT s.*, a.auc FROM setting_auc a JOIN settings s USING (study, config_id)
    QUALIFY row_number() OVER (PARTITION BY study ORDER BY round(a.auc, 12) DESC, config_id) = 1""",
)
q.cte(
    "best_nodes",
    "best nodes",
    """SELECT n.study, b.config_id, n.tree_id, n.node_id, n.feature, n.threshold, n.default_left, n.leaf_value, n.gain, n.cover
    FROM nodes n JOIN best b ON b.study = n.study AND b.train_id = n.config_id AND n.tree_id < b.nrounds""",
)


def importance_text(nodes: str, key: str, out: str) -> str:
    return f"""SELECT {key} AS {out}, feature, round(sum(gain) / sum(sum(gain)) OVER w, 6) AS gain, round(sum(cover) / sum(sum(cover)) OVER w, 6) AS cover,
    round(count(*) / CAST(sum(count(*)) OVER w AS DOUBLE), 6) AS frequency FROM {nodes} WHERE feature IS NOT NULL
    GROUP BY {key}, feature WINDOW w AS (PARTITION BY {key})"""


q.cte(
    "bcount",
    "best margins",
    q.counts_text(
        f"""(SELECT m.study, b.config_id AS model_id, m.label, round({q.sigmoid('m.margin')}, 9) AS score FROM margins m
        JOIN best b ON b.study = m.study AND b.train_id = m.config_id AND b.nrounds = m.nrounds)"""
    ),
)
q.cte("branked", "bcount", q.ranked_text("bcount"))

_NODE_SQL = """study, config_id, tree_id, node_id, feature, round(threshold, 6) AS threshold, default_left, round(leaf_value, 6) AS leaf_value,
 round(gain, 6) AS gain, round(cover, 6) AS cover"""
_PLACES = [
    (
        "placed",
        "SELECT *, CAST(row_number() OVER (PARTITION BY model_id, tree_id ORDER BY node_id) - 1 AS INTEGER) AS place FROM stump",
    )
]
#: Documents number the nodes of a tree without gaps.
_TREE_SQL = """SELECT t.model_id, t.tree_id, t.place AS node_id, t.feature, t.threshold, l.place AS "left", r.place AS "right",
 t.leaf_value, t.gain, t.cover FROM placed t
 LEFT JOIN placed l ON l.model_id = t.model_id AND l.tree_id = t.tree_id AND l.node_id = t."left"
 LEFT JOIN placed r ON r.model_id = t.model_id AND r.tree_id = t.tree_id AND r.node_id = t."right" """
_GLOBAL_SQL = f"""SELECT study, sample_id, 'global' AS model_id, round(sum(margin), 6) AS margin, round({q.sigmoid('sum(margin)')}, 6) AS score
 FROM stump_margin GROUP BY study, sample_id"""

QUERIES = {
    "param_grid": (_grid, q.query("gated", grid_text("gated", bo.GRID))),
    "bin_features": (_bins, q.query("vbinned", "SELECT study, sample_id, feature, bin FROM vbinned")),
    "grad_hess": (
        _grad,
        q.query(
            "vec",
            f"""SELECT study, sample_id, round(p - label, 6) AS g, round(p * (1.0::DOUBLE - p), 6) AS h FROM (
            SELECT *, {q.sigmoid('CAST(v[1] AS DOUBLE) * 4.0::DOUBLE')} AS p FROM vec)""",
        ),
    ),
    "row_col_sampling": (
        _sampling,
        q.query(
            "vec seeds",
            f"""SELECT study, sample_id, CAST(tree AS INTEGER) AS tree, {q.unit_hash('seed', "'row'", 'tree', 'sample_id')} < 0.6::DOUBLE AS row_kept
            FROM vec JOIN seeds USING (study) CROSS JOIN (SELECT unnest(range(0, 3)) AS tree)""",
        ),
    ),
    "column_sampling": (
        _col_sampling,
        q.query(
            "vexpr seeds",
            f"""SELECT study, CAST(tree AS INTEGER) AS tree, CAST(substr(gene_id, 2) AS INTEGER) + 1 AS f FROM (
            SELECT DISTINCT study, gene_id, seed, tree FROM vexpr JOIN seeds USING (study) CROSS JOIN (SELECT unnest(range(0, 3)) AS tree))
            QUALIFY row_number() OVER (PARTITION BY study, tree ORDER BY {q.unit_hash('seed', "'feature'", 'tree', 'gene_id')}, gene_id) <= floor(0.6 * 64 + 1e-9)""",
        ),
    ),
    "split_histogram": (
        _histogram,
        q.query("hist_0_1", "SELECT study, config_id, node, f, bin, round(g, 6) AS g, round(h, 6) AS h, n FROM hist_0_1"),
    ),
    "best_split": (
        _best_split,
        q.query(
            "split_0_1",
            "SELECT study, config_id, node, f, split_bin, default_left, round(gain, 6) AS gain, round(cover, 6) AS cover, n, round(leaf_value, 6) AS leaf_value FROM split_0_1",
        ),
    ),
    "grow_trees": (_grow, q.query("nodes", f"SELECT {_NODE_SQL} FROM nodes")),
    "train_per_study": (
        _train_margins,
        q.query("margins", "SELECT study, config_id, nrounds, sample_id, round(margin, 6) AS margin FROM margins"),
    ),
    "grid_auc": (_grid_auc, q.query("setting_auc", "SELECT study, config_id, round(auc, 6) AS auc FROM setting_auc")),
    "select_best": (
        _best,
        q.query(
            "best",
            "SELECT study, config_id, nrounds, eta, max_depth, gamma, colsample, subsample, round(auc, 6) AS auc FROM best",
        ),
    ),
    "refit_best": (_refit, q.query("best_nodes", f"SELECT {_NODE_SQL} FROM best_nodes")),
    "feature_importance": (_importance, q.query("best_nodes", importance_text("best_nodes", "study", "study"))),
    "sink_importance": (_sink_importance, q.query("stump", importance_text("stump", "model_id", "study"))),
    "train_summary": (
        _train_summary,
        q.query(
            "best branked",
            f"""SELECT study, config_id, nrounds, eta, max_depth, colsample, subsample, round(auc, 4) AS best_auc, round(threshold, 4) AS best_threshold
            FROM best JOIN bt USING (study)""",
            [("bt", YOUDEN_TEXT.replace("FROM ranked", "FROM branked"))],
        ),
    ),
    "model_tree_counts": (
        _counts,
        q.query("stump", "SELECT model_id, count(DISTINCT tree_id) AS num_trees, CAST(1 AS BIGINT) AS num_parallel_tree FROM stump GROUP BY model_id"),
    ),
    "merge_trees": (
        _merge,
        q.query(
            "stump",
            """SELECT CAST(dense_rank() OVER (ORDER BY model_id, tree_id) - 1 AS INTEGER) AS tree_id, node_id, model_id AS source_model, tree_id AS source_tree,
            feature, threshold, leaf_value FROM stump""",
        ),
    ),
    "global_header": (
        _header,
        q.query(
            "stump",
            """SELECT 'global' AS model_id, min(model_id) AS study, 0.0::DOUBLE AS base_margin, CAST(count(*) AS INTEGER) AS n_trees,
            array_to_string(list_transform(range(count(*)), lambda x: 0), ',') AS tree_info, array_to_string(range(count(*) + 1), ',') AS iteration_indptr
            FROM (SELECT DISTINCT model_id, tree_id FROM stump)""",
        ),
    ),
    "predict_trees": (
        _predict,
        q.query(
            "vpred",
            f"SELECT study, sample_id, model_id, round(margin, 6) AS margin, round({q.sigmoid('margin')}, 6) AS score FROM vpred",
        ),
    ),
    "predict_global": (_predict_global, q.query("stump_margin", _GLOBAL_SQL)),
    "model_summary": (
        _model_summary,
        q.query(
            "stump full_grid",
            """SELECT s.model_id, count(DISTINCT s.tree_id) AS num_trees, CAST(1 AS INTEGER) AS num_parallel_tree, any_value(g.max_depth) AS max_depth,
            any_value(eta) AS eta, any_value(colsample) AS colsample, any_value(subsample) AS subsample, 1.0::DOUBLE AS reg_lambda, 0.0::DOUBLE AS reg_alpha,
            'hist' AS tree_method, (SELECT count(DISTINCT feature) FROM stump) AS num_features
            FROM stump s JOIN full_grid g ON g.study = s.model_id AND g.config_id = 1 + 500 * CAST(substr(s.model_id, 2) AS INTEGER) GROUP BY s.model_id
            UNION ALL SELECT 'global', (SELECT count(*) FROM (SELECT DISTINCT model_id, tree_id FROM stump)), 1, max_depth, eta, colsample, subsample, 1.0, 0.0, 'hist',
            (SELECT count(DISTINCT feature) FROM stump) FROM full_grid WHERE study = (SELECT min(model_id) FROM stump)
             AND config_id = 1 + 500 * CAST(substr(study, 2) AS INTEGER)""",
        ),
    ),
    "import_tree_model": (_import, q.query("stump", _TREE_SQL, _PLACES)),
    "import_tree_lines": (_import_lines, q.query("stump", _TREE_SQL, _PLACES)),
    "merge_documents": (_merge_documents, q.query("stump_margin", _GLOBAL_SQL)),
    "export_tree_model": (
        _export,
        q.query(
            "stump",
            """SELECT model_id, 0.0::DOUBLE AS base_margin, CAST(count(DISTINCT tree_id) AS INTEGER) AS n_trees, count(*) AS n_nodes,
            round(sum(leaf_value), 6) AS leaf_sum FROM stump GROUP BY model_id""",
        ),
    ),
}
