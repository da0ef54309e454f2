"""Tree models as tables: counting, merging, describing, predicting.

``model`` is one row per model; ``tree_node`` one row per node. ``left`` and
``right`` name a node's children; the root has the least ``node_id`` of its tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import round9, sigmoid
from .scale import attach, keep

CHUNK_TREES = 64
MAX_BROADCAST_CHUNKS = 64
#: Samples that meet a chunk of trees together, and values they may have in all.
BLOCK_ROWS, BLOCK_VALUES = 512, 1 << 20


def tree_depth(nodes: str = "nodes") -> Column:
    """Levels below the root of a linked tree, read off its child positions."""

    def descend(state: Column, _: Column) -> Column:
        node = lambda i: F.get(F.col(nodes), i)
        below = F.flatten(F.transform(state["level"], lambda i: F.array(node(i)["left"], node(i)["right"])))
        below = F.filter(below, lambda i: i.isNotNull())
        return F.struct(below.alias("level"), (state["depth"] + (F.size(below) > 0).cast("int")).alias("depth"))

    start = F.struct(F.array(F.lit(0)).alias("level"), F.lit(0).alias("depth"))
    return F.aggregate(nodes, start, descend, lambda state: state["depth"])


def linked_trees(tree_node: DataFrame) -> DataFrame:
    """(model_id, tree_id, nodes): a tree is an array of nodes with its root first;
    children are given by array position, features by catalog position (``at``).
    """
    places = feature_catalog(tree_node).select(F.posexplode("features").alias("_at", "feature"))
    listed = F.sort_array(
        F.collect_list(F.struct("node_id", "_at", "threshold", "left", "right", "default_left", "leaf_value"))
    )
    # nodes of documents are numbered without gaps: their number is their place; others are looked for
    dense = F.element_at("_nodes.node_id", -1) == F.size("_nodes") - 1
    position = lambda i: F.when(dense, i).otherwise(F.array_position("_nodes.node_id", i) - 1).cast("int")
    linked = F.transform(
        "_nodes",
        lambda n: F.struct(
            n["_at"].alias("at"),
            n["threshold"].alias("threshold"),
            position(n["left"]).alias("left"),
            position(n["right"]).alias("right"),
            n["default_left"].alias("default_left"),
            n["leaf_value"].alias("leaf"),
        ),
    )
    gathered = attach(tree_node, places, ["feature"], "left").groupBy("model_id", "tree_id").agg(listed.alias("_nodes"))
    return gathered.select("model_id", "tree_id", linked.alias("nodes"))


def model_tree_counts(tree_node: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Trees per model; ``num_parallel_tree`` as the model's row states it, else 1."""
    counts = tree_node.groupBy("model_id").agg(F.count_distinct("tree_id").alias("num_trees"))
    if model is None or "num_parallel_tree" not in model.columns:
        return counts.withColumn("num_parallel_tree", F.lit(1).cast("bigint"))
    stated = model.select("model_id", F.col("num_parallel_tree").cast("bigint").alias("num_parallel_tree"))
    return attach(counts, stated, ["model_id"], "left")


def model_offsets(model: DataFrame) -> DataFrame:
    """First global tree number per model, in study order (one row per model)."""
    ordered = Window.partitionBy(F.lit(0)).orderBy("study", "model_id")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return model.select(
        "model_id", F.coalesce(F.sum("n_trees").over(earlier), F.lit(0)).cast("int").alias("offset")
    )


def merge_trees(model: DataFrame, tree_node: DataFrame, model_id: str = "global") -> DataFrame:
    """All local trees as one model with contiguous tree numbers and their origin."""
    return (
        attach(tree_node, model_offsets(model), ["model_id"])
        .withColumn("source_model", F.col("model_id"))
        .withColumn("source_tree", F.col("tree_id"))
        .withColumn("tree_id", F.col("offset") + F.col("tree_id"))
        .withColumn("model_id", F.lit(model_id))
        .drop("offset")
    )


def global_header(model: DataFrame, model_id: str = "global", combine: str = "sum") -> DataFrame:
    """The merged model's row: every other field from the first model, counts rebuilt.

    ``combine='mean'`` scales the summed leaves by one over the number of models.
    """
    n_models = F.count(F.lit(1))
    rebuilt = {"model_id", "n_trees", "leaf_scale", "tree_info", "iteration_indptr"}
    carried = F.struct(*[c for c in model.columns if c not in rebuilt])
    first = F.min_by(carried, F.struct("study", "model_id"))
    return model.agg(
        F.when(n_models == 0, F.raise_error(F.lit("no local models found")).cast("string"))
        .otherwise(F.lit(model_id))
        .alias("model_id"),
        first.alias("_first"),
        F.coalesce(F.sum("n_trees"), F.lit(0)).cast("int").alias("n_trees"),
        (F.lit(1.0) / F.nullif(n_models, F.lit(0).cast("bigint")) if combine == "mean" else F.lit(1.0)).alias(
            "leaf_scale"
        ),
    ).select(
        "model_id",
        "_first.*",
        "n_trees",
        "leaf_scale",
        F.array_repeat(F.lit(0), F.col("n_trees")).alias("tree_info"),
        F.sequence(F.lit(0), F.col("n_trees")).alias("iteration_indptr"),
    )


def model_summary(model: DataFrame, tree_node: DataFrame) -> DataFrame:
    """What a model's document states of it, NULL where it says nothing, and the counts of its trees.

    ``model`` comes from documents (see ``sources.models``). ``max_depth`` is the stated one, else the depth of the
    deepest tree; ``num_features`` the stated number, else the features that trees split on.
    """
    seen = tree_node.groupBy("model_id").agg(
        F.count_distinct("tree_id").alias("num_trees"),
        F.count_distinct("feature").alias("_features"),
    )
    depths = linked_trees(tree_node).groupBy("model_id").agg(F.max(tree_depth()).alias("_depth"))
    rows = attach(model, attach(seen, depths, ["model_id"]), ["model_id"])

    def stated(fields: str, name: str, item: str, kind: str) -> Column:
        if fields not in model.columns:
            return F.lit(None).cast(kind)
        return F.variant_get(F.col(fields)[name], f"$.{item}", "string").cast(kind)

    tree = lambda item, kind="double": stated("booster_fields", "tree_train_param", item, kind)
    return rows.select(
        "model_id",
        "num_trees",
        stated("model_fields", "gbtree_model_param", "num_parallel_tree", "int").alias("num_parallel_tree"),
        F.coalesce(tree("max_depth", "int"), "_depth").alias("max_depth"),
        tree("eta").alias("eta"),
        tree("colsample_bytree").alias("colsample"),
        tree("subsample").alias("subsample"),
        tree("lambda").alias("reg_lambda"),
        tree("alpha").alias("reg_alpha"),
        stated("booster_fields", "gbtree_train_param", "tree_method", "string").alias("tree_method"),
        F.coalesce(stated("learner_fields", "learner_model_param", "num_feature", "bigint"), "_features").alias("num_features"),
    )


def feature_catalog(tree_node: DataFrame) -> DataFrame:
    """One row: every feature any tree splits on, in name order."""
    return tree_node.agg(F.sort_array(F.collect_set("feature")).alias("features"))


def sample_vectors(scores: DataFrame, tree_node: DataFrame) -> DataFrame:
    """``x``: a sample's values along the feature catalog, NULL where absent.

    ``scores`` is (study, sample_id, signature, score). Every sample has a row, also
    one with none of the features. Values no tree uses are dropped before the shuffle.
    """
    catalog = keep(feature_catalog(tree_node))
    places = catalog.select(F.posexplode("features").alias("_at", "signature"))
    size = catalog.select(F.size("features").alias("n"))
    used = F.when(F.col("_at").isNotNull(), F.struct("_at", "score"))
    gathered = attach(scores, places, ["signature"], "left").groupBy("sample_id", "study").agg(
        F.sort_array(F.collect_list(used)).alias("_s")
    )
    positions = F.slice(F.sequence(F.lit(0), F.col("_n")), F.lit(1), F.col("_n"))
    entries = F.map_from_entries("_s")
    # a sample with each feature once is in order already; in others features are looked for, and a repeated one is refused
    whole = (F.size("_s") == F.col("_n")) & (F.size(F.array_distinct("_s._at")) == F.col("_n"))
    x = F.when(whole, F.col("_s.score")).otherwise(F.transform(positions, lambda i: entries[i]))
    return gathered.withColumn("_n", size.scalar()).select("study", "sample_id", x.alias("x"))


def tree_chunks(tree_node: DataFrame, model: DataFrame, chunk_trees: int = CHUNK_TREES) -> DataFrame:
    """Trees packed for prediction: (model_id, chunk, trees), numbered over all models.

    A chunk holds at most ``chunk_trees`` trees of a model; a model without trees
    has one empty chunk. Numbers stand on a window over one row per model.
    """
    trees = linked_trees(tree_node).select(
        "model_id",
        F.floor(F.col("tree_id") / chunk_trees).cast("int").alias("_part"),
        F.struct(tree_depth().alias("depth"), "nodes").alias("tree"),
    )
    filled = trees.groupBy("model_id", "_part").agg(F.collect_list("tree").alias("trees"))
    chunks = model.select("model_id").join(filled, "model_id", "left").select(
        "model_id", F.coalesce("_part", F.lit(0)).alias("_part"), F.coalesce("trees", F.array()).alias("trees")
    )
    ordered = Window.partitionBy(F.lit(0)).orderBy("model_id").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        chunks.groupBy("model_id")
        .agg((F.max("_part") + 1).alias("_n"))
        .select("model_id", F.coalesce(F.sum("_n").over(ordered), F.lit(0)).cast("int").alias("_first"))
    )
    return attach(chunks, firsts, ["model_id"]).select(
        "model_id", "trees", (F.col("_first") + F.col("_part")).alias("chunk")
    )


def sample_blocks(vectors: DataFrame) -> DataFrame:
    """``rows``: samples packed where they lie into arrays of (study, sample_id, x), so that trees come once per array."""
    kinds = ", ".join(f"`{c}`: {vectors.schema[c].dataType.simpleString()}" for c in ("study", "sample_id"))
    rows = vectors.select("study", "sample_id", F.col("x").cast("array<double>").alias("x"))

    def work(batches):
        for batch in batches:
            values = len(batch.column("x").flatten())
            step = max(1, min(BLOCK_ROWS, BLOCK_VALUES * batch.num_rows // max(values, 1)))
            for at in range(0, batch.num_rows, step):
                part = pa.Table.from_batches([batch.slice(at, step)]).to_struct_array().combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=["rows"])

    return rows.mapInArrow(work, f"rows array<struct<{kinds}, x: array<double>>>")


def _numbers(column: pa.Array, missing) -> np.ndarray:
    return pc.fill_null(column, missing).to_numpy(zero_copy_only=False)


def leaf_sums(x: pa.Array, trees: pa.Array) -> pa.Array:
    """Sum of the leaves that each sample of ``x`` reaches in ``trees``, NULL where one has no value.

    All samples step through all trees at once. A missing value takes the default side, a missing side is the right one;
    comparisons are Spark's, where NaN is greater than any number. A step to a node that is not there ends without a leaf.
    """
    n = len(x)
    depth, nodes = _numbers(trees.field("depth"), 0), trees.field("nodes")
    sizes = _numbers(pc.list_value_length(nodes), 0).astype(np.int64)
    first, flat = np.append(0, np.cumsum(sizes))[:-1], nodes.flatten()
    lost = len(flat)  # one more node, without children and leaf
    more = lambda name, missing, end: np.append(_numbers(flat.field(name), missing), end)
    at, left, right = (more(c, d, d).astype(np.int64) for c, d in (("at", 0), ("left", -1), ("right", -1)))
    inner = np.append(flat.field("left").is_valid().to_numpy(zero_copy_only=False), False)
    cut, cut_known = more("threshold", 0.0, 0.0), np.append(flat.field("threshold").is_valid().to_numpy(zero_copy_only=False), False)
    default_left, leaf = more("default_left", False, False), more("leaf", 0.0, 0.0)
    leaf_known = np.append(flat.field("leaf").is_valid().to_numpy(zero_copy_only=False), False)

    # samples as a grid, one more column for values that are not there
    lengths = _numbers(pc.list_value_length(x), 0).astype(np.int64)
    cells, wide = x.flatten(), int(lengths.max(initial=0))
    grid, known = np.zeros((n, wide + 1)), np.zeros((n, wide + 1), bool)
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(cells)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grid[row, column], known[row, column] = _numbers(cells, 0.0), cells.is_valid().to_numpy(zero_copy_only=False)
    at = np.where((at < 0) | (at >= wide), wide, at)

    place = np.tile(np.where(sizes > 0, first, lost), (n, 1))
    for step in range(int(depth.max(initial=-1)) + 1):
        here = inner[place] & (depth >= step)
        if not here.any():
            break
        s, t = np.nonzero(here)
        node = place[s, t]
        value, there, limit = grid[s, at[node]], known[s, at[node]], cut[node]
        less = (value < limit) | (np.isnan(limit) & ~np.isnan(value))
        child = np.where(np.where(there, less & cut_known[node], default_left[node]), left[node], right[node])
        place[s, t] = np.where((child < 0) | (child >= sizes[t]), lost, first[t] + child)
    total = np.zeros(n)
    for t in range(len(sizes)):  # one by one: the order of the sum is that of the trees
        total += leaf[place[:, t]]
    return pa.array(total, mask=~leaf_known[place].all(axis=1))


def predict_trees(
    vectors: DataFrame,
    tree_node: DataFrame,
    model: DataFrame,
    chunk_trees: int = CHUNK_TREES,
    max_chunks: int = MAX_BROADCAST_CHUNKS,
) -> DataFrame:
    """Every model on every sample: study, sample_id, model_id, margin, score.

    One row per sample and model: absent features and NULL values take the default
    branch, and a model without trees gives its base margin.

    Samples are packed into blocks, which step through a chunk of trees at once.
    Few chunks are broadcast, so samples never move. With many chunks a block
    is repeated once per chunk, meets its chunk in a salted join, and partial
    margins are summed.
    """
    chunks = keep(tree_chunks(tree_node, model, chunk_trees))
    n_chunks, n_models = chunks.agg(F.coalesce(F.max("chunk") + 1, F.lit(0)), F.count_distinct("model_id")).first()
    spread = sample_blocks(vectors).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    met = attach(spread, chunks, ["chunk"], max_rows=max_chunks).select("rows", "model_id", "trees")

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, trees = (batch.column(c).slice(i, 1).flatten() for c in ("rows", "trees"))
                model_id = batch.column("model_id").take(pa.array([i] * len(rows)))
                sums = leaf_sums(rows.field("x"), trees)
                yield pa.RecordBatch.from_arrays(
                    [rows.field("study"), rows.field("sample_id"), model_id, sums], names=["study", "sample_id", "model_id", "_sum"]
                )

    kinds = {c: vectors.schema[c].dataType for c in ("study", "sample_id")} | {"model_id": model.schema["model_id"].dataType}
    partial = met.mapInArrow(work, ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds.items()) + ", _sum double")
    if n_chunks > n_models:
        partial = partial.groupBy("study", "sample_id", "model_id").agg(F.sum("_sum").alias("_sum"))
    scale = F.col("leaf_scale") if "leaf_scale" in model.columns else F.lit(1.0)
    heads = model.select("model_id", "base_margin", scale.alias("_scale"))
    margin = F.col("base_margin") + F.col("_scale") * F.col("_sum")
    return attach(partial, heads, ["model_id"]).select(
        "study", "sample_id", "model_id", margin.alias("margin"), round9(sigmoid(margin)).alias("score")
    )
