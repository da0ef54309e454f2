"""Tree models as JSON documents in the layout of gradient-boosting libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import sigmoid
from ..operators.forest import feature_catalog
from ..operators.scale import attach
from .cohorts import file_stem

# Field names and placeholder of the document layout.
ROOT_PARENT = 2147483647
TREE_SCHEMA = (
    "id INT, tree_param STRUCT<num_nodes: STRING, num_feature: STRING>, left_children ARRAY<INT>, "
    "right_children ARRAY<INT>, parents ARRAY<INT>, split_indices ARRAY<INT>, split_conditions ARRAY<DOUBLE>, "
    "default_left ARRAY<INT>, loss_changes ARRAY<DOUBLE>, sum_hessian ARRAY<DOUBLE>"
)
#: A list of strings, brackets and quotes inside them included.
_NAMES = r'"feature_names"\s*:\s*(\[(?:"(?:[^"\\]|\\.)*+"|[\s,])*+\])'
DOCUMENT_SCHEMA = (
    "learner STRUCT<feature_names: ARRAY<STRING>, learner_model_param: STRUCT<base_score: STRING, num_feature: STRING>, "
    "gradient_booster: STRUCT<model: STRUCT<gbtree_model_param: STRUCT<num_trees: STRING, num_parallel_tree: STRING>, "
    f"trees: ARRAY<STRUCT<{TREE_SCHEMA.replace(' INT', ': INT').replace('tree_param STRUCT', 'tree_param: STRUCT').replace(' ARRAY<', ': ARRAY<')}>>, "
    "tree_info: ARRAY<INT>, iteration_indptr: ARRAY<INT>>>>"
)
#: All fields of a document beside its trees, as the reader finds them: known ones are rebuilt, others pass through.
HEAD_SCHEMA = "learner MAP<STRING, VARIANT>, version VARIANT"
FIELDS = "MAP<STRING, VARIANT>"
REBUILT = {
    "learner": ["feature_names", "learner_model_param", "gradient_booster"],
    "booster": ["model"],
    "model": ["gbtree_model_param", "trees", "tree_info", "iteration_indptr"],
}


# ---- the head of a document --------------------------------------------------------


def head_columns(text: str) -> list[Column]:
    """``learner_fields``, ``booster_fields``, ``model_fields`` (maps of VARIANT), ``version`` and ``feature_names`` of a document."""
    d = F.from_json(text, HEAD_SCHEMA)
    inner = lambda fields, name: F.variant_get(fields[name], "$", FIELDS)
    learner = d["learner"]
    booster = inner(learner, "gradient_booster")
    but = lambda fields, *names: F.map_filter(fields, lambda k, _: ~k.isin(*names))
    return [
        but(learner, "feature_names", "gradient_booster").alias("learner_fields"),
        but(booster, "model").alias("booster_fields"),
        but(inner(booster, "model"), "trees", "tree_info", "iteration_indptr").alias("model_fields"),
        d["version"].alias("version"),
    ]


def with_settings(model: DataFrame, reg_lambda: float, reg_alpha: float, tree_method: str) -> DataFrame:
    """Adds ``booster_fields`` for models of this library's trainer, from their columns ``eta``, ``max_depth``, ``colsample``
    and ``subsample`` and what holds for every run."""
    text = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("string")
    names = {"eta": "eta", "max_depth": "max_depth", "colsample_bytree": "colsample", "subsample": "subsample",
             "lambda": reg_lambda, "alpha": reg_alpha}
    tree = F.struct(*[text(c).alias(n) for n, c in names.items()])
    method = F.struct(F.lit(tree_method).alias("tree_method"))
    value = lambda c: F.parse_json(F.to_json(c))
    return model.withColumn(
        "booster_fields",
        F.create_map(
            F.lit("name"), F.parse_json(F.lit('"gbtree"')), F.lit("tree_train_param"), value(tree), F.lit("gbtree_train_param"), value(method)
        ),
    )


def _fields(model: DataFrame, kind: str, default: str) -> Column:
    """Fields that pass through, as JSON text with a comma behind each."""
    if f"{kind}_fields" not in model.columns:
        return F.lit(default)
    kept = F.map_filter(f"{kind}_fields", lambda k, _: ~k.isin(*REBUILT[kind]))
    inside = F.regexp_replace(F.to_json(kept), r"^\{|\}$", "")
    return F.coalesce(F.when(inside != "", F.concat(inside, F.lit(","))).otherwise(F.lit("")), F.lit(default))


def _parameters(model: DataFrame, kind: str, name: str, **rebuilt: Column) -> Column:
    """An object of text parameters: those of the document, the rebuilt ones anew."""
    entries = F.create_map(*[x for k, v in rebuilt.items() for x in (F.lit(k), v)])
    if f"{kind}_fields" in model.columns:
        stated = F.variant_get(F.col(f"{kind}_fields")[name], "$", "MAP<STRING, STRING>")
        rest = F.map_filter(stated, lambda k, _: ~k.isin(*rebuilt))
        entries = F.map_concat(F.coalesce(rest, F.create_map().cast("map<string,string>")), entries)
    return F.to_json(entries)


def packed_trees(tree_node: DataFrame) -> DataFrame:
    """(model_id, tree_id, tree): a tree's nodes as parallel arrays.

    One group is one tree, bounded by its depth.
    """
    places = feature_catalog(tree_node).select(F.posexplode("features").alias("_at", "feature"))
    nodes = F.sort_array(
        F.collect_list(
            F.struct("node_id", "_at", "threshold", "left", "right", "default_left", "leaf_value", "gain", "cover")
        )
    )
    packed = attach(tree_node, places, ["feature"], "left").groupBy("model_id", "tree_id").agg(nodes.alias("n"))
    ids = F.col("n.node_id")
    place = lambda i: (F.array_position(ids, i) - 1).cast("int")
    child = lambda side: F.transform("n", lambda n: F.coalesce(place(n[side]), F.lit(-1)))
    above = lambda i: F.greatest(F.array_position("n.left", i), F.array_position("n.right", i)).cast("int")
    parent = F.transform(
        ids, lambda i: F.when(above(i) == 0, F.lit(ROOT_PARENT)).otherwise(above(i) - 1)
    )
    filled = lambda field, default: F.transform(f"n.{field}", lambda v: F.coalesce(v, F.lit(default)))
    return packed.select(
        "model_id",
        "tree_id",
        F.struct(
            F.col("tree_id").alias("id"),
            child("left").alias("left_children"),
            child("right").alias("right_children"),
            parent.alias("parents"),
            filled("_at", 0).alias("split_indices"),
            F.transform("n", lambda n: F.coalesce(n["threshold"], n["leaf_value"])).alias("split_conditions"),
            F.transform("n", lambda n: n["default_left"].cast("int")).alias("default_left"),
            filled("gain", 0.0).alias("loss_changes"),
            filled("cover", 0.0).alias("sum_hessian"),
            F.struct(F.size("n").cast("string").alias("num_nodes"), F.lit("0").alias("num_feature")).alias("tree_param"),
        ).alias("tree"),
    )


def document_lines(model: DataFrame, tree_node: DataFrame) -> DataFrame:
    """(model_id, line, value): head, one line per tree, tail. Joined, the lines of
    a model are one JSON document; no row ever holds a whole ensemble."""
    trees = attach(packed_trees(tree_node), model.select("model_id", "n_trees"), ["model_id"])
    comma = F.when(F.col("tree_id") == F.col("n_trees") - 1, "").otherwise(",")
    body = trees.select(
        "model_id", (F.col("tree_id") + 1).alias("line"), F.concat(F.to_json("tree"), comma).alias("value")
    )
    names = feature_catalog(tree_node).scalar()
    n = F.col("n_trees").cast("string")
    parallel = F.col("num_parallel_tree").cast("string") if "num_parallel_tree" in model.columns else F.lit("1")
    base, size = sigmoid(F.col("base_margin")).cast("string"), F.size(names).cast("string")
    learner = F.concat(
        F.lit('{"learner":{"feature_names":'),
        F.to_json(names),
        F.lit(',"learner_model_param":'),
        _parameters(model, "learner", "learner_model_param", base_score=base, num_feature=size),
        F.lit(","),
        _fields(model, "learner", '"objective":{"name":"binary:logistic"},'),
        F.lit('"gradient_booster":{'),
        _fields(model, "booster", '"name":"gbtree",'),
        F.lit('"model":{'),
        _fields(model, "model", ""),
        F.lit('"gbtree_model_param":'),
        _parameters(model, "model", "gbtree_model_param", num_trees=n, num_parallel_tree=F.coalesce(parallel, F.lit("1"))),
        F.lit(',"trees":['),
    )
    tail = F.concat(
        F.lit('],"tree_info":'),
        F.to_json(F.array_repeat(F.lit(0), F.col("n_trees"))),
        F.lit(',"iteration_indptr":'),
        F.to_json(F.sequence(F.lit(0), F.col("n_trees"))),
        F.lit("}}},\"version\":"),
        F.coalesce(F.to_json("version"), F.lit("[1,0,0]")) if "version" in model.columns else F.lit("[1,0,0]"),
        F.lit("}"),
    )
    ends = model.select(
        "model_id",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("line"), learner.alias("value")),
                F.struct((F.col("n_trees") + 1).alias("line"), tail.alias("value")),
            )
        ),
    )
    return body.unionByName(ends)


def export_tree_model(model: DataFrame, tree_node: DataFrame, path: str) -> None:
    """One JSON file per model below ``path``, streamed line by line in order."""
    lines = document_lines(model, tree_node)
    (
        lines.repartition("model_id")
        .sortWithinPartitions("model_id", "line")
        .select("model_id", "value")
        .write.partitionBy("model_id")
        .text(path)
    )


def _nodes(trees: DataFrame) -> DataFrame:
    """tree_node rows of parsed trees (model_id, names, tree), numbered as in the document.

    A node other than the root that has no parent was deleted and is left out. A split
    on a feature without a name is called ``f`` and its index.
    """
    t = lambda f: F.col(f"tree.{f}").alias(f)
    fields = ["left_children", "right_children", "parents", "split_indices", "split_conditions", "default_left"]
    rows = trees.select(
        "model_id", F.col("tree.id").alias("tree_id"), "names",
        F.inline(
            F.arrays_zip(
                F.sequence(F.lit(0), F.size("tree.left_children") - 1).alias("node_id"),
                *[t(f) for f in [*fields, "loss_changes", "sum_hessian"]],
            )
        ),
    ).filter((F.col("node_id") == 0) | (F.col("parents") != ROOT_PARENT))
    split = F.col("left_children") >= 0
    name = F.coalesce(F.get("names", F.col("split_indices")), F.concat(F.lit("f"), F.col("split_indices").cast("string")))
    return rows.select(
        "model_id",
        "tree_id",
        "node_id",
        F.when(split, name).alias("feature"),
        F.when(split, F.col("split_conditions")).alias("threshold"),
        F.when(split, F.col("left_children")).alias("left"),
        F.when(split, F.col("right_children")).alias("right"),
        (F.col("default_left") == 1).alias("default_left"),
        F.when(~split, F.col("split_conditions")).alias("leaf_value"),
        F.when(split, F.col("loss_changes")).alias("gain"),
        F.col("sum_hessian").alias("cover"),
    )


def _model_id():
    parts = F.split(F.col("_metadata.file_path"), "/")
    parent = F.url_decode(F.element_at(parts, -2))
    return F.when(parent.startswith("model_id="), F.regexp_replace(parent, "^model_id=", "")).otherwise(
        file_stem(F.col("_metadata.file_path"))
    )


def import_tree_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(model, tree_node) of all JSON documents below ``path``, one document per file.

    ``model`` keeps every field of a document: its full ``feature_names`` and, as VARIANT, all that is not rebuilt from
    the trees. Merging carries them on and export writes them again.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    parsed = raw.select(_model_id().alias("model_id"), F.from_json("value", DOCUMENT_SCHEMA).alias("d"), "value")
    readable = F.col("d.learner.gradient_booster.model.trees").isNotNull()
    fail = F.raise_error(F.concat(F.lit("no tree model in document "), F.col("model_id")))
    parsed = parsed.select(F.when(readable, F.col("model_id")).otherwise(fail.cast("string")).alias("model_id"), "d", "value")
    booster = "d.learner.gradient_booster.model"
    # newer documents put the value in brackets
    base = F.regexp_replace("d.learner.learner_model_param.base_score", r"[\[\]]", "").cast("double")
    model = parsed.select(
        "model_id",
        F.col("model_id").alias("study"),
        F.log(base / (F.lit(1.0) - base)).alias("base_margin"),
        F.col(f"{booster}.gbtree_model_param.num_trees").cast("int").alias("n_trees"),
        F.col(f"{booster}.gbtree_model_param.num_parallel_tree").cast("int").alias("num_parallel_tree"),
        F.col("d.learner.feature_names").alias("feature_names"),
        *head_columns("value"),
    )
    trees = parsed.select(
        "model_id", F.col("d.learner.feature_names").alias("names"), F.explode(f"{booster}.trees").alias("tree")
    )
    return model, _nodes(trees)


def import_tree_lines(spark: SparkSession, path: str) -> DataFrame:
    """tree_node of documents of any size, on one line or on many.

    The text is split at closing braces, so an ensemble is dealt out between tasks tree
    by tree. ``tree_param``, the one object inside a tree, must be its last field, as
    in documents with sorted fields and those written here; others fail.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "}")
    raw = reader.text(path).select(_model_id().alias("model_id"), "value")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("model_id")))
    listed = F.regexp_extract("value", _NAMES, 1)
    names = raw.filter(F.col("value").contains('"feature_names"')).select(
        "model_id",
        F.when(listed != "", F.from_json(listed, "ARRAY<STRING>"))
        .otherwise(fail("feature names not understood in ").cast("array<string>"))
        .alias("names"),
    )
    text = F.concat(F.regexp_extract("value", r"(\{[^{]*\{[^{]*)$", 1), F.lit("}}"))
    tree = F.from_json(text, TREE_SCHEMA)
    trees = raw.filter(F.col("value").contains('"left_children"')).select(
        "model_id",
        F.when(tree["left_children"].isNotNull() & tree["tree_param"].isNotNull(), tree)
        .otherwise(fail("tree not understood in ").cast(StructType.fromDDL(TREE_SCHEMA)))
        .alias("tree"),
    )
    return _nodes(attach(trees, names, ["model_id"], "left"))
