"""Tree tables: merging, documents, prediction paths."""

import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import clinical as cl
from cohortloom.operators import features as ft
from cohortloom.operators import forest as fo
from cohortloom.sources import cohorts as co
from cohortloom.sources import models as mo

NODE = (
    "model_id string, tree_id int, node_id int, feature string, threshold double, left int, right int, "
    "default_left boolean, leaf_value double, gain double, cover double"
)


def stump(model, tree, feature, cut, low, high):
    return [
        (model, tree, 0, feature, cut, 1, 2, True, None, 1.0, 4.0),
        (model, tree, 1, None, None, None, None, True, low, None, 2.0),
        (model, tree, 2, None, None, None, None, True, high, None, 2.0),
    ]


@pytest.fixture
def toys(spark):
    nodes = (
        stump("a", 0, "x", 0.5, -1.0, 1.0) + stump("a", 1, "y", 0.0, -0.25, 0.5)
        + stump("b", 0, "x", 0.1, 0.2, 0.4) + stump("b", 1, "z", 2.0, 0.0, 8.0)
        + stump("c", 0, "y", 1.0, 0.1, 0.3) + stump("c", 1, "x", 0.0, 0.0, 0.6) + stump("c", 2, "z", 0.0, 0.7, 0.9)
    )
    tree_node = spark.createDataFrame(nodes, NODE)
    rows = [("a", "a", 0, 0.0, 2), ("b", "b", 0, 0.0, 2), ("c", "c", 0, 0.0, 3)]
    model = spark.createDataFrame(rows, "model_id string, study string, config_id int, base_margin double, n_trees int")
    return model, tree_node


def samples(spark):
    rows = [("v", "p1", "x", 0.7), ("v", "p1", "y", -1.0), ("v", "p1", "z", 3.0), ("v", "p2", "x", 0.2)]
    return spark.createDataFrame(rows, "study string, sample_id string, signature string, score double")


def test_merge_numbers_trees(toys):
    merged = fo.merge_trees(*toys)
    ids = {(r.source_model, r.source_tree): r.tree_id for r in merged.collect()}
    assert ids == {("a", 0): 0, ("a", 1): 1, ("b", 0): 2, ("b", 1): 3, ("c", 0): 4, ("c", 1): 5, ("c", 2): 6}
    head = fo.global_header(toys[0]).first()
    assert head.n_trees == 7 and head.tree_info == [0] * 7 and head.iteration_indptr == list(range(8))


def test_header_fails_without_models(toys):
    with pytest.raises(Exception, match="no local models"):
        fo.global_header(toys[0].filter("false")).collect()


@pytest.mark.parametrize("chunk_trees,max_chunks", [(64, 64), (2, 64), (2, 0)])
def test_prediction_by_hand_on_every_path(spark, toys, chunk_trees, max_chunks):
    model, tree_node = toys
    vectors = fo.sample_vectors(samples(spark), tree_node)
    got = fo.predict_trees(vectors, tree_node, model, chunk_trees, max_chunks).collect()
    margins = {(r.sample_id, r.model_id): r.margin for r in got}
    # p2 lacks y and z: such splits go left
    assert margins == pytest.approx(
        {("p1", "a"): 0.75, ("p1", "b"): 8.4, ("p1", "c"): 1.6, ("p2", "a"): -1.25, ("p2", "b"): 0.4, ("p2", "c"): 1.4}
    )
    assert got[0].score == pytest.approx(1 / (1 + math.exp(-got[0].margin)), abs=1e-8)


@pytest.mark.parametrize("combine,factor", [("sum", 1.0), ("mean", 1 / 3)])
def test_global_margin_is_sum_of_local_margins(spark, toys, combine, factor):
    model, tree_node = toys
    merged, head = fo.merge_trees(model, tree_node), fo.global_header(model, combine=combine)
    vectors = fo.sample_vectors(samples(spark), tree_node)
    local = fo.predict_trees(vectors, tree_node, model).groupBy("sample_id").agg(F.sum("margin").alias("m")).collect()
    glob = {r.sample_id: r.margin for r in fo.predict_trees(vectors, merged, head).collect()}
    assert glob == pytest.approx({r.sample_id: r.m * factor for r in local})


def test_documents_are_json_and_come_back(spark, toys, tmp_path):
    model, tree_node = toys
    mo.export_tree_model(model, tree_node, str(tmp_path / "json"))
    files = sorted((tmp_path / "json").glob("model_id=*/*.txt"))
    assert len(files) == 3
    doc = json.loads(files[2].read_text())["learner"]
    booster = doc["gradient_booster"]["model"]
    assert booster["gbtree_model_param"]["num_trees"] == "3" and booster["iteration_indptr"] == [0, 1, 2, 3]
    assert [t["id"] for t in booster["trees"]] == [0, 1, 2] and doc["feature_names"] == ["x", "y", "z"]
    want = sorted(map(str, tree_node.collect()))
    back_model, back = mo.import_tree_model(spark, str(tmp_path / "json"))
    assert sorted(map(str, back.select(*tree_node.columns).collect())) == want
    lines = mo.import_tree_lines(spark, str(tmp_path / "json"))
    assert sorted(map(str, lines.select(*tree_node.columns).collect())) == want
    assert {(r.model_id, r.n_trees, r.base_margin) for r in back_model.collect()} == {("a", 2, 0.0), ("b", 2, 0.0), ("c", 3, 0.0)}


def test_foreign_document_with_breadth_first_nodes(spark, tmp_path):
    tree = {
        "id": 0, "tree_param": {"num_nodes": "5", "num_feature": "2"}, "left_children": [1, -1, 3, -1, -1],
        "right_children": [2, -1, 4, -1, -1], "parents": [2147483647, 0, 0, 2, 2], "split_indices": [1, 0, 0, 0, 0],
        "split_conditions": [0.5, -1.0, 0.25, 2.0, 3.0], "default_left": [1, 0, 0, 0, 0],
        "loss_changes": [4.0, 0.0, 1.0, 0.0, 0.0], "sum_hessian": [9.0, 4.0, 5.0, 2.0, 3.0],
    }
    booster = {"gbtree_model_param": {"num_trees": "1", "num_parallel_tree": "1"}, "trees": [tree], "tree_info": [0]}
    doc = {"learner": {"feature_names": ["f", "g"], "learner_model_param": {"base_score": "5E-1", "num_feature": "2"},
                       "gradient_booster": {"model": booster, "name": "gbtree"}}}
    (tmp_path / "XGB_train_set_one.json").write_text(json.dumps(doc))
    model, nodes = mo.import_tree_model(spark, str(tmp_path))
    assert model.first().model_id == "XGB_train_set_one"
    got = {r.node_id: (r.feature, r.threshold, r.leaf_value) for r in nodes.collect()}
    assert got == {0: ("g", 0.5, None), 1: (None, None, -1.0), 2: ("f", 0.25, None), 3: (None, None, 2.0), 4: (None, None, 3.0)}


def document(trees, base="5E-1", names=("f", "g")):
    booster = {"gbtree_model_param": {"num_parallel_tree": "1", "num_trees": str(len(trees))}, "tree_info": [0] * len(trees),
               "trees": trees}
    return {"learner": {"feature_names": list(names), "gradient_booster": {"model": booster, "name": "gbtree"},
                        "learner_model_param": {"base_score": base, "num_feature": str(len(names))}}}


def chain(depth, tree=0):
    """A tree whose right children split again, ``depth`` levels deep; fields sorted."""
    left, right, parents, cuts = [-1] * (2 * depth + 1), [-1] * (2 * depth + 1), [2147483647] + [0] * (2 * depth), []
    for i in range(depth):
        at = 2 * i
        left[at], right[at] = at + 1, at + 2
        parents[at + 1] = parents[at + 2] = at
    cuts = [float(i // 2) if left[i] >= 0 else float(i) for i in range(2 * depth + 1)]
    size = 2 * depth + 1
    return {"default_left": [0] * size, "id": tree, "left_children": left, "loss_changes": [0.0] * size, "parents": parents,
            "right_children": right, "split_conditions": cuts, "split_indices": [0] * size, "sum_hessian": [1.0] * size,
            "tree_param": {"num_deleted": "0", "num_feature": "2", "num_nodes": str(size)}}


@pytest.mark.parametrize("indent", [None, 2])
def test_deep_trees_in_documents_of_any_layout(spark, tmp_path, indent):
    names = ("a]b", 'c"d{')
    (tmp_path / "deep.json").write_text(json.dumps(document([chain(40), chain(2, 1)], "[5E-1]", names), indent=indent))
    model, nodes = mo.import_tree_model(spark, str(tmp_path))
    assert model.first().base_margin == 0.0
    lines = mo.import_tree_lines(spark, str(tmp_path))
    assert sorted(map(str, lines.collect())) == sorted(map(str, nodes.collect()))
    assert nodes.count() == 81 + 5 and nodes.filter("feature = 'a]b'").count() == 42
    rows = [("v", "low", "a]b", -1.0), ("v", "mid", "a]b", 20.5), ("v", "high", "a]b", 99.0), ("v", "none", "other", 1.0)]
    scores = spark.createDataFrame(rows, "study string, sample_id string, signature string, score double")
    got = fo.predict_trees(fo.sample_vectors(scores, nodes), nodes, model).collect()
    # a value goes left at the first cut above it; an absent one follows the default, right
    assert {r.sample_id: r.margin for r in got} == {"low": 1.0 + 1.0, "mid": 43.0 + 4.0, "high": 80.0 + 4.0, "none": 80.0 + 4.0}
    row = fo.model_summary(model, nodes).first()
    assert row.max_depth == 40 and row.eta is None and row.tree_method is None


def test_documents_without_names_and_with_deleted_nodes(spark, tmp_path):
    tree = chain(1)
    for field, value in (("left_children", -1), ("right_children", -1), ("parents", 2147483647), ("default_left", 0),
                         ("loss_changes", 0.0), ("split_conditions", 7.0), ("split_indices", 0), ("sum_hessian", 0.0)):
        tree[field] = tree[field] + [value]
    (tmp_path / "one.json").write_text(json.dumps(document([tree], names=())))
    for nodes in (mo.import_tree_model(spark, str(tmp_path))[1], mo.import_tree_lines(spark, str(tmp_path))):
        assert [(r.node_id, r.feature) for r in nodes.orderBy("node_id").collect()] == [(0, "f0"), (1, None), (2, None)]


def test_documents_that_are_no_tree_models_fail(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"learner": {}}')
    with pytest.raises(Exception, match="no tree model in document"):
        mo.import_tree_model(spark, str(tmp_path))[0].collect()
    first = chain(1)
    odd = {"tree_param": first.pop("tree_param"), **first}
    (tmp_path / "bad.json").write_text(json.dumps(document([odd])))
    with pytest.raises(Exception, match="not understood"):
        mo.import_tree_lines(spark, str(tmp_path)).collect()


def test_unknown_fields_pass_through_import_merge_and_export(spark, tmp_path):
    for i, name in enumerate(("a", "b")):
        made = document([chain(2)])
        made["version"] = [3, 1, 4]
        made["learner"]["attributes"] = {"best_iteration": str(i), "note": 'a "quoted" {note}'}
        made["learner"]["learner_model_param"]["num_target"] = "1"
        made["learner"]["gradient_booster"]["tree_train_param"] = {"eta": f"0.{i + 1}", "lambda": "2", "alpha": "0.5", "max_depth": "7"}
        made["learner"]["gradient_booster"]["gbtree_train_param"] = {"tree_method": "approx"}
        made["learner"]["gradient_booster"]["model"]["gbtree_model_param"]["num_parallel_tree"] = "3"
        made["learner"]["gradient_booster"]["model"]["cats"] = {"enc": [1, 2]}
        (tmp_path / f"{name}.json").write_text(json.dumps(made))
    local, nodes = mo.import_tree_model(spark, str(tmp_path))
    summary = {r.model_id: r for r in fo.model_summary(local, nodes).collect()}
    assert [(summary[m].eta, summary[m].reg_lambda, summary[m].reg_alpha, summary[m].max_depth) for m in "ab"] == [(0.1, 2.0, 0.5, 7), (0.2, 2.0, 0.5, 7)]
    assert summary["a"].tree_method == "approx" and summary["a"].num_parallel_tree == 3
    out = str(tmp_path / "global")
    mo.export_tree_model(fo.global_header(local), fo.merge_trees(local, nodes), out)
    text = "".join(r.value for r in spark.read.option("recursiveFileLookup", "true").text(out, wholetext=True).collect())
    made = json.loads(text)
    learner = made["learner"]
    booster = learner["gradient_booster"]
    assert made["version"] == [3, 1, 4] and learner["attributes"] == {"best_iteration": "0", "note": 'a "quoted" {note}'}
    assert learner["learner_model_param"]["num_target"] == "1" and booster["tree_train_param"]["eta"] == "0.1"
    assert booster["model"]["cats"] == {"enc": [1, 2]} and booster["model"]["gbtree_model_param"] == {"num_trees": "2", "num_parallel_tree": "3"}
    assert [t["id"] for t in booster["model"]["trees"]] == [0, 1] and booster["model"]["tree_info"] == [0, 0]


def test_documents_merge_and_predict(spark, toys, tmp_path):
    mo.export_tree_model(*toys, str(tmp_path / "local"))
    local, nodes = mo.import_tree_model(spark, str(tmp_path / "local"))
    mo.export_tree_model(fo.global_header(local), fo.merge_trees(local, nodes), str(tmp_path / "global"))
    head, merged = mo.import_tree_model(spark, str(tmp_path / "global"))
    got = fo.predict_trees(fo.sample_vectors(samples(spark), merged), merged, head).collect()
    assert {r.sample_id: r.margin for r in got} == pytest.approx({"p1": 10.75, "p2": 0.55})


@pytest.mark.parametrize("max_chunks", [64, 0])
def test_every_sample_and_model_is_predicted(spark, toys, max_chunks):
    model, tree_node = toys
    leaf = spark.createDataFrame([("leaf", 0, 0, None, None, None, None, True, 0.3, None, 2.0)], NODE)
    heads = [("leaf", "leaf", 0, 0.5, 1), ("bare", "bare", 0, -2.0, 0)]
    more = spark.createDataFrame(heads, model.schema)
    rows = [("v", "p3", "other", 1.0), ("v", "p4", "x", None)]
    scores = samples(spark).unionByName(spark.createDataFrame(rows, samples(spark).schema))
    every, nodes = model.unionByName(more), tree_node.unionByName(leaf)
    got = fo.predict_trees(fo.sample_vectors(scores, nodes), nodes, every, max_chunks=max_chunks).collect()
    margins = {(r.sample_id, r.model_id): r.margin for r in got}
    assert len(got) == 4 * 5
    assert all(margins[p, "leaf"] == 0.8 and margins[p, "bare"] == -2.0 for p in ("p1", "p2", "p3", "p4"))
    for p in ("p3", "p4"):  # nothing known: every split goes left
        assert [margins[p, m] for m in "abc"] == pytest.approx([-1.25, 0.2, 0.8])
    alone = fo.predict_trees(fo.sample_vectors(scores, leaf), leaf, more, max_chunks=max_chunks).collect()
    assert sorted((r.sample_id, r.margin) for r in alone) == sorted((p, m) for p in ("p1", "p2", "p3", "p4") for m in (0.8, -2.0))


def test_shared_tables_refuse_patient_keys(spark):
    df = spark.createDataFrame([("s", "p", 1.0)], "study string, sample_id string, auc double")
    with pytest.raises(ValueError, match="patient keys"):
        cl.assert_shareable(df)
    assert cl.assert_shareable(cl.strip_patient_ids(df)).columns == ["study", "auc"]


def test_cohort_names(spark):
    rows = [("data/x/ICB_Gide__Melanoma__PD-(L)1.rda",), ("S2__Lung__IO+combo.rda",), ("only.rda",)]
    got = co.parse_cohort_name(spark.createDataFrame(rows, "path string")).collect()
    assert [(r.study, r.cancer, r.treatment) for r in got] == [
        ("ICB_Gide", "Melanoma", "PD-(L)1"), ("S2", "Lung", "IO+combo"), ("only", None, None)
    ]


def test_absent_features_are_filled_and_missing_values_stay(spark):
    rows = [("v", "p", "x", None), ("v", "q", "x", 1.0), ("w", "r", "y", 2.0)]
    scores = spark.createDataFrame(rows, "study string, sample_id string, signature string, score double")
    listed = spark.createDataFrame([("m", "x"), ("m", "y")], "model_id string, feature string")
    got = {(r.sample_id, r.feature): r.value for r in ft.align_features(scores, listed).collect()}
    assert got == {("p", "x"): None, ("p", "y"): 0.0, ("q", "x"): 1.0, ("q", "y"): 0.0, ("r", "x"): 0.0, ("r", "y"): 2.0}
    features = spark.createDataFrame([(["x", "y"],)], "features array<string>")
    vectors = spark.createDataFrame([("v", "p", [None, None]), ("w", "r", [None, 2.0])], "study string, sample_id string, x array<double>")
    filled = {r.sample_id: r.x for r in ft.fill_absent(vectors, scores, features, 9.0).collect()}
    assert filled == {"p": [None, 9.0], "r": [9.0, 2.0]}


def brute_leaf(nodes, x, depth):
    """The leaf one sample reaches, NULL as None, NaN above any number."""
    at = 0
    for _ in range(depth + 1):
        node = nodes[at] if at is not None and 0 <= at < len(nodes) else None
        if node is None:
            return None
        if node["left"] is None:
            break
        f = node["at"] or 0
        v = x[f] if x is not None and f < len(x) else None
        t = node["threshold"]
        if v is None:
            left = node["default_left"]
        else:
            left = t is not None and (v < t or (math.isnan(t) and not math.isnan(v)))
        at = node["left"] if left else node["right"]
    node = nodes[at] if at is not None and 0 <= at < len(nodes) else None
    return node and node["leaf"]


def test_leaf_sums_equal_walking_each_tree_alone():
    rng = random.Random(3)
    nan = float("nan")

    def grown(height):
        if height == 0 or rng.random() < 0.2:
            return [dict(at=None, threshold=None, left=None, right=None, default_left=True, leaf=rng.choice([rng.gauss(0, 1)] * 30 + [None]))]
        low, high = grown(height - 1), grown(height - 1)
        for part, by in ((low, 1), (high, 1 + len(low))):
            for n in part:
                n.update({c: n[c] + by for c in ("left", "right") if n[c] is not None})
        cut = rng.choice([rng.gauss(0, 1)] * 8 + [nan, None])
        right = rng.choice([1 + len(low)] * 12 + [None, 99])
        top = dict(at=rng.choice([0, 1, 2, 7, None]), threshold=cut, left=1, right=right, default_left=rng.choice([True, False, None]), leaf=None)
        return [top, *low, *high]

    x = [[rng.choice([rng.gauss(0, 1), None, nan]) for _ in range(3)] for _ in range(60)] + [None, [], [0.1]]
    node = pa.struct([("at", pa.int32()), ("threshold", pa.float64()), ("left", pa.int32()), ("right", pa.int32()), ("default_left", pa.bool_()), ("leaf", pa.float64())])
    known = 0
    for n in [1] * 20 + [3] * 10:
        trees = [dict(depth=4, nodes=grown(4)) for _ in range(n)]
        got = fo.leaf_sums(pa.array(x, pa.list_(pa.float64())), pa.array(trees, pa.struct([("depth", pa.int32()), ("nodes", pa.list_(node))]))).to_pylist()
        for have, row in zip(got, x, strict=True):
            leaves = [brute_leaf(t["nodes"], row, 4) for t in trees]
            assert have == (None if None in leaves else pytest.approx(sum(leaves)))
            known += have is not None
    assert 200 < known < 30 * len(x)


def test_trees_come_once_per_block_of_samples(spark, toys):
    """A row that meets the trees holds many samples; a sample with a block to itself is predicted alike."""
    model, tree_node = toys
    rows = [("v", f"p{i}", f, (i * k % 7) / 3.0) for i in range(40) for k, f in enumerate("xyz", 1)]
    scores = spark.createDataFrame(rows, "study string, sample_id string, signature string, score double").coalesce(1)
    vectors = fo.sample_vectors(scores, tree_node).coalesce(1)
    sizes = [len(r.rows) for r in fo.sample_blocks(vectors).collect()]
    assert sum(sizes) == 40 and len(sizes) == 1
    whole = {(r.sample_id, r.model_id): r.margin for r in fo.predict_trees(vectors, tree_node, model).collect()}
    alone = {(r.sample_id, r.model_id): r.margin for r in fo.predict_trees(vectors.repartition(40, "sample_id"), tree_node, model).collect()}
    assert len(whole) == 120 and whole == alone


def test_repeated_feature_of_a_sample_is_refused(spark, toys):
    rows = [("v", "p1", "x", 0.7), ("v", "p1", "x", 0.9), ("v", "p1", "y", 0.1)]
    scores = spark.createDataFrame(rows, "study string, sample_id string, signature string, score double")
    with pytest.raises(Exception, match="(?i)duplicate"):
        fo.sample_vectors(scores, toys[1]).collect()
