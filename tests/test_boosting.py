"""Training: every stage against SQL on one shared run, and self-consistency."""

import pytest
from pyspark.sql import functions as F

from cohortloom.catalog import models as m
from cohortloom.catalog.scoring import r6
from cohortloom.operators import boosting as bo
from cohortloom.operators import forest as fo
from cohortloom.operators import roc
from cohortloom.operators.scale import keep
from cohortloom.plans import derived as d
from compare import differences
import __spark_entry__ as contract


@pytest.fixture(scope="module")
def run(spark, sf):
    samples, lists, grid, nodes, margins = m.trained(spark, sf)
    return samples, lists, keep(grid), keep(nodes), keep(margins)


def same(df, duck, name):
    diff, rows = differences(df, duck, contract.oracle_sql()[name])
    assert not diff and rows > 0


def test_nodes_and_margins(run, duck):
    _, _, _, nodes, margins = run
    same(m._nodes(nodes), duck, "grow_trees")
    same(r6(margins.select("study", "config_id", "nrounds", "sample_id", "margin"), "margin"), duck, "train_per_study")


def test_search_and_chosen_models(run, duck):
    _, _, grid, nodes, margins = run
    aucs = keep(bo.grid_auc(margins, grid))
    same(r6(aucs, "auc"), duck, "grid_auc")
    best = keep(bo.select_best(aucs, grid))
    same(r6(best, "auc"), duck, "select_best")
    nodes, last = bo.chosen_models(nodes, margins, best, grid)
    nodes = keep(nodes)
    same(m._nodes(nodes), duck, "refit_best")
    importance = bo.feature_importance(nodes, ("study",))
    same(r6(importance, "gain", "cover", "frequency"), duck, "feature_importance")
    for r in importance.groupBy("study").agg(F.sum("gain").alias("g"), F.sum("frequency").alias("f")).collect():
        assert r.g == pytest.approx(1) and r.f == pytest.approx(1)
    predictions = last.withColumn("score", F.round(bo.sigmoid(F.col("margin")), 9)).withColumnRenamed("config_id", "model_id")
    summary = bo.train_summary(best, roc.youden_threshold(roc.ranked_counts(predictions))).drop("reported_at")
    same(summary, duck, "train_summary")


SMALL = bo.GRID | {"nrounds": [1, 2], "eta": [0.1, 0.3], "max_depth": [1, 2], "gamma": [0.0], "colsample": [0.6], "subsample": [0.8]}


def plain_rows(nodes):
    return sorted(map(str, r6(nodes.select(*m.NODE_COLUMNS), "leaf_value", "gain", "cover").collect()))


def test_waves_and_refits_change_nothing(spark, sf, run):
    samples, lists, _, _, _ = run
    grid, seeds = keep(bo.param_grid(m.studies(spark, sf), SMALL)), keep(m.seeds(spark, sf))
    nodes, margins = bo.train_per_study(samples, lists, grid, seeds)
    nodes, margins = keep(nodes), keep(margins)
    again, _ = bo.train_per_study(samples, lists, grid, seeds, wave_size=1)
    assert plain_rows(again) == plain_rows(nodes)
    best = keep(bo.select_best(bo.grid_auc(margins, grid), grid))
    chosen, _ = bo.chosen_models(nodes, margins, best, grid)
    refit, _ = bo.refit_best(samples, lists, best, seeds)
    assert plain_rows(chosen) == plain_rows(refit)


def test_a_round_runs_the_same_jobs_whatever_its_number(spark, sf, run):
    samples, lists, _, _, _ = run
    one = bo.distinct_trainings(bo.param_grid(m.studies(spark, sf), SMALL)).filter("config_id = train_id").drop("train_id")
    growth = bo.Growth(samples, bo.training_table(one.withColumn("nrounds", F.lit(5)), lists, m.seeds(spark, sf)), 2, 0.0)
    jobs, sizes = [], []
    for tree in range(4):
        spark.sparkContext.setJobGroup(f"round-{tree}", "a round")
        growth.grow(tree)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"round-{tree}")))
        sizes.append(len(growth.state._jdf.queryExecution().toString()))
    spark.sparkContext.setJobGroup("other", "")
    # the first round meets no file listing of its own kind; later ones are alike
    assert jobs[1] == jobs[2] == jobs[3] and max(sizes) < 1.2 * min(sizes)


def tiny(spark, rows, cuts=(0.5, 1.5, 2.5)):
    """One study with one feature: (value, label, how often)."""
    cells = [(f"{i}-{k}", v, y) for i, (v, y, n) in enumerate(rows) for k in range(n)]
    values = spark.createDataFrame([("s", i, "x", v) for i, v, _ in cells], "study string, sample_id string, feature string, value double")
    labels = spark.createDataFrame([("s", i, y) for i, _, y in cells], "study string, sample_id string, label int")
    at = keep(bo.placed(spark.createDataFrame([("s", "x", list(cuts))], "study string, feature string, cuts array<double>")))
    samples = keep(bo.binned_samples(bo.bin_features(values, at), labels))
    setting = {"nrounds": [1], "eta": [1.0], "max_depth": [1], "gamma": [0.0], "colsample": [1.0], "subsample": [1.0]}
    studies = labels.select("study").distinct()
    grid = bo.distinct_trainings(bo.param_grid(studies, setting)).drop("train_id")
    nodes, _ = bo.grow_trees(samples, bo.training_table(grid, bo.feature_lists(at), bo.study_seeds(studies)), 1, 1)
    return {r.node_id: r for r in nodes.collect()}


@pytest.mark.parametrize("missing_like_low, threshold", [(True, 1.5), (False, 1.5)])
def test_missing_values_go_where_the_gain_is_greater(spark, missing_like_low, threshold):
    rows = [(0.0, 0, 20), (1.0, 0, 20), (2.0, 1, 20), (3.0, 1, 20), (None, 0 if missing_like_low else 1, 20)]
    nodes = tiny(spark, rows)
    root = nodes[0]
    assert (root.default_left, root.threshold, root.feature) == (missing_like_low, threshold, "x")
    # p = 1/2 everywhere: h = 1/4, g = +-1/2 a sample
    left = (60 if missing_like_low else 40, -1)
    assert nodes[1].leaf_value == pytest.approx(-(left[0] * 0.5) / (left[0] * 0.25 + 1))
    assert nodes[1].cover + nodes[2].cover == pytest.approx(root.cover) == pytest.approx(25.0)


def test_only_missing_values_tell_the_classes_apart(spark):
    nodes = tiny(spark, [(0.0, 0, 30), (1.0, 0, 30), (None, 1, 30)])
    assert not nodes[0].default_left and nodes[0].threshold == 1.5  # all known values left, missing ones right


def test_a_feature_without_a_row_is_missing(spark):
    cells = spark.createDataFrame(
        [("s", "a", "x", 1.0), ("s", "a", "y", None), ("s", "b", "y", 2.0)], "study string, sample_id string, feature string, value double"
    )
    cuts = bo.placed(spark.createDataFrame([("s", "x", [0.5]), ("s", "y", [5.0])], "study string, feature string, cuts array<double>"))
    labels = spark.createDataFrame([("s", "a", 1), ("s", "b", 0)], "study string, sample_id string, label int")
    rows = bo.binned_samples(bo.bin_features(cells, cuts), labels).collect()
    assert {r.sample_id: r.bins for r in rows} == {"a": [1, None], "b": [None, 0]}


def test_trees_reproduce_training_margins(spark, sf, run):
    """Walking the exported trees on raw values gives the margins of training."""
    _, _, _, nodes, margins = run
    tag = F.concat("study", F.lit("/"), F.col("config_id").cast("string"))
    nodes = nodes.withColumn("model_id", tag)
    model = nodes.select("model_id").distinct().withColumn("base_margin", F.lit(0.0))
    scores = d.vec_gappy(spark, sf).select(
        "study", "sample_id", F.col("feature").alias("signature"), F.col("value").alias("score")
    )
    predicted = fo.predict_trees(fo.sample_vectors(scores, nodes), nodes, model)
    last = margins.filter(F.col("nrounds") == m.ROUNDS).withColumn("model_id", tag)
    both = predicted.join(last.select("study", "sample_id", "model_id", F.col("margin").alias("want")), ["study", "sample_id", "model_id"])
    assert both.count() == last.count()
    assert both.filter(F.abs(F.col("margin") - F.col("want")) > 1e-9).count() == 0


def test_full_grid_and_its_distinct_trainings(spark):
    one = spark.createDataFrame([("s",)], "study string")
    grid = bo.distinct_trainings(bo.param_grid(one))
    assert grid.count() == 3240
    assert grid.select("train_id").distinct().count() == 135
    first = grid.orderBy("config_id").limit(7).collect()
    assert [r.nrounds for r in first] == [10, 60, 110, 160, 210, 260, 10] and first[6].eta == 0.0825


def test_select_best_takes_first_of_ties(spark):
    aucs = spark.createDataFrame([("s", 3, 0.9), ("s", 2, 0.9), ("s", 1, 0.8)], "study string, config_id int, auc double")
    grid = spark.createDataFrame([("s", i) for i in (1, 2, 3)], "study string, config_id int")
    assert bo.select_best(aucs, grid).first().config_id == 2


def test_sketched_cuts_are_close_to_exact_ones(spark, sf):
    rows = keep(m.vec_features(spark, sf))
    exact, near = bo.bin_cuts(rows, 10), bo.bin_cuts(rows, 10, exact=False).withColumnRenamed("cuts", "near")
    gap = F.array_max(F.zip_with("cuts", "near", lambda a, b: F.abs(a - b)))
    worst = exact.join(near, ["study", "feature"]).agg(F.max(gap), F.count("*")).first()
    assert worst[0] < 0.05 and worst[1] == 5 * 64
