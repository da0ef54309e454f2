"""Curves, areas, intervals and fits on small and random inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import bootstrap as bs
from cohortloom.operators import logit as lo
from cohortloom.operators import roc


def frame(spark, rows):
    full = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "study string, model_id string, label int, score double, sample_id int")


def random_rows(seed, n=400, study="s"):
    rng = random.Random(seed)
    return [(study, "m", y := int(rng.random() < 0.4), round(rng.gauss(0.6 * y, 1), 1)) for _ in range(n)]


def brute_auc(rows):
    pos, neg = [r[3] for r in rows if r[2] == 1], [r[3] for r in rows if r[2] == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rows = [("s", "m", 1, 2.0), ("s", "m", 1, 1.0), ("s", "m", 0, 1.0), ("s", "m", 0, 0.0)]
    assert roc.auc(roc.ranked_counts(frame(spark, rows))).first().auc == 0.875


def test_auc_properties(spark):
    rows = random_rows(1)
    auc = lambda r: roc.auc(roc.ranked_counts(frame(spark, r), buckets=8)).first().auc
    a = auc(rows)
    assert a == pytest.approx(brute_auc(rows))
    assert auc([(s, m, y, -x) for s, m, y, x in rows]) == pytest.approx(1 - a)
    assert auc([(s, m, y, x**3) for s, m, y, x in rows]) == pytest.approx(a, abs=1e-9)


def test_single_class_gives_null(spark):
    ranked = roc.ranked_counts(frame(spark, [("s", "m", 0, 1.0), ("s", "m", 0, 2.0)]))
    assert roc.auc(ranked).first().auc is None
    assert roc.youden_threshold(ranked).count() == 0
    assert all(r.sens is None for r in roc.roc_curve(ranked).collect())


def test_curve_is_monotone_and_anchored(spark):
    points = roc.roc_curve(roc.ranked_counts(frame(spark, random_rows(2)), buckets=4)).orderBy("threshold").collect()
    assert (points[0].sens, points[0].spec) == (1.0, 0.0)
    assert (points[-1].sens, points[-1].spec, points[-1].threshold) == (0.0, 1.0, float("inf"))
    assert all(a.sens >= b.sens and a.spec <= b.spec for a, b in zip(points, points[1:]))


def test_youden_infinite_when_useless(spark):
    rows = [("s", "m", 1, 1.0), ("s", "m", 0, 1.0)]
    r = roc.youden_threshold(roc.ranked_counts(frame(spark, rows))).first()
    assert r.sens_plus_spec == 1.0 and np.isnan(r.threshold)  # mean of -inf and +inf
    rows = [("s", "m", 1, 3.0), ("s", "m", 0, 1.0)]
    assert roc.youden_threshold(roc.ranked_counts(frame(spark, rows))).first().threshold == 2.0


def test_grid_has_every_point_once(spark):
    rows = random_rows(3, 90)
    ranked = roc.ranked_counts(frame(spark, rows), buckets=8)
    grid = roc.roc_interpolate(ranked).orderBy("i").collect()
    assert [r.i for r in grid] == list(range(150))
    curve = sorted({(r.spec, r.sens) for r in roc.roc_curve(ranked).collect()})
    levels = sorted({s for s, _ in curve})
    for r in grid:
        at = [t for s, t in curve if abs(s - r.spec) < 1e-12]
        if at:
            assert r.sens == pytest.approx(max(at))
        else:
            a, b = max(s for s in levels if s < r.spec), min(s for s in levels if s > r.spec)
            lo_, hi = min(t for s, t in curve if s == a), max(t for s, t in curve if s == b)
            assert r.sens == pytest.approx(lo_ + (r.spec - a) / (b - a) * (hi - lo_))


def test_close_scores_do_not_tie(spark):
    rows = [("s", "m", int(i >= 50), 0.5 + i * 1e-10) for i in range(100)]
    assert roc.auc(roc.ranked_counts(frame(spark, rows))).first().auc == 1.0
    rows = [("s", "m", 0, -0.0), ("s", "m", 1, 0.0)]
    assert roc.auc(roc.ranked_counts(frame(spark, rows))).first().auc == 0.5


@pytest.mark.parametrize("least", [2, 6])
def test_bootstrap_brackets_auc_and_like_redrawn_samples(spark, monkeypatch, least):
    monkeypatch.setattr(bs, "LEAST", least)  # several blocks
    monkeypatch.setattr(bs, "BLOCKS", 64 if least == 2 else 4096)
    rows = random_rows(4, 120)
    per = [r.auc for r in bs.bootstrap_auc(frame(spark, rows), 400, buckets=4).collect()]
    ci = bs.bootstrap_auc_ci(frame(spark, rows), 400, buckets=4).first()
    assert len(per) == ci.n == 400 and ci.low <= ci.mid <= ci.high and ci.low < brute_auc(rows) < ci.high
    draw = np.random.default_rng(1)
    pos, neg = ([r for r in rows if r[2] == y] for y in (1, 0))
    again = [brute_auc([c[i] for c in (pos, neg) for i in draw.integers(0, len(c), len(c))]) for _ in range(400)]
    assert abs(np.mean(per) - np.mean(again)) < 0.02 and abs(np.std(per) - np.std(again)) < 0.01


def test_blocks_change_nothing(spark, monkeypatch):
    rows = frame(spark, random_rows(5, 90))
    one = sorted(r.auc for r in bs.bootstrap_auc(rows, 30).collect())
    monkeypatch.setattr(bs, "LEAST", 1)
    assert sorted(r.auc for r in bs.bootstrap_auc(rows, 30).collect()) == one


def test_draws_keep_their_sum():
    counts = np.random.default_rng(2).integers(0, 4, 64)
    before = np.concatenate([[0], np.cumsum(counts)])
    out = bs.split(np.full(50, counts.sum()), before, "x", np.arange(50), 6, 0, 6)
    assert (out.sum(1) == counts.sum()).all() and (out[:, counts == 0] == 0).all()
    assert np.allclose(out.mean(0), counts, atol=1.2)


@pytest.mark.parametrize("n, p", [(1, 0.5), (12, 0.3), (40, 0.9), (10_000, 0.0004), (1000, 0.37), (10**6, 0.75)])
def test_binomials(n, p):
    u, v = bs.uniforms([f"{n}|{p}|{i}" for i in range(20_000)])
    k = bs.binomials(np.full(20_000, n), np.full(20_000, p), u, v)
    sd = (n * p * (1 - p)) ** 0.5
    assert k.min() >= 0 and k.max() <= n
    assert abs(k.mean() - n * p) < 5 * sd / 20_000**0.5 and abs(k.std() / sd - 1) < 0.03


def test_logit_matches_spark_glm(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = frame(spark, random_rows(6))
    b = lo.fit_logit(df, 10).first()
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="label").fit(
        VectorAssembler(inputCols=["score"], outputCol="features").transform(df)
    )
    assert b.b0 == pytest.approx(glm.intercept, abs=1e-6)
    assert b.b1 == pytest.approx(glm.coefficients[0], abs=1e-6)


def test_plans_have_no_products_of_tables(spark):
    df = frame(spark, random_rows(7))
    ranked = roc.ranked_counts(df)
    for out in (roc.auc(ranked), roc.roc_interpolate(ranked), bs.bootstrap_auc_ci(df, 3)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_draws_of_one_key_are_dealt_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(bs, "LEAST", 2)
    counted = roc.score_counts(frame(spark, random_rows(6, 200))).withColumn("one", F.lit(1))
    blocks = bs._blocks(roc.cumulative(counted, roc.KEYS, "score", ["pos", "neg", "one"], 4), roc.KEYS)
    dealt = bs._dealt(blocks, roc.KEYS, 300).withColumn("task", F.spark_partition_id())
    n = blocks.count()
    parts = dealt.groupBy("block").agg(F.sum(F.size("draws_pos")).alias("n"), F.count_distinct("task").alias("tasks")).collect()
    assert len(parts) == n > 1 and all(r.n == 300 and r.tasks > 1 for r in parts)
