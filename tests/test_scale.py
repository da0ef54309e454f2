"""Running sums, quantiles and joins on skewed groups, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import scale


def skewed_rows(seed, n=3000):
    """One key holds most rows, one value most of its rows."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        key = "hot" if rng.random() < 0.8 else rng.choice("abc")
        value = 0.0 if rng.random() < 0.4 else round(rng.gauss(0, 1) ** 3, 3)
        rows.append((key, value))
    return rows


@pytest.mark.parametrize("seed,buckets", [(1, 4), (2, 64)])
def test_cumulative_equals_sorting(spark, seed, buckets):
    rows = skewed_rows(seed)
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {
        (r.k, r.v): (r.before_n, r.total_n, r.previous)
        for r in scale.cumulative(df, ["k"], "v", ["n"], buckets).collect()
    }
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        distinct = sorted(set(values))
        for i, v in enumerate(distinct):
            below = sum(x < v for x in values)
            assert got[key, v] == (below, len(values), distinct[i - 1] if i else None)


def test_cumulative_splits_a_hot_key(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    sizes = scale.bucketed(df, ["k"], "v", 64).groupBy("_bucket").count().agg(F.count("*"), F.max("count")).first()
    assert sizes[0] > 40 and sizes[1] < 20_000 / 20


def test_exact_quantiles(spark):
    rows = skewed_rows(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = scale.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares, 8).collect()
    assert len(got) == 4 * len(shares)
    for r in got:
        want = np.quantile([v for k, v in rows if k == r.k], r.share)
        assert r.cut == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(spark, how):
    rows = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(skewed_rows(3, 500))], "k string, v double, i int")
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("zz", 3)], "k string, w int")
    small = scale.attach(rows, lookup, ["k"], how)
    salted = scale.attach(rows, lookup, ["k"], how, max_rows=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, salted.collect()))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_salts_spread_a_hot_key(spark):
    rows = spark.range(10_000).select(F.lit("hot").alias("k"), "id")
    counts = rows.groupBy(scale.salt_by_row(rows, ["k"], 32).alias("s")).count().agg(F.count("*"), F.max("count")).first()
    assert counts[0] == 32 and counts[1] < 2 * 10_000 / 32


def test_large_lookup_is_not_broadcast(spark):
    rows = spark.range(100).withColumnRenamed("id", "k").withColumn("x", F.lit(1))
    lookup = spark.range(5000).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(1))).alias("w"))
    joined = scale.attach(rows, lookup, ["k"], max_rows=0)
    assert joined.count() == 100 and "_salt" not in joined.columns


def test_buckets_count_the_edges_below(spark):
    rng = random.Random(9)
    values = [rng.choice([rng.gauss(0, 3), 0.0, float("nan"), None]) for _ in range(500)]
    rows = spark.createDataFrame([("k", v) for v in values] + [("none", None)], "k string, v double")
    got = scale.bucketed(rows, ["k"], "v", 16)
    edges = rows.filter("k = 'k'").agg(F.array_distinct(F.percentile_approx("v", [i / 16 for i in range(1, 16)], 64)).alias("e")).first().e
    above = lambda v, e: v is not None and not math.isnan(e) and (math.isnan(v) or e < v)
    for r in got.filter("k = 'k'").collect():
        assert r._bucket == sum(above(r.v, e) for e in edges)
    assert got.count() == 501
