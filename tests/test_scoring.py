"""Scores against hand results and direct definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import normal_cdf
from cohortloom.operators import scoring as sc


def expression(spark, table):
    rows = [(s, p, g, float(v)) for (s, p), cells in table.items() for g, v in cells.items()]
    return spark.createDataFrame(rows, "study string, sample_id string, gene_id string, value double")


def gene_set(spark, genes, weights=None):
    rows = [("S", "", g, float((weights or {}).get(g, 1.0)), "") for g in genes]
    return spark.createDataFrame(rows, "signature string, sub_signature string, gene_id string, weight double, grp string")


def test_ssgsea_by_hand(spark):
    # ranks a4 b3 c2 d1 for p1; the set {a, c} has weights 4^.25 and 2^.25
    e = expression(spark, {("s", "p1"): dict(a=9, b=5, c=3, d=1), ("s", "p2"): dict(a=1, b=5, c=3, d=9)})
    got = {r.sample_id: r.score for r in sc.ssgsea(e, gene_set(spark, "ac")).collect()}

    def raw(order):
        w = {g: (4 - i) ** 0.25 for i, g in enumerate(order)}
        total = w["a"] + w["c"]
        hit = miss = out = 0.0
        for g in order:
            hit += w[g] / total if g in "ac" else 0
            miss += 0 if g in "ac" else 0.5
            out += hit - miss
        return out

    r1, r2 = raw("abcd"), raw("dbca")
    assert got["p1"] == pytest.approx(r1 / abs(r1 - r2))
    assert got["p2"] == pytest.approx(r2 / abs(r1 - r2))


def test_normal_cdf(spark):
    zs = [-9.0, -3.3, -1.0, -1e-6, 0.0, 0.4, 2.5, 6.9, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=2e-15)


def test_kernel_shares_equal_pairwise_sums(spark):
    rng = random.Random(4)
    values = {"g1": [rng.gauss(0, 2) for _ in range(80)], "g2": [rng.choice([0.0, 0.0, 1.5, 40.0]) for _ in range(80)]}
    e = expression(spark, {("s", f"p{i}"): {g: v[i] for g, v in values.items()} for i in range(80)})
    got = sc.kernel_shares(e).collect()
    assert len(got) == 160
    for r in got:
        v = values[r.gene_id]
        mean = sum(v) / 80
        h = math.sqrt(sum((x - mean) ** 2 for x in v) / 79) / 4
        want = sum(0.5 * math.erfc(-(r.value - x) / h / math.sqrt(2)) for x in v) / 80
        assert r.f == pytest.approx(want, abs=2e-9)


def test_gsva_walk(spark):
    rng = random.Random(9)
    genes = [f"g{i:02d}" for i in range(12)]
    table = {("s", f"p{j}"): {g: rng.randint(0, 4) for g in genes} for j in range(20)}
    members = set(genes[::3])
    got = {r.sample_id: r.score for r in sc.gsva(expression(spark, table), gene_set(spark, members)).collect()}
    for (_, sample), cells in table.items():
        f = {g: sum(c[g] <= cells[g] for c in table.values()) / 20 for g in genes}
        order = sorted(genes, key=lambda g: (-round(f[g], 9), g))
        r = {g: abs(6 - (i + 1)) for i, g in enumerate(order)}
        total, nu, walk = sum(r[g] for g in members), 0.0, []
        for g in order:
            nu += r[g] / total if g in members else -1 / (12 - len(members))
            walk.append(nu)
        assert got[sample] == pytest.approx(max(0, max(walk)) + min(0, min(walk)))


def test_scores_ignore_row_order_and_partitions(spark):
    rng = random.Random(2)
    table = {("s", f"p{j}"): {f"g{i}": rng.random() for i in range(8)} for j in range(16)}
    e, sets = expression(spark, table), gene_set(spark, ["g1", "g4"])
    for scorer in (sc.ssgsea, sc.gsva, sc.weighted_mean):
        a = {r.sample_id: round(r.score, 9) for r in scorer(e, sets).collect()}
        b = {r.sample_id: round(r.score, 9) for r in scorer(e.repartition(7, "value"), sets).collect()}
        assert a == b


def test_gate_borders_are_strict(spark):
    e = expression(spark, {("s", f"p{i}"): {"a": math.log2(0.001) if i < 2 else 1.0, "b": 1.0} for i in range(4)})
    assert {r.gene_id for r in sc.gene_missing_filter(e, 0.5).collect()} == {"a", "b"}
    assert {r.gene_id for r in sc.gene_missing_filter(e, 0.49).collect()} == {"b"}
    genes = spark.createDataFrame([("s", g) for g in "abcd"], "study string, gene_id string")
    assert sc.signature_coverage_gate(gene_set(spark, "abcde"), genes, 0.8).count() == 0
    assert sc.signature_coverage_gate(gene_set(spark, "abcde"), genes, 0.79).count() == 1


def brute_walks(cells, sets):
    """GSVA deviations and raw ssGSEA scores of one sample: ``cells`` are (gene, by), ``sets`` name -> genes."""
    order = sorted(cells, key=lambda c: (-c[1], c[0]))
    p, out = len(order), {}
    for name, genes in sets.items():
        pos = [i for i, (g, _) in enumerate(order, 1) for _ in range(genes.count(g))]
        m, r = len(pos), [abs(p / 2 - i) for i in pos]
        if not 0 < m < p:
            continue
        ups = [sum(r[: k + 1]) / sum(r) - (pos[k] - k - 1) / (p - m) for k in range(m)] if sum(r) else None
        downs = [sum(r[:k]) / sum(r) - (pos[k] - k - 1) / (p - m) for k in range(m)] if sum(r) else None
        rank = [p - i + 1 for i in pos]
        raw = sum(x**1.25 for x in rank) / sum(x**0.25 for x in rank) - (p * (p + 1) / 2 - sum(rank)) / (p - m)
        out[name] = (max(0, *ups) + min(0, *downs) if ups else None, raw)
    return out


def test_walks_over_arrow_batches_equal_each_sample_alone(spark):
    """Samples run on from batch to batch, names repeat between studies, one is missing, one set lists a gene twice."""
    rng = random.Random(8)
    table = {(s, p): [(f"g{i}", float(rng.randrange(6))) for i in range(rng.randrange(3, 14))] for s in "ab" for p in ("p1", "p2", "p3", None)}
    rows = [(s, p, g, v) for (s, p), cells in table.items() for g, v in cells]
    e = spark.createDataFrame(rows, "study string, sample_id string, gene_id string, value double")
    sets = {"S": ["g0", "g2", "g7"], "T": ["g1", "g1", "g2", "x"]}
    members = spark.createDataFrame([(n, "", g, 1.0, "") for n, genes in sets.items() for g in genes], "signature string, sub_signature string, gene_id string, weight double, grp string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for at, scorer in enumerate((sc._deviation, None)):
            got = sc.walk_sets(e, members.withColumn("sub_signature", F.lit(None).cast("string")), "value", scorer).collect() if scorer else sc.ssgsea(e, members).collect()
            want = {(*key, n): v[at] for key, cells in table.items() for n, v in brute_walks(cells, sets).items() if v[at] is not None}
            if not scorer:
                span = {(s, n): max(x := [v for k, v in want.items() if k[0] == s and k[2] == n]) - min(x) for s, _, n in want}
                want = {k: v / span[k[0], k[2]] for k, v in want.items()}
            assert len(got) == len(want) and {(r.study, r.sample_id, r.signature): r.score for r in got} == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rank_scores_sort_each_cell_once_and_stay_where_they_are(spark):
    """No window over members; the cells are never the broadcast side of the join with their shares."""
    e = sc.keep(expression(spark, {("s", f"p{i}"): dict(a=i, b=5 - i, c=3, d=1) for i in range(6)}))
    sets = sc.keep(gene_set(spark, "ac"))
    for scores in (sc.gsva(e, sets), sc.walk_sets(e, sets, "value", sc._deviation)):
        plan = scores._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("RepartitionByExpression") == 1
    plan = sc.value_shares(e)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan
