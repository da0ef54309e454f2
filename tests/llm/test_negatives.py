import numpy as np
import pytest

from compare import differences
from cohortloom.llm import negatives as ng
from cohortloom.llm.queries import ORACLE_SQL, op12_hard_negatives

SCHEMA = "id long, label int, vector array<bigint>, anchor boolean, score long, part string, row int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def plain(rows, positives=5, negatives=3, low=50, high=95):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for a, (a_id, a_label, a_vec, anchor) in enumerate(rows):
        if not anchor:
            continue
        scored = [
            (-sum(x * y for x, y in zip(a_vec, v)), i is None, i or 0, i, l == a_label)
            for b, (i, l, v, _) in enumerate(rows) if b != a
        ]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4]][:positives]:
            inside = [s for s in scored if not s[4] and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(a_id, p[3], k + 1, s[3], -p[0], -s[0]) for k, s in enumerate(inside[:negatives])]
    return sorted(out, key=str)


def same(spark, rows, **kind):
    got = sorted(map(tuple, ng.hard_negatives(table(spark, rows), **kind).collect()), key=str)
    assert got == plain(rows, **kind)
    return got


def made(n, dim, seed, spread=40):
    draw = np.random.default_rng(seed)
    middle = draw.integers(-spread, spread, (4, dim))
    label = draw.integers(0, 4, n)
    near = middle[draw.integers(0, 4, n)] // 2 + middle[label] + draw.integers(-spread // 2, spread // 2, (n, dim))
    return [(i, int(label[i]), near[i].tolist(), i % 7 == 0) for i in range(n)]


def test_query_against_sql(spark, sf, duck):
    diff, rows = differences(op12_hard_negatives(spark, sf), duck, ORACLE_SQL["op12_hard_negatives"])
    assert not diff and rows > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    assert same(spark, made(150, 6, seed))


def test_many_blocks_broadcast_and_salted(spark, monkeypatch):
    rows = made(120, 4, 3)
    monkeypatch.setattr(ng, "ROWS", 16)
    monkeypatch.setattr(ng, "ANCHORS", 5)
    assert same(spark, rows)
    monkeypatch.setattr(ng, "BROADCAST_BYTES", 0)
    assert same(spark, rows)


def test_other_counts_and_windows(spark):
    same(spark, made(90, 5, 4), positives=2, negatives=7, low=10, high=100)
    assert ng.hard_negatives(table(spark, made(90, 5, 4)), low=99, high=1).collect() == []


def test_ties_and_repeats(spark):
    rows = [(i % 9, i % 2, [3, 1 + i % 2], i % 9 == 0) for i in range(40)]
    assert same(spark, rows, low=1, high=100)


def test_nulls_and_uneven_vectors(spark):
    rows = [
        (0, 1, [4, 4, 1], True), (None, 1, [4, 4], False), (None, 2, [3, 3], False), (5, 2, [3, 3, 9], False), (6, 1, [4], None),
        (7, None, [4, 4], True), (8, 1, None, True), (9, 2, [3, None], False), (10, 2, [], True), (None, 2, [2, 2], True), (11, 2, [], False),
    ]
    assert same(spark, rows)


def test_large_components(spark):
    big = [(i, l, [x * 10**7 for x in v], a) for i, l, v, a in made(60, 4, 5)]
    assert same(spark, big)
    huge = [(0, 1, [1 << 40, 1 << 40], True), (1, 1, [1 << 40, 1], False), (2, 2, [1 << 22, 5], False)]
    assert ng.hard_negatives(table(spark, huge)).first().positive_score == np.iinfo(np.int64).max


def test_nothing(spark):
    assert ng.hard_negatives(table(spark, [])).collect() == []
    assert ng.hard_negatives(table(spark, [(1, 1, [2], False), (2, 2, [2], None)])).collect() == []


def pair_of(rows):
    x = np.array([r[2] for r in rows], np.int64)
    a = np.array([r[2] for r in rows if r[3]], np.int64)
    order, parent, edge = ng.spanning_tree(a)
    place = np.argsort(order)
    own = [i for i, r in enumerate(rows) if r[3]]
    return ng.Pair({
        "dim": x.shape[1], "rows": list(range(len(rows))), "ids": [r[0] for r in rows], "labels": [r[1] for r in rows],
        "vectors": x.astype("<i8").tobytes(), "a_dim": x.shape[1], "a_rows": [own[i] for i in order],
        "a_labels": [rows[own[i]][1] for i in order], "a_vectors": a[order].astype("<i8").tobytes(),
        "a_parent": [-1 if parent[i] < 0 else int(place[parent[i]]) for i in order], "a_edge": edge[order].tolist(),
    })


def test_bounds_hold_and_save_scoring():
    pair = pair_of(made(400, 8, 6, spread=100))

    def wanted(i, low, high):
        exact = (pair.x @ pair.a[i]).astype(np.int64)
        assert (low <= exact).all() and (exact <= high).all()
        return np.arange(0, len(low), 3)

    assert len(list(pair.walk(wanted))) == len(pair.a)
    close = [(i, i % 2, [1000 + i % 5 if k == i % 3 else i % 2 * 40 for k in range(3)], i % 4 == 0) for i in range(400)]
    pair = pair_of(close)
    list(pair.positives(5))
    assert pair.scored < len(pair.a) * len(pair.rows) // 2


def test_spanning_tree_is_least():
    vectors = np.random.default_rng(7).integers(0, 50, (7, 2))
    order, parent, edge = ng.spanning_tree(vectors)
    gap = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
    left, total = {0}, 0.0
    while len(left) < 7:
        cost, best = min((gap[i, j], j) for i in left for j in set(range(7)) - left)
        left.add(best)
        total += cost
    assert np.isclose(edge.sum(), total) and sorted(order) == list(range(7)) and parent[0] == -1
    assert all(list(order).index(parent[i]) < list(order).index(i) for i in range(1, 7))
