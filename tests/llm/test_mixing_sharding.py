import pytest

from compare import differences
from cohortloom.llm import mixing, queries, sharding


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twins(spark, duck, sf, name):
    diff, n = differences(queries.QUERIES[name](spark, sf), duck, queries.ORACLE_SQL[name])
    assert not diff and n


def filled(sizes, weights, cap):
    """Targets by sharing the excess again and again."""
    total, fixed = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        level = (total - sum(fixed.values())) / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if weights[i] * level > cap * sizes[i]]
        if not over:
            return [fixed.get(i, weights[i] * level) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def test_targets(frame):
    names = ["", "Z", "a", "b", "é", "\U0001f600", None]
    sizes = [1, 400, 3, 90, 2000, 7, 60]
    rows = [(i, "w " * n, "en", s) for i, (n, s) in enumerate(zip(sizes, names))]
    got = {r.source: r for r in mixing.shares(frame(rows)).collect()}
    want = filled(sizes, [mixing.WEIGHTS[i % 3] for i in range(7)], 3)
    for name, size, target in zip(names, sizes, want):
        r = got[name]
        assert r.source_size == size and r.target == pytest.approx(target) and r.copies in (int(r.rate), int(r.rate) + 1)
        assert r.taken == r.copies * size <= 3 * size


def test_mixture_rows(frame):
    rows = [(i % 40, f"w{i} " * (i % 9), "en", f"s{i % 4}") for i in range(400)] + [(None, None, None, None), (5, "x y", "en", "s1")]
    docs = frame(rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in mixing.shares(docs).collect())
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_taken_is_near_its_target(frame):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 5}") for i in range(8000)]
    shares = mixing.shares(frame(rows)).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) < 0.06 * r.target for r in shares)


def test_nothing_to_mix(frame):
    assert mixing.shares(frame([])).collect() == [] and mixing.mix(frame([])).collect() == []
    assert [r.taken for r in mixing.shares(frame([(1, " ", "en", "a"), (2, None, "en", "b")])).collect()] == [0, 0]


def test_many_sources_take_the_salted_join(frame, monkeypatch):
    from cohortloom.llm import common

    docs = frame([(i, "w " * (i % 5), "en", f"s{i % 6}" if i % 6 else None) for i in range(200)])
    want = sorted(map(str, mixing.shares(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.shares(docs).collect())) == want


def leaves(items, limit, depth=0):
    """Plain recursion: a bucket splits on its next bit while it is too large."""
    if sum(n for _, n in items) <= limit or depth == 2 * sharding.HASH_BITS:
        return {b: depth for b, _ in items}
    zero, one = ([x for x in items if x[0][depth] == c] for c in "01")
    return (leaves(zero, limit, depth + 1) if zero else {}) | (leaves(one, limit, depth + 1) if one else {})


@pytest.mark.parametrize("step", [3, 12])
def test_shards(frame, step):
    docs = frame([(i, "y" * (i % 50) + f" {i}") for i in range(600)] + [(None, None), (7, "z" * 5000)])
    limit = 700
    rows = sharding.shards(docs, limit, step).collect()
    bits = docs.select("doc_id", sharding.bit_string_of("doc_id", "text").alias("bits"), sharding.F.octet_length(sharding.text_of()).alias("n"))
    by_id = {r.doc_id: r for r in bits.collect()}
    big = {r.doc_id for r in rows if r.n_bytes > limit}
    assert big == {7}
    small = [(r.bits, r.n) for r in by_id.values()]
    assert len(rows) == 602 and sum(r.doc_id == 7 for r in rows) == 2
    totals = {}
    for r in rows:
        assert len(r.shard) == r.depth
        if r.doc_id not in big:
            assert by_id[r.doc_id].bits.startswith(r.shard[: sharding.HASH_BITS])
        totals[r.shard] = totals.get(r.shard, 0) + r.n_bytes
    for r in rows:
        assert totals[r.shard] == r.shard_bytes and (r.shard_bytes <= limit or r.n_bytes > limit)
    assert len(small) == 601


def test_shard_depths(frame):
    docs = frame([(i, "y" * (i % 50) + f" {i}") for i in range(300)])
    bits = docs.select("doc_id", sharding.bit_string_of("doc_id", "text").alias("bits"), sharding.F.octet_length("text").alias("n")).collect()
    want = leaves([(r.bits, r.n) for r in bits], 500)
    got = {r.doc_id: r.depth for r in sharding.shards(docs, 500, 4).collect()}
    assert got == {r.doc_id: want[r.bits] for r in bits}


def test_repeated_rows_share_a_hash_and_are_still_split(frame):
    rows = sharding.shards(frame([(1, "abc")] * 200), 30).collect()
    assert len(rows) == 200 and max(r.shard_bytes for r in rows) <= 30
    assert sharding.shards(frame([]), 30).collect() == []
