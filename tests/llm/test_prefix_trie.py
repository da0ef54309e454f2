import hashlib
import random
import re
import zlib

import pytest

from compare import differences
from cohortloom.llm import prefix_trie as pt
from cohortloom.llm.queries import ORACLE_SQL, op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, words int, shard int, steps string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def step(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def gathered(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, step(role, text), role or "", text or ""))
    return {c: [(t[3], t[4]) for t in sorted(own)] for c, own in convs.items()}


def spliced(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def plain(convs):
    nodes = {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            nodes.setdefault(tuple(own[:d]), []).append(c)
    out = []
    for at, members in nodes.items():
        under = [n for n in nodes if n[: len(at)] == at]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)
        saved = sum((len(nodes[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in under if n)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(at))
        out.append((
            min(members), len(at), min(nodes[at[:-1]]) if at else None, len(members), sum(len(n) == len(at) + 1 for n in under),
            sum(map(leaf, under)), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made(n, seed, letters="abc", longest=6):
    draw = random.Random(seed)
    return [
        (c, t, draw.choice(["u", "u", None]), draw.choice([*letters, "two words", None]))
        for c in range(n) for t in range(draw.randint(1, longest))
    ]


def got(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_query_against_sql(spark, sf, duck):
    diff, rows = differences(op13_prefix_trie(spark, sf), duck, ORACLE_SQL["op13_prefix_trie"])
    assert not diff and rows > 50


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_against_brute_force(spark, ranges):
    rows = made(120, ranges)
    assert got(pt.prefix_trie(table(spark, rows), ranges)) == plain(gathered(rows))


def test_rebuilt_conversations(spark):
    rows = [r for r in made(90, 5) if r[0] % 60 != 20 or r[0] == 25]  # some first conversations are absent
    df = pt.trie(pt.rebuilt(table(spark, rows)), 5)
    assert got(df) == plain(spliced(gathered(rows)))


def test_one_conversation_many_times(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 64)
    rows = [(c, t, "u", f"turn {t}") for c in range(100, 300) for t in range(3)] + made(40, 6)
    df = pt.prefix_trie(table(spark, rows), 6)
    assert got(df) == plain(gathered(rows))


def test_nulls_ties_and_repeats(spark):
    rows = [
        (1, None, "u", "a"), (1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, None, None), (2, 0, None, None), (None, 1, "u", "a"),
        (3, 1, "", ""), (-7, 5, "u", "é  ü x"), (4, None, None, "a"), (4, None, "a", None), (5, 1, "u", "word " * 4000),
    ]
    assert got(pt.prefix_trie(table(spark, rows), 3)) == plain(gathered(rows))


def test_a_long_conversation(spark):
    rows = [(c, t, "u", str(t)) for c in (1, 2, 3) for t in range(1500 if c < 3 else 700)]
    nodes = got(pt.prefix_trie(table(spark, rows), 4))
    assert len(nodes) == 1501 and [n[3] for n in sorted(nodes, key=lambda n: n[1])][::700] == [3, 3, 2]


def test_nothing(spark):
    assert pt.prefix_trie(table(spark, [])).collect() == []
    assert pt.trie(pt.rebuilt(table(spark, [(None, 1, "u", "a")]))).collect() == []


def test_bounds_are_short_and_split_one_path():
    a, b, c = (bytes([x]) * 16 for x in (1, 2, 3))
    sample = [(a + a, 1), (a + b + c, 2), (b, 3), (b, 4), (b, 5), (b + c, 6)]
    bounds = pt.splitters(sample, 6)
    assert bounds == [(a + b, None), (b, None), (b, 4), (b, 5), (b + c, None)]
    number, over = pt.skeleton(bounds)
    assert len(over) == 3 and over == [None, 0, 0]  # the root, a and b


def test_common_first_steps():
    a, b, c = (bytes([x]) * 16 for x in (1, 2, 3))
    assert [pt.shared(*p) for p in ((b"", a), (a, a), (a + b, a + c), (a + b + c, a + b), (b + a, a + a), (a + b + c + a, a + b + a + a))] == [0, 1, 1, 2, 0, 2]
