import random
import re

import numpy as np
import pytest
import xxhash

from cohortloom.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(fps, radius=3):
    """The root of every fingerprint by comparing all pairs."""
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= radius):
            root[find(i)] = find(int(j))
    return [find(i) for i in range(len(fps))]


def expected(rows):
    fps = [plain(t) for _, t in rows]
    roots, least = groups(fps), {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, float("inf")), float("inf") if i is None else i)
    return sorted(str((i, f"{fp:016x}", None if least[r] == float("inf") else least[r])) for (i, _), fp, r in zip(rows, fps, roots))


def got(df):
    return sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in df.collect())


def test_documents(spark, sf, documents):
    assert got(simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))) == expected(list(documents.items()))


def test_odd_rows(frame, odd):
    rows = list(enumerate(odd)) + [(None, "one two three"), (None, "One two THREE"), (5, "a"), (5, "a"), (40, "solo words here")]
    assert got(simhash.near_duplicates(frame(rows))) == expected(rows)
    assert simhash.near_duplicates(frame([])).collect() == []


def test_masks_cover_every_difference():
    masks = simhash.masks(3)
    rng = random.Random(1)
    assert len(masks) == 15
    for _ in range(5000):
        change = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(change & m == 0 for m in masks)
    pairs = [(a, b) for a in range(64) for b in range(a)]
    assert all(any(((1 << a) | (1 << b)) & m == 0 for m in masks) for a, b in pairs)


@pytest.mark.parametrize("block", [4096, 16])
def test_dense_cluster(spark, block):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    near = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(500)}
    fps = sorted(near | {rng.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp bigint")
    found = {r.fp: r.root for r in simhash.components(simhash.edges(df, 3, block)).collect()}
    roots = groups(fps)
    members = {}
    for x, r in zip(fps, roots):
        members.setdefault(r, []).append(simhash._signed(x))
    for own in members.values():
        assert {found.get(x, x) for x in own} == {min(own)}


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {r.root for r in simhash.components(links).collect()} == {0}


def test_representatives(frame):
    text = "the quick brown fox jumps over the lazy dog again and again"
    docs = frame([(4, text), (2, text), (2, text), (None, text), (9, "another text with other words in it"), (None, None)])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "9", "None"]
    assert simhash.representatives(frame([])).collect() == []
