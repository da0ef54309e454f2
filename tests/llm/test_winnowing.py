import collections
import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cohortloom.llm import winnowing as wn


def marks(text, k=wn.K, w=wn.W):
    units = re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")
    hashes = []
    for i in range(max(len(units) - k + 1, min(len(units), 1))):
        h = 42
        for unit in units[i : i + k]:
            h = xxhash.xxh64_intdigest(unit.encode(), h)
        hashes.append(h >> 32)
    out = []
    for i in range(max(len(hashes) - w + 1, min(len(hashes), 1))):
        window = hashes[i : i + w]
        place = max(j for j, h in enumerate(window) if h == min(window)) + i
        if (hashes[place], place) not in out[-w:]:
            out.append((hashes[place], place))
    return out


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, found):
    """``rows`` in the order in which they follow each other."""
    left = sorted(map(tuple, found), key=str)
    want = []
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, new, other = ([h for h, _ in marks(t)] for t in (text, edited, after))
        shown = ["".join(f"{h:08X}" for h in dict.fromkeys(x)) for x in (own, new)]
        own, new, other = set(own), set(new), set(other)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want.append((i, len(text), sha, *shown, likeness(own, new), likeness(own, other)))
    assert left == sorted(want, key=str)


def test_documents(spark, sf, documents):
    check(sorted(documents.items()), wn.compared(spark.read.parquet(f"{sf}/documents.parquet")).collect())


def test_odd_rows(frame, odd):
    rows = list(enumerate(odd))
    check(rows + [(None, "last of all")], wn.compared(frame(rows + [(None, "last of all")])).collect())


def test_repeats_one_row_and_none(frame):
    assert [r.near_next for r in wn.compared(frame([(1, "a b c")] * 3)).collect()] == [1.0] * 3
    check([(1, "just one row here")], wn.compared(frame([(1, "just one row here")])).collect())
    assert wn.compared(frame([])).collect() == []


@pytest.mark.parametrize("k, w", [(3, 8), (2, 5), (1, 1)])
def test_positions_and_guarantee(frame, documents, k, w):
    texts = dict(list(documents.items())[:30])
    for r in wn.fingerprints(frame(list(texts.items())), k, w).collect():
        assert [(m.hash, m.position) for m in r.marks] == marks(texts[r.doc_id], k, w)
        gaps = [b.position - a.position for a, b in zip(r.marks, r.marks[1:])]
        assert all(g <= w for g in gaps)


def test_rows_without_a_doc_id_are_spread(spark, frame):
    """Half of the rows have no doc_id: no task gets more than a few times its share of them."""
    rows = [(i if i % 2 else None, f"text number {i} of some length", None, None) for i in range(800)]
    parts = wn.shuffle_width(spark)
    held = wn.with_next(frame(rows).select("doc_id", "text"), lambda df: df.withColumn("task", F.spark_partition_id()))
    sizes = collections.Counter(r.task for r in held.filter("doc_id IS NULL").select("task").collect())
    assert len(sizes) == 1 << parts.bit_length() - 1 and max(sizes.values()) < 2 * 400 / len(sizes)
    assert held.filter("next IS NULL").count() <= 1 and held.count() == 800
