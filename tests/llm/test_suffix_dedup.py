import hashlib
import random

import numpy as np
import pytest

from cohortloom.llm import suffix_dedup as sd


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", bytes(range(256))])
def test_suffix_array(alphabet):
    rng = random.Random(len(alphabet))
    for n in (1, 2, 7, 50, 400):
        text = bytes(rng.choice(alphabet) for _ in range(n))
        text += text[: n // 2] * rng.randint(0, 3)
        data = np.frombuffer(text, np.uint8)
        order = sd.suffix_array(data, 20)
        assert sorted(order.tolist()) == list(range(len(text)))
        keys = [text[i : i + 20] for i in order]
        assert keys == sorted(keys)
        inner = order[order <= len(text) - 20]
        want = [0] + [next((k for k in range(20) if text[a + k] != text[b + k]), 20) for a, b in zip(inner, inner[1:])]
        assert not len(inner) or sd.common_prefixes(data, inner, 20).tolist() == want


def brute(rows, length=100):
    """Per distinct (doc_id, text) the outcome, from a set of all strings seen so far."""
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(data[s : s + length])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i, text] = (len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def outcome(df):
    return [
        (r.doc_id, (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()))
        for r in df.collect()
    ]


@pytest.mark.parametrize("per_anchor", [20_000, 3])
def test_documents(spark, sf, documents, per_anchor):
    want = {i: w for (i, _), w in brute(sorted(documents.items())).items()}
    found = outcome(sd.deduplicated(spark.read.parquet(f"{sf}/documents.parquet"), per_task=500, per_anchor=per_anchor))
    assert dict(found) == want and len(found) == len(want)
    assert sum(w[1] for w in want.values()) > 1000


def test_odd_rows(frame, odd):
    passage = "a passage of more than one hundred bytes that stands in several of these texts, né, and has no period in it at all "
    rows = [(i, t) for i, t in enumerate(odd)]
    rows += [(90, "x" + passage), (91, passage + "y"), (92, passage * 3), (93, passage[:99]), (94, passage[:100])]
    want = {i: w for (i, _), w in brute(rows).items()}
    assert dict(outcome(sd.deduplicated(frame(rows)))) == want


def test_repeated_rows_and_nulls(frame):
    text = " ".join(f"word{i}" for i in range(40))
    found = outcome(sd.deduplicated(frame([(5, text), (5, text), (None, text), (None, None), (None, None)])))
    whole, none = (len(text), 0, 0), (len(text), len(text), 1)
    assert sorted(str((i, f[:3])) for i, f in found) == sorted(
        str(x) for x in [(5, whole), (5, whole), (None, none), (None, (0, 0, 0)), (None, (0, 0, 0))]
    )
    assert sd.deduplicated(frame([])).collect() == []


def test_long_texts_are_taken_in_blocks(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    whole = [(s.tolist(), h.tolist()) for _, s, h, _, _ in sd.passages([text])]
    for size in (250, 1000):
        parts = [(s + 0, h, [seg(i) for i in range(len(h))]) for _, s, h, _, seg in sd.passages([text], size=size)]
        covered = sorted((s + k, h) for ss, hh, segs in parts for s, h, g in zip(ss.tolist(), hh.tolist(), segs) for k in range(len(g) - 99))
        assert [s for s, _ in covered] == list(range(len(text) - 99))
        starts, hashes = whole[0]
        assert [h for _, h in covered] == [hashes[np.searchsorted(starts, s, side="right") - 1] for s, _ in covered]
        assert all(text[s : s + len(g)] == g for ss, _, segs in parts for s, g in zip(ss.tolist(), segs))
