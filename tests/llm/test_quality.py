import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortloom.llm import quality


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, seen, repeated = len(words), set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = np.zeros(n, bool)
    for i in range(n - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered[i : i + 8] = True
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, int(covered.sum())]


@pytest.mark.parametrize("chunk", [1_000_000, 700, 1])
def test_counts(documents, odd, chunk):
    more = ["a\nb\n\na\n\x0b\na", "é é é " * 9, "a b c d e f g h a b c d e f g h", "a b c d e f g h i"]
    texts = [t or "" for t in odd] + more + list(documents.values())[:60]
    parts = [quality.measured(x) for x in quality.slices(pa.array(texts), chunk)]
    got = np.array([np.concatenate([p[c] for p in parts]) for c in quality.COUNTS]).T.tolist()
    assert got == [counted(t) for t in texts]


def limits_of(rows):
    """Limits from sorted values: of the language and source, else the language, else all."""

    def rough(v):
        shift = max(v.bit_length() - quality.BITS, 0)
        return v >> shift << shift

    values = collections.defaultdict(list)
    for lang, source, c in rows:
        if c[0] >= 20 and 100 * c[4] <= 30 * c[0]:
            m = (1000 * c[2] // c[0], 1000 * c[3] // c[0], 100 * c[1] // c[0])
            for group in {(2, lang, source), (1, lang, None), (0, None, None)}:
                values[group].append(tuple(map(rough, m)))

    def limit(lang, source):
        for group in ((2, lang, source), (1, lang, None), (0, None, None)):
            found = values.get(group, [])
            if len(found) >= quality.MIN_GROUP:
                out = []
                for k, kind in enumerate(quality.METRICS.values()):
                    v = sorted(x[k] for x in found)
                    q1, q2, q3, q99 = (v[int(np.ceil(p * len(v))) - 1] for p in (0.25, 0.5, 0.75, 0.99))
                    spread = quality.REACH * max(q3 - q1, sum(abs(x - q2) for x in v) / len(v))
                    high = q99 + quality.REACH * (q99 - q2) if kind == quality.TAIL else q3 + spread
                    out.append((q1 - spread if kind == quality.BOTH else 0, high))
                return out
        return [(0, float("inf"))] * 3

    return limit


def test_verdicts_against_plain_quantiles(frame):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        words = [("ab" * int(rng.integers(1, 4))) + str(rng.integers(0, 9999)) for _ in range(int(rng.integers(10, 60)))]
        if i % 11 == 0:
            words = [w + "***" for w in words]
        if i % 17 == 0:
            words = [w * 5 for w in words]
        lang, source = (None if i % 5 == 0 else "en" if i % 2 else "de"), (None if i % 7 == 0 else "big" if i % 3 else f"s{i % 4}")
        rows.append((i, " ".join(words), lang, source))
    rows += [(None, None, None, None), (3, "", "en", "big"), (3, "", "en", "big")]
    counts = [(lang, source, counted(t)) for _, t, lang, source in rows]
    limit = limits_of(counts)
    want = collections.Counter()
    for (i, *_), (lang, source, c) in zip(rows, counts):
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        kept = not failed
        if kept:
            m = (1000 * c[2] // c[0], 1000 * c[3] // c[0], 100 * c[1] // c[0])
            kept = all(low <= v <= high for v, (low, high) in zip(m, limit(lang, source)))
        want[(i, *c, failed, kept)] += 1
    docs = frame(rows)
    got = quality.verdicts(docs).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert 0 < sum(r.kept for r in got) < sum(not r.base_failed for r in got)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_labelled_documents(spark, duck, sf):
    """Clean documents stay but for short ones; junk goes."""
    rows = {r.doc_id: r for r in quality.verdicts(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = duck.execute("SELECT doc_id, quality FROM labels").fetchall()
    good = [rows[i] for i, q in labels if q and not rows[i].base_failed]
    bad = [rows[i] for i, q in labels if not q]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.2


def test_limits_follow_the_data(frame):
    """The same text is kept where its kind is common and goes where it is not: no cutoff is fixed."""
    plain = " ".join(f"word{i}" for i in range(40))
    noisy = " ".join(f"word{i}#" for i in range(40))
    rows = [(i, plain + f" x{i}", "en", "prose") for i in range(95)] + [(i, noisy, "en", "prose") for i in range(95, 100)]
    rows += [(i, noisy + f" x{i}", "en", "code") for i in range(100, 195)] + [(i, plain, "en", "code") for i in range(195, 200)]
    kept = {r.doc_id for r in quality.verdicts(frame(rows)).collect() if r.kept}
    assert kept >= set(range(95)) | set(range(100, 195)) and not kept & set(range(95, 100))


def test_empty(frame):
    assert quality.verdicts(frame([])).collect() == [] and quality.keep(frame([])).collect() == []
