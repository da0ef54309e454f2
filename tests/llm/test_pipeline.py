import collections

import corpus_pipeline
from cohortloom.llm import mixing, packing, pii, quality, simhash
from cohortloom.llm.common import written
from cohortloom.llm.vocabulary import load


def test_stages_against_plain_steps(spark, sf):
    """Each stage on what the one before kept, held against the operator's own report or a plain computation."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, states = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(written(stage(spark, states[-1], sf), f"test-{name}"))
    assert all(s.columns == columns for s in states[:-1])
    ids = [collections.Counter(r.doc_id for r in s.select("doc_id").collect()) for s in states[:-1]]

    verdicts = quality.verdicts(states[0]).collect()
    assert ids[1] == collections.Counter(r.doc_id for r in verdicts if r.kept)
    groups = simhash.near_duplicates(states[1]).collect()
    assert ids[2] == collections.Counter({r.component_id for r in groups})
    assert ids[3] == ids[2]
    masked = {r.doc_id: r.text for r in pii.report(states[2], pii.session_key(spark)).collect()}
    assert {r.doc_id: r.text for r in states[3].collect()} == masked
    shares = mixing.shares(states[3]).collect()
    assert ids[4] == collections.Counter({r.doc_id: r.copies for r in shares if r.copies})
    lengths = collections.Counter()
    for r in states[4].collect():
        lengths[r.doc_id] += len(load(packing.TOKENIZER).encode(r.text, add_special_tokens=False).ids) + 1
    packed = collections.Counter()
    for r in states[5].collect():
        packed[r.doc_id] += r.length
    assert packed == lengths


def test_odd_documents(spark, frame, odd, tmp_path):
    """Nulls, empty and very long texts, repeats and clashing columns pass through all stages."""
    rows = [(i, t, "en", "web") for i, t in enumerate(odd)] + [(None, "a b", None, None), (3, None, None, "x"), (3, None, None, "x")]
    plain = " ".join(f"word{i} and{i % 97}" for i in range(400))
    rows += [(100, plain, "en", "web"), (101, plain, "en", None), (None, plain + " more words at the end", None, "web")]
    for name, docs in (("odd", rows), ("empty", [])):
        path = f"{tmp_path}/{name}"
        frame(docs).write.parquet(f"{path}/documents.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        assert (len(out) > 0) == bool(docs)
        assert sum(r.length for r in out if r.start == 0 or r.start > 0) == sum(len(r.ids) // 4 for r in out)
        assert {r.doc_id for r in out} <= {r[0] for r in docs}


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "ids", "sequence_id"} <= set(out.columns) and out.count() > 0
