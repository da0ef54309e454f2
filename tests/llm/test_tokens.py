import zlib

import numpy as np
import pytest

from cohortloom.llm import packing, token_counts
from cohortloom.llm.vocabulary import load


def direct(name, text):
    return load(name).encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, texts):
    by_doc, sequences = {}, set()
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.sequence_id not in sequences
        sequences.add(r.sequence_id)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = direct(packing.TOKENIZER, text) + [packing.END_ID], 0
        lengths = []
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.offset, r.doc_tokens, 1 << r.bucket) == (at, 0, len(ids), r.length)
            assert r.length <= packing.MAX_LENGTH
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length]
            at += r.length
            lengths.append(r.length)
        assert at == len(ids)
        assert len(set(x for x in lengths if x < packing.MAX_LENGTH)) == len([x for x in lengths if x < packing.MAX_LENGTH])


def test_pieces_of_documents(spark, sf, documents):
    check_pieces(packing.pieces(spark.read.parquet(f"{sf}/documents.parquet")).collect(), documents)


def test_pieces_of_odd_texts(frame, odd):
    texts = dict(enumerate(odd))
    check_pieces(packing.pieces(frame(list(texts.items()))).collect(), texts)


def test_pieces_of_nulls_repeats_and_nothing(frame):
    rows = packing.pieces(frame([(None, "a b"), (3, "a b"), (3, "a b")])).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and sorted(str(r.doc_id) for r in rows if r.start == 0) == ["3", "3", "None"]
    assert packing.pieces(frame([])).collect() == []


def test_query_digest(spark, sf):
    from cohortloom.llm.queries import op1_packing

    row = op1_packing(spark, sf).filter("doc_id = 0 AND start = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id = 0").first().text
    ids = (direct(packing.TOKENIZER, text) + [1])[: row.length]
    assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_binary_lengths():
    assert packing.binary_lengths(2 * 2048 + 5, 2048) == [2048, 2048, 4, 1]
    assert packing.binary_lengths(1, 2048) == [1]


def test_buckets_on_disk(spark, frame, tmp_path):
    packing.write_buckets(packing.pieces(frame([(1, "a b c d e f g")])), str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert all(r.length == 1 << r.bucket for r in read.collect())


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (300, 40), (64, 8)])
def test_counts(odd, documents, chunk, overlap):
    texts = [t or "" for t in odd] + [t for t in documents.values() if len(t) > 3000][:12]
    want = [len(direct(token_counts.TOKENIZER, t)) for t in texts]
    assert token_counts.counts_of(token_counts.TOKENIZER, texts, chunk, overlap).tolist() == want
    assert [token_counts.spliced(load(token_counts.TOKENIZER), t, chunk, overlap) for t in texts if t] == [n for t, n in zip(texts, want) if t]


def test_count_rows(frame):
    rows = token_counts.token_counts(frame([(None, None), (2, "é b"), (2, "é b"), (3, "w " * 3000)])).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    assert got == [("2", 4, 2, False), ("2", 4, 2, False), ("3", 6000, 3000, True), ("None", 0, 0, False)]
    assert token_counts.token_counts(frame([])).collect() == []


def test_count_documents(spark, sf, documents):
    for r in token_counts.token_counts(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        assert r.n_tokens == len(direct(token_counts.TOKENIZER, documents[r.doc_id]))
