import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import token_planes as tp
from cohortloom.llm.common import table
from cohortloom.llm.queries import op11_token_planes
from cohortloom.llm.vocabulary import load
from cohortloom.session import scratch_path


def ids_of(text):
    return load(tp.TOKENIZER).encode(text or "", add_special_tokens=False).ids + [tp.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1001])
def test_payloads_give_their_ids_back(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    payload = tp.pack(ids, bits)
    assert tp.unpack(payload).tolist() == ids.tolist()
    assert payload[:4] == b"BPLN" and payload[5] == bits and payload[6] == (0 if n == 0 else 32 // bits)


def test_planes_are_transposed():
    ids = np.array([0x04030201, 0x14131211], np.uint32)
    assert tp.planes_of(ids, 8) == [b"\x01\x11", b"\x02\x12", b"\x03\x13", b"\x04\x14"]
    assert tp.planes_of(np.array([1, 0, 3], np.uint32), 1)[:3] == [b"\x05", b"\x04", b"\x00"]


def test_a_foreign_payload_is_refused():
    with pytest.raises(ValueError):
        tp.unpack(b"ELSE" + tp.pack(np.arange(3, dtype=np.uint32))[4:])


def test_checksums_join():
    draw = np.random.default_rng(3)
    parts = [draw.bytes(int(n)) for n in (0, 1, 4, 1000, 70_001)]
    assert tp.joined_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))
    assert tp.joined_crc([]) == 0


def test_query_against_the_library(spark, sf, documents):
    start, expected = 0, []
    for i in sorted(documents):
        ids = ids_of(documents[i])
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    rows = op11_token_planes(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, rows.collect())) == expected


@pytest.mark.parametrize("bits", [1, 8])
def test_documents_over_many_chunks(spark, frame, odd, bits):
    texts = dict(enumerate(odd))
    path = scratch_path(spark, "planes")
    tp.write(frame(list(texts.items())), path, chunk=64, bits=bits, parts=3)
    stream = [t for i in sorted(texts) for t in ids_of(texts[i])]
    rows, at = sorted(tp.read_documents(spark, path).collect(), key=lambda r: r.doc_id), 0
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids_of(texts[r.doc_id])), crc(stream[at : at + r.n_tokens]))
        at += r.n_tokens
    index = tp.opened(spark, path, "index").orderBy("start").collect()
    assert index[0].start == 0 and all(a.start + a.n == b.start for a, b in zip(index, index[1:]))
    assert index[-1].start + index[-1].n == len(stream) and max(r.n for r in index) == 64
    got = sorted(tp.read_range(spark, path, 100, 500).collect())
    assert got[0].start == 100 and [x for r in got for x in r.ids] == stream[100:600]


def test_nulls_repeats_and_nothing(spark, frame):
    rows = [(None, "a b"), (None, "a b"), (None, None), (3, "c"), (3, "c"), (2, "d e f")]
    path = scratch_path(spark, "planes")
    tp.write(frame(rows), path, chunk=3, parts=4)
    out = tp.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, None, 2, 3, 3]
    assert sorted((r.n_tokens, r.ids_crc32) for r in out) == sorted((len(ids_of(t)), crc(ids_of(t))) for _, t in rows)
    assert [r.start for r in out] == np.cumsum([0] + [r.n_tokens for r in out])[:-1].tolist()
    path = scratch_path(spark, "planes")
    tp.write(frame([]), path)
    assert tp.read_documents(spark, path).collect() == [] and tp.read_range(spark, path, 0, 9).collect() == []


def test_a_hot_doc_id_is_spread(spark, frame):
    path = scratch_path(spark, "planes")
    tp.write(frame([(None, f"text {i % 7}") for i in range(400)]), path, parts=4)
    sizes = [r.n for r in tp.opened(spark, path, "parts").collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_upper_planes_cost_nothing(spark, sf):
    path = scratch_path(spark, "planes")
    tp.write(table(spark, sf, "documents"), path, parts=2)
    sums = tp.opened(spark, path, "index").agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("b")).first()
    assert sums.b < 2 * sums.n  # below two bytes an id
