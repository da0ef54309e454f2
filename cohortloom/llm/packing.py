"""Packing by power-of-two decomposition.

A document's ids (its tokens and one end id) are cut into pieces whose lengths are powers of two: as many of the
greatest length as fit, then the binary digits of the rest. Every piece is a sequence of its own, so no sequence
crosses documents and none is padded; sequences of one length form a bucket, from which batches are drawn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, text_of
from .encode import encoder

TOKENIZER = "byte_bpe_50k.json"
MAX_LENGTH = 2048
END_ID = 1
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


def binary_lengths(n: int, longest: int) -> list[int]:
    """``n`` as a sum of powers of two up to ``longest``, greatest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(
    docs: DataFrame, tokenizer: str = TOKENIZER, max_length: int = MAX_LENGTH, end_id: int = END_ID
) -> DataFrame:
    """Every document (``doc_id``, ``text``) as pieces of power-of-two length.

    Returns ``doc_id``, ``start`` (its ids before the piece), ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens`` (with the end id), ``bucket`` (log2 of the length), ``sequence_id`` and ``offset`` (always 0: a
    piece fills its sequence). A sequence id numbers the pieces of an input partition from ``partition << 33``, so
    ids are distinct without a shuffle; they are not gapless.

    ``max_length`` is a power of two. A null or empty text has the end id alone. Null and repeated doc_ids and
    repeated rows are packed row by row; other columns are not read; an empty table gives an empty result.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")

    def work(batches):
        for batch, texts in by_size(batches, "text", 500_000):
            ids, counts = encoder(tokenizer).encode(texts, end_id)
            cut = [binary_lengths(int(n), max_length) for n in counts]
            per = np.array([len(c) for c in cut])
            lengths = np.array([x for c in cut for x in c], np.int64)
            ends = np.cumsum(lengths)
            first = np.repeat(np.cumsum(counts) - counts, per)
            offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(cut)), per))),
                    pa.array(ends - lengths - first),
                    pa.array(lengths),
                    pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]
                    ).cast(pa.binary()),
                    pa.array(np.repeat(counts, per)),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    cut = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(work, PIECES)
    return cut.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder of files per sequence length, which a training reader opens as arrays of that width."""
    packed.write.partitionBy("bucket").parquet(path)
