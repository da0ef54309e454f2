"""Token ids on disk as compressed bit or byte planes, with a chunk index.

All ids of a table stand in one order: ascending doc_id, each document closed by an end id. The order is cut into parts
(one task each) and every part into chunks of a fixed number of ids. Of a chunk, all lowest bytes (or bits) come first,
then all second ones, and so on; each such plane is compressed by zstandard on its own. The upper planes of small ids are
nearly constant and shrink to almost nothing.

A store is a folder with three tables:

* ``chunks``: ``part``, ``chunk``, ``first`` (ids before it in its part), ``n``, the documents with ids in it
  (``doc_ids``, ``doc_firsts``, ``doc_lengths``) and ``payload``;
* ``index``: ``part``, ``chunk``, ``start`` (ids of all chunks before), ``n``, ``n_bytes``;
* ``parts``: ``part``, ``start``, ``n``.

A payload is ``BPLN``, then little-endian: version (u8), bits per plane (u8: 1 or 8), planes (u8), a zero byte, ids (u32),
the size of every plane (u32 each), and the planes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_size, shuffle_width, text_of, written
from .encode import encoder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Ids of a chunk.
CHUNK = 65_536
LEVEL = 3
MAGIC, VERSION = b"BPLN", 1
HEAD = struct.Struct("<4sBBBxI")
CHUNKS = (
    "part int, chunk int, first bigint, n int, doc_ids array<bigint>, doc_firsts array<bigint>, doc_lengths array<bigint>, "
    "payload binary"
)
TABLES = {
    "chunks": CHUNKS,
    "index": "part int, chunk int, start bigint, n int, n_bytes bigint",
    "parts": "part int, start bigint, n bigint",
}
SEGMENTS = "part int, doc_id bigint, doc_first bigint, doc_length bigint, at bigint, n bigint, crc bigint"


# ---- one chunk -----------------------------------------------------------------


def planes_of(ids: np.ndarray, bits: int) -> list[bytes]:
    """Unsigned 32-bit ids as 4 byte planes or 32 bit planes, lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 1:
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = rows.T
    return [row.tobytes() for row in rows]


def ids_of(planes: list[bytes], bits: int, n: int) -> np.ndarray:
    """The ids that :func:`planes_of` was given."""
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if bits == 1:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = rows.T
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def pack(ids: np.ndarray, bits: int = 8, level: int = LEVEL) -> bytes:
    """A chunk's payload."""
    planes = [zstandard.ZstdCompressor(level=level).compress(p) for p in planes_of(ids, bits)] if len(ids) else []
    sizes = struct.pack(f"<{len(planes)}I", *map(len, planes))
    return b"".join([HEAD.pack(MAGIC, VERSION, bits, len(planes), len(ids)), sizes, *planes])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload."""
    magic, version, bits, count, n = HEAD.unpack_from(payload)
    if magic != MAGIC or version != VERSION or bits not in (1, 8):
        raise ValueError("not a chunk of token planes")
    sizes = struct.unpack_from(f"<{count}I", payload, HEAD.size)
    if not n:
        return np.zeros(0, np.uint32)
    at, planes = HEAD.size + 4 * count, []
    width = (n + 7) // 8 if bits == 1 else n
    for size in sizes:
        planes.append(zstandard.ZstdDecompressor().decompress(payload[at : at + size], max_output_size=width))
        at += size
    return ids_of(planes, bits, n)


# ---- writing -------------------------------------------------------------------


class _Part:
    """The chunks of one part, cut off a stream of documents."""

    def __init__(self, part: int, chunk: int, bits: int):
        self.part, self.size, self.bits = part, chunk, bits
        self.held, self.docs = np.zeros(0, np.uint32), []  # ids not yet written; (doc_id, first, length) with ids in them
        self.first = self.number = 0

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> list[tuple]:
        firsts = self.first + len(self.held) + np.cumsum(counts) - counts
        self.docs += zip(doc_ids, firsts.tolist(), counts.tolist())
        self.held = np.concatenate([self.held, ids])
        full = len(self.held) // self.size
        return [self.cut(self.size) for _ in range(full)]

    def cut(self, n: int) -> tuple:
        """The next chunk of ``n`` ids."""
        ids, self.held = self.held[:n], self.held[n:]
        end, count = self.first + n, 0
        while count < len(self.docs) and self.docs[count][1] < end:
            count += 1
        own = self.docs[:count]
        row = (self.part, self.number, self.first, n, *map(list, zip(*own)), pack(ids, self.bits))
        last = own[-1]
        self.docs = self.docs[count - (last[1] + last[2] > end) :]
        self.first, self.number = end, self.number + 1
        return row


def write(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, chunk: int = CHUNK, bits: int = 8,
    parts: int | None = None,
) -> None:
    """Write the ids of every document (``doc_id``, ``text``) to a store at ``path``.

    Rows are dealt out by ranges of (doc_id, hash of the text, row), so neither a hot doc_id (nulls come first) nor
    repeated rows meet in one task; rows with the same doc_id stand in the order of their texts' hashes. A null or empty text
    has the end id alone. Only ``doc_id`` and ``text`` are read; an empty table gives an empty store. A task holds one chunk
    and a slice of documents (or one longer document) at a time.
    """
    from pyspark import TaskContext

    if bits not in (1, 8):
        raise ValueError("planes are of 1 or 8 bits")

    def work(batches):
        part = _Part(TaskContext.get().partitionId(), chunk, bits)
        for batch, texts in by_size(batches, "text", 500_000):
            ids, counts = encoder(tokenizer).encode(texts, end_id)
            yield from rows(part.add(batch.column("doc_id").to_pylist(), ids, counts))
        if len(part.held):
            yield from rows([part.cut(len(part.held))])

    def rows(made):
        if made:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = ["part", "chunk", "first", "n", "doc_ids", "doc_firsts", "doc_lengths", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    keyed = docs.select(
        F.col("doc_id").cast("bigint"),
        text_of().alias("text"),
        F.xxhash64(text_of()).alias("_h"),
        F.monotonically_increasing_id().alias("_row"),
    )
    dealt = keyed.repartitionByRange(parts or shuffle_width(docs.sparkSession), "doc_id", "_h", "_row")
    sorted_ = dealt.sortWithinPartitions("doc_id", "_h", "_row").select("doc_id", "text")
    # planes are compressed already
    sorted_.mapInArrow(work, CHUNKS).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    _write_index(docs.sparkSession, path)


def _write_index(spark: SparkSession, path: str) -> None:
    """Add up the lengths of parts, of which there are as many as tasks, and number the chunks through."""
    held = opened(spark, path, "chunks").select("part", "chunk", "first", "n", F.length("payload").cast("bigint").alias("n_bytes"))
    sums = held.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part: as many as tasks
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")
    starts.write.parquet(f"{path}/parts")
    begun = opened(spark, path, "parts").select("part", F.col("start").alias("_begun"))
    numbered = held.join(F.broadcast(begun), "part")
    numbered.select("part", "chunk", (F.col("_begun") + F.col("first")).alias("start"), "n", "n_bytes").write.parquet(f"{path}/index")


# ---- reading -------------------------------------------------------------------


def opened(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a store."""
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """A row per document and chunk it has ids in, read off the store: where its ids lie and their checksum."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = np.ascontiguousarray(unpack(row["payload"]), "<u4").tobytes()
                begin, end = row["first"], row["first"] + row["n"]
                out = []
                for doc, first, length in zip(row["doc_ids"], row["doc_firsts"], row["doc_lengths"]):
                    low, high = max(first, begin), min(first + length, end)
                    crc = zlib.crc32(raw[4 * (low - begin) : 4 * (high - begin)])
                    out.append((row["part"], doc, first, length, low - first, high - low, crc))
                yield pa.RecordBatch.from_pylist([dict(zip(fields, o)) for o in out], schema=schema)

    fields = [c.split()[0] for c in SEGMENTS.split(", ")]
    schema = pa.schema([(f, pa.int32() if f == "part" else pa.int64()) for f in fields])
    return opened(spark, path, "chunks").select(
        "part", "first", "n", "doc_ids", "doc_firsts", "doc_lengths", "payload"
    ).mapInArrow(work, SEGMENTS)


def _times(matrix: list[int], vector: int) -> int:
    """A product over bits: the columns of ``matrix`` at the set bits of ``vector``, added without carry."""
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


#: Fixed value: the polynomial of CRC-32, bits reversed. SHIFTS[k] moves a checksum past 2**k zero bytes.
POLYNOMIAL = 0xEDB88320
SHIFTS: list[list[int]] = []


def _shifts(n: int) -> list[list[int]]:
    while len(SHIFTS) < n:
        if SHIFTS:
            SHIFTS.append([_times(SHIFTS[-1], c) for c in SHIFTS[-1]])
            continue
        one = [POLYNOMIAL] + [1 << i for i in range(31)]  # past one zero bit
        for _ in range(3):
            one = [_times(one, c) for c in one]
        SHIFTS.append(one)
    return SHIFTS


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of bytes one after the other, from the (length, CRC-32) of each; the bytes are not needed."""
    total = 0
    for length, crc in parts:
        for k, matrix in enumerate(_shifts(length.bit_length())):
            if length >> k & 1:
                total = _times(matrix, total)
        total ^= crc
    return total


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` (with the end id) and
    ``ids_crc32`` (of its little-endian unsigned 32-bit ids).

    Ids never leave the task that reads their chunk; a document over several chunks is put together from checksums.
    """

    @F.pandas_udf("bigint")
    def join_crc(parts):
        return parts.map(lambda p: joined_crc([(4 * int(x["n"]), int(x["crc"])) for x in p]) if p is not None else None)

    each = segments(spark, path)
    whole = F.col("n") == F.col("doc_length")
    kept = written(each, "token-segments")
    cut = kept.filter(~whole).groupBy("part", "doc_first", "doc_id", "doc_length").agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("_p")
    )
    found = kept.filter(whole).select("part", "doc_first", "doc_id", "doc_length", "crc").unionByName(
        cut.select("part", "doc_first", "doc_id", "doc_length", join_crc("_p").alias("crc"))
    )
    starts = opened(spark, path, "parts").select("part", F.col("start").alias("_begun"))
    return found.join(F.broadcast(starts), "part").select(
        "doc_id",
        (F.col("_begun") + F.col("doc_first")).alias("start"),
        F.col("doc_length").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """Ids ``start`` to ``start + n`` of the whole order as rows (``start``, ``ids``), one per chunk touched.

    The index names the chunks; only their payloads are read.
    """
    index = opened(spark, path, "index")
    wanted = index.filter((F.col("start") < start + n) & (F.col("start") + F.col("n") > start)).select("part", "chunk", "start")

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                low, high = max(start, row["start"]), min(start + n, row["start"] + row["n"])
                ids = unpack(row["payload"])[low - row["start"] : high - row["start"]]
                yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([ids.astype(np.int64)])], names=["start", "ids"])

    held = opened(spark, path, "chunks").select("part", "chunk", "n", "payload")
    return held.join(wanted, ["part", "chunk"]).select("start", "n", "payload").mapInArrow(work, "start bigint, ids array<bigint>")
