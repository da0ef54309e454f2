"""Removal of long repeated passages with suffix arrays built by two-stage sorting.

Every 100-byte string holds an anchor that its content alone chooses: the 32-byte string of least hash in it. Strings
can only be equal if their anchors are, so passages around anchors that occur once are left alone, and the others
are dealt out by anchor. A task sorts the suffixes of its passages in two stages and reads repeats off the common
prefixes of neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, text_of, written

LENGTH = 100
ANCHOR = 32
SEED = 20
#: Passages that one task sorts on average, and the most of one anchor that it gets at once.
PER_TASK = 10_000
PER_ANCHOR = 20_000
#: Bytes of text hashed at once, so that the arrays stay in cache; longer texts are taken in overlapping blocks.
BLOCK = 250_000
PLACE = np.uint64(127)


def _codes() -> np.ndarray:
    """A 64-bit code per byte value."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), SEED) for b in range(256)], np.uint64)


CODES = _codes()
BASE = xxhash.xxh64_intdigest(b"base", SEED) | 1


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` (a power of two) bytes from every position on, by doubling."""
    h, step, factor = CODES[data], 1, BASE
    while step < width:
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = 2 * step, factor * factor % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from every position on, by doubling."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(parts: list[bytes], length: int = LENGTH, seek: bool = True) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: the part, the first string's start in it, the number of strings, the anchor's
    hash, and whether it may occur twice within one of the strings.

    The lowest bits of a hash make room for the place of the anchor; equal strings may so take different anchors of
    equal hash, which is all that counts. Where the places count downwards another anchor wins if there are several;
    this is looked into only if ``seek`` says so.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    h = rolling(data, ANCHOR) & ~PLACE
    place = np.arange(len(h), dtype=np.uint64) & PLACE
    low = least(h | place, length - ANCHOR + 1)
    several = (low ^ least(h | (PLACE - place), length - ANCHOR + 1)) != PLACE if seek else np.zeros(len(low), bool)
    offsets = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(parts)), np.maximum(sizes - length + 1, 0))
    if not len(part):
        return none, none, none, none, none
    per = np.maximum(sizes - length + 1, 0)
    start = np.arange(len(part)) - np.repeat(np.cumsum(per) - per, per)
    where = offsets[part] + start
    at = low[where]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
    twice = np.logical_or.reduceat(several[where], first)
    return part[first], start[first], np.diff(np.append(first, len(part))), (at[first] >> np.uint64(7)).astype(np.int64), twice


def blocks(texts: list[bytes], length: int, size: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, or overlapping blocks of long ones, in groups of about ``size`` bytes: their numbers, offsets and bytes."""
    rows, bases, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        for base in range(0, max(1, len(text) - length + 1), size):
            part = text[base : base + size + length - 1]
            rows.append(i)
            bases.append(base)
            parts.append(part)
            held += len(part)
            if held >= size:
                yield rows, bases, parts
                rows, bases, parts, held = [], [], [], 0
    if rows:
        yield rows, bases, parts


def passages(texts: list[bytes], length: int = LENGTH, size: int = BLOCK, seek: bool = False):
    """Per group of blocks: rows, starts in the whole text, anchor hashes, whether the anchor may occur twice in a
    string, and the bytes of each run."""
    for rows, bases, parts in blocks(texts, length, size):
        part, start, count, h, twice = anchors(parts, length, seek)
        rows, bases = np.array(rows)[part], np.array(bases)[part]
        yield rows, bases + start, h, twice, lambda i, p=part, s=start, c=count, t=parts: t[p[i]][s[i] : s[i] + c[i] + length - 1]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one a byte later; the last is not (the end is smaller than any byte)."""
    step = np.append(np.sign(text[1:].astype(np.int16) - text[:-1]), -1)
    place = np.where(step != 0, np.arange(len(step)), len(step))
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of ``text`` in order of their first ``depth`` bytes at least.

    Stage one sorts directly the suffixes that are smaller than their successors. Stage two scans the buckets of
    first bytes upwards: a suffix in a bucket puts the suffix one byte longer into its own bucket if that one is
    greater. In a bucket those come before the directly sorted ones.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    direct = np.flatnonzero(smaller_than_next(text))
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct])
    array = pa.FixedSizeBinaryArray.from_buffers(pa.binary(depth), len(direct), [None, pa.py_buffer(keys)])
    direct = direct[pc.sort_indices(array).to_numpy()] if len(direct) else direct
    del keys, array
    edges = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        bucket = []
        front = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(front):
            bucket.append(front)
            front = front[front > 0] - 1
            front = front[text[front] == byte]
        waiting[byte] = []
        bucket.append(direct[edges[byte] : edges[byte + 1]])
        done = np.concatenate(bucket)
        if not len(done):
            continue
        out.append(done)
        before = done[done > 0] - 1
        first = text[before]
        before, first = before[first > byte], first[first > byte]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        values, starts = np.unique(first, return_index=True)
        for value, piece in zip(values, np.split(before, starts[1:])):
            waiting[value].append(piece)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the one before it, up to ``depth``; 0 for the first.

    Eight bytes are compared at a time; suffixes here have ``depth`` bytes or more."""
    out = np.zeros(len(order), np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(len(text), np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(text)]
    left = np.arange(1, len(order))
    for at in range(0, depth, 8):
        if not len(left):
            break
        differ = words[order[left - 1] + at] ^ words[order[left] + at]
        out[left] += np.where(differ == 0, 8, 0)
        odd = differ != 0
        if odd.any():
            lead = 63 - np.floor(np.log2(np.maximum(differ[odd].astype(np.float64), 1.0))).astype(np.int64)
            out[left[odd]] += np.maximum(lead, 0) // 8
        left = left[~odd]
    return np.minimum(out, depth)


def repeats(segments: list[bytes], rank: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the strings of the segments, in order, whether an equal one stands earlier by (rank, start)."""
    sizes = np.array([len(s) for s in segments], np.int64)
    counts = sizes - length + 1
    offsets = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    inside = np.arange(int(counts.sum())) - np.repeat(first, counts)
    time = np.repeat((rank << 40) + start, counts) + inside
    text = np.frombuffer(b"".join(segments), np.uint8)
    number = np.full(len(text), -1, np.int64)
    number[np.repeat(offsets, counts) + inside] = np.arange(len(time))
    order = suffix_array(text, length)
    order = order[number[order] >= 0]
    group = np.cumsum(common_prefixes(text, order, length) < length) - 1
    strings = number[order]
    earliest = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max) if len(group) else np.zeros(0, np.int64)
    np.minimum.at(earliest, group, time[strings])
    out = np.zeros(len(time), bool)
    out[strings] = time[strings] > earliest[group]
    return out


def runs(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags inside blocks of ``counts`` flags: the block, the first and the number of flags of each."""
    block = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(flags)) - np.repeat(np.cumsum(counts) - counts, counts)
    edge = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
    begin = np.flatnonzero(flags & (edge | ~np.concatenate([[False], flags[:-1]]))) if len(flags) else np.zeros(0, np.int64)
    stop = np.flatnonzero(flags & np.append(edge[1:] | ~flags[1:], True)) if len(flags) else begin
    return block[begin], at[begin], stop - begin + 1


SPAN = "kind int, absent boolean, doc_id bigint, tie bigint, start bigint, end bigint, string binary"


def sorted_task(batches, length: int):
    """The removed runs of a task's passages (kind 0), and of anchors dealt over several tasks the strings that are
    first here (kind 1)."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    doc = table.column("doc_id")
    absent = np.array(doc.is_null())
    ids, ties = doc.fill_null(0).to_numpy(), table.column("tie").to_numpy()
    starts, hot = table.column("start").to_numpy(), table.column("hot").to_numpy()
    segments = table.column("segment").to_pylist()
    by_doc = np.lexsort((ties, ids, absent))
    key = np.stack([absent, ids, ties])[:, by_doc]
    rank = np.empty(len(ids), np.int64)
    rank[by_doc] = np.cumsum(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) - 1
    # passages alike in all bytes are sorted once, for their earliest
    earliest, copy = {}, np.empty(len(ids), np.int64)
    for i in np.lexsort((starts, rank)).tolist():
        copy[i] = earliest.setdefault(segments[i], i)
    firsts = np.array(sorted(earliest.values()))
    flags = repeats([segments[i] for i in firsts], rank[firsts], starts[firsts], length)
    counts = np.array([len(segments[i]) for i in firsts], np.int64) - length + 1
    block, at, n = runs(flags, counts)
    later = np.flatnonzero((copy != np.arange(len(ids))) & ((rank != rank[copy]) | (starts != starts[copy])))
    whole = np.array([len(segments[i]) for i in later], np.int64)
    rows = np.concatenate([firsts[block], later])
    begin = np.concatenate([starts[firsts[block]] + at, starts[later]])
    end = np.concatenate([starts[firsts[block]] + at + n + length - 1, starts[later] + whole])
    yield spans(0, rows, absent, ids, ties, begin, end, None)
    if hot.any():
        seg = np.repeat(np.arange(len(firsts)), counts)
        inside = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
        left = np.flatnonzero(~flags & hot[firsts[seg]])
        strings = [
            hashlib.blake2b(segments[firsts[s]][i : i + length], digest_size=16).digest()
            for s, i in zip(seg[left].tolist(), inside[left].tolist())
        ]
        rows, begin = firsts[seg[left]], starts[firsts[seg[left]]] + inside[left]
        yield spans(1, rows, absent, ids, ties, begin, begin + length, strings)


def spans(kind, rows, absent, ids, ties, begin, end, strings) -> pa.RecordBatch:
    n = len(rows)
    columns = [
        pa.array(np.full(n, kind, np.int32)), pa.array(absent[rows].astype(bool)), pa.array(ids[rows], mask=absent[rows].astype(bool)),
        pa.array(ties[rows]), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64)),
        pa.nulls(n, pa.binary()) if strings is None else pa.array(strings, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "absent", "doc_id", "tie", "start", "end", "string"])


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def compressed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` as zstd frames, for the two joins that move it."""

    def work(batches):
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            frames = pa.array([tool.compress(t) for t in _bytes(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), frames], names=["doc_id", "tie", "text"])

    return rows.mapInArrow(work, "doc_id bigint, tie bigint, text binary")


def _plain(column: pa.Array) -> list[bytes]:
    tool = zstandard.ZstdDecompressor()
    return [tool.decompress(t) for t in column.to_pylist()]


def shared_anchors(rows: DataFrame, length: int, per_anchor: int) -> DataFrame:
    """Anchors that occur twice or more: ``h``, their number ``n`` and over how many tasks they are dealt, ``tasks``."""

    def work(batches):
        for batch in batches:
            for _, _, h, twice, _ in passages(_bytes(batch.column("text")), length, seek=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, 1 + twice))], names=["h"])

    counts = rows.select("text").mapInArrow(work, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    dealt = counts.filter("n > 1").withColumn("tasks", F.ceil(F.col("n") / per_anchor).cast("int"))
    return written(dealt, "suffix-anchors")


def removed_spans(rows: DataFrame, length: int, per_task: int, per_anchor: int) -> DataFrame:
    """Removed runs (``doc_id``, ``tie``, ``start``, ``end``) of rows with ``doc_id``, ``tie``, ``text``; they may overlap."""
    shared = shared_anchors(rows, length, per_anchor)
    found = shared.agg(F.sum("n"), F.max("tasks")).first()
    tasks = max(shuffle_width(rows.sparkSession), -(-(found[0] or 0) // per_task))

    def marks(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, _, h, _, _ in passages(_bytes(batch.column("text")), length):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(h)], names=["doc_id", "h"])

    held = rows.select("doc_id", "text").mapInArrow(marks, "doc_id bigint, h bigint").join(shared, "h")
    wanted = held.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set(F.struct("h", "tasks")).alias("anchors"))

    def cut(batches):
        for batch in batches:
            texts = _plain(batch.column("text"))
            lists = batch.column("anchors")
            edges = lists.offsets.to_numpy()
            known, parts = (lists.values.field(i).to_numpy() for i in (0, 1))
            tie = batch.column("tie").to_numpy()
            for at, start, h, _, segment in passages(texts, length):
                keep, deal = [], []
                for row in np.unique(at).tolist():
                    own = slice(edges[row], edges[row + 1])
                    order = np.argsort(known[own])
                    sorted_h = known[own][order]
                    mine = np.arange(*np.searchsorted(at, [row, row + 1]))
                    place = np.minimum(np.searchsorted(sorted_h, h[mine]), max(len(sorted_h) - 1, 0))
                    hit = sorted_h[place] == h[mine] if len(sorted_h) else np.zeros(len(mine), bool)
                    keep.append(mine[hit])
                    deal.append(parts[own][order][place[hit]])
                if not keep:
                    continue
                keep, deal = np.concatenate(keep), np.concatenate(deal).astype(np.int64)
                rows_ = at[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[keep] * 1_000_003 + (tie[rows_] ^ start[keep]) % deal),
                        pa.array(deal > 1),
                        batch.column("doc_id").take(pa.array(rows_)),
                        pa.array(tie[rows_]),
                        pa.array(start[keep]),
                        pa.array([segment(i) for i in keep.tolist()], pa.binary()),
                    ],
                    names=["target", "hot", "doc_id", "tie", "start", "segment"],
                )

    schema = "target bigint, hot boolean, doc_id bigint, tie bigint, start bigint, segment binary"
    segments = compressed(rows).join(wanted, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "tie", "text", "anchors").mapInArrow(cut, schema)
    sorted_ = segments.repartition(tasks, "target").mapInArrow(lambda batches: sorted_task(batches, length), SPAN)
    if (found[1] or 0) <= 1:
        return sorted_.select("doc_id", "tie", "start", "end")
    sorted_ = written(sorted_, "suffix-spans")
    # strings of anchors that were dealt over several tasks: the first of each task meet once more
    left = sorted_.filter("kind = 1")
    place = F.struct("absent", "doc_id", "tie", "start")
    earliest = left.groupBy("string").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = left.join(earliest, "string").filter(~place.eqNullSafe(F.col("first")))
    return sorted_.filter("kind = 0").unionByName(again.select(*sorted_.columns)).select("doc_id", "tie", "start", "end")


def deduplicated(
    docs: DataFrame, length: int = LENGTH, per_task: int = PER_TASK, per_anchor: int = PER_ANCHOR
) -> DataFrame:
    """Every document (``doc_id``, ``text``) without the bytes of strings of ``length`` bytes that also start earlier.

    Earlier is a smaller doc_id (null last) or an earlier start in the same document; rows with one doc_id go by a
    hash of their text, and rows alike in both count as one document and do not remove each other. Strings are
    judged on the input. Returns ``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs, ``start`` and ``end``)
    and ``kept`` (the remaining bytes, which may cut characters). A null text is empty; other columns are not read;
    an empty table gives an empty result.
    """
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("tie"), text.alias("text"))
    found = removed_spans(rows, length, per_task, per_anchor)
    per_doc = found.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("tie", "start", "end")).alias("found"))

    def assemble(batches):
        for batch in batches:
            texts, ties = _plain(batch.column("text")), batch.column("tie").to_numpy()
            lists = batch.column("found")
            edges, valid = lists.offsets.to_numpy(), np.array(lists.is_valid())
            tie, start, end = (lists.values.field(i).to_numpy() for i in range(3))
            kept, merged = [], []
            for i, text in enumerate(texts):
                own = np.arange(edges[i], edges[i + 1]) if valid[i] else np.zeros(0, np.int64)
                own = own[tie[own] == ties[i]]
                joined, out, at = [], [], 0
                for a, b in sorted(zip(start[own].tolist(), end[own].tolist())):
                    if joined and a <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], b)
                    else:
                        joined.append({"start": a, "end": b})
                for s in joined:
                    out.append(text[at : s["start"]])
                    at = s["end"]
                kept.append(b"".join([*out, text[at:]]))
                merged.append(joined)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = compressed(rows).join(per_doc, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "tie", "text", "found")
    return joined.mapInArrow(
        assemble, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    )
