"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints are compared under 2**(radius+1) - 1 structured bit masks. Every bit position carries a vector of
radius + 1 bits; the mask of a nonzero vector v keeps the positions whose vector has an odd overlap with v. Up to
``radius`` differing positions span less than the whole space, so some v is orthogonal to all of them and its mask
keeps none of them: every pair within the radius agrees under some mask.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

SHINGLE = 3
RADIUS = 3
BITS = 64
HASH_SEED = 42
#: Distinct fingerprints of one bucket that a task compares at once; larger buckets are compared block by block.
BLOCK = 4096
CHUNK = 1_000_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: lower-cased A-Z, words between ASCII white space, shingles with repeats."""
    data = b" ".join(text.encode().lower().split())
    if not data:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(ends))
    pairs = zip(starts[: len(ends) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], HASH_SEED) for a, b in pairs), np.uint64, len(ends) - width + 1)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(rows: DataFrame, text: Column, shingle: int, name: str = "fp") -> DataFrame:
    """``rows`` with the fingerprint of ``text`` as a signed long."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return rows.withColumn(name, prints(text))


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks. Positions take the nonzero vectors in turn, so all masks keep about half of the bits."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def near(fps: np.ndarray, radius: int) -> np.ndarray:
    """Per fingerprint the index of the first one it is linked with, directly or through others among ``fps``.

    Whatever is found leaves the rest, so a bucket of near copies takes a few passes, not all its pairs.
    """
    label = np.arange(len(fps))
    rest = np.arange(len(fps))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = [seed]
        while front and len(rest):
            hit = np.bitwise_count(fps[rest] ^ fps[front.pop()]) <= radius
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                label[found] = seed
                front += found.tolist()
    return label


def links(buckets: pa.Array, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of fingerprints inside each bucket: a forest with the bucket's links, not all its pairs."""
    offsets = buckets.offsets.to_numpy()
    fps = buckets.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    lows, highs = [], []
    twos = offsets[:-1][sizes == 2] - offsets[0]
    fps = fps[offsets[0] : offsets[-1]].view(np.uint64)
    a, b = fps[twos], fps[twos + 1]
    close = np.bitwise_count(a ^ b) <= radius
    lows.append(a[close])
    highs.append(b[close])
    for at, n in zip((offsets[:-1] - offsets[0])[sizes > 2], sizes[sizes > 2]):
        own = fps[at : at + n]
        label = near(own, radius)
        linked = label != np.arange(n)
        lows.append(own[label[linked]])
        highs.append(own[linked])
    return np.concatenate(lows).view(np.int64), np.concatenate(highs).view(np.int64)


def edges(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (``a``, ``b``) that connect exactly the distinct fingerprints (``fp``) within ``radius`` bits.

    Buckets are counted first (partial counts before the shuffle) and single ones go. A bucket over ``block`` is
    dealt over blocks by hash and every pair of its blocks is compared in a task of its own, so no task holds
    more than two blocks of a bucket.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select(
        "fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key")
    )
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(F.col("own"), j).alias("p"), F.greatest(F.col("own"), j).alias("q")),
    )
    dealt = (
        keyed.join(shared, ["t", "key"])
        .select("t", "key", "fp", blocks.alias("blocks"), own.alias("own"))
        .select("t", "key", "fp", F.explode(pairs).alias("pq"))
    )
    gathered = dealt.groupBy("t", "key", "pq").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select("fps")

    def work(batches):
        for batch in batches:
            a, b = links(batch.column("fps"), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return gathered.mapInArrow(work, "a bigint, b bigint").distinct()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def components(links_: DataFrame) -> DataFrame:
    """The linked nodes (``fp``) and the least node (``root``) that each can reach.

    Every round each node takes the least root among its neighbours and itself, and then the root of that root,
    so the rounds grow with the logarithm of the longest chain. A round ends in a written table; only the number
    of changes comes to the driver.
    """
    both = written(links_.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links_.select("b", "a")), "simhash-links")
    labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("fp"), F.least("u", "v").alias("root")), "simhash-roots")
    while True:
        seen = both.join(labels.select(F.col("fp").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("seen"))
        nearer = labels.join(seen.withColumnRenamed("u", "fp"), "fp").select(
            "fp", F.col("root").alias("was"), F.least("root", "seen").alias("next")
        )
        nearer = written(nearer, "simhash-nearer")
        jump = nearer.select(F.col("fp").alias("next"), F.col("next").alias("beyond"))
        labels = written(
            nearer.join(jump, "next").select("fp", F.least("next", "beyond").alias("root"), (F.col("was") != F.least("next", "beyond")).alias("moved")),
            "simhash-roots",
        )
        if labels.filter("moved").isEmpty():
            return labels.select("fp", "root")
        labels = labels.select("fp", "root")


def grouped(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """The component of every distinct fingerprint of written rows with ``fp`` and ``doc_id``: ``fp``,
    ``component_id`` (the least doc_id in it)."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(edges(distinct, radius, block))
    rooted = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Per document (``doc_id``, ``text``) its ``fingerprint`` (16 hex digits) and ``component_id``, the least doc_id
    reachable over links of at most ``radius`` differing bits.

    Equal fingerprints meet once, so copies are not compared. A text without words has fingerprint zero and links
    like any other; a null text is empty. Null doc_ids take part and get the least doc_id of their component, null
    if all are null; repeated doc_ids and rows stay. Other columns are not read; an empty table gives an empty result.
    """
    rows = with_fingerprint(docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")), F.col("text"), shingle)
    prints = written(rows.select("doc_id", "fp"), "simhash-prints")
    joined = prints.join(grouped(prints, radius, block), "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` per component, the one with the least doc_id (nulls last), with its own columns whatever
    their names. Among rows equal in that, the first in the written order stays."""
    rows = docs.select(
        F.struct("*").alias("d"), F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row")
    )
    kept = written(with_fingerprint(rows, text_of("d.text"), shingle), "simhash-texts")
    places = written(kept.select("doc_id", "row", "fp"), "simhash-places")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    chosen = (
        places.join(grouped(places, radius, block).select("fp", "root"), "fp")
        .groupBy("root")
        .agg(F.min(order).alias("first"))
        .select(F.col("first.row").alias("row"))
    )
    return kept.join(chosen, "row", "left_semi").select("d.*")
