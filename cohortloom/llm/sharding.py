"""Sharding by extendible hashing: only buckets over the byte limit take another bit of the hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import find, text_of, written

#: Bytes of text per shard.
LIMIT_BYTES = 32 * 1024 * 1024
#: Bits that one pass over the buckets still too large looks at.
STEP = 12
#: Bits from the content; as many more come from the row number and are reached by repeated rows only.
HASH_BITS = 60


def bit_string(key: Column) -> Column:
    """The first 60 bits of an md5 as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 2), HASH_BITS, "0")


def bit_string_of(doc_id: str, text: str) -> Column:
    """The hash bits of a document's doc_id and text."""
    return bit_string(F.concat_ws("|", F.col(doc_id).cast("string"), F.md5(text_of(text).cast("binary"))))


def first_bits(bits: Column, depth: Column | int) -> Column:
    return F.substring(bits, F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def leaf_depths(active: DataFrame, depth: int, low: int, limit: int) -> DataFrame:
    """Per cell of ``low`` bits the first depth at which its bucket fits; null if none down to ``low`` does.

    Bytes are summed per cell before anything else, so a pass shuffles cells, not rows.
    """
    cells = active.groupBy(first_bits(F.col("bits"), low).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
    cells = written(cells, "shard-cells")
    above = cells.select(
        "cell", "bytes", F.explode(F.sequence(F.lit(depth), F.lit(low))).alias("depth")
    ).withColumn("shard", first_bits(F.col("cell"), F.col("depth")))
    sums = above.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    fits = F.when(F.col("shard_bytes") <= limit, F.struct("depth", "shard_bytes"))
    leaves = above.drop("bytes").join(sums, "shard").groupBy("cell").agg(F.min(fits).alias("leaf"))
    return written(leaves.select("cell", "leaf.depth", "leaf.shard_bytes"), "shard-leaves")


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, step: int = STEP) -> DataFrame:
    """Assign every document (``doc_id``, ``text``) to a shard of at most ``limit`` bytes of text.

    Returns ``doc_id``, ``n_bytes``, ``shard`` (the hash bits that lead to it, empty for an undivided table),
    ``depth`` (their number) and ``shard_bytes``. A bucket is split on one more bit only while it is over the limit,
    so shards at different depths stand side by side and an added document moves only rows of the bucket it bursts.

    The hash takes the doc_id and the text, a null text counting as empty. Rows alike in both share 60 bits; if
    they burst a bucket, further bits come from their row numbers. One row over the limit gets a shard of its
    own. Other columns are not read; an empty table gives an empty result.
    """
    text = text_of()
    own = bit_string_of("doc_id", "text")
    row = bit_string(F.monotonically_increasing_id().cast("string"))
    active = written(
        docs.select(
            F.col("doc_id").cast("bigint"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.concat(own, row).alias("bits")
        ),
        "shard-rows",
    )
    done, depth, last = [], 0, 2 * HASH_BITS
    while True:
        low = min(depth + step, last)
        leaves = leaf_depths(active, depth, low, limit)
        cell = first_bits(F.col("bits"), low)
        placed = find(active.withColumn("cell", cell), leaves, ["cell"], F.col("bits"))
        if low == last:
            placed = placed.withColumn("depth", F.coalesce("depth", F.lit(last))).withColumn(
                "shard_bytes", F.coalesce("shard_bytes", "n_bytes")
            )
        done.append(
            placed.filter(F.col("depth").isNotNull()).select(
                "doc_id",
                "n_bytes",
                first_bits(F.col("bits"), F.col("depth")).alias("shard"),
                F.col("depth").cast("int").alias("depth"),
                F.col("shard_bytes").cast("bigint").alias("shard_bytes"),
            )
        )
        if low == last or leaves.filter("depth IS NULL").isEmpty():
            return reduce(DataFrame.unionByName, done)
        active = written(placed.filter(F.col("depth").isNull()).select("doc_id", "n_bytes", "bits"), "shard-active")
        depth = low


SHARDS_SQL = f"""
WITH sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, ''))) AS key
  FROM documents
), hashed AS (
  SELECT doc_id, n_bytes, lpad(bin(('0x' || substr(md5(key), 1, 15))::BIGINT), {HASH_BITS}, '0') AS bits FROM sized
), buckets AS (
  SELECT depth, left(bits, depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes
  FROM hashed, range({HASH_BITS + 1}) AS d(depth) GROUP BY ALL
), leaves AS (
  SELECT b.* FROM buckets b LEFT JOIN buckets p ON p.depth = b.depth - 1 AND p.shard = left(b.shard, b.depth - 1)
  WHERE b.shard_bytes <= {LIMIT_BYTES} AND (p.shard_bytes IS NULL OR p.shard_bytes > {LIMIT_BYTES})
)
SELECT doc_id, n_bytes, leaves.shard, leaves.depth::INT AS depth, leaves.shard_bytes
FROM hashed JOIN leaves ON starts_with(bits, leaves.shard)
"""
