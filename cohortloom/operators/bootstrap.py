"""Stratified bootstrap of the AUC: draws per distinct score, not per sample.

Redrawing a class to its own size gives each distinct score a multinomial number of draws. It is found by descent: the
draws of a range of scores are split between its halves by a binomial number, seeded by a hash of (class, replicate,
range), from the whole range down to single scores. The work is replicates x distinct scores. Ranges of up to 2**height
scores are blocks, a row each; the draws that reach a block are split on in its own task for all replicates at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .roc import KEYS, score_counts
from .scale import BUCKETS, bucketed, keep, running_sums

REPLICATES = 1000
#: A key has so many blocks at most; a block has at least 2**LEAST scores.
BLOCKS, LEAST = 4096, 6
#: Replicates of a key that one row deals out.
SHARE = 125
#: Up to this variance a binomial number is found from its distribution, over so many steps; beyond, from a normal one.
EXACT, STEPS = 9.0, 64


def uniforms(tags: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers below 1 from the md5 of each tag, 48 bits each."""
    raw = [hashlib.md5(t.encode()).digest() for t in tags]
    pick = lambda a: np.array([int.from_bytes(d[a : a + 6], "big") for d in raw], np.float64) / 2.0**48
    return pick(0), pick(6)


def binomials(n: np.ndarray, share: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Binomial numbers from uniform ones: by inversion if their variance is small, else from a normal number with a
    term for skewness, in whole numbers from 0 to ``n``."""
    low = share <= 0.5
    p = np.where(low, share, 1.0 - share)
    q, variance = 1.0 - p, n * p * (1.0 - p)
    out = np.zeros(len(n), np.int64)
    few = variance <= EXACT
    if few.any():
        m, a, b, t = n[few].astype(np.float64), p[few], q[few], u[few]
        mass = np.power(b, m)
        sums, k = mass.copy(), np.zeros(len(m), np.int64)
        for i in range(1, STEPS + 1):
            more = (sums < t) & (i <= m)
            if not more.any():
                break
            k[more] = i
            mass = mass * (m - i + 1) / i * (a / b)
            sums = sums + mass
        out[few] = k
    if not few.all():
        m, a, b = n[~few].astype(np.float64), p[~few], q[~few]
        z = np.sqrt(-2.0 * np.log(np.maximum(u[~few], 2.0**-48))) * np.cos(2.0 * np.pi * v[~few])
        k = np.floor(m * a + np.sqrt(variance[~few]) * z + (b - a) * (z * z - 1.0) / 6.0 + 0.5)
        out[~few] = np.clip(k, 0, m).astype(np.int64)
    return np.where(low, out, n - out)


def split(draws: np.ndarray, before: np.ndarray, tag: str, replicates: np.ndarray, height: int, first: int, steps: int) -> np.ndarray:
    """Draws (one row per replicate, one range) split ``steps`` times in halves.

    ``before`` are running counts of the class at the bounds of the ranges wanted, 2**steps + 1 of them. The range is
    number ``first`` of those of 2**``height`` scores.
    """
    held = draws[:, None]
    for step in range(1, steps + 1):
        wide = 1 << (steps - step)
        bounds = before[:: wide]
        counts = np.diff(bounds)
        left, both = counts[::2], counts[::2] + counts[1::2]
        share = np.divide(left, both, out=np.zeros(len(left)), where=both > 0)
        now = np.zeros(held.shape, np.int64)
        now[:, share >= 1] = held[:, share >= 1]
        open_ = (held > 0) & (share > 0) & (share < 1)
        r, j = np.nonzero(open_)
        at = (first << (step - 1)) + j
        tags = [f"{tag}|{replicates[x]}|{height - step + 1}|{y}" for x, y in zip(r.tolist(), at.tolist())]
        u, v = uniforms(tags)
        now[r, j] = binomials(held[r, j], share[j], u, v)
        held = np.stack([now, held - now], 2).reshape(len(held), -1)
    return held


def _blocks(ranked: DataFrame, keys) -> DataFrame:
    """A row per key and block: ``block``, its scores' counts in order, and the key's ``height`` and ``top``.

    ``top`` is the height of the key's whole range, ``height`` that of its blocks.
    """
    exponent = lambda n: F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    top = exponent(F.col("total_one"))
    height = F.greatest(F.lit(LEAST), top - F.lit(BLOCKS.bit_length() - 1))
    placed = ranked.select(
        *keys, top.alias("top"), height.alias("height"), F.col("before_one").alias("i"), "pos", "neg",
        F.col("total_pos").alias("size_pos"), F.col("total_neg").alias("size_neg"),
    )
    place = F.struct("i", "pos", "neg")
    return (
        placed.withColumn("block", F.expr("shiftright(i, height)"))
        .groupBy(*keys, "top", "height", "block", "size_pos", "size_neg")
        .agg(F.sort_array(F.collect_list(place)).alias("_c"))
        .select(*keys, "top", "height", "block", "size_pos", "size_neg", F.col("_c.pos").alias("pos"), F.col("_c.neg").alias("neg"))
    )


def _running(counts: list[int], size: int) -> np.ndarray:
    out = np.zeros(size + 1, np.int64)
    out[1 : len(counts) + 1] = counts
    return np.cumsum(out)


def _dealt(blocks: DataFrame, keys, replicates: int) -> DataFrame:
    """Draws of every replicate and class per block: ``draws_pos`` and ``draws_neg``, arrays over the replicates from
    ``first`` on, ``SHARE`` of them a row."""
    sums = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    each = F.struct("block", sums("pos").alias("pos"), sums("neg").alias("neg"))
    whole = blocks.groupBy(*keys, "top", "height", "size_pos", "size_neg").agg(F.sort_array(F.collect_list(each)).alias("b"))
    tag = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    starts = F.sequence(F.lit(1), F.lit(replicates), F.lit(SHARE))
    rows = whole.select(F.struct(*keys).alias("key"), tag.alias("tag"), "top", "height", "size_pos", "size_neg", "b", F.explode(starts).alias("first"))
    # draws take time, not bytes: a few rows must not be one task
    rows = rows.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "first")

    def work(batches):
        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):
                steps = max(0, row["top"] - row["height"])
                numbers = np.arange(row["first"], min(row["first"] + SHARE, replicates + 1))
                out = {}
                for name, label in (("pos", 1), ("neg", 0)):
                    start = np.full(len(numbers), row[f"size_{name}"], np.int64)
                    before = _running([b[name] for b in row["b"]], 1 << steps)
                    out[name] = split(start, before, f"{row['tag']}|{label}", numbers, row["top"], 0, steps)
                n = len(row["b"])
                key = batch.column("key").slice(at, 1).take(pa.array([0] * n))
                lists = [pa.array(out[c][:, :n].T.tolist(), pa.list_(pa.int64())) for c in ("pos", "neg")]
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(range(n), pa.int64()), pa.array([row["first"]] * n, pa.int32()), *lists],
                    names=["key", "block", "first", "draws_pos", "draws_neg"],
                )

    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)
    dealt = rows.mapInArrow(work, f"key struct<{kinds}>, block bigint, first int, draws_pos array<bigint>, draws_neg array<bigint>")
    return dealt.select("key.*", "block", "first", "draws_pos", "draws_neg")


def bootstrap_auc(
    predictions: DataFrame, replicates: int = REPLICATES, keys=KEYS, buckets: int = BUCKETS
) -> DataFrame:
    """AUC of every replicate, NULL if a class is absent.

    A block yields per replicate its draws of either class and the pairs won inside it; pairs between blocks follow
    from the sums, so no score leaves its block.
    """
    counted = keep(score_counts(predictions, keys).withColumn("one", F.lit(1)))
    ranked = running_sums(bucketed(counted, keys, "score", buckets), keys, "score", ["pos", "neg", "one"])
    blocks = keep(_blocks(ranked, keys))
    dealt = keep(_dealt(blocks, keys, replicates))
    tag = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    # draws take time, not bytes: small partitions are not to be put together
    width = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = blocks.join(dealt, [*keys, "block"]).repartition(width, *keys, "block", "first").select(
        F.struct(*keys).alias("key"), tag.alias("tag"), "top", "height", "block", "first", "pos", "neg", "draws_pos", "draws_neg"
    )
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)

    def work(batches):
        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):
                steps, numbers = min(row["top"], row["height"]), np.arange(row["first"], row["first"] + len(row["draws_pos"]))
                drawn = {}
                for name, label in (("pos", 1), ("neg", 0)):
                    before = _running(row[name], 1 << steps)
                    start = np.array(row[f"draws_{name}"], np.int64)
                    drawn[name] = split(start, before, f"{row['tag']}|{label}", numbers, steps, row["block"], steps)
                pos, neg = drawn["pos"].astype(np.float64), drawn["neg"].astype(np.float64)
                won = (pos * (np.cumsum(neg, 1) - neg / 2.0)).sum(1)
                key = batch.column("key").slice(at, 1).take(pa.array([0] * len(numbers)))
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(numbers.astype(np.int32)), pa.array([row["block"]] * len(numbers), pa.int64()), pa.array(pos.sum(1)), pa.array(neg.sum(1)), pa.array(won)],
                    names=["key", "replicate", "block", "pos", "neg", "won"],
                )

    parts = met.mapInArrow(work, f"key struct<{kinds}>, replicate int, block bigint, pos double, neg double, won double")
    each = F.sort_array(F.collect_list(F.struct("block", "pos", "neg", "won")))
    start = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(0.0).alias("won"))
    total = F.aggregate(each, start, lambda s, x: F.struct(
        (s["pos"] + x["pos"]).alias("pos"), (s["neg"] + x["neg"]).alias("neg"), (s["won"] + x["won"] + x["pos"] * s["neg"]).alias("won")
    ))
    sums = parts.groupBy("key", "replicate").agg(total.alias("t"))
    return sums.select("key.*", "replicate", (F.col("t.won") / F.nullif(F.col("t.pos") * F.col("t.neg"), F.lit(0.0))).alias("auc"))


def bootstrap_auc_ci(
    predictions: DataFrame, replicates: int = REPLICATES, keys=KEYS, buckets: int = BUCKETS
) -> DataFrame:
    """2.5, 50 and 97.5 % quantiles over the replicates."""
    at = lambda q: F.percentile("auc", F.lit(q))
    return (
        bootstrap_auc(predictions, replicates, keys, buckets)
        .filter(F.col("auc").isNotNull())
        .groupBy(*keys)
        .agg(at(0.025).alias("low"), at(0.5).alias("mid"), at(0.975).alias("high"), F.count("auc").alias("n"))
    )
