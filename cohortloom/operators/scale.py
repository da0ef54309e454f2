"""Joins and running sums that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder, written

SMALL_BYTES = 10 * 1024 * 1024
MAX_BROADCAST_ROWS = 500_000
SALTS = 32
BUCKETS = 256


def keep(df: DataFrame, label: str = "kept") -> DataFrame:
    """A table that is read several times, computed once: see :func:`written`."""
    return written(df, label)


def held(df: DataFrame) -> DataFrame:
    """An intermediate step, computed once and cut off from its lineage by a checkpoint in the shared folder.

    Unlike a written table Spark drops it when nothing refers to it any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def planned_bytes(df: DataFrame) -> int:
    """The planner's size estimate, derived from the sizes of the files read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def input_bytes(df: DataFrame) -> int:
    """Bytes of all tables a plan reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def salt_by_row(rows: DataFrame, on: Sequence[str], salts: int):
    """A salt that depends on the row's other columns only, so retries agree."""
    spread = [
        F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        for f in rows.schema.fields
        if f.name not in on
    ]
    return F.pmod(F.xxhash64(*spread), F.lit(salts)) if spread else F.lit(0).cast("bigint")


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join many rows to a lookup with few rows per key.

    A lookup whose planned size is small is broadcast: the estimate is made from
    the sizes of the files it is read from. Otherwise it is counted (written
    first, unless it is cheap to compute again); within ``max_rows`` it is
    broadcast and the rows stay where they are. Beyond that the rows are salted
    by their own content and every lookup row is repeated once per salt, so a key
    with a third of all rows is spread over ``salts`` tasks. ``max_rows=0``
    always salts.
    """
    on = list(on)
    if max_rows and planned_bytes(lookup) <= SMALL_BYTES:
        return rows.join(F.broadcast(lookup), on, how)
    if input_bytes(lookup) > SMALL_BYTES:
        lookup = keep(lookup, "lookup")
    if max_rows and lookup.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(lookup), on, how)
    salted = rows.withColumn("_salt", salt_by_row(rows, on, salts))
    copies = lookup.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def bucketed(rows: DataFrame, keys: Sequence[str], order: str, buckets: int = BUCKETS) -> DataFrame:
    """Cut every key's value range into pieces of about equal row count.

    Edges come from a mergeable quantile sketch (bounded state per key); a row's
    ``_bucket`` is the number of edges below its value, so equal values stay
    together and a large key becomes ``buckets`` independent pieces.
    """
    shares = [F.lit(i / buckets) for i in range(1, buckets)]
    edges = rows.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(order, F.array(*shares), F.lit(4 * buckets))).alias("_edges")
    )
    located = attach(rows, edges, keys, max_rows=MAX_BROADCAST_ROWS // buckets)
    size = F.size("_edges")
    halve = lambda s, mid: F.when(s["a"] >= s["b"], s).when(
        F.get("_edges", mid) < F.col(order), F.struct((mid + 1).alias("a"), s["b"].alias("b"))
    ).otherwise(F.struct(s["a"].alias("a"), mid.alias("b")))
    # edges ascend: their number below a value is found by halving
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(buckets.bit_length())),
        F.struct(F.lit(0).alias("a"), size.alias("b")),
        lambda s, _: halve(s, F.shiftright(s["a"] + s["b"], 1)),
        lambda s: s["a"],
    )
    bucket = F.when(F.col("_edges").isNotNull(), found).otherwise(size)
    return located.withColumn("_bucket", bucket).drop("_edges")


def running_sums(rows: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """Adds ``before_<c>`` and ``total_<c>`` per key for every summed column, and
    ``previous`` (the next lower value of ``order``).

    ``rows`` has one row per key and value and a ``_bucket`` column. Sums per
    bucket are accumulated first (a table of keys x buckets); the row-level
    window is then confined to one bucket.
    """
    parts = rows.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in sums], F.max(order).alias("_top")
    )
    whole = Window.partitionBy(*keys)
    lower = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{c}").over(lower), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in sums],
        F.max("_top").over(lower).alias("_below"),
    )
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, [*keys, "_bucket"]).select(
        *rows.columns,
        *[(F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias(f"before_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
        F.coalesce(F.lag(order).over(inner), F.col("_below")).alias("previous"),
    )


def cumulative(
    rows: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """``bucketed`` then ``running_sums`` over a table that is computed once."""
    return running_sums(bucketed(keep(rows), keys, order, buckets), keys, order, sums)


def exact_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], buckets: int = BUCKETS
) -> DataFrame:
    """Linearly interpolated quantiles, exact at any group size.

    Distinct values with counts replace the rows; a quantile is read off the one
    or two values whose cumulative range holds its positions.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = cumulative(counts, keys, value, ["n"], buckets)
    first, end = F.col("before_n"), F.col("before_n") + F.col("n")
    inside = lambda p: (p >= first) & (p < end)
    places = F.transform(
        F.array(*[F.lit(float(s)) for s in shares]),
        lambda s: F.struct(s.alias("share"), (s * (F.col("total_n") - 1)).alias("at")),
    )
    held = F.filter(places, lambda q: inside(F.floor(q["at"])) | inside(F.ceil(q["at"])))
    hits = ranked.select(*keys, F.col(value).alias("_v"), "before_n", "n", F.explode(held).alias("_q"))
    low, high = F.floor("_q.at"), F.ceil("_q.at")
    return (
        hits.groupBy(*keys, F.col("_q.share").alias("share"))
        .agg(
            F.max(F.when(inside(low), F.col("_v"))).alias("_low"),
            F.max(F.when(inside(high), F.col("_v"))).alias("_high"),
            F.max(F.col("_q.at") - low).alias("_part"),
        )
        .select(*keys, "share", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("cut"))
    )
