"""Mixing sources to target weights: repetition rates per source, whole copies and one hash-seeded draw for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import hash48
from .common import find, shuffle_width, text_of, word_count, written

#: Weights by place of the source in code-point order, repeating; a source is repeated at most so often.
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"


def numbered(sources: DataFrame) -> DataFrame:
    """``place`` of every source in code-point order from 0, null last, without sorting all in one task.

    Sources are ranged over partitions; the partitions' counts (one row each) give the offsets.
    """
    spark = sources.sparkSession
    ranged = sources.repartitionByRange(shuffle_width(spark), F.col("source").asc_nulls_last())
    parts = written(ranged.withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return (
        parts.withColumn("inside", inside)
        .join(F.broadcast(offsets), "part")
        .select("source", "source_size", (F.col("offset") + F.col("inside") - 1).alias("place"))
    )


def water_level(sources: DataFrame, max_rate: float) -> float:
    """The words per unit of weight at which all targets, each stopped at ``max_rate`` times its source, add up to all words.

    A step gives what the stopped sources leave to the others by weight; steps end when no further source is
    stopped. Only totals come to the driver.
    """
    cap, level, stopped = F.lit(float(max_rate)) * F.col("source_size"), 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        n, words, held, weight = sources.agg(
            F.count_if(above), F.sum("source_size"), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == stopped or not weight:
            return level
        stopped, level = n, (float(words or 0) - float(held or 0.0)) / float(weight)


def rates(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """Per source its words, target and repetition rate, from rows with ``source`` and ``size``."""
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = written(numbered(totals).withColumn("weight", weight), "mix-weights")
    level = water_level(placed, max_rate)
    target = F.least(F.col("weight") * F.lit(level), F.lit(float(max_rate)) * F.col("source_size"))
    rated = placed.select("source", "source_size", target.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return written(rated.withColumn("rate", rate), "mix-rates")


def draw(size: Column, seed: str = SEED) -> Column:
    """Copies of a document: floor(rate), and one more if its hash falls below the fraction."""
    whole = F.floor("rate")
    u = hash48(F.lit(seed), F.col("doc_id"), F.col("source"), size) / F.lit(float(2**48))
    return (whole + (u < F.col("rate") - whole).cast("bigint")).cast("bigint")


def shares(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE, seed: str = SEED
) -> DataFrame:
    """The share of every document (``doc_id``, ``text``, ``source``) in the mixture, one row per row.

    Returns ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target``, ``rate``, ``copies``, ``taken``.
    A null text has no words; a null source is a source of its own, last in order; the draw hashes the seed, the
    doc_id, the source and the size (nulls left out), so repeated rows are drawn alike and reruns agree. With no
    words at all every target and rate is 0. Other columns are not read.
    """
    sized = written(
        docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), word_count(text_of()).alias("size")),
        "mix-sizes",
    )
    rated = find(sized, rates(sized, weights, max_rate), ["source"], F.struct("doc_id", "size"))
    return rated.withColumn("copies", draw(F.col("size"), seed)).withColumn("taken", F.col("copies") * F.col("size"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE, seed: str = SEED
) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as ``shares`` says, with its own columns.

    Columns named like results of ``shares`` are passed on untouched. Documents with no copy are left out.
    """
    size = word_count(text_of("d.text"))
    held = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("bigint"), F.col("source").cast("string"))
    sized = held.select("source", size.alias("size"))
    rated = find(held, rates(sized, weights, max_rate), ["source"], F.col("d.doc_id"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return rated.withColumn("copies", draw(size, seed)).filter("copies > 0").select("d", copies).select("d.*")


SHARES_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM sources
), weighted AS (
  SELECT *, CASE place % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END::DOUBLE AS weight,
         {MAX_RATE}::DOUBLE * source_size AS cap
  FROM placed
), filled AS (
  SELECT *,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
         row_number() OVER (ORDER BY cap / weight, place) AS step
  FROM weighted
  WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levelled AS (
  SELECT arg_min(level, step) FILTER (weight * level <= cap) AS level FROM filled
), rated AS (
  SELECT source, source_size, least(weight * levelled.level, cap) AS target FROM weighted, levelled
), drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, sized.source, size::VARCHAR)), 1, 12))::BIGINT
         / {float(2**48)} AS u
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + (u < rate - floor(rate))::INT) * size)::BIGINT AS taken
FROM drawn
"""
