"""What several corpus operators share: table access, words, and a lookup join that holds for hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written as written_table

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A lookup of at most so many fixed-width rows (a few MB) is sent to every executor.
BROADCAST_ROWS = 50_000
SALTS = 32


#: Drops the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder. What was shuffled to make it is dropped: nothing reads it again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return written_table(df, label)
    finally:
        conf.set(CLEANUP, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string; a null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def kept_columns(df: DataFrame, made: Sequence[str]) -> list[str]:
    """The columns of ``df`` that an operator passes on: its own results win over columns of the same name."""
    own = {c.lower() for c in made}
    return [c for c in df.columns if c.lower() not in own]


def find(rows: DataFrame, lookup: DataFrame, on: Sequence[str], spread: Column, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per key, already written); null keys match null keys.

    Up to BROADCAST_ROWS keys, counted, the lookup goes to every executor and the rows stay where they are.
    Beyond, rows are salted by ``spread`` and each lookup row is repeated per salt, so one key with a third
    of all rows is spread over SALTS tasks.
    """
    names = [c for c in lookup.columns if c not in on]
    side = lookup.select(*[F.col(c).alias(f"_on_{c}") for c in on], *names)
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(side), same, how)
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
        copies = side.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, same & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy")
    return joined.drop(*[f"_on_{c}" for c in on])


def by_size(batches: Iterator[pa.RecordBatch], column: str, chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with about ``chars`` characters of text each (one row at least), and their texts."""
    for batch in batches:
        at, held, texts = 0, 0, []
        for i, value in enumerate(batch.column(column)):
            text = value.as_py() or ""
            texts.append(text)
            held += len(text)
            if held >= chars:
                yield batch.slice(at, i + 1 - at), texts
                at, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(at), texts


def mapped(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


__all__ = [
    "BROADCAST_ROWS", "WORD", "by_size", "find", "kept_columns", "mapped", "shuffle_width", "table", "text_of",
    "word_count", "written",
]
