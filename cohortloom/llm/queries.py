"""One query per corpus operator over its whole table, and its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    html_extract, mixing, negatives, packing, pii, prefix_trie, quality, sharding, simhash, suffix_dedup, token_counts, token_planes, winnowing,
)
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(table(spark, sf_dir, "documents"))
    return made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii.session_key(spark))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.shares(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compared(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-planes")
    token_planes.write(table(spark, sf_dir, "documents"), path)
    return token_planes.read_documents(spark, path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(finite).select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"),
        (F.col("vec_id") % 50 == 0).alias("anchor"),
    )
    return negatives.hard_negatives(rows)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_winnowing": op5_winnowing,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_html_extract": op10_html_extract,
    "op11_token_planes": op11_token_planes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL = {
    "op3_mixing": mixing.SHARES_SQL,
    "op9_sharding": sharding.SHARDS_SQL,
    "op12_hard_negatives": negatives.NEGATIVES_SQL,
    "op13_prefix_trie": prefix_trie.TRIE_SQL,
}
