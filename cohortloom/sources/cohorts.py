"""Cohort files, their names, and signature lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cohorts(rows: DataFrame, folder: str) -> None:
    """One sub-folder ``<study>`` per cohort. Rows of a study may fill many files."""
    rows.write.partitionBy("cohort").parquet(folder)


def scan_cohorts(spark: SparkSession, folder: str, schema: str | None = None, glob: str = "*.parquet") -> DataFrame:
    """All cohorts below ``folder`` in one scan, tagged with their file's folder name.

    Works for ``cohort=<name>`` folders and for ``<name>.parquet`` files alike.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    rows = (reader.schema(schema) if schema else reader).parquet(folder)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    parts = F.split(plain(F.col("_metadata.file_path")), "/")
    folder_name, file_name = F.element_at(parts, -2), F.element_at(parts, -1)
    tag = (
        F.when(folder_name.startswith("cohort="), plain(F.regexp_replace(folder_name, "^cohort=", "")))
        .when(folder_name.endswith(".parquet"), folder_name)
        .otherwise(file_name)
    )
    return rows.withColumn("cohort", file_stem(tag))


def file_stem(path) -> Column:
    """Last part of a path without folder and data-file extension."""
    col = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(col, "^.*/", ""), r"\.(rda|rds|csv|json|parquet)$", "")


def parse_cohort_name(paths: DataFrame, column: str = "path") -> DataFrame:
    """Adds study, cancer and treatment of ``<study>__<cancer>__<treatment>``."""
    parts = F.split(file_stem(column), "__")
    return paths.withColumns(
        {"study": F.get(parts, F.lit(0)), "cancer": F.get(parts, F.lit(1)), "treatment": F.get(parts, F.lit(2))}
    )


def first_k_cohorts(rows: DataFrame, k: int = 3) -> DataFrame:
    """Rows of the first ``k`` studies by name."""
    first = rows.select("study").distinct().orderBy("study").limit(k)
    return rows.join(F.broadcast(first), "study", "left_semi")  # k rows


def scan_selected(spark: SparkSession, path: str) -> DataFrame:
    """Signature names, one per line; blank lines are skipped."""
    name = F.trim(F.col("value"))
    return spark.read.text(path).filter(F.length(name) > 0).select(name.alias("signature"))
