"""Training matrices and result tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clinical import assert_shareable, strip_patient_ids
from ..operators.features import pivot_scores


def train_wide(scores: DataFrame, valid: DataFrame, features: list[str]) -> DataFrame:
    """study, one column per feature, response; patient keys are dropped."""
    wide = pivot_scores(scores, features).join(valid.select("study", "sample_id", "response"), ["study", "sample_id"])
    return strip_patient_ids(wide).select("study", *features, "response")


def sink_train_csv(wide: DataFrame, path: str) -> None:
    """One folder of CSV files with header per study."""
    assert_shareable(wide).write.partitionBy("study").option("header", "true").csv(path)


def scan_train_csv(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """Training CSVs with a stated schema, so no pass over the data infers it."""
    columns = ", ".join(f"`{f}` DOUBLE" for f in features)
    rows = spark.read.option("header", "true").schema(f"{columns}, response STRING, study STRING").csv(path)
    return rows.select("study", *features, "response")


def sink_importance(importance: DataFrame, path: str) -> None:
    assert_shareable(importance).write.partitionBy("study").option("header", "true").csv(path)


def scan_importance(spark: SparkSession, path: str) -> DataFrame:
    schema = "feature STRING, gain DOUBLE, cover DOUBLE, frequency DOUBLE, study STRING"
    return spark.read.option("header", "true").schema(schema).csv(path)


def sink_eval(aucs: DataFrame, path: str) -> None:
    """Validation metrics per study and model; no patient-level column may pass."""
    assert_shareable(aucs).write.parquet(path)
