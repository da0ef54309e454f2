"""Patient tables: projection, gates, label coding, harmonised terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import attach

# The documented clinical columns.
CLINICAL_COLUMNS = {
    "patientid": "string",
    "age": "int",
    "sex": "string",
    "cancer_type": "string",
    "histo": "string",
    "treatment_type": "string",
    "stage": "string",
    "recist": "string",
    "response": "string",
    "survival_time_os": "double",
    "event_occurred_os": "int",
    "survival_time_pfs": "double",
    "event_occurred_pfs": "int",
    "survival_unit": "string",
}
MIN_PATIENTS = 25
PATIENT_KEYS = ("patientid", "patient_id", "sample_id")


def typed_clinical(raw: DataFrame) -> DataFrame:
    """Every documented column in its documented type; unreadable text is NULL."""
    present = set(raw.columns)
    typed = [
        (F.col(c).try_cast(t) if c in present else F.lit(None).cast(t)).alias(c) for c, t in CLINICAL_COLUMNS.items()
    ]
    extra = [c for c in raw.columns if c not in CLINICAL_COLUMNS]
    return raw.select(*extra, *typed)


def clinical_project(raw: DataFrame) -> DataFrame:
    return typed_clinical(raw).select("study", F.col("patientid").alias("sample_id"), "response")


def drop_missing_response(clinical: DataFrame) -> DataFrame:
    return clinical.dropna()


def cohort_size_gate(valid: DataFrame, min_n: int = MIN_PATIENTS) -> DataFrame:
    """Keep the rows of studies with at least ``min_n`` valid patients."""
    large = valid.groupBy("study").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n).select("study")
    return attach(valid, large, ["study"], "left_semi")


def restrict_samples(expression: DataFrame, valid: DataFrame) -> DataFrame:
    """Expression of valid patients only. A patient has at most one row per gene,
    so the key cannot be hot and a plain join is even."""
    return expression.join(valid.select("study", "sample_id"), ["study", "sample_id"], "left_semi")


def encode_response(response="response") -> Column:
    """Non-responder is the positive class; any other text is unknown."""
    col = F.col(response) if isinstance(response, str) else response
    return F.when(col == "R", 0).when(col == "NR", 1)


def harmonize_treatment(treatment) -> Column:
    """PD-1 and PD-L1 agents to one class, combinations with CTLA-4 to another.

    A text is split at + / , ; and "and"; "anti-", hyphens and blanks are dropped from each part, and the set of
    targets decides. Any other text is passed on, trimmed.
    """
    col = F.col(treatment) if isinstance(treatment, str) else treatment
    parts = F.split(F.lower(F.trim(col)), r"\s*(?:[+/,;&]|\band\b)\s*")
    targets = F.array_distinct(
        F.filter(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, "^anti", ""), "[^a-z0-9]", "")), lambda t: t != "")
    )
    axis = F.array(*[F.lit(t) for t in ("pd1", "pdl1")])
    combined = F.exists(targets, lambda t: t.contains("ctla4") | t.contains("combo"))
    return (
        F.when(combined, "IO+combo")
        .when((F.size(targets) > 0) & (F.size(F.array_except(targets, axis)) == 0), "PD-(L)1")
        .otherwise(F.trim(col))
    )


def harmonize_cancer(rows: DataFrame, synonyms: DataFrame, column: str = "cancer") -> DataFrame:
    """Adds ``cancer_group``: the standard label of a synonym, else the text itself.

    ``synonyms`` is ``(term, label)`` with lower-case unique terms.
    """
    keyed = rows.withColumn("term", F.lower(F.trim(F.col(column))))
    return (
        attach(keyed, synonyms.select("term", "label"), ["term"], "left")
        .withColumn("cancer_group", F.coalesce("label", F.trim(F.col(column))))
        .drop("term", "label")
    )


def cohort_profile(clinical: DataFrame, by=("study",), min_n: int = MIN_PATIENTS) -> DataFrame:
    """Patients, responders, non-responders, missing and the size gate per stratum."""
    response = F.col("response")
    return clinical.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(response == "R").alias("n_r"),
        F.count_if(response == "NR").alias("n_nr"),
        F.count_if(response.isNull()).alias("n_missing"),
        (F.count_if(response.isNotNull()) >= min_n).alias("passes"),
    )


def strip_patient_ids(df: DataFrame) -> DataFrame:
    return df.drop(*PATIENT_KEYS)


def assert_shareable(df: DataFrame) -> DataFrame:
    """Refuse a table that would carry patient keys across a study's border."""
    leaked = [c for c in df.columns if c.lower() in PATIENT_KEYS]
    if leaked:
        raise ValueError(f"patient keys in a shared table: {leaked}")
    return df
