"""Queries over sources and patient tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import literal_rows
from ..operators import clinical as cl
from ..operators import features as ft
from ..operators import scoring as sc
from ..plans import derived as d
from ..session import scratch_path
from ..sources import cohorts as co
from ..sources import training as tr
from . import sql as q

ORDERED = ["study", "sample_id"]


def gated(spark, sf):
    return cl.cohort_size_gate(cl.drop_missing_response(d.basket_clinical(spark, sf)))


def _scan_cohorts(spark, sf):
    folder = scratch_path(spark, "cohorts")
    rows = d.basket_tpm(spark, sf).withColumn("cohort", F.concat("study", F.lit("__Mixed__PD-(L)1")))
    co.write_cohorts(rows.drop("study"), folder)
    parsed = co.parse_cohort_name(co.scan_cohorts(spark, folder, "sample_id STRING, gene_id STRING, value DOUBLE"), "cohort")
    return parsed.select("study", "cancer", "treatment", "sample_id", "gene_id", "value")


def _parse_names(spark, sf):
    return co.parse_cohort_name(d.cohort_paths(spark, sf)).drop("path")


def _first_k(spark, sf):
    return co.first_k_cohorts(d.basket_clinical(spark, sf), 3)


def _scan_selected(spark, sf):
    path = scratch_path(spark, "selected")
    names = d.basket_selected(spark, sf)
    names.select(F.concat(F.lit(" "), F.col("signature"), F.lit("\n")).alias("value")).write.text(path)
    return co.scan_selected(spark, path)


def _clinical_project(spark, sf):
    return cl.clinical_project(d.raw_clinical(spark, sf))


def _typed_clinical(spark, sf):
    return cl.typed_clinical(d.raw_clinical(spark, sf))


def _drop_missing(spark, sf):
    return cl.drop_missing_response(d.basket_clinical(spark, sf))


def _restrict(spark, sf):
    return cl.restrict_samples(d.basket_tpm(spark, sf), gated(spark, sf))


def _encode(spark, sf):
    return d.basket_clinical(spark, sf).withColumn("label", cl.encode_response())


def _treatment(spark, sf):
    return d.terms(spark, sf).select(*ORDERED, "treatment", cl.harmonize_treatment("treatment").alias("treatment_group"))


def _synonyms(spark):
    return literal_rows(spark, "term string, label string", [("skcm", "Melanoma"), ("melanoma", "Melanoma"), ("lung", "Lung")])


def _cancer(spark, sf):
    return cl.harmonize_cancer(d.terms(spark, sf), _synonyms(spark)).select(*ORDERED, "cancer", "cancer_group")


def _stratify(spark, sf):
    strata = cl.harmonize_cancer(d.terms(spark, sf), _synonyms(spark)).withColumn(
        "treatment_group", cl.harmonize_treatment("treatment")
    )
    rows = d.basket_clinical(spark, sf).join(strata.select(*ORDERED, "cancer_group", "treatment_group"), ORDERED)
    return cl.cohort_profile(rows, ("cancer_group", "treatment_group"))


def _profile(spark, sf):
    return cl.cohort_profile(d.basket_clinical(spark, sf))


def _strip(spark, sf):
    return cl.assert_shareable(cl.strip_patient_ids(d.basket_clinical(spark, sf)))


def light_scores(spark, sf):
    """Scores of the value-based signatures of the gated studies."""
    expr = sc.keep(sc.gene_missing_filter(sc.keep(logged(spark, sf))))
    sets = sc.eligible_sets(expr, sc.score_dispatch(d.basket_signatures(spark, sf), d.basket_signature_info(spark)))
    of = lambda b: sets.filter(F.col("branch") == b)
    out = ["study", "sample_id", "signature", "score"]
    return (
        sc.weighted_mean(expr, of("mean")).select(*out)
        .unionByName(sc.cox_is(expr, of("cox_is")).select(*out))
        .unionByName(sc.ips(expr, of("ips")).select(*out))
    )


def logged(spark, sf):
    """Logged expression of the valid patients of large enough studies."""
    return sc.log_expr(cl.restrict_samples(d.basket_tpm(spark, sf), gated(spark, sf)))


def all_scores(spark, sf):
    """Scores of every signature of the gated studies, whatever its method."""
    expr = sc.keep(sc.gene_missing_filter(sc.keep(logged(spark, sf))))
    return sc.score_all(expr, d.basket_signatures(spark, sf), d.basket_signature_info(spark), min_samples=0)


def names_of(signatures) -> list[str]:
    """Signature names in order: the columns of a wide table, one row for the driver."""
    return signatures.agg(F.sort_array(F.collect_set("signature")).alias("s")).first().s


def _train_csv(spark, sf):
    path = scratch_path(spark, "train")
    selected = sc.keep(d.basket_selected(spark, sf))
    names = names_of(selected)
    scores = sc.keep(ft.select_signatures(all_scores(spark, sf), selected))
    wide = tr.train_wide(ft.filter_common(scores, ft.common_features(scores)), gated(spark, sf), names)
    tr.sink_train_csv(wide, path)
    return path, names


def _sink_train(spark, sf):
    path, names = _train_csv(spark, sf)
    rows = spark.read.option("header", "true").csv(path)
    return rows.select("study", *[F.round(F.col(c).cast("double"), 6).alias(c.lower()) for c in names], "response")


def _scan_train(spark, sf):
    path, names = _train_csv(spark, sf)
    rows = tr.scan_train_csv(spark, path, names)
    return rows.groupBy("study", "response").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c.lower()) for c in names]
    )


#: The names that the derived signature list has, for the columns of the SQL side.
NAMES = ["BAD", "COX", "IPR", "IPS", "OV", "PAS", "PIO", "S0", "S1", "S2", "S3", "S4", "UNK"]
SELECTED = [n for n in NAMES if n != "S4"]


def wide_columns(names: list[str], value: str = "score") -> str:
    return ", ".join(f"max({value}) FILTER (signature = '{n}') AS {n.lower()}" for n in names)


def each(names: list[str], text: str) -> str:
    return ", ".join(text.format(n.lower()) + f" AS {n.lower()}" for n in names)


_WIDE = f"""SELECT study, sample_id, {wide_columns(SELECTED)} FROM scores WHERE signature IN (SELECT signature FROM scores GROUP BY 1
 HAVING count(DISTINCT study) = (SELECT count(DISTINCT study) FROM scores)) GROUP BY ALL"""

_TERM_SQL = """SELECT r_name AS study, CAST(c_custkey AS VARCHAR) AS sample_id,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SKCM' WHEN 'BUILDING' THEN ' melanoma ' WHEN 'FURNITURE' THEN 'Lung' WHEN 'MACHINERY' THEN 'Rare tumour' END AS cancer,
 CASE c_nationkey % 6 WHEN 0 THEN 'anti-PD-1' WHEN 1 THEN 'anti-PD-L1' WHEN 2 THEN 'anti-PD-1/anti-PD-L1' WHEN 3 THEN 'PD-1 + CTLA4 combo' WHEN 4 THEN 'Chemo' END AS treatment
 FROM people"""
q.cte("terms", "people", _TERM_SQL)
q.cte(
    "strata",
    "terms",
    """SELECT *, CASE lower(trim(cancer)) WHEN 'skcm' THEN 'Melanoma' WHEN 'melanoma' THEN 'Melanoma' ELSE trim(cancer) END AS cancer_group,
    CASE WHEN treatment LIKE '%combo%' OR treatment LIKE '%CTLA4%' THEN 'IO+combo' WHEN treatment IN ('anti-PD-1', 'anti-PD-L1', 'anti-PD-1/anti-PD-L1')
    THEN 'PD-(L)1' ELSE treatment END AS treatment_group FROM terms""",
)
_PROFILE = """count(*) AS n, count(*) FILTER (response = 'R') AS n_r, count(*) FILTER (response = 'NR') AS n_nr,
 count(*) FILTER (response IS NULL) AS n_missing, count(response) >= 25 AS passes"""

QUERIES = {
    "scan_cohorts": (
        _scan_cohorts,
        q.query("tpm", "SELECT study, 'Mixed' AS cancer, 'PD-(L)1' AS treatment, sample_id, gene_id, value FROM tpm"),
    ),
    "parse_cohort_name": (
        _parse_names,
        q.query(
            "people",
            """SELECT CAST(c_custkey AS VARCHAR) AS sample_id, 'ICB_' || n_name AS study, c_mktsegment AS cancer,
            CASE WHEN c_custkey % 7 <> 2 THEN CASE c_nationkey % 6 WHEN 0 THEN 'anti-PD-1' WHEN 1 THEN 'anti-PD-L1'
            WHEN 2 THEN 'anti-PD-1+anti-PD-L1' WHEN 3 THEN 'PD-1 + CTLA4 combo' WHEN 4 THEN 'Chemo' ELSE 'none' END END AS treatment FROM people""",
        ),
    ),
    "first_k_cohorts": (
        _first_k,
        q.query("clinical", "SELECT * FROM clinical WHERE study IN (SELECT DISTINCT study FROM clinical ORDER BY 1 LIMIT 3)"),
    ),
    "scan_selected": (
        _scan_selected,
        q.query("signature", "SELECT DISTINCT signature FROM signature WHERE signature <> 'S4'"),
    ),
    "scan_train_csv": (
        _scan_train,
        q.query(
            "scores valid",
            f"""SELECT study, response, count(*) AS n, {each(SELECTED, 'round(avg({}), 6)')}
            FROM wide JOIN valid USING (study, sample_id) GROUP BY ALL""",
            [("wide", _WIDE)],
        ),
    ),
    "sink_train_csv": (
        _sink_train,
        q.query(
            "scores valid",
            f"""SELECT study, {each(SELECTED, 'round({}, 6)')}, response
            FROM wide JOIN valid USING (study, sample_id)""",
            [("wide", _WIDE)],
        ),
    ),
    "clinical_project": (_clinical_project, q.query("clinical", "SELECT * FROM clinical")),
    "clinical_schema": (
        _typed_clinical,
        q.query(
            "people",
            """SELECT r_name AS study, CAST(c_custkey AS VARCHAR) AS patientid,
            CASE WHEN c_custkey % 10 <> 3 THEN CAST(c_custkey % 60 + 20 AS INTEGER) END AS age,
            CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
            CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SKCM' WHEN 'BUILDING' THEN ' melanoma ' WHEN 'FURNITURE' THEN 'Lung' WHEN 'MACHINERY' THEN 'Rare tumour' END AS cancer_type,
            c_mktsegment AS histo,
            CASE c_nationkey % 6 WHEN 0 THEN 'anti-PD-1' WHEN 1 THEN 'anti-PD-L1' WHEN 2 THEN 'anti-PD-1/anti-PD-L1' WHEN 3 THEN 'PD-1 + CTLA4 combo' WHEN 4 THEN 'Chemo' END AS treatment_type,
            'stage ' || CAST(c_custkey % 4 + 1 AS VARCHAR) AS stage,
            CASE c_custkey % 4 WHEN 0 THEN 'CR' WHEN 1 THEN 'PR' WHEN 2 THEN 'SD' ELSE 'PD' END AS recist,
            CASE WHEN c_acctbal >= 5000 THEN 'R' WHEN c_acctbal >= 0 THEN 'NR' END AS response,
            CASE WHEN c_custkey % 9 <> 4 THEN CAST(c_custkey % 50 AS DOUBLE) END AS survival_time_os,
            CAST(c_custkey % 2 AS INTEGER) AS event_occurred_os, CAST(c_custkey % 30 AS DOUBLE) AS survival_time_pfs,
            CAST(c_custkey % 2 AS INTEGER) AS event_occurred_pfs, 'month' AS survival_unit FROM people""",
        ),
    ),
    "drop_missing_response": (_drop_missing, q.query("valid", "SELECT * FROM valid")),
    "cohort_size_gate": (gated, q.query("gated", "SELECT * FROM gated")),
    "restrict_samples": (_restrict, q.query("tpm gated", "SELECT * FROM tpm SEMI JOIN gated USING (study, sample_id)")),
    "encode_response": (
        _encode,
        q.query("clinical", "SELECT *, CASE response WHEN 'R' THEN 0 WHEN 'NR' THEN 1 END AS label FROM clinical"),
    ),
    "harmonize_treatment": (
        _treatment,
        q.query("strata", "SELECT study, sample_id, treatment, treatment_group FROM strata"),
    ),
    "harmonize_cancer": (_cancer, q.query("strata", "SELECT study, sample_id, cancer, cancer_group FROM strata")),
    "stratify": (
        _stratify,
        q.query(
            "strata clinical",
            f"SELECT cancer_group, treatment_group, {_PROFILE} FROM clinical JOIN strata USING (study, sample_id) GROUP BY cancer_group, treatment_group",
        ),
    ),
    "cohort_profile": (_profile, q.query("clinical", f"SELECT study, {_PROFILE} FROM clinical GROUP BY study")),
    "strip_patient_ids": (_strip, q.query("clinical", "SELECT study, response FROM clinical")),
}
