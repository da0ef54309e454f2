"""Study-shaped inputs derived from the warehouse tables.

``basket``: customers as samples, brands as genes, bought quantity as value.
``vec``: embedding rows as samples, positions as genes.
``doc``: labelled documents with two scores, for evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import literal_rows, round9
from ..operators.scale import attach, keep

_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A warehouse table; its schema is read from the file footer once per session."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    # 25 nations: the planner broadcasts them from their file size
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def _response() -> Column:
    return F.when(F.col("c_acctbal") >= 5000, "R").when(F.col("c_acctbal") >= 0, "NR")


def basket_clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(
        F.col("r_name").alias("study"),
        F.col("c_custkey").cast("string").alias("sample_id"),
        _response().alias("response"),
    )


def raw_clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documented 14 clinical columns, all still text."""
    key = F.col("c_custkey")
    return _customers(spark, sf_dir).select(
        F.col("r_name").alias("study"),
        key.cast("string").alias("patientid"),
        F.when(key % 10 == 3, F.lit("unknown")).otherwise((key % 60 + 20).cast("string")).alias("age"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("sex"),
        raw_cancer().alias("cancer_type"),
        F.col("c_mktsegment").alias("histo"),
        raw_treatment().alias("treatment_type"),
        F.concat(F.lit("stage "), (key % 4 + 1).cast("string")).alias("stage"),
        F.element_at(F.array(*[F.lit(x) for x in ("CR", "PR", "SD", "PD")]), (key % 4 + 1).cast("int")).alias("recist"),
        _response().alias("response"),
        F.when(key % 9 == 4, F.lit("n/a")).otherwise((key % 50).cast("string")).alias("survival_time_os"),
        (key % 2).cast("string").alias("event_occurred_os"),
        (key % 30).cast("string").alias("survival_time_pfs"),
        (key % 2).cast("string").alias("event_occurred_pfs"),
        F.lit("month").alias("survival_unit"),
    )


def raw_treatment() -> Column:
    """Differently spelt treatments, by nation of the customer."""
    terms = ["anti-PD-1", "anti-PD-L1", "anti-PD-1/anti-PD-L1", "PD-1 + CTLA4 combo", "Chemo", None]
    return F.element_at(F.array(*[F.lit(t) for t in terms]), (F.col("c_nationkey") % 6 + 1).cast("int"))


def raw_cancer() -> Column:
    """Differently spelt cancer types, by market segment of the customer."""
    seg = F.col("c_mktsegment")
    return (
        F.when(seg == "AUTOMOBILE", "SKCM")
        .when(seg == "BUILDING", " melanoma ")
        .when(seg == "FURNITURE", "Lung")
        .when(seg == "MACHINERY", "Rare tumour")
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: study, raw cancer type, raw treatment."""
    return _customers(spark, sf_dir).select(
        F.col("r_name").alias("study"),
        F.col("c_custkey").cast("string").alias("sample_id"),
        raw_cancer().alias("cancer"),
        raw_treatment().alias("treatment"),
    )


def cohort_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort file path per customer; some lack a part or a folder."""
    folder = F.when(F.col("c_custkey") % 3 == 0, "data/procdata/").otherwise("")
    treatment = F.when(F.col("c_custkey") % 7 == 2, F.lit("")).otherwise(
        F.concat(F.lit("__"), F.coalesce(raw_treatment(), F.lit("none")))
    )
    return _customers(spark, sf_dir).select(
        F.col("c_custkey").cast("string").alias("sample_id"),
        F.concat(
            folder,
            F.lit("ICB_"),
            F.col("n_name"),
            F.lit("__"),
            F.col("c_mktsegment"),
            F.regexp_replace(treatment, "/", "+"),
            F.lit(".rda"),
        ).alias("path"),
    )


def basket_tpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, sample_id, gene_id, value: bought quantity, 0 where nothing was bought.

    A customer's sums are gathered in one map (at most one entry per brand) and
    read off along the list of all brands in ``part``, so zero cells need no product
    of tables. The part table is broadcast only if it is small; a hot order is split
    by AQE, a hot customer shrinks in the partial sums.
    """
    brands = table(spark, sf_dir, "part").agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    bought = (
        attach(lines, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"])
        .join(orders, "l_orderkey")
        .groupBy("o_custkey", "p_brand")
        .agg(F.sum("l_quantity").alias("qty"))
        .groupBy("o_custkey")
        .agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "qty"))).alias("qty"))
    )
    samples = _customers(spark, sf_dir).select("c_custkey", "r_name")
    return (
        samples.join(bought, F.col("c_custkey") == F.col("o_custkey"), "left")
        .withColumn("brands", brands.scalar())
        .select(
            F.col("r_name").alias("study"),
            F.col("c_custkey").cast("string").alias("sample_id"),
            "qty",
            F.explode("brands").alias("gene_id"),
        )
        .select("study", "sample_id", "gene_id", F.coalesce(F.col("qty")[F.col("gene_id")], F.lit(0.0)).alias("value"))
    )


def basket_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signature, sub_signature, gene_id, weight, grp: built from the brands on sale."""
    k = F.col("k")
    brands = (
        table(spark, sf_dir, "part")
        .select(F.col("p_brand").alias("gene_id"))
        .distinct()
        .withColumn("k", F.substring("gene_id", 7, 10).cast("int"))
    )

    def member(cond, signature, sub="", weight=1.0, grp="", gene=None):
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(
            cond,
            F.struct(
                F.lit(signature).alias("signature"),
                as_col(sub).alias("sub_signature"),
                as_col(gene if gene is not None else F.col("gene_id")).alias("gene_id"),
                as_col(weight).cast("double").alias("weight"),
                as_col(grp).alias("grp"),
            ),
        )

    members = [
        member(k % 5 == 0, "S0"),
        member(k % 5 == 1, "S1"),
        member(k % 5 == 2, "S2"),
        member(k % 5 == 3, "S3", weight=F.when(k % 2 == 1, 1.0).otherwise(-1.0)),
        member(k % 5 == 4, "S4"),
        member(k.between(1, 10), "COX", grp=F.when(k <= 5, "pro").otherwise("anti")),
        member(
            k >= 1,
            "IPS",
            weight=F.when((k <= 6) | k.between(13, 18), 1.0).otherwise(-1.0),
            grp=F.when(k <= 6, "MHC").when(k <= 12, "CP").when(k <= 18, "EC").otherwise("SC"),
        ),
        member(k % 5 == 0, "PIO", sub="sensitive", weight=1.0),
        member(k % 5 == 1, "PIO", sub="resistant", weight=-1.0),
        member(k >= 1, "IPR", sub=(k % 3).cast("string")),
        member(k % 4 <= 2, "PAS", sub=(k % 4).cast("string")),
        member(
            k % 6 <= 2,
            "OV",
            sub=(k % 6).cast("string"),
            weight=F.when(k % 6 == 0, 0.5).when(k % 6 == 1, -0.3).otherwise(0.2),
        ),
        member(k.between(1, 4), "BAD"),
        member(k.between(1, 2), "BAD", gene=F.concat(F.lit("Brand#9"), (k - 1).cast("string"))),
        member(k.between(1, 5), "UNK"),
    ]
    return brands.select(F.inline(F.array_compact(F.array(*members))))


def basket_signature_info(spark: SparkSession) -> DataFrame:
    rows = [
        ("S0", "GSVA", None),
        ("S1", "GSVA", None),
        ("S2", "ssGSEA", None),
        ("S3", "Weighted Mean", None),
        ("S4", "ssGSEA", None),
        ("COX", "Specific Algorithm", "cox_is"),
        ("IPS", "Specific Algorithm", "ips"),
        ("PIO", "Specific Algorithm", "pio"),
        ("IPR", "Specific Algorithm", "ipres"),
        ("PAS", "Specific Algorithm", "passon"),
        ("OV", "Specific Algorithm", "ipsov"),
        ("BAD", "GSVA", None),
        ("UNK", "No Such Method", None),
    ]
    return literal_rows(spark, "signature string, method string, algorithm string", rows)


def basket_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket_signatures(spark, sf_dir).select("signature").distinct().filter("signature <> 'S4'")


def vec_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, sample_id, label, values: one row per sample."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("V"), (F.col("vec_id") % 5).cast("string")).alias("study"),
        F.col("vec_id").cast("string").alias("sample_id"),
        (F.col("label") % 2).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


def vec_gene(position: str) -> Column:
    """The gene's name at a position, which has two digits at least."""
    place = F.col(position).cast("string")
    return F.concat(F.lit("d"), F.lpad(place, F.greatest(F.lit(2), F.length(place)), "0"))


def vec_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, sample_id, label, gene_id, value."""
    return vec_samples(spark, sf_dir).select(
        "study", "sample_id", "label", F.posexplode("values").alias("_pos", "value")
    ).select(
        "study",
        "sample_id",
        "label",
        vec_gene("_pos").alias("gene_id"),
        "value",
    )


def vec_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_cells(spark, sf_dir).drop("label")


def vec_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, sample_id, feature, value: the vec table with every eleventh value missing, by sample and position."""
    rows = vec_expression(spark, sf_dir).withColumnRenamed("gene_id", "feature")
    place = F.expr("substring(feature, 2)").cast("bigint")
    missing = F.pmod(F.col("sample_id").cast("bigint") + place * 7, F.lit(11)) == 0
    return rows.withColumn("value", F.when(~missing, F.col("value")))


def vec_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_samples(spark, sf_dir).select("study", "sample_id", "label")


def doc_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, sample_id, label, model_id, score of the two document models."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    scores = F.array(
        F.struct(F.lit("m1").alias("model_id"), round9(F.log(F.col("n_chars") + F.lit(1.0))).alias("score")),
        F.struct(F.lit("m2").alias("model_id"), (F.length("text") % 97).cast("double").alias("score")),
    )
    return (
        docs.select("doc_id", "lang", scores.alias("scores"))
        .join(labels, "doc_id")
        .select(
            F.col("lang").alias("study"),
            F.col("doc_id").cast("string").alias("sample_id"),
            (F.lit(1) - F.col("quality")).cast("int").alias("label"),
            F.inline("scores"),
        )
    )


def stump_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Small two-level tree models read off the vec table, one per study.

    Tree t of a study splits on gene t at the study mean, its right child on the
    next gene. Returns ``(model, tree_node)``.
    """
    # per position, a number; names come after the sums, which are few and written once
    cells = vec_samples(spark, sf_dir).select("study", "label", F.posexplode("values").alias("tree_id", "value"))
    gene = keep(
        cells.groupBy("study", "tree_id")
        .agg(
            F.round(F.avg("value"), 6).alias("cut"),
            F.count(F.lit(1)).cast("double").alias("n"),
            F.round(F.stddev_samp("value"), 6).alias("sd"),
            F.round(F.avg(F.col("label").cast("double")) - F.lit(0.5), 6).alias("rate"),
        )
        .withColumn("gene_id", vec_gene("tree_id"))
        .withColumn("genes", F.count(F.lit(1)).over(Window.partitionBy("study")).cast("int")),
        "genes",
    )
    follower = gene.select(
        "study",
        F.pmod(F.col("tree_id") - 1, F.col("genes")).alias("tree_id"),
        F.col("gene_id").alias("next_gene"),
        F.col("cut").alias("next_cut"),
        F.col("sd").alias("next_sd"),
    )
    t = gene.join(follower, ["study", "tree_id"])
    no_s, no_d, no_i = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("int")

    def node(i, feature, cut, left, right, leaf, gain, cover):
        return F.struct(
            F.lit(i).alias("node_id"),
            feature.alias("feature"),
            cut.alias("threshold"),
            left.alias("left"),
            right.alias("right"),
            F.lit(True).alias("default_left"),
            leaf.alias("leaf_value"),
            gain.alias("gain"),
            cover.alias("cover"),
        )

    leaf = lambda i, v, share: node(
        i, no_s, no_d, no_i, no_i, v, no_d, F.col("n") * F.lit(share)
    )
    nodes = F.array(
        node(0, F.col("gene_id"), F.col("cut"), F.lit(1), F.lit(2), no_d, F.col("sd"), F.col("n")),
        leaf(1, F.round(F.col("rate") * 0.1 - F.col("sd") * 0.05, 6), 0.5),
        node(2, F.col("next_gene"), F.col("next_cut"), F.lit(5), F.lit(6), no_d, F.col("next_sd"), F.col("n") * 0.5),
        leaf(5, F.round(F.col("sd") * 0.02, 6), 0.25),
        leaf(6, F.round(F.col("rate") * 0.1 + F.col("sd") * 0.05, 6), 0.25),
    )
    tree_node = t.select(F.col("study").alias("model_id"), "tree_id", F.inline(nodes))
    model = gene.groupBy("study").agg(F.count(F.lit(1)).cast("int").alias("n_trees")).select(
        F.col("study").alias("model_id"),
        "study",
        F.lit(0).alias("config_id"),
        F.lit(0.0).alias("base_margin"),
        "n_trees",
    )
    return model, tree_node
