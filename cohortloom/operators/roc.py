"""ROC curves and what is read off them.

Predictions ``(study, model_id, sample_id, label, score)`` are first reduced to
distinct scores with label counts; running counts are built per score range, so
neither a large study nor a tied score lands in one task. Label 1 is the case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import BUCKETS, attach, cumulative

KEYS = ("study", "model_id")
GRID_POINTS = 150


def score_counts(predictions: DataFrame, keys=KEYS) -> DataFrame:
    """Distinct scores with label counts. Scores tie only if they are equal; who wants ties closer by rounds them before."""
    return (
        predictions.filter(F.col("label").isNotNull() & F.col("score").isNotNull())
        .groupBy(*keys, F.col("score").cast("double").alias("score"))
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )


def ranked_counts(predictions: DataFrame, keys=KEYS, buckets: int = BUCKETS) -> DataFrame:
    """Distinct scores with ``before_pos``, ``before_neg`` and the totals."""
    return cumulative(score_counts(predictions, keys), keys, "score", ["pos", "neg"], buckets)


def roc_curve(ranked: DataFrame, keys=KEYS) -> DataFrame:
    """Sensitivity and specificity when scores at or above the threshold are cases.

    The lowest score is the (1, 0) corner; the highest also yields the (0, 1)
    corner at an infinite threshold.
    """
    here = F.struct(
        F.col("score").alias("threshold"),
        (F.col("total_pos") - F.col("before_pos")).alias("tp"),
        (F.col("total_neg") - F.col("before_neg")).alias("fp"),
    )
    end = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"))
    last = (F.col("before_pos") + F.col("pos") == F.col("total_pos")) & (
        F.col("before_neg") + F.col("neg") == F.col("total_neg")
    )
    points = F.when(last, F.array(here, end)).otherwise(F.array(here))
    return ranked.select(*keys, "total_pos", "total_neg", F.inline(points)).select(
        *keys,
        "threshold",
        "tp",
        "fp",
        (F.col("tp") / F.nullif("total_pos", F.lit(0))).alias("sens"),
        (F.lit(1.0) - F.col("fp") / F.nullif("total_neg", F.lit(0))).alias("spec"),
    )


def auc(ranked: DataFrame, keys=KEYS) -> DataFrame:
    """Rank-sum area, ties one half; NULL when a class is absent."""
    wins = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / F.lit(2.0)))
    pairs = F.nullif(F.max("total_pos").cast("double") * F.max("total_neg"), F.lit(0.0))
    return ranked.groupBy(*keys).agg((wins / pairs).alias("auc"))


def _median(kind: str):
    """Median score of one class from its cumulative counts."""
    n = F.col(f"total_{kind}")
    low, high = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    first, size = F.col(f"before_{kind}"), F.col(kind)
    holds = lambda p: F.when((p >= first) & (p < first + size), F.col("score"))
    return (F.max(holds(low)) + F.max(holds(high))) / F.lit(2.0)


def roc_direction(ranked: DataFrame, keys=KEYS) -> DataFrame:
    """AUC with the direction chosen from the class medians."""
    wins = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / F.lit(2.0)))
    pairs = F.nullif(F.max("total_pos").cast("double") * F.max("total_neg"), F.lit(0.0))
    medians = ranked.groupBy(*keys).agg(
        _median("neg").alias("median_control"), _median("pos").alias("median_case"), (wins / pairs).alias("auc")
    )
    falling = F.col("median_control") > F.col("median_case")
    return medians.select(
        *keys,
        "median_control",
        "median_case",
        F.when(falling, ">").otherwise("<").alias("direction"),
        "auc",
        F.when(falling, F.lit(1.0) - F.col("auc")).otherwise(F.col("auc")).alias("auc_auto"),
    )


def youden_threshold(ranked: DataFrame, keys=KEYS) -> DataFrame:
    """Threshold with the greatest sensitivity + specificity, mean over ties.

    A threshold lies midway between neighbouring scores and is infinite at the
    ends. The criterion is compared as whole numbers.
    """
    whole = lambda c: c.cast("decimal(19,0)")
    pos, neg = whole(F.col("total_pos")), whole(F.col("total_neg"))
    tp = whole(F.col("total_pos") - F.col("before_pos"))
    cut = F.coalesce((F.col("previous") + F.col("score")) / F.lit(2.0), F.lit(float("-inf")))
    here = F.struct((tp * neg + whole(F.col("before_neg")) * pos).cast("decimal(38,0)").alias("j"), cut.alias("cut"))
    end = F.struct((neg * pos).cast("decimal(38,0)").alias("j"), F.lit(float("inf")).alias("cut"))
    last = (F.col("before_pos") + F.col("pos") == F.col("total_pos")) & (
        F.col("before_neg") + F.col("neg") == F.col("total_neg")
    )
    return (
        ranked.filter((F.col("total_pos") > 0) & (F.col("total_neg") > 0))
        .select(*keys, "total_pos", "total_neg", F.inline(F.when(last, F.array(here, end)).otherwise(F.array(here))))
        .groupBy(*keys, "j")
        .agg(F.avg("cut").alias("cut"), F.max(F.col("total_pos").cast("double") * F.col("total_neg")).alias("scale"))
        .groupBy(*keys)
        .agg(F.max_by("cut", "j").alias("threshold"), (F.max("j").cast("double") / F.max("scale")).alias("sens_plus_spec"))
    )


def confusion_metrics(counts: DataFrame, thresholds: DataFrame, keys=KEYS) -> DataFrame:
    """Accuracy, precision, recall and F1 at a threshold, from distinct scores."""
    called = F.col("score") >= F.col("threshold")
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    tally = (
        attach(counts, thresholds.select(*keys, "threshold"), keys)
        .groupBy(*keys)
        .agg(
            total("pos", called).alias("tp"),
            total("neg", called).alias("fp"),
            total("pos", ~called).alias("fn"),
            total("neg", ~called).alias("tn"),
        )
    )
    ratio = lambda a, b: a / F.nullif(b, F.lit(0).cast("bigint"))
    return tally.select(
        *keys,
        "tp",
        "fp",
        "fn",
        "tn",
        ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def roc_interpolate(ranked: DataFrame, keys=KEYS, points: int = GRID_POINTS) -> DataFrame:
    """Sensitivity at equally spaced specificities, linear between ROC points.

    A distinct score is one segment of the curve, from (true negatives, true
    positives) below it to those including it. It emits the grid points in its
    own half-open specificity range, found by whole-number arithmetic: no join.
    """
    last = points - 1
    tn, tp = F.col("before_neg"), F.col("total_pos") - F.col("before_pos")
    first = F.expr(f"before_neg * {last} div total_neg") + 1
    end = F.expr(f"(before_neg + neg) * {last} div total_neg")
    start = F.when((tn == 0) & (F.col("before_pos") == 0), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    span = F.when(first <= end, F.sequence(first, end)).otherwise(
        F.array().cast("array<bigint>")
    )
    along = (F.col("i") * F.col("total_neg") / F.lit(float(last)) - tn) / F.col("neg")
    sens = F.when(F.col("i") == 0, F.lit(1.0)).otherwise((tp - along * F.col("pos")) / F.col("total_pos"))
    return (
        ranked.filter((F.col("total_pos") > 0) & (F.col("total_neg") > 0))
        .select("*", F.explode(F.concat(start, span)).alias("i"))
        .select(*keys, F.col("i").cast("int").alias("i"), (F.col("i") / F.lit(float(last))).alias("spec"), sens.alias("sens"))
    )


def mean_roc_band(grid: DataFrame, by=("study",)) -> DataFrame:
    """Mean sensitivity over models and one standard deviation, kept in [0, 1]."""
    mean, sd = F.avg("sens"), F.stddev_samp("sens")
    return grid.groupBy(*by, "i").agg(
        F.max("spec").alias("spec"),
        mean.alias("sens"),
        F.least(mean + sd, F.lit(1.0)).alias("sens_upper"),
        F.greatest(mean - sd, F.lit(0.0)).alias("sens_lower"),
    )


def local_auc_summary(aucs: DataFrame, by=("study",)) -> DataFrame:
    """Mean AUC over local models with 2.5 and 97.5 % quantiles."""
    return aucs.groupBy(*by).agg(
        F.avg("auc").alias("auc_mean"),
        F.percentile("auc", F.lit(0.025)).alias("auc_low"),
        F.percentile("auc", F.lit(0.975)).alias("auc_high"),
        F.count("auc").alias("n_models"),
    )


def stack_curves(band: DataFrame, *curves: DataFrame) -> DataFrame:
    """Band and single curves in one long table; absent columns are NULL."""
    out = band
    for curve in curves:
        out = out.unionByName(curve, allowMissingColumns=True)
    return out


def auc_long(local: DataFrame, merged: DataFrame, signature: DataFrame) -> DataFrame:
    """One row per study and model, local models first by name."""
    tag = lambda df, name: df.select("study", F.lit(name).alias("model"), "auc")
    return (
        tag(local, "Local Model")
        .unionByName(tag(merged, "Distributed Model"))
        .unionByName(tag(signature, "Signature Model"))
    )


def report_labels(summary: DataFrame, titles: DataFrame) -> DataFrame:
    """Study title and "name AUC: x [low-high]", two decimals.

    ``summary`` is (study, name, auc, low, high). What is not known is NA.
    """
    shown = lambda c: F.regexp_replace(F.round(c, 2).cast("string"), r"\.0$", "")
    two = lambda c: F.coalesce(shown(c), F.lit("NA"))
    label = F.concat(
        "name", F.lit(" AUC: "), two("auc"), F.lit(" ["), two("low"), F.lit("-"), two("high"), F.lit("]")
    )
    return attach(summary, titles, ["study"], "left").select(
        "study", F.coalesce("title", "study").alias("title"), "name", label.alias("label")
    )


def pair_inputs(data: DataFrame, scores: DataFrame) -> DataFrame:
    """Which studies have data, scores or both; counts of rows on either side."""
    left = data.groupBy("study").agg(F.count(F.lit(1)).alias("n_data"))
    right = scores.groupBy("study").agg(F.count(F.lit(1)).alias("n_scores"))
    return left.join(right, "study", "full_outer").select(
        "study",
        "n_data",
        "n_scores",
        F.when(F.col("n_scores").isNull(), "no scores")
        .when(F.col("n_data").isNull(), "no data")
        .otherwise("paired")
        .alias("status"),
    )
