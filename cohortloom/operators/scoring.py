"""Signature scores per sample.

Expression is ``(study, sample_id, gene_id, value)``; a gene set table is
``(signature, sub_signature, gene_id, weight, grp)``. One sample never has more
rows than there are genes, so windows per sample are bounded by the gene list;
everything per study or per gene of a study goes through aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_zero, normal_cdf, normal_pdf, round9
from .scale import MAX_BROADCAST_ROWS, attach, cumulative, keep

MISSING_SHARE = 0.5
CONST = 0.001
MIN_SAMPLES = 15
MIN_COVERAGE = 0.8

CELL = ["study", "sample_id", "gene_id"]
SET = ["signature", "sub_signature"]
SCORED = ["study", "sample_id", *SET]

BRANCHES = ("gsva", "ssgsea", "mean", "cox_is", "ips", "pio", "ipres", "passon", "ipsov")
UNGATED = ("ips",)


# ---- gates ---------------------------------------------------------------


def log_expr(expression: DataFrame, const: float = CONST) -> DataFrame:
    return expression.withColumn("value", F.log2(F.col("value") + F.lit(const)))


def gene_missing_filter(expression: DataFrame, share: float = MISSING_SHARE, const: float = CONST) -> DataFrame:
    """Drop genes that are zero in more than ``share`` of a study's samples."""
    zero = F.avg(is_zero(F.col("value"), const).cast("double"))
    kept = expression.groupBy("study", "gene_id").agg(zero.alias("z")).filter(F.col("z") <= share)
    return attach(expression, kept.select("study", "gene_id"), ["study", "gene_id"], "left_semi")


def signature_coverage_gate(signature: DataFrame, genes: DataFrame, share: float = MIN_COVERAGE) -> DataFrame:
    """(study, signature) pairs with more than ``share`` of the genes measured.

    ``genes`` is the distinct ``(study, gene_id)`` list.
    """
    members = signature.select("signature", "gene_id").distinct()
    sizes = members.groupBy("signature").agg(F.count(F.lit(1)).alias("n_genes"))
    found = attach(genes, members, ["gene_id"]).groupBy("study", "signature").agg(F.count(F.lit(1)).alias("n_found"))
    return attach(found, sizes, ["signature"]).filter(
        F.col("n_found") / F.col("n_genes") > F.lit(share)
    ).select("study", "signature")


def signature_sample_gate(expression: DataFrame, n: int = MIN_SAMPLES) -> DataFrame:
    """Keep the expression of studies with at least ``n`` samples."""
    large = (
        expression.select("study", "sample_id")
        .distinct()
        .groupBy("study")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= n)
        .select("study")
    )
    return attach(expression, large, ["study"], "left_semi")


def score_dispatch(signature: DataFrame, info: DataFrame) -> DataFrame:
    """Adds ``branch``: the scorer a signature is routed to, NULL if unknown."""
    method = F.col("method")
    branch = (
        F.when(method == "GSVA", "gsva")
        .when(method == "ssGSEA", "ssgsea")
        .when(method == "Weighted Mean", "mean")
        .when((method == "Specific Algorithm") & F.col("algorithm").isin(*BRANCHES[3:]), F.col("algorithm"))
    )
    routes = info.select("signature", branch.alias("branch"))
    return attach(signature, routes, ["signature"], "left")


def eligible_sets(expression: DataFrame, routed: DataFrame, share: float = MIN_COVERAGE) -> DataFrame:
    """Gene sets per study after the coverage gate (not applied to ungated branches)."""
    genes = keep(expression.select("study", "gene_id").distinct())
    members = routed.filter(F.col("branch").isNotNull()).select("signature", "branch", "gene_id").distinct()
    sizes = members.groupBy("signature").agg(F.count(F.lit(1)).alias("n_genes"))
    found = (
        attach(genes, members, ["gene_id"])
        .groupBy("study", "signature", "branch")
        .agg(F.count(F.lit(1)).alias("n_found"))
    )
    covered = F.col("n_found") / F.col("n_genes") > F.lit(share)
    passed = (
        attach(found, sizes, ["signature"])
        .filter(covered | F.col("branch").isin(*UNGATED))
        .select("study", "signature", "branch")
    )
    rows = routed.join(passed, ["signature", "branch"])  # one row per study, set and gene
    return keep(rows.select("study", *SET, "gene_id", "weight", "grp", "branch"))


def members_of(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of genes that belong to a set, once per set. ``sets`` may carry ``study``."""
    on = ["study", "gene_id"] if "study" in sets.columns else ["gene_id"]
    return attach(rows, sets, on)


# ---- rank based scores -----------------------------------------------------


def value_shares(expression: DataFrame) -> DataFrame:
    """Adds ``f``: the share of the study's samples at or below the gene's value.

    Distinct values are counted first; their cumulative counts are built per
    value range, so a gene of a very large study is not one task. Few shares are
    broadcast and the cells stay where they are.
    """
    keys = ["study", "gene_id"]
    counts = expression.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    shares = cumulative(counts, keys, "value", ["n"], buckets=32).select(
        *keys, "value", round9((F.col("before_n") + F.col("n")) / F.col("total_n")).alias("f")
    )
    shares = keep(shares)
    few = shares.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    # cells compress so well that the planner would take their file for the smaller side
    return expression.join(F.broadcast(shares) if few else shares.hint("merge"), [*keys, "value"])


KERNEL_TERMS = 16
KERNEL_REACH = 8


def kernel_shares(expression: DataFrame) -> DataFrame:
    """Adds ``f``: the Gaussian kernel distribution function, bandwidth sd/4.

    The sum over all samples is taken without forming pairs. Samples fall into
    cells one bandwidth wide; a cell keeps its count and the first moments about
    its centre (mergeable sums). Around a centre the kernel is its Taylor series
    in those moments, beyond ``KERNEL_REACH`` bandwidths it is 0 or 1. With
    offsets of at most half a bandwidth 16 terms leave an error below 1e-9.
    """
    keys = ["study", "gene_id"]
    stats = expression.groupBy(*keys).agg(
        F.avg("value").alias("_mean"), (F.stddev_samp("value") / F.lit(4.0)).alias("_h"), F.count(F.lit(1)).alias("_n")
    )
    scaled = attach(expression, stats, keys).filter(F.col("_h") > 0)
    scaled = scaled.withColumn("_z", (F.col("value") - F.col("_mean")) / F.col("_h"))
    scaled = keep(scaled.withColumn("_cell", F.round("_z").cast("bigint")))
    offset = F.col("_z") - F.col("_cell")
    moment = lambda m: F.pow(offset, F.lit(float(m))) if m else F.lit(1.0)
    cells = scaled.groupBy(*keys, "_cell").agg(
        F.array(*[F.sum(moment(m)) for m in range(KERNEL_TERMS)]).alias("_moments")
    )
    near = Window.partitionBy(*keys).orderBy("_cell").rangeBetween(-KERNEL_REACH, KERNEL_REACH)
    below = Window.partitionBy(*keys).orderBy("_cell").rangeBetween(Window.unboundedPreceding, -KERNEL_REACH - 1)
    around = cells.select(
        *keys,
        "_cell",
        F.coalesce(F.sum(F.col("_moments")[0]).over(below), F.lit(0.0)).alias("_lower"),
        F.collect_list(F.struct(F.col("_cell").alias("at"), F.col("_moments").alias("m"))).over(near).alias("_near"),
    )

    def cell_share(cell: Column) -> Column:
        # Phi(d - t) around d: derivatives are Hermite polynomials times the density
        d = F.col("_z") - cell["at"].cast("double")
        start = F.struct(F.lit(1.0).alias("he"), F.lit(0.0).alias("prev"), F.lit(0.0).alias("sum"), F.lit(1.0).alias("c"))
        series = F.aggregate(
            F.sequence(F.lit(1), F.lit(KERNEL_TERMS - 1)),
            start,
            lambda s, m: F.struct(
                (d * s["he"] - (m - 1) * s["prev"]).alias("he"),
                s["he"].alias("prev"),
                (s["sum"] - cell["m"][m] * s["he"] * s["c"] / m).alias("sum"),
                (s["c"] / m).alias("c"),
            ),
            lambda s: s["sum"],
        )
        return cell["m"][0] * normal_cdf(d) + normal_pdf(d) * series

    total = F.aggregate(F.col("_near"), F.col("_lower"), lambda acc, cell: acc + cell_share(cell))
    return attach(scaled, around, [*keys, "_cell"], max_rows=20_000).select(
        *CELL, "value", round9(total / F.col("_n")).alias("f")
    )


def walk_sets(expression: DataFrame, sets: DataFrame, by: str, score) -> DataFrame:
    """``score`` of every sample and set that share a gene: (study, sample_id, signature, sub_signature, score).

    Genes of a sample are ranked by ``by`` from the highest, ties by name. Each cell carries the numbers of the sets its
    gene is in, so cells are dealt out by sample and sorted once, and arrays do the rest: ``score(pos, p, starts)`` takes
    the members' positions, set by set in ascending order, the size of the sample and where each set starts. A task holds
    an Arrow batch and the sample that runs on into the next.
    """
    names = sets.select(*SET).distinct()
    names = keep(names.withColumn("_set", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*SET))))
    ids = F.broadcast(names.select(*[F.col(c).alias(f"_{c}") for c in SET], "_set"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SET]
    on = ["study", "gene_id"] if "study" in sets.columns else ["gene_id"]
    member = sets.join(ids, same[0] & same[1]).groupBy(*on).agg(F.collect_list("_set").alias("_sets"))
    cells = attach(expression.select(*CELL, by), member, on, "left").repartition("study", "sample_id")
    # sample first: nearly every comparison ends at the first bytes of its name
    ordered = cells.sortWithinPartitions("sample_id", "study", F.desc(by), "gene_id").select("study", "sample_id", "_sets")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:2])

    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = held.combine_chunks()
            firsts = _sample_starts(held)
            yield from _set_scores(held.slice(0, firsts[-1]), firsts[:-1], score)
            held = held.slice(firsts[-1])
        if held is not None:
            yield from _set_scores(held, np.zeros(1, np.int64), score)

    scored = ordered.mapInArrow(work, f"{kinds}, _set int, score double")
    return scored.join(F.broadcast(names), "_set").select(*SCORED, "score")


def _sample_starts(cells: pa.Table) -> np.ndarray:
    """Rows at which another sample begins."""
    new = np.zeros(cells.num_rows, bool)
    new[0] = True
    for name in ("study", "sample_id"):
        column = cells.column(name)
        here, last = column.slice(1), column.slice(0, cells.num_rows - 1)
        differs = pc.fill_null(pc.not_equal(here, last), False).to_numpy()
        new[1:] |= differs | (here.is_null().to_numpy() != last.is_null().to_numpy())
    return np.flatnonzero(new)


def _set_scores(cells: pa.Table, firsts: np.ndarray, score):
    """Scores of whole samples that begin at rows ``firsts`` and are sorted from the highest gene."""
    if not cells.num_rows:
        return
    sizes = np.diff(np.append(firsts, cells.num_rows))
    sample = np.repeat(np.arange(len(firsts)), sizes)
    lists = cells.column("_sets").combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(cells.num_rows), lengths)
    number = lists.flatten().to_numpy(zero_copy_only=False)
    if not len(row):
        return
    order = np.lexsort((row, number, sample[row]))
    row, number = row[order], number[order]
    at = sample[row]
    starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (number[1:] != number[:-1])))
    of = at[starts]
    values = score(row - firsts[at] + 1, sizes[of], starts)
    found = ~np.isnan(values)
    where = pa.array(firsts[of][found])
    yield pa.RecordBatch.from_arrays(
        [cells.column(c).combine_chunks().take(where) for c in ("study", "sample_id")]
        + [pa.array(number[starts][found].astype(np.int32)), pa.array(values[found])],
        names=["study", "sample_id", "_set", "score"],
    )


def _deviation(pos: np.ndarray, p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Greatest plus least deviation of the GSVA walk; NaN where it has no steps. Weights are halves: sums are exact."""
    m = np.diff(np.append(starts, len(pos)))
    each = np.repeat(np.arange(len(starts)), m)
    r = np.abs(p[each] / 2.0 - pos)
    run = np.cumsum(r)
    cum = run - np.repeat(run[starts] - r[starts], m)
    total = np.add.reduceat(r, starts)
    k = np.arange(len(pos)) - starts[each] + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        missed = (pos - k) / (p - m)[each]
        after = np.maximum.reduceat(cum / total[each] - missed, starts)
        before = np.minimum.reduceat((cum - r) / total[each] - missed, starts)
        return np.where((p > m) & (total > 0), np.maximum(after, 0.0) + np.minimum(before, 0.0), np.nan)


def gsva(expression: DataFrame, sets: DataFrame, kcdf: str = "none") -> DataFrame:
    """GSVA score per sample and set: greatest plus least deviation of the walk.

    The walk turns only at member genes, so its extremes are read off just after
    and just before each member; the other genes only count towards positions.
    """
    shares = {"none": value_shares, "gaussian": kernel_shares}[kcdf](expression)
    return walk_sets(shares, sets, "f", _deviation)


def ssgsea(expression: DataFrame, sets: DataFrame, alpha: float = 0.25) -> DataFrame:
    """ssGSEA score, divided by its range over the study's samples.

    Summing the walk over all positions weighs every gene by its rank from the
    bottom, so only member rows are aggregated; there is no running window.
    """

    def raw_score(pos, p, starts):
        m = np.diff(np.append(starts, len(pos)))
        rank = np.repeat(p, m) - pos + 1.0
        weight = rank**alpha
        hit, all_weight, ranks = (np.add.reduceat(x, starts) for x in (weight * rank, weight, rank))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(p > m, hit / all_weight - (p * (p + 1) / 2.0 - ranks) / (p - m), np.nan)

    raw = keep(walk_sets(expression, sets, "value", raw_score).withColumnRenamed("score", "raw"))
    span = raw.groupBy("study", *SET).agg((F.max("raw") - F.min("raw")).alias("span"))
    return attach(raw, span, ["study", *SET]).select(
        *SCORED, F.when(F.col("span") > 0, F.col("raw") / F.col("span")).alias("score")
    )


# ---- value based scores ------------------------------------------------------


def gene_z(expression: DataFrame) -> DataFrame:
    """Adds ``z`` per gene over the study; constant genes are left out."""
    stats = expression.groupBy("study", "gene_id").agg(
        F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd")
    )
    return (
        attach(expression, stats.filter(F.round("_sd", 9) > 0), ["study", "gene_id"])
        .withColumn("z", (F.col("value") - F.col("_mean")) / F.col("_sd"))
        .drop("_mean", "_sd")
    )


def weighted_mean(expression: DataFrame, sets: DataFrame) -> DataFrame:
    used = attach(expression, sets.select("gene_id").distinct(), ["gene_id"], "left_semi")
    return (
        members_of(gene_z(used), sets)
        .groupBy(*SCORED)
        .agg((F.sum(F.col("weight") * F.col("z")) / F.sum(F.abs("weight"))).alias("score"))
    )


def cox_is(expression: DataFrame, sets: DataFrame) -> DataFrame:
    mean_of = lambda g: F.avg(F.when(F.col("grp") == g, F.col("value")))
    return (
        members_of(expression, sets)
        .groupBy(*SCORED)
        .agg((mean_of("pro") / F.nullif(mean_of("anti"), F.lit(0.0))).alias("score"))
    )


def ips(expression: DataFrame, sets: DataFrame) -> DataFrame:
    """z within the sample, weighted mean per category, category sum on 0..10."""
    sample = Window.partitionBy("sample_id", "study")  # sorts compare the name with more values first
    sd = F.stddev_samp("value").over(sample)
    z = expression.select(
        *CELL, F.when(sd > 0, (F.col("value") - F.avg("value").over(sample)) / sd).alias("z")
    )
    total = F.round(F.sum("part"), 9)
    return (
        members_of(z, sets)
        .groupBy(*SCORED, "grp")
        .agg(F.avg(F.col("weight") * F.col("z")).alias("part"))
        .groupBy(*SCORED)
        .agg(
            F.when(total <= 0, F.lit(0.0))
            .when(total >= 3, F.lit(10.0))
            .otherwise(F.round(F.lit(10.0) * total / F.lit(3.0)))
            .alias("score")
        )
    )


# ---- composites ------------------------------------------------------------------


def set_weights(sets: DataFrame) -> DataFrame:
    on = [c for c in ("study",) if c in sets.columns]
    return sets.groupBy(*on, *SET).agg(F.max("weight").alias("set_weight"))


def weighted_sum(sub_scores: DataFrame, sets: DataFrame) -> DataFrame:
    """Sum of sub-signature scores times the weight of the sub-signature."""
    weights = set_weights(sets)
    on = [c for c in ("study", *SET) if c in weights.columns]
    return (
        attach(sub_scores, weights, on)
        .groupBy("study", "sample_id", "signature")
        .agg(F.sum(F.col("set_weight") * F.col("score")).alias("score"))
    )


def mean_of_subs(sub_scores: DataFrame) -> DataFrame:
    return sub_scores.groupBy("study", "sample_id", "signature").agg(F.avg("score").alias("score"))


def mean_of_z(sub_scores: DataFrame) -> DataFrame:
    """Mean over sub-signatures of their scores standardised over the study."""
    keys = ["study", *SET]
    stats = sub_scores.groupBy(*keys).agg(F.avg("score").alias("_mean"), F.stddev_samp("score").alias("_sd"))
    z = F.when(F.round("_sd", 9) > 0, (F.col("score") - F.col("_mean")) / F.col("_sd"))
    return mean_of_subs(attach(sub_scores, stats, keys).select("study", "sample_id", *SET, z.alias("score")))


def pio(expression: DataFrame, sets: DataFrame, kcdf: str = "none") -> DataFrame:
    return weighted_sum(gsva(expression, sets, kcdf), sets)


def ipres(expression: DataFrame, sets: DataFrame, kcdf: str = "none") -> DataFrame:
    return mean_of_z(keep(gsva(expression, sets, kcdf)))


def passon(expression: DataFrame, sets: DataFrame) -> DataFrame:
    return mean_of_subs(ssgsea(expression, sets))


def ipsov(expression: DataFrame, sets: DataFrame) -> DataFrame:
    return weighted_sum(ssgsea(expression, sets), sets)


# ---- all signatures together -------------------------------------------------------


def score_all(
    expression: DataFrame, signature: DataFrame, info: DataFrame, kcdf: str = "none", min_samples: int = MIN_SAMPLES
) -> DataFrame:
    """Every routed signature in one plan: one rank pass per rank method.

    ``expression`` is logged and gene-filtered. Returns (study, sample_id,
    signature, score).
    """
    expression = keep(signature_sample_gate(expression, min_samples))
    sets = eligible_sets(expression, score_dispatch(signature, info))
    of = lambda *names: sets.filter(F.col("branch").isin(*names))
    out = ["study", "sample_id", "signature", "score"]
    by_gsva = keep(gsva(expression, of("gsva", "pio", "ipres").drop("branch"), kcdf))
    by_ssgsea = keep(ssgsea(expression, of("ssgsea", "passon", "ipsov").drop("branch")))
    pick = lambda df, name: attach(
        df, of(name).select("study", "signature").distinct(), ["study", "signature"], "left_semi"
    )
    branches = [
        pick(by_gsva, "gsva"),
        weighted_sum(pick(by_gsva, "pio"), of("pio")),
        mean_of_z(pick(by_gsva, "ipres")),
        pick(by_ssgsea, "ssgsea"),
        mean_of_subs(pick(by_ssgsea, "passon")),
        weighted_sum(pick(by_ssgsea, "ipsov"), of("ipsov")),
        weighted_mean(expression, of("mean")),
        cox_is(expression, of("cox_is")),
        ips(expression, of("ips")),
    ]
    scores = branches[0].select(*out)
    for branch in branches[1:]:
        scores = scores.unionByName(branch.select(*out))
    return scores


def score_assemble(samples: DataFrame, signature: DataFrame, scores: DataFrame) -> DataFrame:
    """A row per sample and signature; a signature without scores is NULL.

    Scores are gathered per sample (at most one per signature) and laid out along
    the list of signature names, so no product of tables is formed.
    """
    names = signature.agg(F.sort_array(F.collect_set("signature")).alias("_names"))
    gathered = scores.filter(F.col("score").isNotNull()).groupBy("study", "sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("signature", "score"))).alias("_scores")
    )
    rows = samples.select("study", "sample_id").join(gathered, ["study", "sample_id"], "left")
    return (
        rows.withColumn("_names", names.scalar())
        .select("study", "sample_id", F.explode("_names").alias("signature"), "_scores")
        .select("study", "sample_id", "signature", F.col("_scores")[F.col("signature")].alias("score"))
    )


def drop_incomplete_signatures(scores: DataFrame) -> DataFrame:
    """Remove signatures with a missing score in the study."""
    complete = (
        scores.groupBy("study", "signature")
        .agg(F.count_if(F.col("score").isNull()).alias("n_null"))
        .filter("n_null = 0")
        .select("study", "signature")
    )
    return attach(scores, complete, ["study", "signature"], "left_semi")
