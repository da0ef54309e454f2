"""Gradient-boosted trees for all studies and parameter settings together.

A training is a (study, config_id) pair. Samples are one row each, whatever the number of trainings: binned features, which
never change, next to an array with the margin under every training. A tree level is one grouped sum of gradients per
(training, node, feature, bin); only these sums leave the rows, so a study of any size is reduced before the shuffle. Of two
sister nodes only the smaller one is summed, the other is their parent less the sister. Missing values are a cell of their
own, and every cut is tried with them on either side. Tree levels and rounds are the only things stepped through.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import round9, sigmoid, unit_hash
from ..session import scratch_path
from .roc import auc, ranked_counts
from .scale import attach, exact_quantiles, held, keep

# The search grid, first column varying fastest.
GRID = {
    "nrounds": [10, 60, 110, 160, 210, 260],
    "eta": [0.01, 0.0825, 0.155, 0.2275, 0.3],
    "max_depth": [3, 6, 9],
    "gamma": [0.0, 0.1, 0.5, 1.0],
    "colsample": [0.6, 0.8, 1.0],
    "subsample": [0.6, 0.8, 1.0],
}
GRID_TYPES = {
    "nrounds": "int",
    "eta": "double",
    "max_depth": "int",
    "gamma": "double",
    "colsample": "double",
    "subsample": "double",
}
L2 = 1.0
MIN_CHILD_HESSIAN = 1.0
BASE_SEED = 135
TRAINING = ["study", "config_id"]
#: Trainings of a study that are run together.
WAVE = 64
#: Gains that differ by less than its inverse are ties; a child needs its least hessian up to half of that.
SCALE = 1e9
#: Per-study trees of at most so many bytes go to every executor.
FOREST_BYTES = 64 << 20
SPLITS = (
    "study string, config_id int, node int, f int, split_bin int, default_left boolean, gain double, cover double, n bigint, "
    "leaf_value double, small int"
)


# ---- parameters ------------------------------------------------------------


def param_grid(studies: DataFrame, grid: dict[str, list] = GRID) -> DataFrame:
    """Every parameter setting for every study, numbered from 1.

    The number is unfolded into one index per parameter, so the product of the
    parameter lists is never joined.
    """
    size = 1
    for values in grid.values():
        size *= len(values)
    rest = F.col("config_id") - 1
    columns = []
    for name, values in grid.items():
        listed = F.array(*[F.lit(v).cast(GRID_TYPES[name]) for v in values])
        columns.append(F.element_at(listed, (F.floor(rest) % len(values) + 1).cast("int")).alias(name))
        rest = F.floor(rest / len(values))
    return studies.select("study").select(
        "study", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("config_id")
    ).select("study", "config_id", *columns)


def distinct_trainings(grid: DataFrame, apply_gamma: bool = False) -> DataFrame:
    """Settings that need a training of their own.

    The rounds of otherwise equal settings are prefixes of one run, and gamma
    counts only when it is applied; ``train_id`` names the run of a setting.
    """
    same = ["study", "eta", "max_depth", "colsample", "subsample"] + (["gamma"] if apply_gamma else [])
    return grid.withColumn("train_id", F.min("config_id").over(Window.partitionBy(*same))).withColumn(
        "gamma", F.col("gamma") if apply_gamma else F.lit(0.0)
    )


def study_seeds(studies: DataFrame, base: int = BASE_SEED) -> DataFrame:
    """seed = base + place of the study by name (one row per study)."""
    names = studies.agg(F.sort_array(F.collect_set("study")).alias("names"))
    return names.select(F.posexplode("names").alias("i", "study")).select(
        "study", (F.lit(base) + F.col("i") + 1).cast("int").alias("seed")
    )


# ---- binning ---------------------------------------------------------------


def bin_cuts(expression: DataFrame, bins: int = 256, exact: bool = True) -> DataFrame:
    """Inner quantile cut points per study and feature, rounded to 6 digits.

    ``exact=False`` reads them off a mergeable sketch in one pass over the rows.
    """
    shares = [i / bins for i in range(1, bins)]
    keys = ["study", "feature"]
    expression = expression.filter(F.col("value").isNotNull())
    if not exact:
        sketch = F.percentile_approx("value", F.array(*[F.lit(s) for s in shares]), F.lit(10_000))
        rounded = expression.groupBy(*keys).agg(sketch.alias("cuts"))
        return rounded.withColumn("cuts", F.transform("cuts", lambda c: F.round(c, 6)))
    cuts = exact_quantiles(expression, keys, "value", shares, buckets=32)
    return cuts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.round("cut", 6))).alias("cuts"))


def bin_features(expression: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``bin``: how many cut points lie at or below the value; NULL where the value is missing."""
    below = F.size(F.filter("cuts", lambda c: c <= F.col("value")))
    return (
        attach(expression, cuts, ["study", "feature"])
        .withColumn("bin", F.when(F.col("value").isNotNull(), below))
        .drop("cuts")
    )


def placed(cuts: DataFrame) -> DataFrame:
    """Adds ``at``, the place (from 1) of a feature among its study's by name, and ``width``, their number."""
    study = Window.partitionBy("study")
    return cuts.withColumn("at", F.row_number().over(study.orderBy("feature"))).withColumn("width", F.count(F.lit(1)).over(study))


def binned_samples(binned: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per sample: ``bins`` in feature-name order next to the label. A feature without a row is missing.

    ``binned`` carries the places of :func:`placed`.
    """
    gathered = binned.groupBy("study", "sample_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "bin"))).alias("_b"), F.max("width").cast("int").alias("_w")
    )
    here = lambda i: F.get(F.filter("_b", lambda x: x["at"] == i), F.lit(0))["bin"]
    bins = F.when(F.size("_b") == F.col("_w"), F.col("_b.bin")).otherwise(F.transform(F.sequence(F.lit(1), F.col("_w")), here))
    return gathered.join(labels, ["study", "sample_id"]).select("study", "sample_id", "label", bins.alias("bins"))


def feature_lists(cuts: DataFrame) -> DataFrame:
    """Feature names and cut points per study, in name order."""
    listed = F.sort_array(F.collect_list(F.struct("feature", "cuts")))
    return cuts.groupBy("study").agg(listed.alias("_f")).select(
        "study", F.col("_f.feature").alias("features"), F.col("_f.cuts").alias("feature_cuts")
    )


# ---- one tree ----------------------------------------------------------------


def grad_hess(rows: DataFrame) -> DataFrame:
    p = sigmoid(F.col("margin"))
    return rows.withColumn("g", p - F.col("label")).withColumn("h", p * (F.lit(1.0) - p))


def row_kept(tree) -> Column:
    """Is the sample used by this tree? Reproducible from the study's seed."""
    return unit_hash("seed", F.lit("row"), tree, "sample_id") < F.col("subsample")


def feature_order(tree) -> Column:
    """Feature positions (from 1) in the tree's random order."""
    positions = F.sequence(F.lit(1), F.size("features"))
    keyed = F.transform(
        positions,
        lambda i: F.struct(
            unit_hash("seed", F.lit("feature"), tree, F.element_at("features", i)).alias("u"), i.alias("i")
        ),
    )
    return F.sort_array(keyed)["i"]


def features_kept(tree) -> Column:
    """The first share of the tree's feature order, one feature at least."""
    n = F.greatest(F.lit(1), F.floor(F.col("colsample") * F.size("features") + F.lit(1e-9)).cast("int"))
    return F.sort_array(F.slice(feature_order(tree), F.lit(1), n))


def row_col_sampling(rows: DataFrame, tree) -> DataFrame:
    return rows.withColumn("row_kept", row_kept(tree))


def split_histogram(rows: DataFrame) -> DataFrame:
    """Sums of gradients per (training, node, feature, bin); bin NULL holds the missing values.

    ``rows`` carry ``node``, ``g``, ``h``, ``bins`` and the kept feature
    positions ``kept``; partial sums are formed before the shuffle.
    """
    cells = rows.select(*TRAINING, "node", "g", "h", "bins", F.explode("kept").alias("f"))
    return (
        cells.groupBy(*TRAINING, "node", "f", F.get("bins", F.col("f") - 1).alias("bin"))
        .agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    )


def with_sisters(summed: DataFrame, parents: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds the nodes that were not summed: the cells of their parent less those of their sister.

    ``summed`` has the smaller child of every split of ``splits``, ``parents`` the level above; its
    shuffle serves both of its uses here. Cells left without
    samples are dropped by their whole-number count, so rounding leaves none behind.
    """
    cells = [*TRAINING, "node", "f", "bin"]
    other = F.col("node") + F.when(F.col("node") % 2 == 1, 1).otherwise(-1)
    step = splits.filter(F.col("small").isNotNull()).select(*TRAINING, "node", "small")
    above = attach(parents, step, [*TRAINING, "node"]).withColumn("node", F.col("node") * 2 + 2 - F.col("small")).drop("small")
    less = summed.select(*TRAINING, other.alias("node"), "f", "bin", *[(-F.col(c)).alias(c) for c in ("g", "h", "n")])
    left = (
        above.unionByName(less)
        .groupBy(*cells)
        .agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
        .filter(F.col("n") > 0)
    )
    return summed.unionByName(left)


def best_split(hist: DataFrame, params: DataFrame) -> DataFrame:
    """Best cut of every node. A node without a positive gain becomes a leaf.

    Every cut is tried with the missing values left and, if there are any, right;
    ``default_left`` tells which was better. Running sums go over the bins of one
    feature, a bounded list. Gain is compared in whole units of 1 / SCALE; ties take the
    first feature, then the first bin, then left. ``small`` names the child with
    fewer samples (0 left, 1 right) where the next level will split again.
    """
    sums, level, best, rows = _split_columns()
    # a node's cells, features x bins at most, serve its running sums and its choice in one place
    dealt = hist.repartition(*TRAINING, "node")
    cells = dealt.select(*TRAINING, "node", "f", "bin", *sums).withColumn("level", level)
    cells = attach(cells, params.select(*TRAINING, "gamma", "max_depth", "eta", "n_cuts"), TRAINING)
    return cells.groupBy(*TRAINING, "node").agg(*best).select(*rows)


@functools.cache
def _split_columns() -> tuple[list[Column], Column, list[Column], list[Column]]:
    """The columns of :func:`best_split`, put together once."""
    feature = Window.partitionBy(*TRAINING, "node", "f")
    left = feature.orderBy(F.asc_nulls_first("bin")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("bin").isNotNull()
    sums = []
    for c in ("g", "h", "n"):
        sums += [
            F.sum(F.when(known, F.col(c)).otherwise(0)).over(left).alias(f"{c}l"),
            F.sum(F.when(~known, F.col(c)).otherwise(0)).over(feature).alias(f"{c}m"),
            F.sum(c).over(feature).alias(f"{c}t"),
        ]
    level = F.floor(F.log2(F.col("node") + F.lit(1.000001))).cast("int")
    part = lambda g, h: g * g / (h + F.lit(L2))
    enough = MIN_CHILD_HESSIAN - 0.5 / SCALE

    def tried(with_missing: bool):
        gl, hl, nl = (F.col(f"{c}l") + F.col(f"{c}m") if with_missing else F.col(f"{c}l") for c in ("g", "h", "n"))
        gr, hr = F.col("gt") - gl, F.col("ht") - hl
        gain = F.lit(0.5) * (part(gl, hl) + part(gr, hr) - part(F.col("gt"), F.col("ht"))) - F.col("gamma")
        units = F.floor(gain * F.lit(SCALE) + F.lit(0.5))
        cut = known & (F.col("bin") < F.get("n_cuts", F.col("f") - 1)) & (F.col("level") < F.col("max_depth"))
        rank = F.struct(
            units.alias("units"),
            (-F.col("f")).alias("f"),
            (-F.col("bin")).alias("bin"),
            F.lit(int(with_missing)).alias("left"),
            gl.alias("gl"),
            hl.alias("hl"),
            nl.alias("nl"),
            gain.alias("gain"),
        )
        allowed = cut & (hl >= enough) & (hr >= enough) & (units > 0)
        return F.max(F.when(allowed & (F.lit(with_missing) | (F.col("nm") > 0)), rank))

    best = [
        F.greatest(tried(True), tried(False)).alias("best"),
        F.min_by(F.struct("gt", "ht", F.col("nt").alias("n"), "eta", "level", "max_depth"), "f").alias("all"),
    ]
    rows = [
        *[F.col(c) for c in TRAINING],
        F.col("node"),
        (-F.col("best.f")).alias("f"),
        (-F.col("best.bin")).alias("split_bin"),
        (F.col("best.left") == 1).alias("default_left"),
        F.col("best.gain").alias("gain"),
        F.col("all.ht").alias("cover"),
        F.col("all.n").alias("n"),
        F.when(F.col("best").isNull(), leaf_of("all.gt", "all.ht", "all.eta")).alias("leaf_value"),
        F.when(
            F.col("all.level") + 1 < F.col("all.max_depth"), (F.col("best.nl") * 2 > F.col("all.n")).cast("int")
        ).alias("small"),
        F.col("best"),
        F.col("all"),
    ]
    return sums, level, best, rows


def leaf_of(g: str, h: str, eta: str) -> Column:
    return -F.col(eta) * F.col(g) / (F.col(h) + F.lit(L2))


def with_last_leaves(splits: DataFrame) -> DataFrame:
    """Splits and, below splits of the deepest level, their two leaves, whose sums the split knows."""
    return splits.withColumn("default_left", F.coalesce("default_left", F.lit(True))).select(*TRAINING, _leaf_rows())


@functools.cache
def _leaf_rows() -> Column:
    ends = F.col("f").isNotNull() & F.col("small").isNull()
    b, t = F.col("best"), F.col("all")

    def child(right: int, g: Column, h: Column, n: Column) -> Column:
        value = -F.col("all.eta") * g / (h + F.lit(L2))
        node = (F.col("node") * 2 + 1 + right).alias("node")
        return row(node=node, cover=h, n=n, leaf_value=value, default_left=F.lit(True))

    def row(**values) -> Column:
        fields = [f.split() for f in SPLITS.split(", ")[2:]]
        return F.struct(*[values.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields])

    own = row(**{f.split()[0]: F.col(f.split()[0]) for f in SPLITS.split(", ")[2:]})
    left, right = child(0, b["gl"], b["hl"], b["nl"]), child(1, t["gt"] - b["gl"], t["ht"] - b["hl"], t["n"] - b["nl"])
    return F.inline(F.when(ends, F.array(own, left, right)).otherwise(F.array(own)))


def walked(tree: Column, levels: int) -> Column:
    """The node a sample's ``bins`` reach in a tree (an array by node number) after so many levels, or its leaf."""

    def step(node: Column, _: Column) -> Column:
        at = F.get(tree, node)
        bin_ = F.get("bins", at["f"] - 1)
        right = F.when(bin_.isNull(), ~at["default_left"]).otherwise(bin_ > at["split_bin"])
        return F.when(at["f"].isNull(), node).otherwise(node * 2 + 1 + right.cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), step) if levels else F.lit(0)


# ---- all trees -----------------------------------------------------------------


def training_table(trainings: DataFrame, lists: DataFrame, seeds: DataFrame) -> DataFrame:
    """Parameters, seed and feature list per training (one row each)."""
    return attach(attach(trainings, lists, ["study"]), seeds, ["study"]).withColumn(
        "n_cuts", F.transform("feature_cuts", lambda c: F.size(c))
    )


class Growth:
    """One run of trainings: their parameters, the samples with their margins, and the splits written so far."""

    def __init__(self, samples: DataFrame, trainings: DataFrame, max_depth: int, base_margin: float):
        self.spark = samples.sparkSession
        self.trainings, self.depth = keep(trainings), max_depth
        self.params = self.trainings.select(*TRAINING, "eta", "max_depth", "gamma", "n_cuts")
        per_study = self.trainings.groupBy("study").agg(
            F.first("seed").alias("seed"), F.sort_array(F.collect_list("config_id")).alias("configs")
        )
        size = per_study.agg(F.count(F.lit(1)).alias("studies"), F.max(F.size("configs")).alias("most")).first()
        # what a study's trees take: parameters, feature places and nodes per training
        wide = 2 ** (max_depth + 1) * 48 + 4096
        self.fits = size.studies * (size.most or 0) * wide <= FOREST_BYTES
        self.path = scratch_path(self.spark, "splits")
        cores = self.spark.sparkContext.defaultParallelism
        if samples.rdd.getNumPartitions() < cores:  # a small table of many trainings is dealt to all cores
            samples = samples.repartition(cores, "study", "sample_id")
        start = F.array_repeat(F.lit(float(base_margin)), F.size("configs"))
        self.state = held(
            self.meet(samples, per_study).select("study", "sample_id", "label", "bins", "seed", "configs", start.alias("margins"))
        )

    def meet(self, rows: DataFrame, lookup: DataFrame) -> DataFrame:
        """Rows with what their study's trainings share."""
        if self.fits:
            return rows.join(F.broadcast(lookup), "study")
        return attach(rows, lookup, ["study"], max_rows=0)

    def written(self, tree: int) -> DataFrame:
        return self.spark.read.schema(f"{SPLITS}, level int").parquet(f"{self.path}/tree_id={tree}")

    def forest(self, tree: int, levels: int) -> DataFrame:
        """Per study an array over its trainings: parameters, kept features and the tree grown so far."""
        own = self.trainings.withColumn("kept", F.when(F.col("nrounds") > tree, features_kept(F.lit(tree))))
        if levels:
            # heap numbering: node i of a training at place i
            nodes = self.written(tree).groupBy(*TRAINING).agg(
                F.collect_list(F.struct("node", "f", "split_bin", "default_left", "leaf_value", "small")).alias("_n")
            )
            place = lambda i: F.get(F.filter("_n", lambda x: x["node"] == i), F.lit(0))
            row = nodes.select(*TRAINING, F.transform(F.sequence(F.lit(0), F.lit(2 ** (levels + 1) - 2)), place).alias("tree"))
            own = own.join(F.broadcast(row) if self.fits else row, TRAINING, "left")
        slots = F.struct("config_id", "subsample", "max_depth", "kept", *(["tree"] if levels else []))
        return own.groupBy("study").agg(F.sort_array(F.collect_list(slots)).alias("slots"))

    def rows(self, tree: int, level: int) -> DataFrame:
        """A row per sample and training that sums it at this level: used rows in the smaller of two sisters."""
        drawn = self.state.withColumn("_u", unit_hash("seed", F.lit("row"), F.lit(tree), "sample_id"))
        met = self.meet(drawn, self.forest(tree, level))

        def slot(w: Column, i: Column) -> Column:
            node = walked(w["tree"], level) if level else F.lit(0)
            live = w["kept"].isNotNull() & (F.col("_u") < w["subsample"]) & (w["max_depth"] > level)
            return F.struct(
                w["config_id"].alias("config_id"), w["kept"].alias("kept"), F.get("margins", i).alias("margin"),
                F.when(live, node).alias("node"), *([w["tree"].alias("tree")] if level else []),
            )

        each = met.select("study", "label", "bins", F.inline(F.filter(F.transform("slots", slot), lambda w: w["node"].isNotNull())))
        if level:
            parent = F.get("tree", F.floor((F.col("node") - 1) / 2).cast("int"))
            each = each.filter(F.col("node") >= 2**level - 1).filter(parent["small"] == (F.col("node") - 1) % 2).drop("tree")
        return grad_hess(each)

    def level(self, tree: int, level: int, above: DataFrame | None = None) -> DataFrame:
        """Writes the splits of a level and returns its sums; ``above`` are those of the level before."""
        hist = split_histogram(self.rows(tree, level))
        if level:
            hist = with_sisters(hist, above, self.written(tree).filter(F.col("level") == level - 1))
        if level + 1 < self.depth:
            hist = held(hist)
        with_last_leaves(best_split(hist, self.params)).write.parquet(f"{self.path}/tree_id={tree}/level={level}")
        return hist

    def grow(self, tree: int) -> None:
        """One round: the tree of every training, then the margins under it."""
        above = None
        for level in range(self.depth):
            above = self.level(tree, level, above)
        met = self.meet(self.state, self.forest(tree, self.depth))

        def moved(m: Column, i: Column) -> Column:
            w = F.get("slots", i)
            return m + F.coalesce(F.get(w["tree"], walked(w["tree"], self.depth))["leaf_value"], F.lit(0.0))

        self.state = held(met.withColumn("margins", F.transform("margins", moved)).select(*self.state.columns))

    def margins(self, after: int) -> DataFrame:
        """Every sample's margin under every training."""
        each = self.state.select("study", "sample_id", "label", "configs", F.posexplode("margins").alias("_i", "margin"))
        return each.select("study", F.get("configs", F.col("_i")).alias("config_id"), F.lit(after).alias("nrounds"), "sample_id", "label", "margin")


def grow_trees(
    samples: DataFrame,
    trainings: DataFrame,
    rounds: int,
    max_depth: int,
    checkpoints: list[int] | None = None,
    base_margin: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """Train every (study, config_id) of ``trainings`` for ``rounds`` rounds.

    ``samples`` is the output of :func:`binned_samples`; ``trainings`` of
    :func:`training_table`. Returns ``(tree_node, margins)``; ``margins`` holds
    every sample's margin after each of the ``checkpoints`` rounds (default: the
    last), a training contributing no tree beyond its own ``nrounds``. A round runs
    the same jobs whatever its number: per level a sum and its splits, then the new
    margins, all cut off from their lineage in the shared folder.
    """
    checkpoints = checkpoints or [rounds]
    run = Growth(samples, trainings, max_depth, base_margin)
    margins = []
    for tree in range(rounds):
        run.grow(tree)
        if tree + 1 in checkpoints:
            margins.append(run.margins(tree + 1))
    at_checkpoints = margins[0]
    for more in margins[1:]:
        at_checkpoints = at_checkpoints.unionByName(more)
    nodes = run.spark.read.schema(f"{SPLITS}, tree_id int, level int").parquet(run.path)
    return name_nodes(nodes, run.trainings.select(*TRAINING, "features", "feature_cuts")), at_checkpoints


def name_nodes(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """Splits and leaves as tree nodes with feature names and thresholds."""
    split = F.col("f").isNotNull()
    named = attach(nodes, lists, TRAINING, max_rows=20_000)
    return named.select(
        *TRAINING,
        "tree_id",
        F.col("node").alias("node_id"),
        F.when(split, F.element_at("features", F.coalesce("f", F.lit(1)))).alias("feature"),
        F.when(
            split,
            F.get(F.element_at("feature_cuts", F.coalesce("f", F.lit(1))), F.coalesce("split_bin", F.lit(0))),
        ).alias("threshold"),
        F.when(split, F.col("node") * 2 + 1).alias("left"),
        F.when(split, F.col("node") * 2 + 2).alias("right"),
        "default_left",
        "leaf_value",
        "gain",
        "cover",
    )


# ---- search and report -------------------------------------------------------------


def prepare_samples(
    expression: DataFrame, labels: DataFrame, bins: int = 256, exact: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(samples, lists): binned rows and per-study feature lists.

    ``expression`` is (study, sample_id, feature, value).
    """
    cuts = keep(placed(bin_cuts(expression, bins, exact)))
    return keep(binned_samples(bin_features(expression, cuts), labels)), feature_lists(cuts)


def train_per_study(
    samples: DataFrame,
    lists: DataFrame,
    grid: DataFrame,
    seeds: DataFrame,
    apply_gamma: bool = False,
    wave_size: int = WAVE,
) -> tuple[DataFrame, DataFrame]:
    """Trees and checkpoint margins of every distinct training of the grid.

    ``grid`` is :func:`param_grid` output or part of it; study and setting are
    keys of one job. A study's trainings run in waves of ``wave_size``, which
    bounds the margins of a sample and the trees of a study. ``config_id`` of
    the result is the ``train_id``.
    """
    runs = (
        distinct_trainings(grid, apply_gamma)
        .groupBy("study", F.col("train_id").alias("config_id"), "eta", "max_depth", "gamma", "colsample", "subsample")
        .agg(F.max("nrounds").alias("nrounds"), F.collect_set("nrounds").alias("_at"))
    )
    place = F.row_number().over(Window.partitionBy("study").orderBy("config_id")) - 1
    runs = keep(runs.withColumn("_wave", F.floor(place / wave_size).cast("int")))
    # one row per wave for the driver: how far to step
    limits = (
        runs.groupBy("_wave")
        .agg(
            F.max("nrounds").alias("rounds"),
            F.max("max_depth").alias("depth"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_at")))).alias("at"),
        )
        .orderBy("_wave")
        .collect()
    )
    nodes, margins = None, None
    for wave in limits:
        table = training_table(runs.filter(F.col("_wave") == wave["_wave"]).drop("_at", "_wave"), lists, seeds)
        more_nodes, more_margins = grow_trees(samples, table, wave["rounds"], wave["depth"], wave["at"])
        nodes = more_nodes if nodes is None else nodes.unionByName(more_nodes)
        margins = more_margins if margins is None else margins.unionByName(more_margins)
    return nodes, margins


def grid_auc(margins: DataFrame, grid: DataFrame, apply_gamma: bool = False) -> DataFrame:
    """Training AUC of every setting: study, config_id, auc.

    Scores that agree to 9 digits tie: margins are sums whose last digits depend on the order of rows.
    """
    keys = ("study", "train_id", "nrounds")
    predictions = margins.withColumnRenamed("config_id", "train_id").withColumn("score", round9(sigmoid(F.col("margin"))))
    aucs = auc(ranked_counts(predictions, keys, buckets=64), keys)
    return attach(distinct_trainings(grid, apply_gamma).select("study", "config_id", "train_id", "nrounds"), aucs, keys).select(
        "study", "config_id", "auc"
    )


def select_best(aucs: DataFrame, grid: DataFrame) -> DataFrame:
    """The first setting with the greatest AUC (12 digits) per study."""
    rank = F.struct(F.round("auc", 12), -F.col("config_id"))
    best = aucs.groupBy("study").agg(F.max_by(F.struct("config_id", "auc"), rank).alias("_b")).select("study", "_b.*")
    return attach(grid, best, ["study", "config_id"])


def chosen_models(
    nodes: DataFrame, margins: DataFrame, best: DataFrame, grid: DataFrame, apply_gamma: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The trees and margins of every study's chosen setting, taken from the search.

    Growing a setting again gives the same trees, as sampling is
    hashed, so the first ``nrounds`` trees of its run are the refitted model; see :func:`refit_best`.
    """
    run = [F.col("study"), F.col("train_id"), F.col("nrounds").alias("_rounds"), F.col("config_id").alias("_config")]
    runs = distinct_trainings(grid, apply_gamma).select("study", "config_id", "train_id")
    chosen = keep(attach(best, runs, TRAINING).select(*run))
    named = lambda df: df.withColumnRenamed("config_id", "train_id")
    trees = attach(named(nodes), chosen, ["study", "train_id"]).filter(F.col("tree_id") < F.col("_rounds"))
    last = attach(named(margins), chosen, ["study", "train_id"]).filter(F.col("nrounds") == F.col("_rounds"))
    back = lambda df, like: df.withColumn("config_id", F.col("_config")).select(*like.columns)
    return back(trees, nodes), back(last, margins)


def refit_best(
    samples: DataFrame, lists: DataFrame, best: DataFrame, seeds: DataFrame, apply_gamma: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Train the chosen setting of every study again; returns (tree_node, margins)."""
    chosen = keep(best.withColumn("gamma", F.col("gamma") if apply_gamma else F.lit(0.0)).drop("auc"))
    limits = chosen.agg(F.max("nrounds"), F.max("max_depth")).first()
    return grow_trees(samples, training_table(chosen, lists, seeds), limits[0], limits[1])


def feature_importance(tree_node: DataFrame, keys=("model_id",)) -> DataFrame:
    """Share of gain, cover and split count per feature."""
    sums = keep(
        tree_node.filter(F.col("feature").isNotNull())
        .groupBy(*keys, "feature")
        .agg(F.sum("gain").alias("g"), F.sum("cover").alias("c"), F.count(F.lit(1)).alias("n"))
    )
    totals = sums.groupBy(*keys).agg(F.sum("g").alias("tg"), F.sum("c").alias("tc"), F.sum("n").alias("tn"))
    return attach(sums, totals, keys).select(
        *keys,
        "feature",
        (F.col("g") / F.col("tg")).alias("gain"),
        (F.col("c") / F.col("tc")).alias("cover"),
        (F.col("n") / F.col("tn")).alias("frequency"),
    )


def train_summary(best: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Chosen parameters with AUC and threshold to 4 digits, stamped now."""
    return attach(best, thresholds.select("study", "threshold"), ["study"], "left").select(
        "study",
        "config_id",
        "nrounds",
        "eta",
        "max_depth",
        "colsample",
        "subsample",
        F.round("auc", 4).alias("best_auc"),
        F.round("threshold", 4).alias("best_threshold"),
        F.current_timestamp().alias("reported_at"),
    )
