"""Quality rules with limits that follow the data: quantile sketches per language and source give the limits,
which a join brings back to the documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import find, text_of, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
#: Groups with fewer documents take the limits of their language, or of all documents.
MIN_GROUP = 50
#: A limit lies so many quartile distances outside the quartiles, or mean deviations from the median if those are more.
REACH = 3
#: What follows from the quantiles of a metric: limits on both sides of the quartiles, one above them, or one as many
#: distances beyond the 99th percentile as that lies above the median, where most values are equal and a few are not.
#: Symbols and repeated lines are counted per 1,000 words, the mean word length in hundredths of a character.
BOTH, ABOVE, TAIL = "both", "above", "tail"
METRICS = {"symbols": ABOVE, "dup_lines": TAIL, "word_length": BOTH}
#: Values are kept to so many leading bits in a sketch: a quantile is exact to 1 part in 2**(BITS - 1).
BITS = 6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
CHUNK = 1_000_000


def ranks(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 that are equal where the values are."""
    return pa.array(values).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sums of ``mask`` between successive offsets."""
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def listed(lists: pa.Array, wanted: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The wanted elements of lists, the row of each, and the rows' offsets among them."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flags = wanted.to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[flags]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    return lists.values.filter(wanted), rows, np.concatenate([[0], np.cumsum(counts)])


def repeated_words(ids: np.ndarray, rows: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per row the words inside windows that occur twice or more in the row.

    Windows are named exactly, not by hash: names of 2, 4 and 8 words are ranks of pairs of shorter names.
    """
    n, names, width = len(ids), ids, 1
    if n < window:
        return np.zeros(len(offsets) - 1, np.int64)
    while width < window:
        names = ranks(names[:-width] * (int(names.max()) + 1) + names[width:])
        width *= 2
    inside = np.flatnonzero(np.arange(n - window + 1) + window <= offsets[1:][rows[: n - window + 1]])
    key = ranks(rows[inside] * (int(names.max()) + 1) + names[inside]) if len(inside) else inside
    twice = inside[np.bincount(key)[key] > 1] if len(inside) else inside
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + window, -1)
    return per_row(np.cumsum(step[:-1]) > 0, offsets)


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of a column of texts without nulls."""
    data = texts.cast(pa.string())
    bounds = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    table = np.zeros(256, np.uint8)
    table[list(SYMBOLS)] = 1
    symbols = per_row(table[raw], bounds)
    table[:] = 1
    table[0x80:0xC0] = 0
    table[list(SPACES)] = 0
    chars = per_row(table[raw], bounds)

    words = pc.ascii_split_whitespace(data)
    words, rows, offsets = listed(words, pc.not_equal(pc.binary_length(words.values), 0))
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pc.split_pattern(data, "\n")
    lines, at, line_offsets = listed(lines, pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(lines.values)), 0))
    line_ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(at * (int(line_ids.max()) + 1) + line_ids) if len(line_ids) else line_ids
    distinct = np.bincount(pairs // (int(line_ids.max()) + 1), minlength=len(texts)) if len(line_ids) else np.zeros(len(texts), np.int64)
    return {
        "n_words": np.diff(offsets),
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": np.diff(line_offsets) - distinct,
        "n_repeat_words": repeated_words(ids, rows, offsets),
    }


def slices(texts: pa.Array, chunk: int) -> list[pa.Array]:
    """Runs of texts with about ``chunk`` bytes each, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    cut = np.flatnonzero(np.diff(ends // chunk)) + 1
    edges = [0, *cut.tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(edges, edges[1:])]


@F.arrow_udf(MEASURES)
def measures(texts: pa.Array) -> pa.Array:
    parts = [measured(x) for x in slices(texts, CHUNK)] if len(texts) else []
    columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))


def metric(name: str, m: str = "m") -> Column:
    """A metric of a document as a whole number; null without words."""
    of = {"symbols": (1000, "n_symbols", "n_words"), "dup_lines": (1000, "n_dup_lines", "n_words"), "word_length": (100, "word_chars", "n_words")}
    scale, part, whole = of[name]
    return F.expr(f"{scale}L * {m}.{part} div nullif({m}.{whole}, 0L)")


def base_failed(m: str = "m") -> Column:
    words, repeats = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (words < MIN_WORDS) | (repeats * 100 > words * MAX_REPEAT_PERCENT)


def sketches(rows: DataFrame) -> DataFrame:
    """Counts per (level, lang, source, metric, value to BITS leading bits) of rows with ``lang``, ``source``, ``m``.

    Such a sketch has a bounded number of values and merges by adding counts in any order, so thresholds do not
    depend on partitioning. Level 2 is a language and source, 1 a language, 0 everything. Documents that fail the
    base rules are left out.
    """
    values = F.array(*[F.struct(F.lit(n).alias("metric"), metric(n).alias("v")) for n in METRICS])
    shift = "greatest(length(bin(x.v)) - {0}, 0)".format(BITS)
    counts = (
        rows.filter(~base_failed())
        .select("lang", "source", F.explode(values).alias("x"))
        .groupBy("lang", "source", "x.metric", F.expr(f"shiftleft(shiftright(x.v, {shift}), {shift})").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    none = F.lit(None).cast("string")
    level = lambda k, a, b: F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source"))
    levels = F.array(level(2, F.col("lang"), F.col("source")), level(1, F.col("lang"), none), level(0, none, none))
    return (
        counts.select(F.explode(levels).alias("g"), "metric", "value", "n")
        .groupBy("g.level", "g.lang", "g.source", "metric", "value")
        .agg(F.sum("n").alias("n"))
    )


def limits(sketch: DataFrame) -> DataFrame:
    """Per (level, lang, source) with MIN_GROUP documents or more, a struct of the lower and upper limit per metric.

    A window over one sketch holds its bounded number of values only."""
    of = ["level", "lang", "source", "metric"]
    whole = Window.partitionBy(*of)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    at = lambda p: F.min(F.when(F.col("upto") >= F.col("total") * p, F.col("value")))
    middle = ranked.withColumn("q2", at(0.5).over(whole))
    quartiles = middle.groupBy(*of).agg(
        F.first("total").alias("total"),
        at(0.25).alias("q1"),
        F.first("q2").alias("q2"),
        at(0.75).alias("q3"),
        at(0.99).alias("q99"),
        (F.sum(F.col("n") * F.abs(F.col("value") - F.col("q2"))) / F.first("total")).alias("deviation"),
    )
    chosen = []
    spread = REACH * F.greatest((F.col("q3") - F.col("q1")).cast("double"), F.col("deviation"))
    tail = F.col("q99") + REACH * (F.col("q99") - F.col("q2"))
    for name, kind in METRICS.items():
        high = tail.cast("double") if kind == TAIL else F.col("q3") + spread
        low = F.col("q1") - spread if kind == BOTH else F.lit(0.0)
        mine = F.col("metric") == name
        chosen += [F.max(F.when(mine, low)).alias(f"{name}_low"), F.max(F.when(mine, high)).alias(f"{name}_high")]
    return quartiles.filter(F.col("total") >= MIN_GROUP).groupBy("level", "lang", "source").agg(*chosen)


def thresholds(rows: DataFrame) -> DataFrame:
    """The limits that hold for every (lang, source) among ``rows``: its own, else its language's, else those of all."""
    found = written(limits(sketches(rows)), "quality-limits")
    names = [f"{m}_{side}" for m in METRICS for side in ("low", "high")]
    out = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    for level, on in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])):
        side = found.filter(F.col("level") == level).select(
            *[F.col(c).alias(f"_{level}_{c}") for c in on], *[F.col(c).alias(f"_{level}_{c}_v") for c in names]
        )
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_{level}_{c}"))
        # level 0 has one row at most
        out = out.join(side if on else F.broadcast(side), same, "left")
    return written(
        out.select("lang", "source", *[F.coalesce(*[F.col(f"_{k}_{c}_v") for k in (2, 1, 0)]).alias(c) for c in names]),
        "quality-thresholds",
    )


def judged(rows: DataFrame) -> DataFrame:
    """Written rows with ``lang``, ``source`` and ``m``, and their ``base_failed`` and ``kept``."""
    inside = ~base_failed()
    for name in METRICS:
        value = metric(name)
        inside = inside & F.coalesce((value >= F.col(f"{name}_low")) & (value <= F.col(f"{name}_high")), F.lit(True))
    held = find(rows, thresholds(rows), ["lang", "source"], F.col("m"))
    return held.withColumn("base_failed", base_failed()).withColumn("kept", F.coalesce(inside, F.lit(False)))


def _grouped(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, F.col("lang").cast("string"), F.col("source").cast("string"), measures(text_of()).alias("m"))


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document (``doc_id``, ``text``, ``lang``, ``source``) its counts, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules (words, repeated windows) and its symbols, repeated lines and
    mean word length lie within the limits of its language and source, which follow from the quantiles of the documents
    there and from nothing else. Null languages and sources are groups of their own; a null text is empty and fails the base rules; rows are judged
    one by one, so null and repeated doc_ids stay. With too few documents for any limit the base rules decide.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = written(_grouped(docs, F.col("doc_id").cast("bigint")), "quality-rows")
    return judged(rows).select("doc_id", *[F.col(f"m.{c}").alias(c) for c in COUNTS], "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns whatever their names."""
    rows = written(_grouped(docs, F.struct("*").alias("d")), "quality-texts")
    return judged(rows).filter("kept").select("d.*")
