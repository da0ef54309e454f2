"""Document fingerprints by winnowing, in column expressions only.

A text is cut into units: runs of up to eight characters between white space. Every K units in a row have a hash;
in every window of W hashes the least one is chosen, the rightmost of equals, and chosen hashes are kept with their
positions. Two texts that share W + K - 1 units in a row therefore share a fingerprint inside that run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, text_of

K = 3
W = 8
UNIT = r"[^\x20\x09-\x0D]{1,8}"
#: Low bits that hold a position, from the end so that the rightmost of equal hashes is the least.
PLACE_BITS = 31
LAST_PLACE = (1 << PLACE_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def chosen(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen hashes of a text in order, each a long of a 32-bit hash and a position.

    A text with fewer than ``k`` units has one hash of them all, one with fewer than ``w`` hashes one window; a text
    without units has none.
    """

    def hashes(units: Column) -> Column:
        grams = F.greatest(F.size(units) - (k - 1), F.least(F.size(units), F.lit(1)))

        def one(i: Column) -> Column:
            h = F.shiftrightunsigned(F.xxhash64(*[F.get(units, i + j) for j in range(k)]), 32)
            return F.shiftleft(h, PLACE_BITS) + (F.lit(LAST_PLACE) - i)

        return F.when(grams > 0, F.transform(F.sequence(F.lit(0), grams - 1), one)).otherwise(F.array().cast("array<bigint>"))

    def halved(step: int) -> Callable[[Column], Column]:
        def pairs(m: Column) -> Column:
            later = F.slice(m, step + 1, F.greatest(F.size(m) - step, F.lit(0)))
            return F.zip_with(m, later, lambda x, y: F.least(x, y))

        return pairs

    def windows(values: Column) -> Column:
        least, width = values, 1
        while width < w:
            least = let(least, halved(min(width, w - width)))
            width *= 2
        return let(least, lambda m: F.array_distinct(F.slice(m, 1, F.greatest(F.size(m) - (w - 1), F.least(F.size(m), F.lit(1))))))

    return let(let(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), hashes), windows)


def hash_of(mark: Column) -> Column:
    return F.shiftright(mark, PLACE_BITS)


def position_of(mark: Column) -> Column:
    """The unit at which a chosen hash starts, from 0."""
    return F.lit(LAST_PLACE) - mark.bitwiseAND(F.lit(LAST_PLACE))


def hash_set(marks: Column) -> Column:
    """The different hashes, in order of first appearance."""
    return F.array_distinct(F.transform(marks, hash_of))


def written_out(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sets; 1 if both are empty."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)),
    )


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per document (``doc_id``, ``text``) its ``marks``: an array of ``hash`` and ``position``.

    A null text is empty and has none; null and repeated doc_ids and rows stay; other columns are not read.
    """
    marks = F.transform(chosen(text_of(), k, w), lambda m: F.struct(hash_of(m).alias("hash"), position_of(m).alias("position")))
    return docs.select(F.col("doc_id").cast("bigint"), marks.alias("marks"))


def with_next(docs: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (``doc_id``, ``text``) with the struct ``next`` of the row that follows by doc_id, the first after the last.

    Nulls come last, spread over parts of their own, and equal doc_ids go by a hash of their text. Rows are ranged into parts by a quantile sketch
    of the doc_ids (as many numbers as there are shuffle partitions come to the driver); each part also gets a copy
    of the first row of the part after it, so a window inside the part sees every successor. ``make`` adds columns
    after the rows have been dealt out.
    """
    spark = docs.sparkSession
    parts = shuffle_width(spark)
    rows = docs.withColumn("_tie", F.xxhash64("text"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    edges = docs.agg(F.percentile_approx("doc_id", shares, F.lit(10 * parts)).alias("e")).first()["e"] or []
    edge = F.array(*[F.lit(e).cast("bigint") for e in sorted(set(edges))]) if edges else F.array().cast("array<bigint>")
    # rows without a doc_id, however many, are ranged by their hash
    bits = parts.bit_length() - 1
    hashed = F.shiftright("_tie", 64 - bits) + (1 << bits - 1) if bits else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), F.lit(len(edges) + 1) + hashed.cast("int")).otherwise(
        F.size(F.filter(edge, lambda e: e < F.col("doc_id")))
    )
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.col("_tie").alias("tie"))
    firsts = rows.groupBy(part.alias("part")).agg(F.min(order).alias("first")).orderBy("part").collect()
    before = [(firsts[i - 1]["part"], f["part"], f["first"]["doc_id"], f["first"]["tie"]) for i, f in enumerate(firsts)]
    heads = spark.createDataFrame(before, "_to int, _part int, _id bigint, _head bigint")
    held = rows.withColumn("_own", part).join(
        F.broadcast(heads),
        (F.col("_own") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_head")),
        "left",
    )
    places = F.array_compact(
        F.array(
            F.struct(F.col("_own").alias("part"), F.lit(False).alias("copy")),
            F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("part"), F.lit(True).alias("copy"))),
        )
    )
    dealt = held.select("doc_id", "text", "_tie", F.explode(places).alias("_at")).select(
        "doc_id", "text", "_tie", F.col("_at.part").alias("_part"), F.col("_at.copy").alias("_copy")
    )
    made = make(dealt.repartitionById(len(edges) + 1 + (1 << bits), "_part"))  # a task for each part
    follow = Window.partitionBy("_part").orderBy("_copy", F.col("doc_id").asc_nulls_last(), "_tie")
    extra = [c for c in made.columns if c not in dealt.columns]
    return (
        made.withColumn("next", F.lead(F.struct("text", *extra)).over(follow))
        .filter(~F.col("_copy"))
        .select("doc_id", "text", *extra, "next")
    )


def compared(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per document its fingerprint, that of its edited text and the likeness of both and of the next document's.

    The edited text has the last quarter of the code points (rounded down) replaced by as many from the start of the
    next document by doc_id, or all it has. Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. A null text is empty; two empty fingerprints are alike.
    Null doc_ids come last and repeated ones stay; a single row follows itself; other columns are not read; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    held = with_next(rows, lambda df: df.withColumn("own", hash_set(chosen(F.col("text"), k, w))))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - quarter), F.substring(F.col("next.text"), F.lit(1), quarter)
    )
    made = held.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        "own",
        F.col("next.own").alias("after"),
        let(
            edited,
            lambda t: F.struct(F.sha2(t.cast("binary"), 256).alias("sha"), hash_set(chosen(t, k, w)).alias("hashes")),
        ).alias("edited"),
    )
    return made.select(
        "doc_id",
        "n_chars",
        F.col("edited.sha").alias("edited_sha256"),
        written_out(F.col("own")).alias("fingerprint"),
        written_out(F.col("edited.hashes")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited.hashes")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
