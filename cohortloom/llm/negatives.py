"""Hard negatives by exact inner products, with bounds along a spanning tree of the anchors.

An anchor's positives are its best rows of the same label; its hard negatives for a positive are the best rows of another
label whose score lies in a window below that positive's score. Anchors are a stated query set and meet all rows in blocks.

The anchors of a block form a minimum spanning tree. Only the root is scored against every candidate x of a block. For a
child c of a parent p, the inequality of Cauchy and Schwarz gives |c.x - p.x| <= |c - p| |x|, so p's score (or p's bounds,
where x was not scored) plus or minus the edge length times the norm of x bounds the score of c. A candidate is scored
only if its bounds overlap what is looked for: the windows of the anchor's positives, or the best positives so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, written

POSITIVES, NEGATIVES = 5, 3
#: The window in hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Candidates and anchors of a block.
ROWS, ANCHORS = 2048, 512
#: Anchor blocks of at most so many bytes, counted, go to every executor; more are joined with salts.
BROADCAST_BYTES = 32 << 20
#: A record batch holds so many pairs of blocks.
PAIRS_PER_BATCH = 8
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

BLOCK = "block bigint, dim int, rows array<bigint>, ids array<bigint>, labels array<bigint>, vectors binary"
TREE = (
    "part int, a_dim int, a_rows array<bigint>, a_labels array<bigint>, a_vectors binary, a_parent array<int>, "
    "a_edge array<double>"
)
HITS = "anchor_row bigint, slot int, row bigint, id bigint, score bigint"
LAST = np.iinfo(np.int64).max


# ---- blocks --------------------------------------------------------------------


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones are filled up with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    at = np.arange(out.shape[1]) < lengths[:, None]
    out[at] = flat
    return out


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of a partition in tables of ``rows`` rows, with their matrices."""
    held = []
    for batch in batches:
        held.append(batch)
        while sum(map(len, held)) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            cut, held = whole.slice(0, rows).combine_chunks(), whole.slice(rows).to_batches()
            yield cut, matrix(cut["vector"].chunk(0))
    if sum(map(len, held)):
        cut = pa.Table.from_batches(held).combine_chunks()
        yield cut, matrix(cut["vector"].chunk(0))


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """``row, id, label, vector`` in blocks of at most ROWS rows, without a shuffle."""
    from pyspark import TaskContext

    def work(batches):
        first = TaskContext.get().partitionId() << 33
        for i, (cut, held) in enumerate(_packed(batches, ROWS)):
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([first + i], pa.int64()),
                    "dim": pa.array([held.shape[1]], pa.int32()),
                    "rows": pa.array([cut["row"].to_pylist()], pa.list_(pa.int64())),
                    "ids": pa.array([cut["id"].to_pylist()], pa.list_(pa.int64())),
                    "labels": pa.array([cut["label"].to_pylist()], pa.list_(pa.int64())),
                    "vectors": pa.array([held.astype("<i8").tobytes()], pa.binary()),
                }
            )

    return rows.select("row", "id", "label", "vector").mapInArrow(work, BLOCK)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree from row 0: rows in the order they join, the parent of each and the edge to it."""
    v = vectors.astype(np.float64)
    n = len(v)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int32), np.zeros(n)
    near, via = np.full(n, np.inf), np.zeros(n, np.int32)
    out = np.ones(n, bool)
    now = 0
    for i in range(n):
        order[i], out[now] = now, False
        if i + 1 == n:
            break
        gap = np.sqrt(((v - v[now]) ** 2).sum(1))
        closer = out & (gap < near)
        near[closer], via[closer] = gap[closer], now
        now = int(np.argmin(np.where(out, near, np.inf)))
        parent[now], edge[now] = via[now], near[now]
    return order, parent, edge


def anchor_trees(anchors: DataFrame, parts: int) -> DataFrame:
    """``row, label, vector`` of anchors in ``parts`` blocks of like labels, each with its spanning tree: rows in
    tree order, so that a parent stands before its children."""
    from pyspark import TaskContext

    def work(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not sum(map(len, tables)):
            return
        cut = pa.concat_tables(tables).combine_chunks()
        held = matrix(cut["vector"].chunk(0))
        order, parent, edge = spanning_tree(held)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        own = parent[order]
        cut = cut.take(pa.array(order))
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "a_dim": pa.array([held.shape[1]], pa.int32()),
                "a_rows": pa.array([cut["row"].to_pylist()], pa.list_(pa.int64())),
                "a_labels": pa.array([cut["label"].to_pylist()], pa.list_(pa.int64())),
                "a_vectors": pa.array([held[order].astype("<i8").tobytes()], pa.binary()),
                "a_parent": pa.array([np.where(own < 0, -1, place[own]).tolist()], pa.list_(pa.int32())),
                "a_edge": pa.array([edge[order].tolist()], pa.list_(pa.float64())),
            }
        )

    dealt = anchors.select("row", "label", "vector").repartitionByRange(parts, "label", "row")
    return dealt.mapInArrow(work, TREE)


# ---- a block of anchors against a block of candidates ------------------------------


class Pair:
    """Candidates and anchors of one pair of blocks; ``scored`` counts inner products."""

    def __init__(self, row: dict):
        shape = lambda raw, dim, n: np.frombuffer(raw, "<i8").reshape(n, dim)
        x, a = shape(row["vectors"], row["dim"], len(row["ids"])), shape(row["a_vectors"], row["a_dim"], len(row["a_rows"]))
        dim = max(x.shape[1], a.shape[1])
        x, a = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (x, a))
        self.rows = np.array(row["rows"], np.int64)
        self.ids, self.labels = row["ids"], np.array(row["labels"], np.int64)
        self.keys = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.a_rows, self.a_labels = np.array(row["a_rows"], np.int64), np.array(row["a_labels"], np.int64)
        self.parent, self.edge = row["a_parent"], row["a_edge"]
        far = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(1))
        self.norms, self.a_norms, self.scored = far(x), far(a), 0
        most = max(1, dim) * float(abs(x).max(initial=0)) * float(abs(a).max(initial=0))
        # doubles are exact below 2**53; beyond a long's range Python's whole numbers are, cut off at its ends
        kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
        self.x, self.a = x.astype(kind), a.astype(kind)

    def scores(self, i: int, picked: np.ndarray) -> np.ndarray:
        self.scored += len(picked)
        found = self.x[picked] @ self.a[i]
        if found.dtype == object:
            found = np.clip(found, -LAST, LAST)
        return found.astype(np.int64)

    def walk(self, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Anchors in tree order with the places and exact scores of the candidates that ``wanted`` asks for, given
        bounds of all scores. At the root all are scored."""
        n = len(self.rows)
        low, high = np.empty((len(self.a), n)), np.empty((len(self.a), n))
        for i, p in enumerate(self.parent):
            if p < 0:
                every = np.arange(n)
                low[i] = high[i] = exact = self.scores(i, every)
                picked = wanted(i, low[i], high[i])
                yield i, picked, exact[picked]
                continue
            # rounding stays far below the last term
            reach = self.edge[i] * (1 + 1e-9) * self.norms + 1e-12 * (self.a_norms[i] + self.a_norms[p]) * self.norms + 1e-6
            low[i], high[i] = low[p] - reach, high[p] + reach
            picked = wanted(i, low[i], high[i])
            exact = self.scores(i, picked)
            low[i][picked] = high[i][picked] = exact
            yield i, picked, exact

    def best(self, picked: np.ndarray, exact: np.ndarray) -> np.ndarray:
        """Places within ``picked`` by falling score, then id (null last), then row."""
        return np.lexsort((self.rows[picked], self.keys[picked], -exact))

    def positives(self, count: int) -> Iterator[tuple]:
        """The best ``count`` rows of an anchor's label, itself left out."""

        def wanted(i, low, high):
            own = np.flatnonzero((self.labels == self.a_labels[i]) & (self.rows != self.a_rows[i]))
            if len(own) <= count:
                return own
            least = np.partition(low[own], -count)[-count]  # so many reach at least this
            return own[high[own] >= least]

        for i, picked, exact in self.walk(wanted):
            for at in self.best(picked, exact)[:count]:
                yield int(self.a_rows[i]), 0, int(self.rows[picked[at]]), self.ids[picked[at]], int(exact[at])

    def negatives(self, windows: dict[int, list[tuple[int, int, int]]], count: int) -> Iterator[tuple]:
        """For each window (slot, least, most) of an anchor the best ``count`` rows of another label within."""

        def wanted(i, low, high):
            own = windows.get(int(self.a_rows[i]), [])
            overlap = np.zeros(len(low), bool)
            for _, least, most in own:
                overlap |= (high >= least) & (low <= most)
            return np.flatnonzero(overlap & (self.labels != self.a_labels[i]))

        for i, picked, exact in self.walk(wanted):
            order = self.best(picked, exact)
            falling = -exact[order]
            for slot, least, most in windows.get(int(self.a_rows[i]), []):
                first = int(np.searchsorted(falling, -most, "left"))
                for at in order[first : first + count]:
                    if exact[at] < least:
                        break
                    yield int(self.a_rows[i]), slot, int(self.rows[picked[at]]), self.ids[picked[at]], int(exact[at])


# ---- all pairs of blocks ----------------------------------------------------------


def meet(blocks: DataFrame, trees: DataFrame, parts: int, tree_bytes: int) -> DataFrame:
    """Every candidate block beside every anchor block.

    Few anchor blocks are broadcast and the candidates stay where they are. More are joined by block number and a salt
    of the candidates' block, so that one anchor block does not put all candidates into one task.
    """
    faced = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if tree_bytes <= BROADCAST_BYTES:
        return faced.join(F.broadcast(trees), "part")
    salts = max(1, shuffle_width(blocks.sparkSession) // parts)
    copies = trees.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return faced.withColumn("_salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).join(copies, ["part", "_salt"])


def found(pairs: DataFrame, search: Callable[[Pair, dict], Iterator[tuple]], label: str) -> DataFrame:
    """What ``search`` yields for every pair of blocks, as a table."""

    def work(batches):
        names = [c.split()[0] for c in HITS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for row in batch.to_pylist():
                made = list(search(Pair(row), row))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    conf = pairs.sparkSession.conf
    before = conf.get(BATCH)
    conf.set(BATCH, str(PAIRS_PER_BATCH))
    try:
        return written(pairs.mapInArrow(work, HITS), label)
    finally:
        conf.set(BATCH, before)


def best_of(hits: DataFrame, count: int) -> DataFrame:
    """The first ``count`` hits per anchor and slot; partial limits run before the shuffle."""
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def hard_negatives(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """Hard negatives of every anchor and positive.

    ``rows`` has ``id`` (bigint), ``label``, ``vector`` (array of whole numbers) and ``anchor`` (boolean). Scores are
    inner products; higher ones come first, ties by smaller id. The positives of an anchor are its first ``positives``
    other rows of the same label. For each the first ``negatives`` rows of another label are returned that satisfy
    ``low * positive_score <= 100 * negative_score <= high * positive_score``: ``anchor_id``, ``positive_id``,
    ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a null label or vector or a null component take no part; a null ``anchor`` is no anchor. A null id counts
    as the greatest. Repeated ids and rows are rows of their own. Vectors of unequal length are filled up with zeros.
    Scores beyond a long stop at its ends. Other columns are not read; without rows or anchors the result is empty.
    """
    spark = rows.sparkSession
    usable = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull()))
    flat = usable.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("id").cast("bigint"),
        F.col("label").cast("bigint"),
        F.col("vector").cast("array<bigint>"),
        F.coalesce("anchor", F.lit(False)).alias("anchor"),
    )
    flat = written(flat, "negative-rows")  # from here on row numbers stay
    own = flat.filter("anchor")
    size = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    parts = max(1, -(-size.n // ANCHORS))
    tree_bytes = size.n * (8 * (size.dim or 0) + 64)
    blocks = written(candidate_blocks(flat), "negative-blocks")
    trees = written(anchor_trees(own, parts), "negative-trees")
    parts = (trees.agg(F.max("part")).first()[0] or 0) + 1
    hits = found(meet(blocks, trees, parts, tree_bytes), lambda pair, row: pair.positives(positives), "negative-positives")
    chosen = written(best_of(hits, positives).select("anchor_row", F.col("rank").alias("slot"), "id", "score"), "negative-chosen")
    # the positives of an anchor block's anchors: at most ANCHORS * positives
    member = trees.select("part", F.explode("a_rows").alias("anchor_row"))
    per_part = member.join(chosen, "anchor_row").groupBy("part").agg(
        F.collect_list(F.struct("anchor_row", "slot", "score")).alias("windows")
    )
    armed = written(trees.join(per_part, "part"), "negative-windows")

    def search(pair, row):
        open_ = {}
        for w in row["windows"]:
            s = w["score"]
            open_.setdefault(w["anchor_row"], []).append((w["slot"], -(-low * s // 100), high * s // 100))
        return pair.negatives(open_, negatives)

    misses = found(meet(blocks, armed, parts, tree_bytes + 24 * positives * size.n), search, "negative-hits")
    anchors = own.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    scored = best_of(misses, negatives).select(
        "anchor_row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    paid = chosen.select("anchor_row", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return scored.join(paid, ["anchor_row", "slot"]).join(anchors, "anchor_row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


#: The query over ``embeddings`` in SQL: every anchor against every row, without bounds.
NEGATIVES_SQL = """
WITH flat AS (
 SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
 SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same,
  CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
 FROM flat a JOIN flat c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
pos AS (
 SELECT * FROM scored WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
 CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST, n.r) AS INTEGER) AS "rank",
 n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY "rank" <= 3
"""
