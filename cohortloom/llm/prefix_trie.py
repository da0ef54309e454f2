"""The trie of conversations that share their first turns, built from range partitions and a skeleton.

A conversation is a path: the digests of its turns one after the other, so that paths in byte order have every subtree of
the trie side by side. Rows are range-partitioned by (path, conv_id) at splitters drawn from a sample; a node lies in more
than one range only if it is a prefix of a splitter. These prefixes are the skeleton, a small trie that every task gets.
A task walks its sorted range with a stack and finishes all other nodes on its own. Of skeleton nodes it emits partial
aggregates, which are added up and then rolled up along the skeleton.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, text_of, word_count, written

#: Bytes of a turn in a path.
STEP = 16
#: Sampled paths per range.
SAMPLES = 32
#: Ends of a skeleton node are passed on in pieces of about so many bytes.
PIECE = 1 << 20
#: A finished node, a partial skeleton node, and ends of a skeleton node.
NODE, PART, ENDS = 0, 1, 2
ROWS = (
    "kind int, skeleton int, conv_id bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved bigint, words bigint, ends string, shard int, piece bigint"
)
FIELDS = [c.split()[0] for c in ROWS.split(", ")]
KINDS = [
    pa.string() if f == "ends" else pa.int32() if f in ("kind", "skeleton", "shard") else pa.int64() for f in FIELDS
]
ROOT = b""
EMPTY = hashlib.sha256(b"").hexdigest()


# ---- paths -----------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and its turns in order: arrays ``steps`` (hex digests of role and text) and ``words``.

    Turns of the same number stand by their digests; a null number comes first. Texts are not gathered, a turn takes 48
    bytes. Rows with a null conv_id belong to no conversation.
    """
    role, text = text_of("role"), text_of("text")
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), digest.alias("step"), word_count(text).alias("words")).alias("t"),
    )
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.col("t.step").alias("steps"), F.col("t.words").alias("words"))


def path(steps: Column) -> Column:
    """The digests as bytes, one after the other."""
    return F.unhex(F.array_join(steps, ""))


# ---- splitters and skeleton --------------------------------------------------------


def splitters(sample: list[tuple[bytes, int]], ranges: int) -> list[tuple[bytes, int | None]]:
    """Bounds of ``ranges`` ranges of about equal share of a sorted sample, each as short as it can be.

    Between two different paths the first part of the later one that differs is enough, and no id is needed. Within
    equal paths the bound is the whole path and an id, so that one path may fill several ranges.
    """
    out = []
    for i in range(1, ranges):
        at = i * len(sample) // ranges
        if not 0 < at < len(sample):
            continue
        before, here = sample[at - 1], sample[at]
        if before[0] == here[0]:
            bound = here
        else:
            bound = (here[0][: STEP * (shared(before[0], here[0]) + 1)], None)
        if not out or order(bound) > order(out[-1]):
            out.append(bound)
    return out


def order(bound: tuple[bytes, int | None]) -> tuple[bytes, int]:
    """A sortable form: without an id a bound stands before all ids of its path."""
    return bound[0], -(1 << 63) if bound[1] is None else bound[1]


def shared(a: bytes, b: bytes) -> int:
    """The number of first steps that two paths have in common."""
    n = min(len(a), len(b)) // STEP
    if a[: n * STEP] == b[: n * STEP]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * STEP : middle * STEP] == b[low * STEP : middle * STEP]:
            low = middle
        else:
            high = middle
    return low


def below(key: bytes, step: bytes) -> bytes:
    """The key of a child in the skeleton; keys have one size at any depth."""
    return hashlib.blake2b(key + step, digest_size=STEP).digest()


def skeleton(bounds: list[tuple[bytes, int | None]]) -> tuple[dict[bytes, int], list[int | None]]:
    """The nodes that ranges may share, all prefixes of the bounds: numbers by key, and the parent of each number.

    The root comes first and parents before children. There are as many nodes as steps in all bounds at most.
    """
    number, over = {ROOT: 0}, [None]
    for at, conv in bounds:
        key = ROOT
        # without an id the bound stands before its own node
        for d in range(len(at) // STEP - (conv is None)):
            parent, key = number[key], below(key, at[STEP * d : STEP * (d + 1)])
            if key not in number:
                number[key] = len(over)
                over.append(parent)
    return number, over


# ---- one range ---------------------------------------------------------------------


class _Open:
    """A node on the stack: what is known of its members so far."""

    __slots__ = ("children", "convs", "depth", "ends", "hash", "key", "leaves", "least", "node", "saved", "waiting", "words")

    def __init__(self, depth: int, words: int, key: bytes | None, node: int | None):
        self.depth, self.words = depth, words
        self.key, self.node = key, node  # key and number in the skeleton, or None
        self.convs = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.hash, self.ends = (None, []) if node is not None else (hashlib.sha256(), None)
        self.waiting: list[list] = []  # finished children whose parent's conv_id is not known yet


class Walk:
    """The nodes of a sorted range of paths."""

    def __init__(self, number: dict[bytes, int], shard: int):
        self.number, self.shard, self.pieces = number, shard, 0
        self.before, self.out = b"", []
        self.stack = [_Open(0, 0, ROOT, number[ROOT])]

    def add(self, conv: int, at: bytes, words: list[int]) -> None:
        """The next conversation; ids of equal paths rise."""
        keep = shared(self.before, at)
        while len(self.stack) > keep + 1:
            self.close()
        for depth in range(keep + 1, len(at) // STEP + 1):
            over = self.stack[-1]
            over.children += 1
            # only a skeleton node has skeleton children
            key = None if over.node is None else below(over.key, at[STEP * (depth - 1) : STEP * depth])
            self.stack.append(_Open(depth, words[depth - 1], key, self.number.get(key)))
        top, self.before = self.stack[-1], at
        top.convs += 1
        top.least = conv if top.least is None else min(top.least, conv)
        if top.node is None:
            top.hash.update(b"%d" % conv if top.ends is None else b",%d" % conv)
            top.ends = []
        else:
            top.ends.append(conv)
            if len(top.ends) * 8 >= PIECE:
                self.pass_on(top)

    def pass_on(self, node: _Open) -> None:
        """Ends of a skeleton node so far."""
        if node.ends:
            text = ",".join(map(str, node.ends))
            self.out.append([ENDS, node.node, None, None, None, None, None, None, None, None, text, self.shard, self.pieces])
            self.pieces, node.ends = self.pieces + 1, []

    def close(self) -> None:
        """The top of the stack is complete in this range."""
        node = self.stack.pop()
        over = self.stack[-1] if self.stack else None
        if over is not None:
            over.convs += node.convs
            over.least = node.least if over.least is None else min(over.least, node.least)
        for row in node.waiting:
            row[4] = node.least
        self.out += node.waiting
        if node.node is not None:
            self.pass_on(node)
            self.out.append(
                [PART, node.node, node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, node.words, None, self.shard, None]
            )
            if over is not None:
                over.children -= 1  # other ranges may count it too
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.convs - 1) * node.words
        row = [NODE, None, node.least, node.depth, None, node.convs, node.children, leaves, saved, None, node.hash.hexdigest(), None, None]
        over.leaves += leaves
        over.saved += saved
        if over.node is not None:  # its parent's conv_id comes from the skeleton
            row[1] = over.node
            self.out.append(row)
        else:
            over.waiting.append(row)

    def finish(self) -> None:
        while self.stack:
            self.close()


def walked(batches: Iterator[pa.RecordBatch], number: dict[bytes, int], shard: int) -> Iterator[pa.RecordBatch]:
    """Rows of all nodes of a range."""
    walk = Walk(number, shard)

    def taken(least: int):
        if len(walk.out) > least:
            made, walk.out = walk.out, []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), KINDS)], names=FIELDS)

    some = False
    for batch in batches:
        some = some or len(batch) > 0
        for conv, at, words in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), batch.column("words").to_pylist()):
            walk.add(conv, at, words)
            yield from taken(10_000)
    if some:
        walk.finish()
        yield from taken(0)


# ---- the whole trie ------------------------------------------------------------------


def bounds_of(paths: DataFrame, ranges: int) -> list[tuple[bytes, int | None]]:
    """Splitters from about SAMPLES conversations a range, each counted by its length, taken by a hash of the id."""
    total = paths.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    if ranges < 2 or not total:
        return []
    # one in so many steps: a long conversation may be taken more than once
    every = max(1, total // (ranges * SAMPLES))
    drawn = F.floor((F.size("words") + 1 + F.pmod(F.xxhash64("conv_id"), F.lit(every))) / every).cast("int")
    taken = paths.select("path", "conv_id", drawn.alias("times")).filter("times > 0").collect()
    held = sorted((bytes(r.path), r.conv_id, r.times) for r in taken)
    return splitters([(p, c) for p, c, times in held for _ in range(times)], ranges)


def trie(paths: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every node of the trie of ``paths`` (``conv_id``, unique; ``path``: 16 bytes a turn; ``words``: one number a turn).

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (of the root: null), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``; see :func:`prefix_trie`.
    """
    from pyspark import TaskContext

    spark = paths.sparkSession
    paths = written(paths.select("conv_id", "path", "words"), "trie-paths")
    wanted = ranges or shuffle_width(spark)
    bounds = bounds_of(paths, wanted)
    number, over = skeleton(bounds)
    marks = [order(b) for b in bounds]

    def placed(batches):
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            at = [bisect_right(marks, key) for key in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "shard"])

    dealt = paths.mapInArrow(placed, "conv_id bigint, path binary, words array<bigint>, shard int")
    sorted_ = dealt.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("path", "conv_id").drop("shard")
    rows = written(sorted_.mapInArrow(lambda b: walked(b, number, TaskContext.get().partitionId()), ROWS), "trie-rows")

    top = written(skeleton_nodes(rows, over), "trie-skeleton")
    finished = rows.filter(F.col("kind") == NODE)
    above = top.select(F.col("skeleton").alias("_over"), F.col("conv_id").alias("_conv"))
    # at most one row per step of a bound
    local = finished.join(F.broadcast(above), F.col("skeleton") == F.col("_over"), "left").select(
        "conv_id", "depth", F.coalesce("parent", "_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return local.unionByName(top.drop("skeleton"))


def skeleton_nodes(rows: DataFrame, over: list[int | None]) -> DataFrame:
    """Skeleton nodes: the partial aggregates of all ranges, added up by Spark, then rolled up from child to parent.

    The sums are one row per skeleton node, no more than the skeleton that was sent to the tasks.
    """
    sums = (
        rows.filter(F.col("kind") == PART)
        .groupBy("skeleton")
        .agg(
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
            *[F.max(c).alias(c) for c in ("depth", "words")],
        )
    )
    held = {r.skeleton: r.asDict() for r in sums.collect()}
    for i in sorted(held, reverse=True):  # children before parents
        node = held[i]
        node["n_leaves"] += node["n_children"] == 0
        node["saved"] += (node["n_convs"] - 1) * node["words"]
        if i:
            parent = held[over[i]]
            parent["n_children"] += 1
            parent["n_leaves"] += node["n_leaves"]
            parent["saved"] += node["saved"]
        node["parent"] = held[over[i]]["conv_id"] if i else None
    names = ["skeleton", "conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved"]
    made = pa.table({n: pa.array([v[n] for v in held.values()], pa.int32() if n == "skeleton" else pa.int64()) for n in names})
    nodes = rows.sparkSession.createDataFrame(made)
    return nodes.join(ends_of(rows), "skeleton", "left").select(
        "skeleton", "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )


def ends_of(rows: DataFrame) -> DataFrame:
    """Digests of the ends of skeleton nodes.

    A digest has to be made from first to last, so the pieces of a node run through one task, one at a time: ranges
    are in path order, and within a path in the order of ids.
    """

    def work(batches):
        now, made = None, None
        for batch in batches:
            for node, text in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist()):
                if node == now:
                    made.update(b",")
                else:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"skeleton": pa.array([now], pa.int32()), "ends": [made.hexdigest()]})
                    now, made = node, hashlib.sha256()
                made.update(text.encode())
        if now is not None:
            yield pa.RecordBatch.from_pydict({"skeleton": pa.array([now], pa.int32()), "ends": [made.hexdigest()]})

    pieces = rows.filter(F.col("kind") == ENDS).select("skeleton", "shard", "piece", "ends")
    dealt = pieces.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "piece")
    return dealt.select("skeleton", "ends").mapInArrow(work, "skeleton int, ends string")


def prefix_trie(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """The trie of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``) as they are.

    A node stands for a sequence of first turns (role and text) and has the conversations that start with it as members.
    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (its parent's conv_id; of the root: null),
    ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of its subtree, itself included), ``saved_tokens`` (over
    its subtree, members less one times the words of a node's last text) and ``ends_sha256`` (of the ids of members
    that end there, ascending, joined by commas).

    Turns are in the order of ``turn``, nulls first, repeated numbers by digest. A null role or text is empty. Rows with
    a null conv_id take no part. Other columns are not read. Without conversations there is no node, not even the root.
    """
    return trie(turns(conversations).select("conv_id", path(F.col("steps")).alias("path"), "words"), ranges)


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Paths of conversations that start like the first of their group of ids.

    Conversation c takes the first h turns of conversation c - c % ``group`` and then its own after its first h, with
    h = crc32(decimal c) % ``most``.
    """
    held = written(turns(conversations), "trie-turns")
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = held.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_first"), F.slice("steps", 1, most - 1).alias("_steps"), F.slice("words", 1, most - 1).alias("_words")
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    own = held.select("*", first.alias("_first"), h.alias("_h")).join(heads, "_first", "left")

    def spliced(head: str, tail: str) -> Column:
        begun = F.coalesce(F.slice(head, F.lit(1), F.col("_h")), F.array().cast(own.schema[tail].dataType))
        return F.concat(begun, F.slice(tail, F.col("_h") + 1, F.greatest(F.size(tail), F.lit(1))))

    return own.select("conv_id", path(spliced("_steps", "steps")).alias("path"), spliced("_words", "words").alias("words"))



#: The query over ``conversations`` in SQL: every prefix written out, CRC-32 worked out from its polynomial.
TRIE_SQL = r"""
WITH crc_table AS (
 SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_concat([b], [0, 1, 2, 3, 4, 5, 6, 7]),
   lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
turn_rows AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS step,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
 FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
 SELECT conv_id, list(step ORDER BY turn NULLS FIRST, step) AS steps, list(words ORDER BY turn NULLS FIRST, step) AS words
 FROM turn_rows GROUP BY conv_id),
heads AS (
 SELECT conv_id, steps, words, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
   list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
   lambda c, d: xor(c >> 8, t[CAST(xor(c, d) & 255 AS BIGINT) + 1])), 4294967295) % 4 AS h
 FROM convs, crc_table),
own AS (
 SELECT c.conv_id, coalesce(f.steps[:c.h], []) || c.steps[c.h + 1:] AS steps, coalesce(f.words[:c.h], []) || c.words[c.h + 1:] AS words
 FROM heads c LEFT JOIN heads f ON f.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (
 SELECT conv_id, len(steps) AS n, depth, array_to_string(steps[:depth], '') AS node,
  CASE WHEN depth > 0 THEN array_to_string(steps[:depth - 1], '') END AS over, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words
 FROM (SELECT *, unnest(range(len(steps) + 1)) AS depth FROM own)),
nodes AS (
 SELECT node, any_value(over) AS over, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends
 FROM prefixes GROUP BY node),
kids AS (SELECT over AS node, count(*) AS n FROM nodes WHERE over IS NOT NULL GROUP BY over),
full_nodes AS (
 SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * n.words AS saved
 FROM nodes n LEFT JOIN kids k USING (node)),
above AS (
 SELECT substr(node, 1, CAST(32 * d AS BIGINT)) AS node, leaf, saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_nodes)),
sums AS (SELECT node, sum(leaf) AS n_leaves, sum(saved) AS saved FROM above GROUP BY node)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
 CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = f.over
"""
