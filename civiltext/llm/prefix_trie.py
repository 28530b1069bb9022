"""The trie of conversation prefixes, with what sharing them saves.

A turn is 128 bits of its role and text. The digest of a prefix is the sum, in four lanes of 32 bits, of the hashes of its
turns with their depths, so digests follow from running sums, also where a conversation is spread over many tasks: nothing
gathers a whole conversation.

A count-min sketch of all prefix digests, with counters up to two, is built in every task and added up. Where the estimate
is one the prefix belongs to a single conversation, and its node is written as it is: one member, one leaf, nothing saved.
Only prefixes that may be shared are shuffled and grouped exactly; a wrong estimate costs a row, not the result. The sketch
has four cells a row for each prefix and at most `MOST_CELLS`; beyond about 30 million prefixes it proves less.

Every node belongs to its smallest member, so a conversation owns the lower part of its path. Sums over a subtree are the
sums, over the members, of what each owns from that depth on: running sums again, then one grouping. Deep tries take no
more rounds than flat ones, and no group holds more than a chunk of `CHUNK_TURNS` turns of a conversation.

Conversations are numbers; rows without one belong to none. Turns are in the order of their number, null first, turns of
one number in the order of their digest; a null role or text is empty, equal turns count each. A conversation without
turns is a member of the root. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiltext.llm.common import stored, text_or_empty
from civiltext.operators.joins import spread_join

HEADS, FAMILY = 6, 100  # a conversation starts with fewer than six turns of the first one of its hundred
CHUNK_TURNS = 4096
LEAST_CELLS, MOST_CELLS, SKETCH_ROWS = 1 << 12, 1 << 24, 4
SLICE = 1 << 16
LANE = (1 << 32) - 1
LANES = ("l1", "l2", "l3", "l4")


def _low(value: Column) -> Column:
    return value.bitwiseAND(F.lit(LANE))


def _two_lanes(high: Column, low: Column) -> Column:
    return F.shiftleft(_low(high), 32).bitwiseOR(_low(low))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """`(conv, pos, hi, lo, chars)` for `turns (conv_id, turn, role, text)`, pos from 1.

    Rows are dealt by range, numbered where they are, and moved up by what of their conversation lies in earlier parts.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", F.xxhash64(role, text).alias("hi"),
        F.xxhash64(F.lit("second"), role, text).alias("lo"), F.length(text).cast("bigint").alias("chars"),
    )
    # the last key deals out rows equal in everything else
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = stored(rows.repartitionByRange("conv", "turn", "hi", "lo", "tie").withColumn("part", F.spark_partition_id()), "turns")
    spans = dealt.groupBy("conv", "part").count()
    before = F.sum("count").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a part has at most one conversation that began in an earlier one: no more rows than parts
    behind = F.broadcast(spans.select("conv", "part", before.alias("before")).filter("before IS NOT NULL"))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "hi", "lo"))
    numbered = dealt.withColumn("place", place.cast("bigint")).join(behind, ["conv", "part"], "left")
    pos = F.col("place") + F.coalesce("before", F.lit(0))
    return stored(numbered.select("conv", pos.alias("pos"), "hi", "lo", "chars"), "ordered-turns")


def with_borrowed_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps `(conv, depth, hi, lo, chars, total)` and conversations `(conv, total)` after the rebuilding.

    The first h turns of a conversation come from the first one of its hundred, h being the crc32 of its number modulo 6.
    """
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("len"))
    first = lengths.filter(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    own = lengths.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS)
    own = own.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(first, "base", "left")
    used = F.least("h", F.coalesce("base_len", F.lit(0)))
    total = used + F.greatest(F.col("len") - F.col("h"), F.lit(0))
    convs = stored(own.select("conv", "base", "len", "h", used.alias("used"), total.alias("total")), "conversations")
    # a hundred conversations at most share a head of five turns
    heads = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv", "base")
    borrowed = convs.join(heads, "base").filter("pos <= used").select("conv", F.col("pos").alias("depth"), "hi", "lo", "chars", "total")
    lookup = convs.select("conv", "h", "used", "total", F.col("len").alias("n_rows"))
    rest = spread_join(turns, lookup, "conv").filter("pos > h")
    rest = rest.select("conv", (F.col("used") + F.col("pos") - F.col("h")).alias("depth"), "hi", "lo", "chars", "total")
    return borrowed.unionByName(rest), convs.select("conv", "total")


def _chunk(depth: Column) -> Column:
    return F.floor(depth / F.lit(CHUNK_TURNS))


def prefixes(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """`(conv, depth, k1, k2, p1, p2, chars, last)`: each prefix with its digest and that of the one before, roots included."""
    mixed = (F.xxhash64("depth", "hi", "lo"), F.xxhash64(F.lit("second"), "depth", "hi", "lo"))
    lanes = [lane for x in mixed for lane in (_low(F.shiftrightunsigned(x, 32)), _low(x))]
    rows = steps.select("conv", "depth", "chars", "total", _chunk(F.col("depth")).alias("chunk"), *[x.alias(n) for n, x in zip(LANES, lanes)])
    rows = stored(rows, "steps")
    sums = rows.groupBy("conv", "chunk").agg(*[F.sum(n).alias(n) for n in LANES])
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per chunk of a conversation longer than a chunk
    begun = sums.select("conv", "chunk", *[F.sum(n).over(earlier).alias(f"b_{n}") for n in LANES]).filter("b_l1 IS NOT NULL")
    within = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select("*", *[F.sum(n).over(within).alias(f"s_{n}") for n in LANES]).join(begun, ["conv", "chunk"], "left")
    here = [F.col(f"s_{n}") + F.coalesce(f"b_{n}", F.lit(0)) for n in LANES]
    above = [s - F.col(n) for s, n in zip(here, LANES)]
    found = run.select(
        "conv", "depth", _two_lanes(*here[:2]).alias("k1"), _two_lanes(*here[2:]).alias("k2"), _two_lanes(*above[:2]).alias("p1"),
        _two_lanes(*above[2:]).alias("p2"), "chars", (F.col("depth") == F.col("total")).alias("last"),
    )
    zero = F.lit(0).cast("bigint")
    roots = convs.select(
        "conv", zero.alias("depth"), *[zero.alias(n) for n in ("k1", "k2", "p1", "p2", "chars")], (F.col("total") == 0).alias("last"))
    return stored(found.unionByName(roots), "prefixes")


def _cells(first: np.ndarray, second: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each digest in each row of the sketch: every lane of the digest is a hash of its own."""
    return [lane & (width - 1) for key in (first, second) for lane in (key >> 32 & LANE, key & LANE)]


def count_min(digests: DataFrame, width: int) -> np.ndarray:
    """Counters up to two of digests `(k1, k2)`: `SKETCH_ROWS` rows of `width` cells, added up from those of the tasks by slices."""
    schema = "slice int, cells binary"
    arrow = pa.schema([("slice", pa.int32()), ("cells", pa.binary())])

    def emit(slices: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for number, cells in slices:
            yield pa.RecordBatch.from_pydict({"slice": [number], "cells": [cells.tobytes()]}, schema=arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SKETCH_ROWS, width), dtype=np.uint8)
        for batch in batches:
            for row, cells in zip(table, _cells(batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), width)):
                places, counts = np.unique(cells, return_counts=True)
                row[places] = np.minimum(row[places] + np.minimum(counts, 2), 2)
        flat = table.ravel()
        yield from emit((i, part) for i, start in enumerate(range(0, len(flat), SLICE)) if (part := flat[start : start + SLICE]).any())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, cells in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist()):
                part = np.frombuffer(cells, dtype=np.uint8)
                sums[number] = np.minimum(sums[number] + part, 2).astype(np.uint8) if number in sums else part
        yield from emit(iter(sums.items()))

    added = digests.select("k1", "k2").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema)
    sketch = np.zeros(SKETCH_ROWS * width, dtype=np.uint8)
    # bounded by the size of the sketch
    for number, cells in stored(added, "sketch").toLocalIterator():
        sketch[number * SLICE : number * SLICE + len(cells)] = np.frombuffer(cells, dtype=np.uint8)
    return sketch.reshape(SKETCH_ROWS, width)


def screened(rows: DataFrame) -> DataFrame:
    """`rows` of `prefixes` with `alone` and `parent_alone`: whether the sketch proves that one conversation only has the prefix."""
    spark, width = rows.sparkSession, LEAST_CELLS
    wanted = SKETCH_ROWS * rows.count()
    while width < min(wanted, MOST_CELLS):
        width *= 2
    sketch = spark.sparkContext.broadcast(count_min(rows, width))

    def alone(first: pa.Array, second: pa.Array) -> pa.Array:
        cells = _cells(first.to_numpy(), second.to_numpy(), width)
        return pa.array(np.minimum.reduce([row[c] for row, c in zip(sketch.value, cells)]) == 1)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [alone(batch.column(a), batch.column(b)) for a, b in (("k1", "k2"), ("p1", "p2"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "alone", "parent_alone"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return stored(rows.mapInArrow(screen, f"{fields}, alone boolean, parent_alone boolean"), "screened")


def ends_digest(ends: DataFrame) -> DataFrame:
    """`(k1, k2, ends_sha256)` of `ends (k1, k2, conv)`: the numbers of a node in ascending order, comma-joined.

    Sorted parts are joined to texts batch by batch; the texts of a node, few for any number of members, are hashed in order.
    """
    keys = [("k1", pa.int64()), ("k2", pa.int64())]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1).tolist(), batch.num_rows]
            convs = batch.column("conv").to_pylist()
            starts = cuts[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[starts]), pa.array(k2[starts]), pa.array([convs[i] for i in starts]),
                 pa.array([",".join(map(str, convs[i:j])) for i, j in zip(starts, cuts[1:])])],
                names=["k1", "k2", "first", "joined"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> pa.RecordBatch:
            row = {"k1": [now[0]], "k2": [now[1]], "ends_sha256": [state.hexdigest()]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([*keys, ("ends_sha256", pa.string())]))

        for batch in batches:
            for k1, k2, joined in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "joined"))):
                if (k1, k2) != now:
                    if now:
                        yield done()
                    now, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(joined.encode())
        if now:
            yield done()

    dealt = ends.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    parts = stored(dealt.mapInArrow(join, "k1 bigint, k2 bigint, first bigint, joined string"), "ends")
    together = parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return together.mapInArrow(digest, "k1 bigint, k2 bigint, ends_sha256 string")


def _subtree_sums(shared: DataFrame, owned: DataFrame) -> DataFrame:
    """`(k1, k2, saved, leaves)`: over the members of a node, what each owns at its depth and below.

    `shared (conv, depth, k1, k2)` are the prefixes that may be shared, `owned (conv, depth, w, leaf)` the values of nodes
    at their owners.
    """
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    rows = shared.select("conv", "depth", "k1", "k2", zero.alias("w"), zero.alias("leaf")).unionByName(
        owned.select("conv", "depth", none.alias("k1"), none.alias("k2"), "w", "leaf"))
    rows = stored(rows.withColumn("chunk", _chunk(F.col("depth"))), "owned")
    later = Window.partitionBy("conv").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "chunk").agg(F.sum("w").alias("w"), F.sum("leaf").alias("leaf"))
    below = sums.select("conv", "chunk", F.sum("w").over(later).alias("b_w"), F.sum("leaf").over(later).alias("b_leaf")).filter("b_w IS NOT NULL")
    # equal depths are peers: a prefix counts what is owned at its own depth
    within = Window.partitionBy("conv", "chunk").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select("*", F.sum("w").over(within).alias("s_w"), F.sum("leaf").over(within).alias("s_leaf")).filter("k1 IS NOT NULL")
    run = run.join(below, ["conv", "chunk"], "left")
    return run.groupBy("k1", "k2").agg(
        F.sum(F.col("s_w") + F.coalesce("b_w", F.lit(0))).alias("saved"), F.sum(F.col("s_leaf") + F.coalesce("b_leaf", F.lit(0))).alias("leaves"))


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of stored `rows` as `prefixes` gives them, one row each."""
    rows = screened(rows)
    single, shared = rows.filter("alone"), rows.filter("NOT alone")
    nodes = stored(
        shared.groupBy("k1", "k2").agg(
            F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"), F.max("chars").alias("chars"),
            F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("parent_alone").alias("parent_alone"),
        ), "nodes")
    child = F.expr("depth > 0 AND NOT parent_alone")
    children = nodes.filter(child).select("p1", "p2").unionByName(single.filter(child).select("p1", "p2"))
    children = children.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = stored(nodes, "nodes-children")

    owned = nodes.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("w"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    tails = single.filter("last").select("conv", "depth", F.lit(0).cast("bigint").alias("w"), F.lit(1).cast("bigint").alias("leaf"))
    sums = _subtree_sums(shared, owned.unionByName(tails))
    ends = ends_digest(shared.filter("last").select("k1", "k2", "conv"))
    own_end = F.when(F.col("last"), F.col("conv").cast("string")).otherwise("")
    columns = ["conv", "depth", "p1", "p2", "parent_alone", "n_convs", "n_children", "leaves", "saved", "ends_sha256"]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    many = nodes.join(sums, ["k1", "k2"]).join(ends, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).select(*columns)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    alone = single.select(
        "conv", "depth", "p1", "p2", "parent_alone", one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"),
        one.alias("leaves"), none.alias("saved"), F.sha2(own_end.cast("binary"), 256).alias("ends_sha256"),
    )
    both = many.unionByName(alone)
    # a parent that one conversation only has belongs to the same one; others are looked up
    known = both.filter("depth = 0 OR parent_alone").withColumn("parent", F.when(F.col("depth") > 0, F.col("conv")))
    key = F.struct("k1", "k2")
    lookup = nodes.select(key.alias("key"), F.col("conv").alias("parent"), F.col("n_children").alias("n_rows")).filter("n_rows > 0")
    sought = both.filter(child).withColumn("key", F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2")))
    found = spread_join(sought, lookup, "key").drop("key")
    return known.unionByName(found).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    steps, convs = with_borrowed_heads(ordered_turns(table))
    return trie(prefixes(steps, convs))


SQL_TEXT = """WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS step
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)),
lengths AS (SELECT v.c, v.base, v.h, least(v.h, count(b.pos)) AS used FROM convs v LEFT JOIN turns b ON b.c = v.base GROUP BY v.c, v.base, v.h),
steps AS (
  SELECT l.c, b.pos AS depth, b.step FROM lengths l JOIN turns b ON b.c = l.base AND b.pos <= l.h
  UNION ALL SELECT l.c, l.used + t.pos - l.h, t.step FROM lengths l JOIN turns t ON t.c = l.c AND t.pos > l.h),
rows_ AS (
  SELECT c, depth, length(step.text) AS chars, sha256(list(step) OVER (PARTITION BY c ORDER BY depth)::JSON::VARCHAR) AS key FROM steps
  UNION ALL SELECT c, 0, 0, '' FROM convs),
paths AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY c) AS last FROM rows_),
nodes AS (
  SELECT key, min(c) AS c, any_value(depth) AS depth, any_value(chars) AS chars, any_value(parent) AS parent, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM paths GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
family AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.key = n.key),
-- each node adds to all nodes on the path of one of its members
subtree AS (
  SELECT p.key, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM family n JOIN paths p ON p.c = n.c AND p.depth <= n.depth GROUP BY p.key)
SELECT n.c AS conv_id, n.depth::BIGINT AS depth, p.c AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM family n JOIN subtree s ON s.key = n.key LEFT JOIN nodes p ON p.key = n.parent"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
SQL = {"op13_prefix_trie": SQL_TEXT}
