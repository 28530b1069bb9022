"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to give `target` of its `size` words takes each of its documents
target/size times on average: a whole part, and a fraction that must become 0 or 1. Two
documents with fractions pass mass to each other, at random but fair, until one fraction is
whole; in words, nothing is lost. So a source meets its target up to the last fraction.

The documents of a source are dealt by hash into small groups, each is reduced to at most
one document with a fraction, and those residuals are dealt into groups again, level by
level, up to one per source. A group holds few documents however large its source is, and
the number of levels is the logarithm of the largest source. Native expressions only.

Sizes are words; a null or empty text has size 0, takes part in no pairing and takes no
words. A null source is a source of its own, after all others. Rows equal in id, source and
size are numbered among themselves, where they lie, and are decided one by one. An empty
table gives no rows. Draws are hashes of ids, numbers and the seed, so a rerun agrees,
however the rows are dealt.

Sources are ranked and their targets found by running sums over ranges of them, so their
number may grow with the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiltext.llm.common import WORD, documents, stored, text_or_empty, uniform

CYCLE = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
GROUP = 256
SEED = 17


def words_in(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text_or_empty(text), F.lit(WORD), F.lit(0))).cast("bigint")


def running_sums(rows: DataFrame, order: list[Column], names: list[str]) -> DataFrame:
    """`rows` with `before_<name>` for each of `names`: the sum over all rows earlier in `order`.

    Rows are dealt by range; a window runs within each part, and one over the sums of the parts.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    offsets = F.broadcast(parts.select("part", *[F.sum(n).over(earlier).alias(f"of_{n}") for n in names]))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *[F.sum(n).over(within).alias(f"in_{n}") for n in names]).join(offsets, "part")
    zero = F.lit(0)
    return summed.select(
        *[c for c in dealt.columns if c != "part"],
        *[(F.coalesce(f"in_{n}", zero) + F.coalesce(f"of_{n}", zero)).alias(f"before_{n}") for n in names],
    )


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """`(source, source_size, source_docs, target)` from `sizes (source, size)`; one row per source.

    Sources in order of their names weigh by `cycle`. A target stops at `most` times its source's size; the rest is
    shared anew by weight. That ends where all sources below their limit have the same target per weight, and
    since a source reaches its limit the earlier the lower limit/weight is, running sums in that order find it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    by_name = F.col("source").asc_nulls_last()
    ranked = running_sums(totals.withColumn("one", F.lit(1).cast("bigint")), [by_name], ["one"])
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    limit = F.col("source_size") * F.lit(most)
    ranked = ranked.select(
        "source", "source_size", "source_docs", F.get(weights, (F.col("before_one") % len(cycle)).cast("int")).alias("weight"), limit.alias("limit"))
    ratio = F.col("limit") / F.col("weight")
    ordered = stored(running_sums(ranked, [ratio.asc(), by_name], ["limit", "weight"]), "limits")
    size, weight = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    left = F.lit(float(size or 0) * share) - F.col("before_limit")
    level = left / (F.lit(float(weight or 1)) - F.col("before_weight"))
    # the first source that its share does not fill sets the level of all further ones
    first = ordered.select(ratio.alias("ratio"), "source", level.alias("level"), "weight", "limit").filter(F.col("level") * F.col("weight") < F.col("limit"))
    unfilled = first.orderBy("ratio", by_name).select("level").first()
    common = F.col("limit") if unfilled is None else F.lit(unfilled[0]) * F.col("weight")
    return ordered.select("source", "source_size", "source_docs", F.least(F.col("limit"), common).alias("target"))


def numbered_copies(sizes: DataFrame) -> DataFrame:
    """Stored `sizes (row, id, source, size)` with `nth`, from 1 among rows equal in id, source and size.

    `row` comes from `monotonically_increasing_id`, whose high bits are the partition: equal rows are numbered within
    each partition and moved up by those in earlier ones, so they never meet in a task, however many they are.
    """
    key = ["id", "source", "size"]
    parted = sizes.withColumn("part", F.shiftright("row", 33))
    counts = parted.groupBy(*key, "part").count()
    before = F.sum("count").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    behind = counts.select(*[F.col(c).alias(f"b_{c}") for c in (*key, "part")], before.alias("before")).filter("before IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(*key, "part").orderBy("row"))
    same = F.lit(True)
    for c in (*key, "part"):
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    placed = parted.withColumn("place", place.cast("bigint")).join(behind, same, "left")
    return placed.select("row", *key, (F.col("place") + F.coalesce("before", F.lit(0))).alias("nth"))


def _reduce_group(items: Column, seed: int, id_type: str) -> Column:
    """From items `(size, id, nth, row, share)` of falling size: those whose share became whole, and the one left over, if any."""
    nobody = F.expr(f"CAST(NULL AS struct<size: bigint, id: {id_type}, nth: bigint, row: bigint, share: double>)")
    none_done = F.expr(f"CAST(array() AS array<struct<size: bigint, id: {id_type}, nth: bigint, row: bigint, extra: int>>)")

    def same(item: Column) -> list[Column]:
        return [item[name].alias(name) for name in ("size", "id", "nth", "row")]

    def done(item: Column, extra: Column) -> Column:
        return F.struct(*same(item), extra.cast("int").alias("extra"))

    def step(state: Column, new: Column) -> Column:
        old = state["left"]
        mass_old, mass_new = old["share"] * old["size"], new["share"] * new["size"]
        room_old, room_new = old["size"] - mass_old, new["size"] - mass_new
        up, down = F.least(room_old, mass_new), F.least(mass_old, room_new)  # what `old` can gain, or lose
        gains = uniform(old["id"], old["size"], old["nth"], new["id"], new["size"], new["nth"], F.lit(seed)) * (up + down) < down
        # the document with the smaller side becomes whole; the other keeps a fraction
        old_whole = F.when(gains, room_old <= mass_new).otherwise(mass_old <= room_new)
        extra = F.when(old_whole, gains.cast("int")).otherwise((~gains).cast("int"))
        moved = F.when(gains, up).otherwise(-down)
        rest = F.when(
            old_whole, F.struct(*same(new), ((mass_new - moved) / new["size"]).alias("share"))
        ).otherwise(F.struct(*same(old), ((mass_old + moved) / old["size"]).alias("share")))
        paired = F.struct(
            rest.alias("left"),
            F.concat(state["done"], F.array(F.when(old_whole, done(old, extra)).otherwise(done(new, extra)))).alias("done"),
        )
        return F.when(old.isNull(), F.struct(new.alias("left"), state["done"].alias("done"))).otherwise(paired)

    return F.aggregate(items, F.struct(nobody.alias("left"), none_done.alias("done")), step)


def pivotal_rounding(items: DataFrame, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """`(row, size, extra)` for `items (row, source, id, size, nth, share, source_docs)` with shares in (0, 1): extra is 0 or 1.

    `source_docs` bounds the number of items of the source. The last share of a source goes to the nearer whole
    number.
    """
    most = items.agg(F.max("source_docs")).first()[0] or 1
    levels = max(1, math.ceil(math.log(most, group))) + 1
    id_type = items.schema["id"].dataType.simpleString()
    current = items.select("source", "source_docs", F.struct("size", "id", "nth", "row", "share").alias("item"))
    finished = []
    for level in range(1, levels + 1):
        groups = F.ceil(F.col("source_docs") / F.lit(float(group) ** level))
        slot = F.when(groups <= 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("item.id", "item.size", "item.nth", F.lit(seed + level)), groups))
        # largest first: a large document that is left over by the end could not be balanced any more
        reduced = current.groupBy("source", "source_docs", slot.alias("slot")).agg(
            F.sort_array(F.collect_list("item"), asc=False).alias("items")
        )
        reduced = reduced.select("source", "source_docs", _reduce_group(F.col("items"), seed + level, id_type).alias("state"))
        reduced = stored(reduced, f"mix-{level}")
        finished.append(reduced.select(F.explode("state.done").alias("d")).select("d.row", "d.size", "d.extra"))
        current = reduced.filter("state.left IS NOT NULL").select("source", "source_docs", F.col("state.left").alias("item"))
    last = F.round("item.share").cast("int").alias("extra")
    finished.append(current.select("item.row", "item.size", last))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def mix(sizes: DataFrame, share: float = SHARE, most: float = MOST, cycle: tuple[int, ...] = CYCLE, seed: int = SEED) -> DataFrame:
    """`(row, id, source, size, source_size, target, copies)` for stored rows `sizes (row, id, source, size)`.

    `row` is unique, from `monotonically_increasing_id`, and only tells rows apart; `copies` is a whole number.
    """
    targets = stored(source_targets(sizes, share, most, cycle), "targets")
    per_doc = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = targets.select(F.col("source").alias("of_source"), "source_size", "source_docs", "target")
    whole = F.floor(per_doc + F.lit(1e-12))
    planned = numbered_copies(sizes).join(sources, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    planned = stored(planned.withColumn("whole", whole).withColumn("share", per_doc - F.col("whole")), "planned")
    open_items = planned.filter((F.col("share") > 1e-9) & (F.col("size") > 0))
    rounded = pivotal_rounding(open_items, seed).select("row", "extra")
    return planned.join(rounded, "row", "left").select(
        "row", "id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies")
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.monotonically_increasing_id().alias("row")
    sizes = documents(spark, sf_dir).select(row, F.col("doc_id").alias("id"), "source", words_in(F.col("text")).alias("size"))
    mixed = mix(stored(sizes, "sizes"))
    return mixed.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


QUERIES = {"op2_mix_sources": op2_mix_sources}
SQL: dict[str, str] = {}
