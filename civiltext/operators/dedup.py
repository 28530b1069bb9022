"""Near-duplicate removal: MinHash signatures, LSH bands, first-row-wins selection.

Two rows collide when any of their bands falls into the same bucket. Rows are walked in id
order; a kept row drops every later row it collides with, a dropped row drops nobody. Rows
that no chain of collisions connects do not matter to each other, so the walk is made part
by part, each in a task: a row is kept if none of its buckets is closed, and closes them. A
part too large for a task is walked in slices of its ids, and what a slice closes is
dropped from the rest before the next. Colliding rows are never paired up, so a bucket that
holds a third of the table costs as much as its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiltext.functions.hashing import NUM_PERM, PRIME, SEED, permutations, token_hashes
from civiltext.functions.text import token_set
from civiltext.operators import collisions
from civiltext.operators.collisions import Prefix, against_prefix, agreement, packed
from civiltext.operators.components import connected_parts
from civiltext.operators.joins import sifted, spread_join
from civiltext.operators.linear import slices
from civiltext.operators.sampling import sample_n
from civiltext.session import bound_batches, cut_lineage

THRESHOLD = 0.80
SWEEP = tuple(round(0.20 + 0.05 * i, 2) for i in range(16))
BLOCK_TOKENS = 32_768
PREFIX_ROWS = 1 << 14  # that the sweep walks first, at most
PREFIX_SHARE = 16  # or one of so many rows, if these are fewer
MET_AT_ONCE = 500_000  # memberships of rows after the prefix that one task compares
WALKED_AT_ONCE = 2_000_000  # memberships (row, bucket) of a part that one task walks
HALVINGS = 20  # of a larger part, for its first slice


@lru_cache(maxsize=None)
def band_plan(threshold: float, num_perm: int = NUM_PERM) -> tuple[int, int]:
    """Bands and rows per band that minimise the summed error areas on either side of the threshold.

    With b bands of r rows, similarity s collides with probability 1 - (1 - s^r)^b.
    """
    step = 0.001
    low = np.arange(0, round(threshold / step)) * step + step / 2
    high = threshold + np.arange(0, round((1 - threshold) / step)) * step + step / 2
    best = None
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            false_hits = (1 - (1 - low**rows) ** bands).sum() * step
            misses = ((1 - high**rows) ** bands).sum() * step
            error = (false_hits + misses) / 2
            if best is None or error < best[0]:
                best = (error, bands, rows)
    return best[1], best[2]


def _signature_udf(num_perm: int):
    pairs = permutations(num_perm)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def signature(tokens: pa.Array) -> pa.Array:
        values = np.concatenate([np.zeros(0, np.int64), *(minima(part) for part in slices(tokens))])
        pa.default_memory_pool().release_unused()
        return pa.ListArray.from_arrays(np.arange(len(tokens) + 1, dtype=np.int32) * num_perm, values)

    def minima(tokens: pa.ListArray) -> np.ndarray:
        flat, edges = token_hashes(tokens.flatten()), tokens.offsets.to_numpy()
        edges = edges - edges[0]
        out = np.full((len(tokens), num_perm), PRIME, dtype=np.int64)
        filled = np.flatnonzero(np.diff(edges))
        # blocks of rows whose tokens fit into the processor cache
        cuts = np.flatnonzero(np.diff(edges[filled] // BLOCK_TOKENS)) + 1
        for rows in np.split(filled, cuts):
            if not len(rows):
                continue
            start = edges[rows[0]]
            x, starts = flat[start:edges[rows[-1] + 1]], edges[rows] - start
            v, high = np.empty_like(x), np.empty_like(x)
            for s, (a, b) in enumerate(pairs):
                np.multiply(x, a, out=v)
                v += b
                for _ in range(2):  # modulo 2^31 - 1 by folding the high bits
                    np.right_shift(v, 31, out=high)
                    v &= PRIME
                    v += high
                v[v == PRIME] = 0
                out[rows, s] = np.minimum.reduceat(v, starts)
        return out.ravel()

    return signature


def minhash_signature(
    df: DataFrame, num_perm: int = NUM_PERM, id_col: str = "row_id", text_col: str = "text"
) -> DataFrame:
    """`(row_id, signature)`: per permutation the smallest value over the distinct tokens.

    Tokens are split by native expressions; Python hashes each different one of some rows once. A text
    without tokens gets the largest value everywhere, a missing text has no signature.
    """
    bound_batches(df.sparkSession)
    present = df.filter(F.col(text_col).isNotNull())
    return present.select(F.col(id_col).alias("row_id"), _signature_udf(num_perm)(token_set(F.col(text_col))).alias("signature"))


def band_keys(threshold: float, signature: str = "signature", num_perm: int = NUM_PERM) -> Column:
    """One digest per band; the band number is part of it, so equal digests mean a shared bucket."""
    bands, rows = band_plan(threshold, num_perm)
    values = F.col(signature).cast("array<string>")
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.md5(F.concat_ws(",", i.cast("string"), F.slice(values, i * rows + 1, F.lit(rows)))),
    )


def lsh_buckets(signatures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`(row_id, band, bucket)`."""
    return signatures.select("row_id", F.posexplode(band_keys(threshold)).alias("band", "bucket"))


def bucket_leaders(buckets: DataFrame) -> DataFrame:
    """Per bucket its smallest row and its size."""
    return buckets.groupBy("bucket").agg(F.min("row_id").alias("leader"), F.count("*").alias("n_rows"))


def collision_leaders(buckets: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """`(row_id, leader, n_buckets)`: each row with the smallest rows of its buckets.

    This stands for the list of colliding pairs: a bucket of m rows yields m - 1 pairs, not m^2.
    """
    leaders = bucket_leaders(buckets).filter("n_rows > 1")
    return (
        spread_join(buckets, leaders, "bucket", rows_per_task)
        .filter(F.col("leader") != F.col("row_id"))
        .groupBy("row_id", "leader").agg(F.count("*").alias("n_buckets"))
    )


def similarity(a: Column, b: Column, num_perm: int = NUM_PERM) -> Column:
    """Estimated Jaccard similarity: share of equal signature positions."""
    equal = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)
    return F.size(equal) / F.lit(num_perm)


def jaccard_estimate(
    pairs: DataFrame, signatures: DataFrame, num_perm: int = NUM_PERM, agree: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """Adds `sim` to pairs `(row_id, leader)`; a leader of very many rows does not end up in one task.

    `agree` takes the place of `similarity` for signatures that are not arrays.
    """
    own = pairs.join(signatures.select("row_id", F.col("signature").alias("own")), "row_id")
    load = pairs.groupBy("leader").agg(F.count("*").alias("n_rows"))
    other = load.join(
        signatures.select(F.col("row_id").alias("leader"), F.col("signature").alias("other")), "leader"
    )
    both = spread_join(cut_lineage(own), other, "leader")
    sim = agree(F.col("own"), F.col("other")) if agree else similarity(F.col("own"), F.col("other"), num_perm)
    return both.withColumn("sim", sim).drop("own", "other")


def collapse_copies(signatures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`(row_id, keys)` with one row, the first, per set of equal band keys.

    Rows with equal keys collide with the same rows, and the first one always goes before
    the others: either it is kept and drops them, or what dropped it drops them too.
    """
    keyed = signatures.select("row_id", F.transform(band_keys(threshold), F.unhex).alias("keys"))
    return keyed.groupBy("keys").agg(F.min("row_id").alias("row_id"))


def contested_rows(rows: DataFrame) -> DataFrame:
    """`(row_id, keys)` of the rows that share a bucket, with only the shared buckets."""
    members = rows.select("row_id", F.explode("keys").alias("bucket"))
    shared = bucket_leaders(members).filter("n_rows > 1").select("bucket", "n_rows")
    return (
        spread_join(members, shared, "bucket")
        .groupBy("row_id").agg(F.collect_list("bucket").alias("keys"))
    )


def walked(rows: DataFrame) -> DataFrame:
    """`(row_id)` that the walk keeps of `rows (part, row_id, keys)`; a task holds the closed buckets of one part at a time."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, closed = None, set()
        for batch in batches:
            kept = []
            for part, row_id, keys in zip(*(batch.column(c).to_pylist() for c in ("part", "row_id", "keys"))):
                if part != now:
                    now, closed = part, set()
                if closed.isdisjoint(keys):
                    closed.update(keys)
                    kept.append(row_id)
            yield pa.RecordBatch.from_pydict({"row_id": pa.array(kept, pa.int64())})

    ordered = rows.select("part", "row_id", "keys").repartition("part").sortWithinPartitions("part", "row_id")
    return ordered.mapInArrow(walk, "row_id bigint")


def collision_parts(contested: DataFrame) -> DataFrame:
    """Adds `part`, the smallest row that collisions connect a row with."""
    members = contested.select("row_id", F.explode("keys").alias("bucket"))
    edges = spread_join(members, bucket_leaders(members), "bucket").select(F.col("row_id").alias("a"), F.col("leader").alias("b"))
    parts, _ = connected_parts(edges)
    joined = contested.join(parts.withColumnRenamed("node", "row_id"), "row_id", "left")
    return joined.withColumn("part", F.coalesce("part", "row_id"))  # a row without collisions is a part


def first_slices(rows: DataFrame, most: int) -> DataFrame:
    """`(part, last)`: up to which id the slice of each part goes; a slice has about `most` memberships, or half as many."""
    halves = [0.5**k for k in range(1, HALVINGS + 1)]
    load = rows.groupBy("part").agg(
        F.sum(F.size("keys")).alias("load"), F.max("row_id").alias("largest"), F.percentile_approx("row_id", halves, 1 << HALVINGS).alias("cuts"))
    halvings = F.ceil(F.log2(F.col("load") / F.lit(float(most)))).cast("int")
    cut = F.get("cuts", F.least(halvings, F.lit(HALVINGS)) - 1)
    return load.select("part", "load", F.when(F.col("load") <= most, F.col("largest")).otherwise(cut).alias("last"))


def without_closed(rest: DataFrame, slice_rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `rest` that share no bucket with those of `slice_rows` that are kept."""
    closed = slice_rows.join(kept, "row_id", "left_semi").select(F.explode("keys").alias("bucket")).distinct()
    members = rest.select("row_id", F.explode("keys").alias("bucket"))
    loads = bucket_leaders(members).join(closed, "bucket", "left_semi").select("bucket", "n_rows")
    return rest.join(spread_join(members, loads, "bucket").select("row_id").distinct(), "row_id", "left_anti")


def greedy_kept(contested: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """Ids of the contested rows that the walk keeps, and the number of slices of the largest part.

    All rows together are one part if they fit in a task. Otherwise parts up to `most` memberships are walked at once, all
    in one pass; larger ones slice by slice, so they take about twice their memberships by `most` rounds, however long
    the chains in them.
    """
    most = most or WALKED_AT_ONCE
    if (contested.agg(F.sum(F.size("keys"))).first()[0] or 0) <= most:
        return walked(contested.withColumn("part", F.lit(0).cast("bigint"))), 1
    rows, kept, rounds = cut_lineage(collision_parts(contested)), [], 0
    while not rows.isEmpty():
        rounds += 1
        now = rows.join(first_slices(rows, most), "part")
        now = cut_lineage(now.withColumn("in_slice", F.col("row_id") <= F.col("last")))
        slice_rows = now.filter("in_slice")
        kept.append(cut_lineage(walked(slice_rows)))
        rest = now.filter("NOT in_slice").select("part", "row_id", "keys")
        rows = cut_lineage(without_closed(rest, slice_rows.filter(F.col("load") > most), kept[-1]))
    return reduce(lambda a, b: a.unionByName(b), kept), rounds


def kept_ids(signatures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Ids of all rows that survive, including those without any collision."""
    return surviving(cut_lineage(collapse_copies(signatures, threshold)))


def surviving(rows: DataFrame) -> DataFrame:
    """Ids the walk keeps among `(row_id, keys)`; `rows` is read twice, so store it first."""
    contested = cut_lineage(contested_rows(rows))
    free = rows.select("row_id").join(contested, "row_id", "left_anti")
    return free.unionByName(greedy_kept(contested)[0])


def dropped_ids(ids: DataFrame, kept: DataFrame) -> DataFrame:
    return ids.select("row_id").join(kept, "row_id", "left_anti")


def apply_keep_mask(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows that were not dropped. Dropped rows are the few, so theirs is the list to join."""
    return df.join(dropped.select("row_id"), "row_id", "left_anti")


def deduplicate(df: DataFrame, threshold: float = THRESHOLD, num_perm: int = NUM_PERM) -> DataFrame:
    """The corpus without near duplicates of earlier rows."""
    kept = kept_ids(minhash_signature(df, num_perm), threshold)
    return apply_keep_mask(df, dropped_ids(df.filter(F.col("text").isNotNull()), kept))


def sample_signatures(df: DataFrame, n: int = 50_000, num_perm: int = NUM_PERM, seed: int = SEED) -> DataFrame:
    """Signatures of a random sample, for calibration; of all rows when there are fewer than n."""
    return minhash_signature(sample_n(df, n, seed, salt="signatures"), num_perm)


def keepers(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """`(row_id, leader)`: each dropped row with the smallest kept row it collides with."""
    members = rows.select("row_id", F.explode("keys").alias("bucket"))
    owners = members.join(kept, "row_id", "left_semi").select("bucket", F.col("row_id").alias("leader"))
    loads = bucket_leaders(members).filter("n_rows > 1").select("bucket", "n_rows")
    return (
        spread_join(members, owners.join(loads, "bucket"), "bucket")
        .groupBy("row_id").agg(F.min("leader").alias("leader"))
        .filter(F.col("leader") != F.col("row_id"))
    )


def distinct_signatures(signatures: DataFrame) -> DataFrame:
    """`(row_id, signature, copy)` of packed signatures: the first row per signature and, if any, its next copy."""
    keyed = signatures.filter("row_id IS NOT NULL").withColumn("key", F.unhex(F.md5("signature")))
    first = keyed.groupBy("key").agg(F.min("row_id").alias("first"), F.count("*").alias("n_rows"))
    copies = spread_join(keyed.select("row_id", "key"), first.filter("n_rows > 1"), "key")
    second = copies.filter("row_id > first").groupBy("key").agg(F.min("row_id").alias("copy"))
    lookup = first.join(second, "key", "left").select("key", F.col("first").alias("row_id"), "copy")
    return keyed.join(lookup, ["row_id", "key"]).dropDuplicates(["row_id", "key"]).select("row_id", "signature", "copy")


def first_rows(distinct: DataFrame, n: int, plans: list[tuple[int, int]]) -> tuple[Prefix, int]:
    """About `n` rows of the smallest ids, as arrays, and the last of these ids."""
    total = distinct.count()
    cut = F.max("row_id") if total <= n else F.percentile_approx("row_id", n / total, 1 << HALVINGS)
    last = distinct.agg(cut).first()[0]
    rows = distinct.filter(F.col("row_id") <= F.lit(last)).select("row_id", "signature", "copy").toArrow().combine_chunks()
    if not rows.num_rows:
        width = max(bands * size for bands, size in plans)
        return Prefix(np.zeros(0, np.int64), np.zeros((0, width), np.int32), np.zeros(0, np.int64), plans), 0
    row_ids, copies = rows["row_id"].to_numpy(), rows["copy"].fill_null(collisions.NO_ROW).to_numpy()
    values = collisions.equally_long(rows["signature"].combine_chunks(), "<i4")
    order = np.lexsort((values[:, 0], row_ids))
    return Prefix(row_ids[order], values[order], copies[order], plans), last


def met_after(distinct: DataFrame, prefix: Prefix, last: int, thresholds: list[tuple[int, float]], parts: int) -> DataFrame:
    """Stored rows of `collisions.MET` for the rows after the prefix."""
    bound_batches(distinct.sparkSession)
    shared = distinct.sparkSession.sparkContext.broadcast(prefix)
    rest = distinct.filter(F.col("row_id") > F.lit(last)).select("row_id", "signature", "copy")
    meeting = rest.mapInArrow(lambda batches: against_prefix(batches, shared.value, thresholds, parts), collisions.MEETING)
    stored = cut_lineage(meeting.repartition(parts, "part").mapInArrow(collisions.met, collisions.MET))
    shared.unpersist()
    return stored


def rest_pairs(members: DataFrame, most: int) -> DataFrame:
    """`(plan, row_id, leader)` with each row that the walk of its plan drops, for the members `(plan, row_id, key)` of shared bands.

    The plans of up to `most` memberships are walked in a task each, larger ones in parts.
    """
    loads = members.groupBy("plan").count().collect()
    large = sorted(r["plan"] for r in loads if r["count"] > most)
    small = members.filter(~F.col("plan").isin(large)) if large else members
    ordered = small.select("plan", "row_id", "key").repartition("plan").sortWithinPartitions("plan", "row_id")
    pairs = ordered.mapInArrow(collisions.walked_plans, collisions.PAIRS)
    for plan in large:
        own = members.filter(F.col("plan") == plan).groupBy("row_id").agg(F.collect_set("key").alias("keys"))
        contested = cut_lineage(own)
        kept = cut_lineage(greedy_kept(contested, most)[0])
        pairs = pairs.unionByName(keepers(contested, kept).select(F.lit(plan).alias("plan"), "row_id", "leader"))
    return cut_lineage(pairs)


def nearest_pairs(pairs: DataFrame, distinct: DataFrame, thresholds: list[tuple[int, float]], num_perm: int) -> dict[int, tuple]:
    """Per threshold, by its number, `(gap, leader, row_id, sim)` of the nearest among its plan's `pairs (plan, row_id, leader)`."""
    once = cut_lineage(pairs.groupBy("row_id", "leader").agg(F.collect_set("plan").alias("plans")))
    ids = once.select(F.explode(F.array("row_id", "leader")).alias("row_id"))
    sims = jaccard_estimate(once, sifted(distinct.select("row_id", "signature"), ids, "row_id"), num_perm, agreement)
    cases = [F.struct(F.lit(t).alias("t"), F.lit(plan).alias("plan"), F.lit(threshold).alias("threshold")) for t, (plan, threshold) in enumerate(thresholds)]
    own = F.filter(F.array(*cases), lambda case: F.array_contains("plans", case["plan"]))
    each = sims.select("leader", "row_id", "sim", F.explode(own).alias("case"))
    gap = F.abs(F.col("sim") - F.col("case.threshold")).alias("gap")
    found = each.groupBy("case.t").agg(F.min(F.struct(gap, "leader", "row_id", "sim")).alias("ex")).collect()
    return {r["t"]: tuple(r["ex"]) for r in found}


def dedup_sweep(df: DataFrame, thresholds: tuple[float, ...] = SWEEP, num_perm: int = NUM_PERM) -> DataFrame:
    """Per threshold: rows dropped and left, and the dropped pair whose similarity is nearest to it.

    Signatures are computed once and reduced to one row per distinct signature. The walks of all plans go side by side:
    over the first rows, which settle most of the others in one pass, and over those of the others that share a band.
    Thresholds with the same bands share their dropped set.
    """
    signed = minhash_signature(df, num_perm).select("row_id", packed("signature").alias("signature"))
    signatures = cut_lineage(signed)
    distinct = cut_lineage(distinct_signatures(signatures))
    total, n_signed, n_distinct = df.count(), signatures.count(), distinct.count()
    plans = list(dict.fromkeys(band_plan(t, num_perm) for t in thresholds))
    cases = [(plans.index(band_plan(t, num_perm)), float(t)) for t in thresholds]
    prefix, last = first_rows(distinct, min(PREFIX_ROWS, max(1, n_distinct // PREFIX_SHARE)), plans)
    dropped = [int((leaders >= 0).sum()) for leaders in prefix.leaders]
    found = [[prefix.nearest(plan, t)] for plan, t in cases]
    copies = list(prefix.first_copies)
    if len(prefix.row_ids) < n_distinct:
        memberships = (n_distinct - len(prefix.row_ids)) * sum(bands for bands, _ in plans)
        rest = met_after(distinct, prefix, last, cases, memberships // MET_AT_ONCE + 1)
        pairs = rest_pairs(rest.filter(F.col("kind") == collisions.KNOWN), WALKED_AT_ONCE)
        for n in (rest.filter(F.col("kind") == collisions.DROPPED).groupBy("plan").agg(F.sum("n").alias("n")), pairs.groupBy("plan").agg(F.count("*").alias("n"))):
            for r in n.collect():
                dropped[r["plan"]] += r["n"]
        gap = F.abs(F.col("sim") - F.element_at(F.array(*[F.lit(t) for _, t in cases]), (F.col("n") + 1).cast("int"))).alias("gap")
        settled = rest.filter(F.col("kind") == collisions.EXAMPLE).groupBy("n").agg(F.min(F.struct(gap, "leader", "row_id", "sim")).alias("ex"))
        for r in settled.collect():
            found[r["n"]].append(tuple(r["ex"]))
        for t, example in nearest_pairs(pairs, distinct, cases, num_perm).items():
            found[t].append(example)
        if None in copies:
            copied = rest.filter(F.col("kind") == collisions.COPY).select("plan", "leader", F.col("row_id").alias("copy"))
            gone = pairs.select("plan", F.col("row_id").alias("leader"))
            kept = copied.join(gone, ["plan", "leader"], "left_anti")
            for r in kept.groupBy("plan").agg(F.min(F.struct("leader", "copy")).alias("ex")).collect():
                copies[r["plan"]] = tuple(r["ex"])
    lines = []
    for (plan, threshold), examples in zip(cases, found):
        if copies[plan]:
            examples.append((abs(1.0 - threshold), *copies[plan], 1.0))
        gap, keeper, dropped_row, sim = min((e for e in examples if e), default=(None,) * 4)
        n = n_signed - n_distinct + dropped[plan]
        lines.append((threshold, n, total - n, gap, sim, keeper, dropped_row))
    return df.sparkSession.createDataFrame(
        lines, "threshold double, dropped bigint, remaining bigint, gap double, sim double, keeper bigint, dropped_row bigint")


def with_example_texts(sweep: DataFrame, df: DataFrame) -> DataFrame:
    """Adds the whole texts of each threshold's example as `keeper_text` and `dropped_text`; the rows of `sweep` are few."""
    sweep = cut_lineage(sweep)
    wanted = sweep.select(F.explode(F.array("keeper", "dropped_row")).alias("row_id")).filter("row_id IS NOT NULL").distinct()
    texts = cut_lineage(df.join(F.broadcast(wanted), "row_id").select("row_id", "text"))  # two rows per threshold at most
    for name in ("keeper", "dropped"):
        own = texts.select(F.col("row_id").alias("of"), F.col("text").alias(f"{name}_text"))
        sweep = sweep.join(F.broadcast(own), F.col("keeper" if name == "keeper" else "dropped_row") == F.col("of"), "left").drop("of")
    return sweep
