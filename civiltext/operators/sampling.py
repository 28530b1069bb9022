"""Exact samples, stratified splits and balanced sets, independent of partitioning.

Rows are ordered by a hash of their id. "The first n of a class" is then described by one
cut point per class, found from a histogram of hash prefixes plus a ranking inside the one
prefix the cut falls into. Choosing rows is afterwards a comparison per row: the texts are
never sorted or shuffled, and no task ranks a whole class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civiltext.functions.hashing import SEED, order_key

PREFIX_DIGITS = 4  # 65,536 prefixes per class: the histogram is small, a prefix is 1/65,536 of a class
CLASSES = (0, 1)


@dataclass(frozen=True)
class HashCut:
    """Per class the order key and id of its last chosen row."""

    salt: str
    seed: int
    points: dict[int | None, tuple[str, int]]
    class_col: str | None = "y"
    id_col: str = "row_id"

    def chosen(self) -> Column:
        key, row_id = order_key(self.id_col, self.salt, self.seed), F.col(self.id_col).cast("bigint")
        tests = []
        for value, (cut_key, cut_id) in self.points.items():
            inside = F.struct(key, row_id) <= F.struct(F.lit(cut_key), F.lit(cut_id).cast("bigint"))
            tests.append(inside if self.class_col is None else (F.col(self.class_col) == value) & inside)
        return reduce(lambda a, b: a | b, tests, F.lit(False))


def class_counts(df: DataFrame, class_col: str = "y") -> dict[int, int]:
    """Rows per class. A value that is no class is an error, and so is a missing one."""
    other = F.when(F.col(class_col).isin(*CLASSES), F.col(class_col))
    rows = {row[0]: row[1] for row in df.groupBy(other).count().collect()}  # one row per class, one for all others
    if None in rows:
        raise ValueError(f"{rows[None]} rows whose {class_col} is none of {', '.join(map(str, CLASSES))}")
    return dict(sorted(rows.items()))


def allocate(counts: dict[int, int], size: int) -> dict[int, int]:
    """`size` draws in proportion to the class counts: largest remainder, ties to the smaller class value."""
    total = sum(counts.values())
    exact = {c: n / total * size for c, n in counts.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(exact, key=lambda c: (quota[c] - exact[c], c))
    for c in by_remainder[: size - sum(quota.values())]:
        quota[c] += 1
    return quota


def fit_cut(
    df: DataFrame, quotas: dict[int | None, int], salt: str, seed: int = SEED,
    class_col: str | None = "y", id_col: str = "row_id",
) -> HashCut:
    """Cut points so that exactly `quotas[c]` rows of class c are chosen (all, when it has fewer)."""
    group = F.lit(0) if class_col is None else F.col(class_col)
    wanted = {0 if c is None else c: n for c, n in quotas.items() if n > 0}
    if not wanted:
        return HashCut(salt, seed, {}, class_col, id_col)
    keyed = df.select(
        group.alias("g"), F.col(id_col).alias("id"), order_key(id_col, salt, seed).alias("key")
    ).withColumn("prefix", F.substring("key", 1, PREFIX_DIGITS))
    quota = reduce(lambda e, c: e.when(F.col("g") == c, F.lit(wanted[c])), wanted, F.when(F.lit(False), F.lit(0)))
    upto = W.partitionBy("g").orderBy("prefix")
    last = (
        keyed.filter(F.col("g").isin(*wanted)).groupBy("g", "prefix").count()
        .withColumn("through", F.sum("count").over(upto))
        .withColumn("total", F.sum("count").over(W.partitionBy("g")))
        .withColumn("quota", F.least(quota, F.col("total")))
        .filter((F.col("through") >= F.col("quota")) & (F.col("through") - F.col("count") < F.col("quota")))
        .select("g", "prefix", (F.col("quota") - F.col("through") + F.col("count")).alias("rank"))
        .collect()
    )
    if not last:
        return HashCut(salt, seed, {}, class_col, id_col)
    at = reduce(
        lambda a, b: a | b,
        [(F.col("g") == r["g"]) & (F.col("prefix") == r["prefix"]) for r in last],
    )
    rank = reduce(lambda e, r: e.when(F.col("g") == r["g"], F.lit(r["rank"])), last, F.when(F.lit(False), F.lit(0)))
    points = (
        keyed.filter(at)
        .withColumn("n", F.row_number().over(W.partitionBy("g", "prefix").orderBy("key", "id")))
        .filter(F.col("n") == rank).select("g", "key", "id").collect()
    )
    return HashCut(
        salt, seed, {(None if class_col is None else r["g"]): (r["key"], r["id"]) for r in points}, class_col, id_col
    )


def sample_n(df: DataFrame, n: int, seed: int = SEED, salt: str = "sample") -> DataFrame:
    """n rows without replacement; the whole table when it has fewer."""
    return df.filter(fit_cut(df, {None: n}, salt, seed, class_col=None).chosen())


def shuffle(df: DataFrame, seed: int = SEED, salt: str = "shuffle") -> DataFrame:
    """Full reorder, a range-partitioned sort by hash."""
    return df.orderBy(order_key("row_id", salt, seed), "row_id")


def undersample_equal(df: DataFrame, seed: int = SEED, salt: str = "balance") -> DataFrame:
    """Every class cut to the size of the smallest one, whichever that is."""
    counts = class_counts(df)
    smallest = min(counts.values(), default=0)
    return df.filter(fit_cut(df, {c: smallest for c in counts}, salt, seed).chosen())


def overfit_sample(df: DataFrame, per_class: int = 250, seed: int = SEED) -> DataFrame:
    """A small balanced set for checking that a model can fit it."""
    return df.filter(fit_cut(df, {c: per_class for c in CLASSES}, "overfit", seed).chosen())


def stratified_cut(df: DataFrame, size: int | float, salt: str, seed: int = SEED) -> HashCut:
    """Cut for `size` rows, or for that fraction rounded up, in proportion to the classes."""
    counts = class_counts(df)
    n = math.ceil(size * sum(counts.values())) if isinstance(size, float) else size
    return fit_cut(df, allocate(counts, n), salt, seed)


def stratified_split(df: DataFrame, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds `split`: ceil(test * n) rows are `test`, the others `train`."""
    cut = stratified_cut(df, test, "test", seed)
    return df.withColumn("split", F.when(cut.chosen(), "test").otherwise("train"))


def train_subset(splits: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Exactly n stratified rows of the train part, when it has more; other splits stay."""
    train = splits.filter("split = 'train'")
    counts = class_counts(train)
    if n >= sum(counts.values()):
        return splits
    cut = fit_cut(train, allocate(counts, n), "subset", seed)
    return splits.filter((F.col("split") != "train") | cut.chosen())


def val_split(splits: DataFrame, val: float = 0.1, seed: int = SEED) -> DataFrame:
    """Moves a stratified ceil(val * n) of the train part to `val`."""
    cut = stratified_cut(splits.filter("split = 'train'"), val, "val", seed)
    return splits.withColumn(
        "split", F.when((F.col("split") == "train") & cut.chosen(), "val").otherwise(F.col("split"))
    )


def make_splits(
    df: DataFrame, test: float = 0.2, val: float = 0.1, subset: int | None = None, seed: int = SEED
) -> DataFrame:
    """Test, validation and train parts.

    Ids and labels are scanned a few times to find the cut points, so hand over a stored
    table, not the unfinished result of an expensive query.
    """
    splits = stratified_split(df, test, seed)
    if subset:
        splits = train_subset(splits, subset, seed)
    return val_split(splits, val, seed)


def use_splits(df: DataFrame, **options) -> DataFrame:
    """A table that already has `split` is taken as it is, any other is split."""
    if "split" in df.columns:
        if options:
            raise ValueError("the table is already split; split options do not apply")
        return df
    return make_splits(df, **options)


def split_summary(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count("*").alias("n"), F.avg("y").alias("toxic_rate"))


def balance_train_only(splits: DataFrame, seed: int = SEED) -> DataFrame:
    """Undersample the train part; validation and test stay untouched."""
    train = splits.filter("split = 'train'")
    counts = class_counts(train)
    smallest = min(counts.values(), default=0)
    cut = fit_cut(train, {c: smallest for c in counts}, "balance", seed)
    return splits.filter((F.col("split") != "train") | cut.chosen())


def balance_check(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.sum("y").alias("n_toxic"), F.avg("y").alias("toxic_share"))


def balanced_same_size(pool: DataFrame, val: DataFrame, n: int = 90_000, seed: int = SEED) -> DataFrame:
    """n rows of the balanced pool. Validation rows leave the pool first.

    The studied experiment drew from a pool that still held the validation rows; that
    overlap is not repeated here.
    """
    free = pool.join(val.select("row_id"), "row_id", "left_anti")
    return sample_n(undersample_equal(free, seed), n, seed, salt="same-size")
