import math

import pytest
from pyspark.sql import functions as F

from civiltext.operators import sampling


def rows(spark, n_safe, n_toxic, parts=3):
    n = n_safe + n_toxic
    return spark.range(n).select(
        F.col("id").alias("row_id"), (F.col("id") >= n_safe).cast("int").alias("y"), F.lit("t").alias("text")
    ).repartition(parts)


def ids(df):
    return sorted(r.row_id for r in df.select("row_id").collect())


@pytest.mark.parametrize("n_safe,n_toxic", [(7, 3), (50, 13), (4, 0), (40, 60)])
def test_split_sizes_and_stability(spark, n_safe, n_toxic):
    n = n_safe + n_toxic
    splits = sampling.make_splits(rows(spark, n_safe, n_toxic)).select("row_id", "split")
    got = {r["split"]: r["n"] for r in splits.groupBy("split").agg(F.count("*").alias("n")).collect()}
    n_test = math.ceil(0.2 * n)
    n_val = math.ceil(0.1 * (n - n_test))
    assert got == {k: v for k, v in {"test": n_test, "val": n_val, "train": n - n_test - n_val}.items() if v}
    again = sampling.make_splits(rows(spark, n_safe, n_toxic, parts=7)).select("row_id", "split")
    assert splits.exceptAll(again).isEmpty() and splits.count() == n


def test_published_split_sizes():
    """460,303 rows give 92,061 test, 36,825 val and 331,417 train rows."""
    n_test = math.ceil(0.2 * 460_303)
    n_val = math.ceil(0.1 * (460_303 - n_test))
    assert (n_test, n_val, 460_303 - n_test - n_val) == (92_061, 36_825, 331_417)


def test_allocation_by_largest_remainder():
    assert sampling.allocate({0: 7, 1: 3}, 2) == {0: 1, 1: 1}
    assert sampling.allocate({0: 5, 1: 5}, 3) == {0: 2, 1: 1}
    assert sum(sampling.allocate({0: 331_417, 1: 92_061}, 90_001).values()) == 90_001


def test_sample_is_exact_and_capped_at_the_population(spark):
    df = rows(spark, 30, 10)
    sample = ids(sampling.sample_n(df, 12))
    assert len(set(sample)) == 12 and sample == ids(sampling.sample_n(df.repartition(5), 12))
    assert sample != ids(sampling.sample_n(df, 12, seed=7))
    assert len(ids(sampling.sample_n(df, 500))) == 40
    assert ids(sampling.sample_n(df, 0)) == []


@pytest.mark.parametrize("n_safe,n_toxic", [(30, 9), (9, 30)])
def test_undersampling_cuts_every_class(spark, n_safe, n_toxic):
    counts = sampling.class_counts(sampling.undersample_equal(rows(spark, n_safe, n_toxic)))
    assert counts == {0: 9, 1: 9}


def test_train_only_balance_and_subset(spark):
    splits = sampling.make_splits(rows(spark, 80, 20))
    balanced = sampling.balance_train_only(splits)
    held_out = "split <> 'train'"
    assert ids(balanced.filter(held_out)) == ids(splits.filter(held_out))
    counts = sampling.class_counts(balanced.filter("split = 'train'"))
    assert counts[0] == counts[1]
    whole = sampling.stratified_split(rows(spark, 80, 20))
    assert sampling.train_subset(whole, 33).filter("split = 'train'").count() == 33
    assert sampling.train_subset(whole, 500).count() == 100


def test_same_size_sample_has_no_validation_rows(spark):
    splits = sampling.make_splits(rows(spark, 80, 40))
    pool, val = splits.filter("split <> 'test'"), splits.filter("split = 'val'")
    chosen = sampling.balanced_same_size(pool, val, 30)
    assert chosen.count() == 30
    assert chosen.join(val, "row_id").isEmpty()


def test_ready_splits_pass_through(spark):
    splits = sampling.make_splits(rows(spark, 10, 10))
    assert sampling.use_splits(splits) is splits
    with pytest.raises(ValueError):
        sampling.use_splits(splits, test=0.3)
    assert sampling.use_splits(rows(spark, 10, 10)).filter("split = 'test'").count() == 4


def test_shuffle_and_overfit_sample(spark):
    df = rows(spark, 30, 10)
    order = [r.row_id for r in sampling.shuffle(df).collect()]
    assert sorted(order) == list(range(40)) and order != list(range(40))
    assert sampling.class_counts(sampling.overfit_sample(df, 8)) == {0: 8, 1: 8}
