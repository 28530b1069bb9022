"""Samples, splits and balanced sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from civiltext.operators import sampling
from civiltext.operators.dedup import apply_keep_mask
from civiltext.plans import inputs
from civiltext.plans.inputs import with_ctes

SAMPLE, SUBSET, SAME_SIZE, PER_CLASS = 100, 150, 60, 25


def sample_rows(spark, sf_dir):
    return sampling.sample_n(inputs.documents(spark, sf_dir), SAMPLE).select("row_id")


def undersampled(spark, sf_dir):
    return sampling.undersample_equal(inputs.corpus(spark, sf_dir)).select("row_id", "y")


def shuffled_order(spark, sf_dir):
    """Place of each row after the reorder among those whose key starts alike, as the ordered table has them."""
    ordered = sampling.shuffle(inputs.labels(spark, sf_dir))
    prefix = F.substring(sampling.order_key("row_id", "shuffle"), 1, 2)
    placed = ordered.select("row_id", prefix.alias("prefix"), F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("at"))
    # rows of other prefixes stand before and after, so the smallest place of a prefix lies above all of the one before
    bounds = placed.groupBy("prefix").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    apart = F.coalesce(F.lag("last").over(Window.orderBy("prefix")) < F.col("first"), F.lit(True))  # 256 rows
    return placed.select("row_id", "prefix", place.alias("place")).join(bounds.select("prefix", apart.alias("apart")), "prefix")


def split_rows(spark, sf_dir):
    return inputs.splits(spark, sf_dir).select("row_id", "y", "split")


def test_split_rows(spark, sf_dir):
    return sampling.stratified_split(inputs.corpus(spark, sf_dir)).select("row_id", "y", "split")


def split_summary(spark, sf_dir):
    stats = sampling.split_summary(inputs.splits(spark, sf_dir))
    return stats.select("split", "n", F.round("toxic_rate", 6).alias("toxic_rate"))


def subset_rows(spark, sf_dir):
    parts = sampling.stratified_split(inputs.corpus(spark, sf_dir))
    return sampling.train_subset(parts, SUBSET).select("row_id", "y", "split")


def premade_splits(spark, sf_dir):
    """A table that is already split goes through unchanged."""
    ready = sampling.use_splits(inputs.splits(spark, sf_dir))
    return sampling.split_summary(ready).select("split", "n", F.round("toxic_rate", 6).alias("toxic_rate"))


def balanced_train(spark, sf_dir):
    return sampling.balance_train_only(inputs.splits(spark, sf_dir)).select("row_id", "y", "split")


def balance_check(spark, sf_dir):
    balanced = sampling.balance_train_only(inputs.splits(spark, sf_dir)).filter("split = 'train'")
    return sampling.balance_check(balanced).select("n", "n_toxic", F.round("toxic_share", 6).alias("toxic_share"))


def balanced_same_size(spark, sf_dir):
    parts = inputs.splits(spark, sf_dir)
    pool, val = parts.filter("split <> 'test'"), parts.filter("split = 'val'")
    return sampling.balanced_same_size(pool, val, SAME_SIZE).select("row_id", "y")


def overfit_rows(spark, sf_dir):
    return sampling.overfit_sample(inputs.corpus(spark, sf_dir), PER_CLASS).select("row_id", "y")


def toxic_rows_masked(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    return apply_keep_mask(docs, inputs.labels(spark, sf_dir).filter("y = 1")).select("row_id")


QUERIES = {
    "sample_rows": sample_rows,
    "undersampled": undersampled,
    "shuffled_order": shuffled_order,
    "test_split_rows": test_split_rows,
    "split_rows": split_rows,
    "split_summary": split_summary,
    "subset_rows": subset_rows,
    "premade_splits": premade_splits,
    "balanced_train": balanced_train,
    "balance_check": balance_check,
    "balanced_same_size": balanced_same_size,
    "overfit_rows": overfit_rows,
    "toxic_rows_masked": toxic_rows_masked,
}

_summary = "SELECT split, count(*) AS n, round(avg(y), 6) AS toxic_rate FROM splits GROUP BY split"
BALANCED_CTES = """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('balance:42:' || row_id), row_id) AS k
  FROM splits WHERE split = 'train'),
smallest AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM splits WHERE split = 'train' GROUP BY y)),
balanced AS (
  SELECT row_id, y, split FROM ranked, smallest WHERE k <= n
  UNION ALL SELECT row_id, y, split FROM splits WHERE split <> 'train')"""

SQL = {
    "sample_rows": with_ctes(
        ("docs",), f"SELECT row_id FROM docs ORDER BY md5('sample:42:' || row_id), row_id LIMIT {SAMPLE}"
    ),
    "undersampled": with_ctes(("corpus",), """SELECT row_id, y FROM (
  SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('balance:42:' || row_id), row_id) AS k FROM corpus)
WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM corpus GROUP BY y))"""),
    "shuffled_order": with_ctes(("rows",), """SELECT row_id, substr(k, 1, 2) AS prefix,
  (row_number() OVER (PARTITION BY substr(k, 1, 2) ORDER BY k, row_id))::INTEGER AS place, true AS apart
FROM (SELECT row_id, md5('shuffle:42:' || row_id) AS k FROM rows)"""),
    "test_split_rows": with_ctes(("splits",), "SELECT row_id, y, split FROM after_test"),
    "split_rows": with_ctes(("splits",), "SELECT row_id, y, split FROM splits"),
    "split_summary": with_ctes(("splits",), _summary),
    "subset_rows": with_ctes(("splits",), f""", part_counts AS (SELECT y, count(*) AS n FROM pool GROUP BY y),
shares AS (
  SELECT y, n::DOUBLE / (SELECT sum(n) FROM part_counts)::DOUBLE * {SUBSET} AS exact FROM part_counts),
quota AS (
  SELECT y, floor(exact)::BIGINT + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, y)
    <= {SUBSET} - (SELECT sum(floor(exact)) FROM shares) THEN 1 ELSE 0 END AS quota FROM shares),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('subset:42:' || row_id), row_id) AS k FROM pool)
SELECT row_id, y, split FROM after_test WHERE split = 'test'
UNION ALL SELECT r.row_id, r.y, r.split FROM ranked r JOIN quota q ON r.y = q.y
WHERE k <= quota OR (SELECT sum(n) FROM part_counts) <= {SUBSET}"""),
    "premade_splits": with_ctes(("splits",), _summary),
    "balanced_train": with_ctes(("splits",), f"{BALANCED_CTES} SELECT row_id, y, split FROM balanced"),
    "balance_check": with_ctes(("splits",), f"""{BALANCED_CTES}
SELECT count(*) AS n, sum(y)::BIGINT AS n_toxic, round(avg(y), 6) AS toxic_share FROM balanced WHERE split = 'train'"""),
    "balanced_same_size": with_ctes(("splits",), f"""{BALANCED_CTES}
SELECT row_id, y FROM balanced WHERE split = 'train' ORDER BY md5('same-size:42:' || row_id), row_id LIMIT {SAME_SIZE}"""),
    "overfit_rows": with_ctes(("corpus",), f"""SELECT row_id, y FROM (
  SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('overfit:42:' || row_id), row_id) AS k FROM corpus)
WHERE k <= {PER_CLASS}"""),
    "toxic_rows_masked": with_ctes(
        ("docs",), "SELECT row_id FROM docs WHERE row_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    ),
}
