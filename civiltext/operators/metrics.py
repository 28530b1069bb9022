"""Confusion counts, precision / recall / F1, average precision and threshold tuning.

Input is a scored table `(row_id, y, p_toxic)`. By default a row is toxic when p > 0.5,
after tuning when p >= t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civiltext.functions.once import evaluated_once
from civiltext.session import cut_lineage

# The threshold grid, whose step carries the float error of (0.10 + 0.01) - 0.10.
FIRST_THRESHOLD = 0.10
THRESHOLD_STEP = (0.10 + 0.01) - 0.10
N_THRESHOLDS = 81
DEFAULT_THRESHOLD = 0.5

SCORES_PER_SLICE = 100_000


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def predict_default(p: Column | str = "p_toxic") -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (p > DEFAULT_THRESHOLD).cast("int")


def predict_at(threshold: Column | float, p: Column | str = "p_toxic") -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (p >= threshold).cast("int")


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Always four counts, also when a class does not occur."""
    truth, said = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(~truth & ~said).alias("tn"),
        F.count_if(~truth & said).alias("fp"),
        F.count_if(truth & ~said).alias("fn"),
        F.count_if(truth & said).alias("tp"),
    )


def with_quality(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the four counts; 0 where the denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def quality(df: DataFrame, y: str = "y", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    return with_quality(confusion(df, y, pred, by))


def with_error_rates(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select("*", _ratio(fp, fp + tn).alias("fp_rate"), _ratio(fn, fn + tp).alias("fn_rate"))


def error_rates(df: DataFrame, y: str = "y", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    return with_error_rates(confusion(df, y, pred, by))


def pr_auc(df: DataFrame, y: str = "y", p: str = "p_toxic", scores_per_slice: int = SCORES_PER_SLICE) -> DataFrame:
    """Average precision: precision at each distinct score times the recall gained there.

    Running counts over all scores would be one task. Distinct scores are cut at their own
    quantiles into slices of about `scores_per_slice`; each slice runs its own window and
    starts from the totals of the slices above it, a table of one row per slice.
    """
    scores = cut_lineage(df.groupBy(F.col(p).alias("p")).agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos")
    ))
    slices = -(-scores.count() // scores_per_slice) or 1
    cuts = [i / slices for i in range(1, slices)] or [1.0]
    edges = scores.agg(F.percentile_approx("p", cuts, max(10_000, 10 * slices))).scalar()
    sliced = (
        scores.withColumn("edges", edges)
        .withColumn("slice", evaluated_once(F.size(F.filter("edges", lambda e: e < F.col("p")))))
        .drop("edges")
    )
    above = W.orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sliced.groupBy("slice").agg(F.sum("n").alias("slice_n"), F.sum("pos").alias("slice_pos"))
        .select(
            "slice",
            F.coalesce(F.sum("slice_n").over(above), F.lit(0)).alias("n_above"),
            F.coalesce(F.sum("slice_pos").over(above), F.lit(0)).alias("pos_above"),
        )
    )
    running = W.partitionBy("slice").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    steps = sliced.join(starts, "slice").select(
        "pos",
        (F.col("n_above") + F.sum("n").over(running)).alias("seen"),
        (F.col("pos_above") + F.sum("pos").over(running)).alias("hits"),
    )
    gained = F.sum(F.col("pos") * F.col("hits") / F.col("seen"))
    return steps.agg(_ratio(gained, F.sum("pos")).alias("pr_auc"))


def _threshold(i: Column) -> Column:
    return F.lit(FIRST_THRESHOLD) + i * F.lit(THRESHOLD_STEP)


def threshold_sweep(df: DataFrame, y: str = "y", p: str = "p_toxic") -> DataFrame:
    """Counts and F1 at 81 thresholds from 0.10 to 0.90, in one pass over the scores.

    A row is counted once, at the number of thresholds its score reaches; summing that
    histogram from the top gives the predictions of every threshold.
    """
    guess = F.least(
        F.greatest(F.floor((F.col(p) - FIRST_THRESHOLD) / THRESHOLD_STEP), F.lit(-1)), F.lit(N_THRESHOLDS - 1)
    )
    last = F.when((guess < N_THRESHOLDS - 1) & (_threshold(guess + 1) <= F.col(p)), guess + 1).when(
        (guess >= 0) & (_threshold(guess) > F.col(p)), guess - 1
    ).otherwise(guess)
    reached = df.groupBy(last.cast("bigint").alias("i")).agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos")
    )
    grid = df.sparkSession.range(-1, N_THRESHOLDS).select(
        F.col("id").alias("i"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos")
    )
    bins = reached.unionByName(grid).groupBy("i").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    from_top = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    everything = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    said, hits = F.sum("n").over(from_top), F.sum("pos").over(from_top)
    all_n, all_pos = F.sum("n").over(everything), F.sum("pos").over(everything)
    counts = bins.select(
        "i",
        (all_n - all_pos - said + hits).alias("tn"),
        (said - hits).alias("fp"),
        (all_pos - hits).alias("fn"),
        hits.alias("tp"),
    ).filter("i >= 0")
    return with_quality(counts).withColumn("threshold", _threshold(F.col("i"))).drop("i")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest F1, the smallest threshold among equals."""
    return sweep.orderBy(F.desc("f1_score"), "threshold").limit(1).select("threshold", "f1_score")


def tuned_metrics(val: DataFrame, test: DataFrame) -> DataFrame:
    """Threshold chosen on validation rows, counts and quality on test rows."""
    chosen = best_threshold(threshold_sweep(val)).select("threshold").scalar()
    counts = quality(test.withColumn("pred", predict_at(chosen)))
    return counts.select(chosen.alias("threshold"), "*", pr_auc(test).scalar().alias("pr_auc"))


def metrics_by(df: DataFrame, *keys: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Quality per slice, for instance per language."""
    return with_error_rates(quality(df, y, pred, by=keys))


def run_stats(runs: DataFrame) -> DataFrame:
    """Mean, population deviation, minimum and maximum of timed runs per model."""
    ms = F.col("ms_per_sample")
    return runs.groupBy("model").agg(
        F.avg(ms).alias("latency_mean_ms"),
        F.stddev_pop(ms).alias("latency_std_ms"),
        F.min(ms).alias("latency_min_ms"),
        F.max(ms).alias("latency_max_ms"),
    )
