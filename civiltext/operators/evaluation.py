"""Scoring a model once and deriving every published number from the scores."""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.operators.classifiers import predict_proba
from civiltext.operators.metrics import (
    pr_auc, predict_default, quality, run_stats, tuned_metrics,
)
from civiltext.operators.sampling import sample_n
from civiltext.session import cut_lineage

LATENCY_RUNS = 3
LATENCY_ROWS = 1000  # of the test part, in repeated runs


def timed_runs(model: PipelineModel, df: DataFrame, runs: int = LATENCY_RUNS, name: str = "model") -> DataFrame:
    """`(model, run, rows, seconds, ms_per_sample)`: wall time of scoring the whole table, of which a count and a sum are kept.

    `rows` is counted in the scoring pass itself.
    """
    rows = []
    for run in range(runs):
        start = time.perf_counter()
        n, _ = predict_proba(model, df).agg(F.count("*"), F.sum("p_toxic")).first()
        seconds = time.perf_counter() - start
        rows.append((name, run, n, seconds, seconds * 1000 / max(n, 1)))
    return df.sparkSession.createDataFrame(
        rows, "model STRING, run INT, rows BIGINT, seconds DOUBLE, ms_per_sample DOUBLE"
    )


def throughput(runs: DataFrame) -> DataFrame:
    """`(model, rows, passes, rows_per_second)` over all timed runs of a model: rows scored, and passes over the texts."""
    return runs.groupBy("model").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("passes"), (F.sum("rows") / F.sum("seconds")).alias("rows_per_second"))


def _matrix(prefix: str = "") -> Column:
    tn, fp, fn, tp = (F.col(f"{prefix}{c}") for c in ("tn", "fp", "fn", "tp"))
    return F.array(F.array(tn, fp), F.array(fn, tp))


def evaluate_scores(val: DataFrame, test: DataFrame) -> DataFrame:
    """One row: quality and counts at 0.5 and at the threshold tuned on `val`, from scored tables."""
    plain = quality(test.withColumn("pred", predict_default()))
    area = pr_auc(test).scalar()
    block = F.struct("precision", "recall", "f1_score", area.alias("pr_auc"))
    default = plain.select(F.struct(block.alias("q"), _matrix().alias("m"))).scalar()
    tuned = tuned_metrics(val, test).select(
        F.struct(
            F.struct("precision", "recall", "f1_score", "pr_auc").alias("q"), _matrix().alias("m"), "threshold"
        )
    ).scalar()
    row = val.sparkSession.range(1).select(default.alias("d"), tuned.alias("t"))
    return row.select(
        F.col("d.q").alias("quality"),
        F.col("d.m").alias("confusion_matrix"),
        F.col("t.q").alias("quality_tuned"),
        F.col("t.threshold").alias("best_threshold"),
        F.col("t.m").alias("confusion_matrix_tuned"),
    )


def evaluate_model(
    spark: SparkSession, model: PipelineModel, splits: DataFrame, runs: int = LATENCY_RUNS
) -> DataFrame:
    """The full result block of a model on the val and test parts of `splits`.

    Every row is scored once, and that pass, which stores the scores and not the texts, gives the throughput.
    Latency comes from repeated runs over a sample of `LATENCY_ROWS` test rows.
    """
    held_out = splits.filter(F.col("split").isin("val", "test"))
    start = time.perf_counter()
    scored = cut_lineage(predict_proba(model, held_out).select("row_id", "y", "split", "p_toxic"))
    seconds = time.perf_counter() - start
    blocks = evaluate_scores(scored.filter("split = 'val'"), scored.filter("split = 'test'"))
    sample = cut_lineage(sample_n(held_out.filter("split = 'test'").select("row_id", "text"), LATENCY_ROWS, salt="latency"))
    timing = timed_runs(model, sample, runs)
    latency = run_stats(timing).select(
        F.struct("latency_mean_ms", "latency_std_ms", "latency_min_ms", "latency_max_ms")
    ).scalar()
    speed = scored.count() / seconds
    return blocks.select(
        "quality", "confusion_matrix", latency.alias("latency"), F.lit(speed).alias("throughput_samples_per_sec"),
        "quality_tuned", "best_threshold", "confusion_matrix_tuned",
    )


def clean_vs_stress(model: PipelineModel, variants: DataFrame) -> DataFrame:
    """Quality of one model per variant of the same test rows (see `compare.stress_variants`)."""
    scored = predict_proba(model, variants).withColumn("pred", predict_default())
    return quality(scored, by=("variant",))
