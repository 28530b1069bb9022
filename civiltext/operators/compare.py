"""Comparing variants, models and slices.

Long results have the columns `(model, variant, metric, value)`: one row per published
number, so the tables here are small whatever the size of the corpora behind them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civiltext.functions.hashing import SEED, order_key
from civiltext.functions.text import STRESS_VARIANTS, basic_normalize, deobfuscate, obfuscate
from civiltext.session import cut_lineage

METRICS = ("precision", "recall", "f1_score", "pr_auc")


def to_long(wide: DataFrame, *keys: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return wide.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def compare(results: DataFrame, baseline: str, *variants: str) -> DataFrame:
    """One row per metric: the baseline, each variant and its difference; null where a side is missing."""
    table = results.groupBy("metric").pivot("variant", [baseline, *variants]).agg(F.first("value", True))
    deltas = [(F.col(v) - F.col(baseline)).alias(f"{v}_delta") for v in variants]
    return table.select("metric", baseline, *variants, *deltas)


def default_vs_tuned(blocks: DataFrame) -> DataFrame:
    """Change of each metric and extra hits and false alarms, from rows `(model, variant, ...)`."""
    pairs = blocks.filter("variant = 'default'").alias("d").join(
        blocks.filter("variant = 'tuned'").alias("t"), "model"
    )
    deltas = [(F.col(f"t.{m}") - F.col(f"d.{m}")).alias(f"{m}_delta") for m in ("precision", "recall", "f1_score")]
    return pairs.select(
        "model", *deltas,
        (F.col("t.tp") - F.col("d.tp")).alias("extra_tp"),
        (F.col("t.fp") - F.col("d.fp")).alias("extra_fp"),
    )


def cross_model_table(results: DataFrame, models: list[str]) -> DataFrame:
    return results.groupBy("metric").pivot("model", models).agg(F.first("value", True))


def relative_to(results: DataFrame, base: str) -> DataFrame:
    """Each value divided by the base model's value of the same metric."""
    reference = results.filter(F.col("model") == base).select("metric", F.col("value").alias("base_value"))
    return results.join(reference, "metric").select(
        "model", "metric", "value", F.try_divide("value", "base_value").alias("relative")
    )


def pareto_front(models: DataFrame, quality: str = "f1_score", cost: str = "ms_per_sample") -> DataFrame:
    """Models for which no other is at least as good on both axes and better on one.

    Cheapest first, a model stays when it beats the best quality of everything strictly
    cheaper and is not beaten at its own cost, so no model is paired with any other.
    """
    per_cost = models.groupBy(cost).agg(F.max(quality).alias("top"))
    front = _running_records(per_cost, cost)
    return models.join(front, [cost]).filter(F.col(quality) == F.col("top")).select(models.columns)


def _running_records(per_cost: DataFrame, cost: str) -> DataFrame:
    """Costs whose top quality exceeds that of every lower cost, a null cost being the lowest.

    Costs are dealt by range. A running maximum within each range starts from the best of the ranges before, which comes
    from one value per range.
    """
    dealt = cut_lineage(per_cost.repartitionByRange(cost).withColumn("range", F.spark_partition_id()))
    tops = dealt.groupBy("range").agg(F.max("top").alias("top"))
    listed = F.broadcast(tops.agg(F.collect_list(F.struct("range", "top")).alias("tops")))  # one row, a value per range
    earlier = F.filter("tops", lambda t: t["range"] < F.col("range"))
    before = F.array_max(F.transform(earlier, lambda t: t["top"]))
    cheaper = W.partitionBy("range").orderBy(cost).rowsBetween(W.unboundedPreceding, -1)
    within = dealt.withColumn("within", F.max("top").over(cheaper)).join(listed)
    best = F.greatest("within", before)  # nulls do not count
    return within.withColumn("best", best).filter(F.col("best").isNull() | (F.col("top") > F.col("best"))).select(cost, "top")


def disagreements(first: DataFrame, second: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows that two scored tables label differently, widest spread first."""
    joined = first.select("row_id", "y", F.col("p_toxic").alias("p_first")).join(
        second.select("row_id", F.col("p_toxic").alias("p_second")), "row_id"
    )
    return (
        joined.filter((F.col("p_first") > threshold) != (F.col("p_second") > threshold))
        .withColumn("spread", F.abs(F.col("p_first") - F.col("p_second")))
        .orderBy(F.desc("spread"), "row_id")
    )


def stress_set(df: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows with one of the evasions each, picked by a hash of the id. For evaluation only."""
    key = order_key("row_id", "stress", seed)
    variant = F.conv(F.substring(key, 1, 4), 16, 10).cast("bigint") % STRESS_VARIANTS
    return df.withColumn("text", obfuscate(F.col("text"), variant))


def stress_variants(test: DataFrame, seed: int = SEED) -> DataFrame:
    """Clean, obfuscated and deobfuscated versions of the test rows in one table."""
    stressed = stress_set(test, seed)
    versions = {
        "clean": test.withColumn("text", basic_normalize(F.col("text"))),
        "obfuscated": stressed.withColumn("text", basic_normalize(F.col("text"))),
        "deobfuscated": stressed.withColumn("text", basic_normalize(deobfuscate(F.col("text")))),
    }
    clean, *others = [df.withColumn("variant", F.lit(name)) for name, df in versions.items()]
    for other in others:
        clean = clean.unionByName(other)
    return clean


def cached_experiment(exists: Callable[[], bool], load: Callable[[], DataFrame], run: Callable[[], None]) -> DataFrame:
    """Run an experiment unless its results are already stored, then load them."""
    if not exists():
        run()
    return load()
