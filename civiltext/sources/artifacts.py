"""Splits, models and result files of an experiment."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = """
    quality STRUCT<precision: DOUBLE, recall: DOUBLE, f1_score: DOUBLE, pr_auc: DOUBLE>,
    confusion_matrix ARRAY<ARRAY<BIGINT>>,
    latency STRUCT<latency_mean_ms: DOUBLE, latency_std_ms: DOUBLE, latency_min_ms: DOUBLE, latency_max_ms: DOUBLE>,
    throughput_samples_per_sec DOUBLE,
    quality_tuned STRUCT<precision: DOUBLE, recall: DOUBLE, f1_score: DOUBLE, pr_auc: DOUBLE>,
    best_threshold DOUBLE,
    confusion_matrix_tuned ARRAY<ARRAY<BIGINT>>
"""
SPLIT_SCHEMA = "row_id BIGINT, text STRING, y INT, split STRING"


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def write_splits(splits: DataFrame, path: str) -> None:
    """One folder per split, so a reader of one split touches no other."""
    splits.select("row_id", "text", "y", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, *fallbacks: str) -> DataFrame:
    """The first of the paths that exists."""
    for candidate in (path, *fallbacks):
        try:
            return spark.read.schema(SPLIT_SCHEMA).parquet(candidate)
        except AnalysisException as error:
            if not _missing(error):
                raise
    raise FileNotFoundError(f"no splits at {', '.join((path, *fallbacks))}")


def save_model(model: PipelineModel | None, path: str) -> None:
    if model is None:
        raise ValueError("no fitted model to save")
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_results(results: DataFrame, path: str) -> None:
    """One nested row; a single file."""
    results.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(path)


def has_results(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema(RESULT_SCHEMA).json(path).isEmpty()
    except AnalysisException as error:
        if _missing(error):
            return False
        raise


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def model_size(spark: SparkSession, path: str) -> DataFrame:
    """Megabytes below a folder, 0.0 when it does not exist. File bodies are not read."""
    try:
        return _files(spark, path).agg(F.coalesce(F.sum("length") / 1048576, F.lit(0.0)).alias("size_mb"))
    except AnalysisException as error:
        if _missing(error):
            return spark.range(1).select(F.lit(0.0).alias("size_mb"))
        raise


def promote(spark: SparkSession, src: str, dst: str) -> None:
    """Make the model and splits of an ablation the global checkpoint. Evaluate again afterwards."""
    try:
        if _files(spark, src).isEmpty():
            raise FileNotFoundError(f"nothing to promote in {src}")
    except AnalysisException as error:
        if _missing(error):
            raise FileNotFoundError(f"no ablation at {src}") from error
        raise
    save_model(load_model(f"{src}/model"), f"{dst}/model")
    write_splits(read_splits(spark, f"{src}/splits"), f"{dst}/splits")
