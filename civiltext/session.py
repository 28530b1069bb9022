"""Session defaults and shared scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "civiltext", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` overrides them.

    Shuffle partitions stay adaptive: AQE coalesces small ones and splits skewed ones.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of a batch sent to Python, 64 MB by default, for tasks that get whole texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: `spark.checkpoint.dir`, which all executors share.

    A local session without that setting uses its warehouse folder; on a cluster it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/civiltext-{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in a part of its own for this session."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this session; results that still read them have to be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store `df` as Parquet in the shared folder and continue from the stored copy, whose columns can be pruned."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
