"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


INFERENCE = "spark.sql.constraintPropagation.enabled"


def get_session(app: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names; only a local master without one, as in tests, gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="leafmill-checkpoint-"))


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of an iterative job with a reliable (non-local) checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table below the shared checkpoint folder.

    For jobs of many steps on wide expressions: a checkpoint keeps what the optimizer inferred about its columns, expressions and
    all, a table read back starts with nothing. While the table is written no constraints are inferred either; on folds and
    spans that takes the optimizer longer than the job and prunes nothing.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/step-{uuid.uuid4().hex}"
    infer = spark.conf.get(INFERENCE)
    spark.conf.set(INFERENCE, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(INFERENCE, infer)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one task that ``dealt`` aims at.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by key, in partitions of about ``TASK_ROWS`` rows.

    Adaptive execution joins partitions up to a size in compressed bytes. Narrow rows compress to a few bytes, so that is millions of rows,
    and the sorts and windows over them grow in memory far beyond. A number that is asked for is kept, and what follows by
    the same key needs no other shuffle. Tables that the cores hold at that size are left alone.
    """
    return dealt_as(df, task_count(df), *keys)


def task_count(df: DataFrame) -> int:
    """Partitions of about ``TASK_ROWS`` rows that a table needs; 0 where the cores hold it at that size."""
    n = -(-df.count() // TASK_ROWS)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else 0


def dealt_as(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows by key in ``n`` partitions, as ``task_count`` gives them for a table of about as many rows."""
    return df.repartition(n, *keys) if n else df


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that are expensive to compute.

    Catalyst moves a filter below the projection its columns come from and evaluates them anew at every
    mention. A row id in the projection (any value passes) keeps the filter above it.
    """
    held = df.withColumn("__row", F.monotonically_increasing_id())
    return held.where(condition & (F.col("__row") >= 0)).drop("__row")
