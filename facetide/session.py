"""Session set-up and the shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "facetide", cores: int | None = None, **settings: str) -> SparkSession:
    """A session with the engine's fixed rules: UTC, ANSI on, AQE on.

    ``cores`` builds a local session; without it the master comes from spark-submit.
    ``settings`` uses ``__`` for dots, e.g. ``spark__sql__shuffle__partitions="64"``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", str(cores))
        )
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the rules every query relies on in a session built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one under the warehouse.

    Both are Spark's own settings; a cluster keeps its warehouse on shared storage too.
    """
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_SETTING, None) or spark.conf.get(CHECKPOINT_SETTING, None)
    current = context.getCheckpointDir()
    if not configured and current:
        return current.rstrip("/")
    folder = configured or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_intermediate")
    if current is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path under the shared folder (not created yet)."""
    return os.path.join(shared_folder(spark), f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to a new Parquet table in the shared folder, and read from there.

    Cuts the lineage, and lets later passes read only the columns they need.
    """
    path = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
