"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.scalars import named

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not compile methods above this size; wider plans then run operator by operator
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "veritab", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; `conf` keys use `_` for `.`-free overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Run-time settings for a session built elsewhere; explicit choices of its owner stay."""
    for key in ("spark.sql.codegen.hugeMethodLimit", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, DEFAULTS[key])


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local run import this package; on a cluster it travels with `--py-files`."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's `spark.checkpoint.dir`; a local session without one gets a scratch folder.

    Off local mode a folder of the driver's machine would be lost to the executors, so
    a missing setting is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not configured and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="veritab-checkpoint-"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location, for tables written on the way."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage.

    Used where a value must not change when a task is run again (partition
    numbers, generated batches), and where a loop would grow the plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared checkpoint folder and read back, for rows that are costly to make and read more than once."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out over all cores, for costly work on each row: a scan has no more busy tasks than its files have row groups.

    Every row lies in some partition; asking for it keeps filters, which hold the costly
    work, from being moved in front of the exchange.
    """
    dealt = df.hint("repartition")
    return dealt.select([F.when(F.spark_partition_id() >= 0, named(c)).alias(c) for c in df.columns])
