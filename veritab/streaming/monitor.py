"""Structured Streaming jobs over folders of batches (ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritab.session import freeze
from veritab.sources.ledger import LEDGER_SCHEMA, save_results


def run_available(query_writer) -> None:
    """Process all files present and stop."""
    query = query_writer.trigger(availableNow=True).start()
    query.awaitTermination()


def generation_monitor(
    spark: SparkSession, source: str, schema: StructType | str, group: str, accepted: Column, state: str, checkpoint: str, measure: str | None = None
) -> DataFrame:
    """ST1: sampled and accepted rows per run, kept up to date from a folder of batches.

    The checkpoint is the resume point: files counted before are not counted again.  Each
    micro-batch writes the totals of the runs that it changed, in a folder named by its
    batch number, so that a repeated batch overwrites itself; the newest row of a run
    counts.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    sums = [F.count("*").alias("total_sampled"), F.count_if(accepted).alias("total_processed")]
    if measure is not None:
        sums.append(F.sum(measure).alias("measure"))
    counted = rows.groupBy(group).agg(*sums)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/version={number:09d}")

    run_available(counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep))
    return latest_rows(spark, state, group)


def latest_rows(spark: SparkSession, state: str, group: str) -> DataFrame:
    """The newest row of every run."""
    versions = spark.read.parquet(state)
    rest = [c for c in versions.columns if c not in (group, "version")]
    newest = versions.groupBy(group).agg(F.max_by(F.struct(*rest), "version").alias("__row"))
    return newest.select(group, "__row.*")


def compact_state(spark: SparkSession, state: str, group: str) -> None:
    """Put the newest rows into the newest version; the earlier ones are then not needed."""
    numbers = [r.version for r in spark.read.parquet(state).select("version").distinct().collect()]  # one row a folder
    if len(numbers) > 1:
        freeze(latest_rows(spark, state, group)).write.mode("overwrite").parquet(f"{state}/version={max(numbers):09d}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for number in sorted(numbers)[:-1]:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/version={number:09d}"), True)


def ledger_stream_upsert(spark: SparkSession, source: str, ledger: str, checkpoint: str) -> None:
    """ST2: append arriving result rows to the ledger, each exactly once.

    Copies inside a micro-batch and copies of recorded rows are not written; a repeated
    micro-batch therefore changes nothing.
    """
    rows = spark.readStream.schema(LEDGER_SCHEMA).parquet(source)

    def merge(batch: DataFrame, _number: int) -> None:
        if not batch.isEmpty():
            save_results(batch.sparkSession, ledger, batch, overwrite=True)

    run_available(rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge))
