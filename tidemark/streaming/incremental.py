"""Incremental forms: the folds of the batch operators over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.inventory import build_inventory


def activity_stream(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Capabilities that each user's events show in a window; rows later than ``late`` are left to a batch run."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy("user_id", F.window("ts", size).alias("w"))
    return grouped.agg(F.array_sort(F.collect_set("event_type")).alias("requires"), F.count("*").alias("n")).select("user_id", F.col("w.start").alias("starts"), "requires", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, write Parquet exactly once, and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def inventory_stream(spark: SparkSession, files_dir: str, out: str, checkpoint: str) -> None:
    """Rebuild the inventory of every repository with new files: a file stream whose batches replace whole repositories.

    The fold over a repository isn't incremental in its files (an innermost range may come later), so a batch takes all
    files of the repositories it touches. Batches are written by number, so a batch that is run again replaces itself.
    """
    schema = spark.read.parquet(files_dir).schema

    def rebuild(batch: DataFrame, number: int) -> None:
        touched = batch.select("repo").distinct()
        whole = spark.read.parquet(files_dir).join(touched, "repo", "left_semi")
        build_inventory(whole).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = spark.readStream.schema(schema).parquet(files_dir).writeStream.foreachBatch(rebuild)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
