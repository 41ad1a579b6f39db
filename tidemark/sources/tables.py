"""Parquet tables of a data folder, and tables written between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPLIT_BYTES = 128 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def read_texts(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table whose texts cost more to look at than to move.

    A table of few files that is small enough for every core's share to stay below one split is dealt to all cores. A
    larger one keeps its scan's splits of spark.sql.files.maxPartitionBytes: the files' number never sets a task's size.
    """
    df, cores = read(spark, folder, table), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and file_bytes(df) < cores * SPLIT_BYTES else df


def file_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size: for a plain scan, the sum of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, the warehouse.

    Only a local session, where one machine is all there is, gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local")
        folder = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that materialise() wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
