"""Cutting lineage: tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Table(NamedTuple):
    df: DataFrame
    path: str
    name: str | None = None  # in the catalog, if bucketed


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one under /tmp if Spark runs on this machine alone, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path or "file:///tmp/checkpoints"


def save(df: DataFrame, path: str | None = None) -> Table:
    """df written as Parquet, to path or a new folder, and read again: lineage ends there, and any executor may be lost after it."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Table(spark.read.schema(df.schema).parquet(path), path)


def save_bucketed(df: DataFrame, buckets: int, *by: str) -> Table:
    """Like save, in buckets by columns, one file each: joins and aggregations on these columns need no exchange."""
    spark, name = df.sparkSession, f"tessera_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(name)
    return Table(spark.table(name), path, name)


def delete(spark: SparkSession, table: Table) -> None:
    if table.name:
        spark.sql(f"drop table if exists {table.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(table.path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
