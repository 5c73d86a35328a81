"""Sharded tables in partitioned Parquet: one folder a shard, pruned by predicates on the shard."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators import records
from shardloom.registry import SHARD


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows of a shard are spread over several tasks, so that a large shard doesn't end in one."""
    df.repartition(SHARD, F.pmod(F.xxhash64(*[c for c in df.columns if c != SHARD]), F.lit(32))).write.partitionBy(SHARD).mode(mode).parquet(path)


def append(df: DataFrame, path: str) -> None:
    write(df, path, "append")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, on: list[str]) -> None:
    """Upserts rows into a stored table, writing only the shards that they touch.

    The new rows of these shards are written beside the table first, as a table isn't read and overwritten at once.
    """
    touched = [r[0] for r in rows.select(SHARD).distinct().collect()]  # at most a row a shard
    staged = f"{path.rstrip('/')}_staged-{uuid.uuid4().hex}"
    write(records.upsert(read(spark, path).where(F.col(SHARD).isin(touched)), rows, on), staged)
    new = read(spark, staged)
    new.write.option("partitionOverwriteMode", "dynamic").partitionBy(SHARD).mode("overwrite").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_shard(spark: SparkSession, path: str, shard: int) -> bool:
    """Deletes the folder of a shard."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SHARD}={int(shard)}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
