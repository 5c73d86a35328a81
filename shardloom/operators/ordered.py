"""Rows in order over many tasks: blocks by ranges of the order, and places counted from the blocks before.

The rows are dealt by range once and written to the folder that driver and executors share, with the number of their block, so that
later steps see the same blocks. A block is sorted by one task; no task and not the driver sees all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder below the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")


def blocks(df: DataFrame, *terms: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows with ``_block``, which rises with the order; rows that are equal in it are in one block."""
    n = max(1, -(-df.count() // block_rows))
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/blocks-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(n, *terms).withColumn("_block", F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def before(dealt: DataFrame) -> DataFrame:
    """_block, _before: the number of rows in the blocks before; a row a block."""
    counts = dealt.groupBy("_block").agg(F.count("*").alias("n"))
    return counts.select("_block", F.coalesce(F.sum("n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def placed(df: DataFrame, *terms: Column, name: str = "place", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows with their place in the order, from 1; rows that are equal in it have places next to each other."""
    dealt = blocks(df, *terms, block_rows=block_rows)
    inside = F.row_number().over(W.partitionBy("_block").orderBy(*terms))
    return dealt.join(before(dealt), "_block").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_block", "_before")
