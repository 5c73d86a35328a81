"""Puts flat tables into sharded form: rows with their shard and ids as a shard would store them.

Key k lives on shard ``1 + k % 4`` under the local id ``k + 1``. Everything is a projection of the scan; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.catalog import Catalog, Server, ShardRow
from shardloom.functions.ids import IDS
from shardloom.registry import SHARD

N_SHARDS = 4

CATALOG = Catalog(
    shards=(ShardRow(1, default=True), ShardRow(2, "shard_2"), ShardRow(3, None, "cluster2"), ShardRow(4, "shard_4", "cluster2"), ShardRow(5, "shard_5", "ghost")),
    servers=(Server("main", "r1", default=True), Server("cluster2", "r2", open=True), Server("cluster3")),
    region="r1",
)


def shard_of(key: Column) -> Column:
    return (1 + key % N_SHARDS).cast("int")


def reference(key: Column, shard: Column) -> Column:
    """The id of ``key`` as a row on ``shard`` stores it."""
    return F.when(shard_of(key) == shard, key + 1).otherwise(shard_of(key) * F.lit(IDS) + key + 1)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    up = F.call_function("div", k, F.lit(8))
    shard = shard_of(k)
    return _read(spark, sf_dir, "customer").select(
        shard.alias(SHARD),
        (k + 1).alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation_key"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("mktsegment"),
        F.when(k % 7 != 0, F.col("c_mktsegment")).alias("mktsegment_or_null"),
        F.when(shard_of(up) == shard, up + 1).alias("parent_id"),
        F.when(k % 3 == 0, F.array(shard, (shard % N_SHARDS + 1).cast("int"))).otherwise(F.array(shard)).alias("associated_shards"),
    )


def shadow_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, and on shard 1 copies under their global ids of every tenth customer of other shards."""
    own = customer(spark, sf_dir)
    copies = own.where((F.col(SHARD) != 1) & ((F.col("id") - 1) % 10 == 0))
    parent = F.when(F.col("parent_id").isNotNull(), F.col("parent_id") + F.col(SHARD) * F.lit(IDS))
    return own.unionByName(copies.withColumns({"id": F.col("id") + F.col(SHARD) * F.lit(IDS), "parent_id": parent, SHARD: F.lit(1)}))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        shard_of(k).alias(SHARD),
        (k + 1).alias("id"),
        reference(F.col("o_custkey"), shard_of(k)).alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("totalprice"),
        F.col("o_orderdate").alias("orderdate"),
        F.col("o_orderpriority").alias("priority"),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the shard of its order."""
    k = F.col("l_orderkey")
    shard = shard_of(k)
    names = {"l_linenumber": "linenumber", "l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount", "l_shipdate": "shipdate"}
    return _read(spark, sf_dir, "lineitem").select(
        shard.alias(SHARD), (k + 1).alias("order_id"), reference(F.col("l_partkey"), shard).alias("part_id"), reference(F.col("l_suppkey"), shard).alias("supplier_id"), *[F.col(c).alias(n) for c, n in names.items()]
    )


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return _read(spark, sf_dir, "events").select(shard_of(k).alias(SHARD), (k + 1).alias("id"), reference(F.col("user_id"), shard_of(k)).alias("user_id"), "ts", "event_type", "value")


def feature(spark: SparkSession, sf_dir: str, n_orders: int) -> DataFrame:
    """Of an even event its customer owns it, of an odd one the order of its number."""
    k = F.col("event_id")
    owner = F.when(k % 2 == 0, F.col("user_id")).otherwise(k % n_orders)
    kind = F.when(k % 2 == 0, "Customer").otherwise("Order")
    return _read(spark, sf_dir, "events").select(shard_of(k).alias(SHARD), (k + 1).alias("id"), kind.alias("owner_type"), reference(owner, shard_of(k)).alias("owner_id"), "value")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(shard_of(k).alias(SHARD), (k + 1).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("retailprice"))


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _read(spark, sf_dir, "supplier").select(shard_of(k).alias(SHARD), (k + 1).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_key"), F.col("s_acctbal").alias("acctbal"))


def nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_key"))


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsharded rows that point to every fifth customer, as seen from the default shard."""
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").where(k % 5 == 0).select(k.alias("id"), reference(k, F.lit(CATALOG.default.id)).alias("user_id"))


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return _read(spark, sf_dir, "documents").select(shard_of(k).alias(SHARD), k.cast("string").alias("id"), "lang", "source", "n_chars")


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (customer, orders, lineitem, event, part, supplier, nation, region, root, document)}
