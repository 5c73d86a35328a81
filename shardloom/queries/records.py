"""Writes, as the rows that they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions import ids
from shardloom.operators import associations as A
from shardloom.operators import records
from shardloom.queries.base import gid, key, loc, on, query, rel, sh
from shardloom.registry import CUSTOMER, ORDERS, SHARD
from shardloom.sources import placement as P


@query(f"""
SELECT CAST(2 AS INTEGER) AS shard, {rel("c_custkey", 2)} AS id, CASE WHEN {sh("(c_custkey // 8)")} = {sh("c_custkey")} THEN {rel("(c_custkey // 8)", 2)} END AS parent_id, c_name AS name
FROM customer WHERE {sh("c_custkey")} <> 2""")
def shadow_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of the other shards' customers for shard 2."""
    return records.replicate(P.customer(spark, sf_dir), CUSTOMER, 2).select(F.col(SHARD).alias("shard"), "id", "parent_id", "name")


@query(f"""
WITH rows AS (
  SELECT c_custkey AS k, {sh("c_custkey")} AS s, {loc("c_custkey")} AS id FROM customer
  UNION ALL SELECT c_custkey, 1, {gid("c_custkey")} FROM customer WHERE c_custkey % 10 = 0 AND {sh("c_custkey")} <> 1)
SELECT k, CAST(s AS INTEGER) AS shard, id FROM rows WHERE NOT (id >= 10000000000000 AND k % 20 = 0)""")
def shadow_destroy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the copies, on shards 1 and 2, of every twentieth customer."""
    c = P.shadow_customers(spark, sf_dir)
    keys = P.customer(spark, sf_dir).where((F.col("id") - 1) % 20 == 0).select(A.gid("id").alias("gid"))
    left = records.destroy_shadow(c, keys, CUSTOMER, [1, 2])
    return left.select(F.substring("name", 10, 9).cast("long").alias("k"), F.col(SHARD).alias("shard"), "id")


@query(f"SELECT CAST(4 AS INTEGER) AS shard, {loc('o_orderkey')} AS id, {rel('o_custkey', 4)} AS customer_id FROM orders WHERE {sh('o_orderkey')} = 2")
def reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of shard 2 as shard 4 would store them."""
    moved = records.move(on(spark, sf_dir, "orders").shard(2).rows(), ORDERS, 4)
    return moved.select(F.col(SHARD).alias("shard"), "id", "customer_id")


NEW = [(900_000_001, key(6), 10.5), (900_000_002, 9, 20.25)]


@query(f"""
WITH rows AS (
  SELECT {sh("o_orderkey")} AS s, {loc("o_orderkey")} AS id, {rel("o_custkey", sh("o_orderkey"))} AS customer_id, o_totalprice AS totalprice FROM orders
  UNION ALL SELECT 3, 10000900000001, 7, 10.5 UNION ALL SELECT 3, 10000900000002, 10000000000009, 20.25)
SELECT CAST(s AS INTEGER) AS shard, count(*) AS n, round(sum(totalprice), 2) AS total, max(id) AS last, CAST(sum(customer_id % 1000003) AS BIGINT) AS mark FROM rows GROUP BY 1""")
def insert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New orders, with ids as shard 1 reads them, inserted on shard 3."""
    new = spark.createDataFrame([(i, c, t) for i, c, t in NEW], "id long, customer_id long, totalprice double")
    rows = records.incoming(new, ORDERS, 1, 3)
    whole = records.insert(P.orders(spark, sf_dir), rows)
    return whole.groupBy(F.col(SHARD).alias("shard")).agg(F.count("*").alias("n"), F.round(F.sum("totalprice"), 2).alias("total"), F.max("id").alias("last"), F.sum(F.col("customer_id") % 1000003).alias("mark"))


@query(f"""
SELECT {gid("o_orderkey")} AS id, {rel("o_custkey", sh("o_orderkey"))} AS customer_id, CASE WHEN {sh("o_orderkey")} = 2 AND o_orderkey % 5 = 0 THEN 1.0 ELSE o_totalprice END AS totalprice FROM orders
UNION ALL SELECT 20000900000001, 30000000000007, 2.0""")
def upsert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On shard 2 every fifth order gets a new price, and one order is new."""
    o = P.orders(spark, sf_dir)
    changed = o.where((F.col(SHARD) == 2) & ((F.col("id") - 1) % 5 == 0)).withColumn("totalprice", F.lit(1.0))
    new = spark.createDataFrame([(2, 900_000_001, 30_000_000_000_007, 2.0)], f"{SHARD} int, id long, customer_id long, totalprice double")
    whole = records.upsert(o, changed.unionByName(new, allowMissingColumns=True), [SHARD, "id"])
    return whole.select(ids.global_id(F.col("id"), F.col(SHARD)).alias("id"), "customer_id", "totalprice")


@query(f"SELECT count(*) AS n FROM orders WHERE {sh('o_orderkey')} IN (1, 2) AND o_orderstatus = 'P'")
def update_all_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").shard(1, 2).where(status="P").order("id").touched()


@query(f"SELECT count(*) AS n FROM orders WHERE o_custkey IN (1, 2, 3) AND {sh('o_orderkey')} = 4")
def delete_all_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").shard(4).where(customer_id=[key(k) for k in (1, 2, 3)]).touched()


@query(f"""
SELECT o_orderstatus AS was, CASE WHEN {sh('o_orderkey')} IN (1, 2) AND o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def update_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = on(spark, sf_dir, "orders", P.orders(spark, sf_dir).withColumn("was", F.col("status")))
    return q.shard(1, 2).where(status="P").updated(status="X").groupBy("was", "status").agg(F.count("*").alias("n"))


@query(f"SELECT CAST({sh('o_orderkey')} AS INTEGER) AS shard, count(*) AS n FROM orders WHERE NOT (o_custkey IN (1, 2, 3) AND {sh('o_orderkey')} = 4) GROUP BY 1")
def delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = on(spark, sf_dir, "orders").shard(4).where(customer_id=[key(k) for k in (1, 2, 3)]).deleted()
    return left.groupBy(F.col(SHARD).alias("shard")).agg(F.count("*").alias("n"))


NEW_KEYS = [(1, 10.5), (900_000_001, 10.5), (900_000_001, 3.25), (900_000_002, 20.25), (5, 1.5)]
_NEW = "VALUES " + ", ".join(f"({i}, {t})" for i, t in NEW_KEYS)


@query(f"""
WITH old AS (SELECT {loc("o_orderkey")} AS id, o_totalprice AS totalprice FROM orders WHERE {sh("o_orderkey")} = 1),
new AS (SELECT id, min(totalprice) AS totalprice FROM ({_NEW}) v(id, totalprice) WHERE id NOT IN (SELECT id FROM old) GROUP BY id)
SELECT id, totalprice FROM old UNION ALL SELECT id, totalprice FROM new""")
def insert_all_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose ids exist, or that come twice, are skipped."""
    new = spark.createDataFrame(NEW_KEYS, "id long, totalprice double")
    rows = records.incoming(new, ORDERS, 1, 1)
    return records.insert(P.orders(spark, sf_dir), rows, [SHARD, "id"]).where(F.col(SHARD) == 1).select("id", "totalprice")


@query(f"""
SELECT id, customer_id FROM (VALUES (900000001, {key(6)}), (900000002, 9)) v(id, customer_id)""")
def insert_all_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inserted rows of shard 3, with ids as shard 1 reads them; a row that exists there isn't among them."""
    new = spark.createDataFrame([(900_000_001, key(6)), (900_000_002, 9), (key(2), 9)], "id long, customer_id long")
    o = P.orders(spark, sf_dir)
    rows = records.incoming(new, ORDERS, 1, 3)
    added = records.new_rows(o, rows, [SHARD, "id"])
    return records.returned(added, ORDERS, 3, 1, ["id", "customer_id"])


@query(f"""
SELECT {gid("o_orderkey")} AS id, {rel("o_custkey", sh("o_orderkey"))} AS customer_id, o_orderpriority AS priority, CASE WHEN {sh("o_orderkey")} = 2 AND o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders
UNION ALL SELECT 20000900000001, NULL, NULL, 'N'""")
def upsert_all_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name only a status: the other columns of existing orders stay, and a new order has none."""
    o = P.orders(spark, sf_dir)
    changed = o.where((F.col(SHARD) == 2) & ((F.col("id") - 1) % 5 == 0)).select(SHARD, "id", F.lit("X").alias("status"))
    new = spark.createDataFrame([(2, 900_000_001, "N")], f"{SHARD} int, id long, status string")
    whole = records.upsert(o, changed.unionByName(new), [SHARD, "id"])
    return whole.select(ids.global_id(F.col("id"), F.col(SHARD)).alias("id"), "customer_id", "priority", "status")


BIG = f"EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND {sh('o.o_orderkey')} = {sh('c_custkey')} AND o.o_totalprice > 450000)"


def _with_big_orders(spark: SparkSession, sf_dir: str):
    inner = on(spark, sf_dir, "orders").where("totalprice > 450000")
    return on(spark, sf_dir, "customer").shard(1, 2, 3).exists(inner, ("id", "customer_id"))


@query(f"SELECT {gid('c_custkey')} AS id, c_name AS name FROM customer WHERE NOT ({sh('c_custkey')} IN (1, 2, 3) AND {BIG})")
def delete_where_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_big_orders(spark, sf_dir).deleted().select(A.gid("id").alias("id"), "name")


@query(f"SELECT {gid('c_custkey')} AS id, CASE WHEN {sh('c_custkey')} IN (1, 2, 3) AND {BIG} THEN 'X' ELSE c_mktsegment END AS mktsegment FROM customer")
def update_where_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_big_orders(spark, sf_dir).updated(mktsegment="X").select(A.gid("id").alias("id"), "mktsegment")


@query(f"""
WITH top AS (SELECT o_orderkey FROM orders WHERE {sh("o_orderkey")} IN (1, 2) AND o_orderstatus = 'P' ORDER BY o_totalprice DESC, {rel("o_orderkey", 1)} LIMIT 7)
SELECT {gid("o_orderkey")} AS id, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM top) THEN 'X' ELSE o_orderstatus END AS status FROM orders""")
def update_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = on(spark, sf_dir, "orders").shard(1, 2).where(status="P").order("totalprice", descending=True).order("id").limit(7)
    return q.updated(status="X").select(A.gid("id").alias("id"), "status")


@query(f"""
SELECT CAST(shard AS INTEGER) AS shard, {rel("k", "shard")} AS id, name FROM (
  SELECT c_custkey AS k, c_name AS name, unnest(CASE WHEN c_custkey % 3 = 0 THEN [{sh("c_custkey")}, {sh("c_custkey")} % 4 + 1] ELSE [{sh("c_custkey")}] END) AS shard FROM customer)""")
def partition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer once for each shard that it has data on."""
    return records.partition_records(P.customer(spark, sf_dir), CUSTOMER, "associated_shards").select("shard", "id", "name")
