"""Associations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions import ids
from shardloom.operators import associations as A
from shardloom.queries.base import gid, key, on, query, rel, sh
from shardloom.registry import SHARD
from shardloom.sources import placement as P

LOCAL = f"{sh('o_orderkey')} = {sh('o_custkey')}"


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [P.SOURCES[n](spark, sf_dir) for n in names]


def _read(column: str, side: str, cur: int = 1):
    """A column as shard 1 reads it."""
    return ids.relative_id(F.col(f"{side}.{column}"), F.col(f"{side}.{SHARD}"), cur)


@query(f"SELECT {rel('o_orderkey', 1)} AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE {LOCAL}")
def join_in_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    return A.in_shard(o, c, "customer_id", "id").select(_read("id", "a").alias("id"), "b.name")


@query(f"SELECT {rel('o_orderkey', 1)} AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE {LOCAL} OR ({sh('o_orderkey')} = 1 AND c_custkey % 10 = 0)")
def join_shadow_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join within shards also meets copies of other shards' rows."""
    o = P.orders(spark, sf_dir)
    return A.in_shard(o, P.shadow_customers(spark, sf_dir), "customer_id", "id").select(_read("id", "a").alias("id"), "b.name")


@query(f"SELECT {rel('o_orderkey', 1)} AS id, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND {LOCAL}")
def left_join_in_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    return A.in_shard(o, c, "customer_id", "id", "left").select(_read("id", "a").alias("id"), "b.name")


@query(f"SELECT {rel('o_orderkey', 1)} AS id, l_linenumber AS linenumber, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 8 AND {sh('o_orderkey')} IN (1, 2, 3)")
def join_where_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition on a key of the joined table, in that table's terms on each shard."""
    o = on(spark, sf_dir, "orders").shard(1, 2, 3).where(customer_id=key(8)).rows()
    return A.in_shard(P.lineitem(spark, sf_dir), o, "order_id", "id").select(_read("id", "b").alias("id"), "a.linenumber", "a.quantity")


@query(f"SELECT {gid('o_orderkey')} AS id, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def belongs_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.orders(spark, sf_dir)
    return A.belongs_to(o, P.shadow_customers(spark, sf_dir), "customer_id").select(A.gid("id", "child").alias("id"), "parent.name")


@query(f"SELECT {gid('c_custkey')} AS customer, {gid('o_orderkey')} AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE {LOCAL}")
def has_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children on the owner's shard."""
    o, c = _tables(spark, sf_dir, "orders", "customer")
    return A.has_many(c, o, "customer_id").select(F.col("owner._gid").alias("customer"), A.gid("id", "child").alias("id"))


@query(f"SELECT {gid('c_custkey')} AS customer, first_order FROM customer LEFT JOIN (SELECT o_custkey, min({gid('o_orderkey')}) AS first_order FROM orders WHERE {LOCAL} GROUP BY 1) ON o_custkey = c_custkey")
def has_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    return A.has_one(c, o, "customer_id").select(F.col("owner._gid").alias("customer"), F.when(F.col("child.id").isNotNull(), A.gid("id", "child")).alias("first_order"))


SEVERAL = f"({LOCAL} OR c_custkey % 3 = 0 AND {sh('o_orderkey')} = {sh('c_custkey')} % 4 + 1)"


@query(f"SELECT {gid('c_custkey')} AS customer, {gid('o_orderkey')} AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE {SEVERAL}")
def has_many_multishard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    return A.has_many(c, o, "customer_id", shards="associated_shards").select(F.col("owner._gid").alias("customer"), A.gid("id", "child").alias("id"))


THROUGH = f"SELECT {gid('c_custkey')} AS customer, {gid('o_orderkey')} AS order_id, l_linenumber AS linenumber, l_quantity AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE "


def _through(spark: SparkSession, sf_dir: str, shards: str | None) -> DataFrame:
    c, o, li = _tables(spark, sf_dir, "customer", "orders", "lineitem")
    met = A.through(c, o, li, "customer_id", "order_id", shards=shards)
    return met.select(F.col("owner._gid").alias("customer"), A.gid("id", "child").alias("order_id"), "target.linenumber", "target.quantity")


@query(THROUGH + LOCAL)
def through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, None)


@query(THROUGH + SEVERAL)
def through_multishard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "associated_shards")


@query(f"""
WITH t AS (SELECT c_custkey AS k, CASE WHEN {sh("(c_custkey // 8)")} = {sh("c_custkey")} THEN c_custkey // 8 END AS up FROM customer)
SELECT {gid("g.k")} AS customer, {gid("a.k")} AS grandchild FROM t g JOIN t p ON p.up = g.k JOIN t a ON a.up = p.k""")
def self_join_grandchildren(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table under three names, within shards."""
    c = P.customer(spark, sf_dir).select(SHARD, "id", "parent_id")
    two = A.in_shard(c, c, "id", "parent_id").select("a." + SHARD, F.col("a.id").alias("top"), F.col("b.id").alias("middle"))
    three = A.in_shard(two, c, "middle", "parent_id")
    return three.select(ids.globalize(F.col("a.top"), F.col(f"a.{SHARD}")).alias("customer"), A.gid("id", "b").alias("grandchild"))


@query(f"""
WITH n AS (SELECT count(*) AS n FROM orders),
f AS (SELECT event_id AS k, CASE WHEN event_id % 2 = 0 THEN 'Customer' ELSE 'Order' END AS owner_type, CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id % n.n END AS owner FROM events, n)
SELECT {gid("k")} AS id, owner_type, coalesce(c_name, o_orderpriority) AS owner_value
FROM f LEFT JOIN customer ON owner_type = 'Customer' AND owner = c_custkey LEFT JOIN orders ON owner_type = 'Order' AND owner = o_orderkey""")
def polymorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    f = P.feature(spark, sf_dir, o.count())
    met = A.polymorphic(f, "owner_id", "owner_type", {"Customer": c, "Order": o}, {"Customer": "name", "Order": "priority"})
    return met.select(A.gid("id").alias("id"), "owner_type", "owner_value")


@query(f"SELECT {gid('event_id')} AS id, c_mktsegment AS mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def preload_belongs_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = _tables(spark, sf_dir, "event", "customer")
    return A.belongs_to(e, c, "user_id").select(A.gid("id", "child").alias("id"), "parent.mktsegment")


@query(f"SELECT {gid('c_custkey')} AS customer, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {LOCAL} GROUP BY 1")
def preload_has_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    return A.has_many(c, o, "customer_id", how="left").groupBy(F.col("owner._gid").alias("customer")).agg(F.count("child.id").alias("n_orders"))


@query(f"SELECT {gid('c_custkey')} AS customer, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {SEVERAL} GROUP BY 1")
def preload_multishard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    return A.has_many(c, o, "customer_id", shards="associated_shards", how="left").groupBy(F.col("owner._gid").alias("customer")).agg(F.count("child.id").alias("n_orders"))


@query(f"SELECT {gid('c_custkey')} AS customer, p_brand AS brand, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey AND {SEVERAL} JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def preload_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hop by hop: each hop follows its own rows' shards, the last one global part ids."""
    c, o, li, p = _tables(spark, sf_dir, "customer", "orders", "lineitem", "part")
    met = A.through(c, o, li, "customer_id", "order_id", shards="associated_shards")
    lines = met.select(F.col("owner._gid").alias("customer"), F.col(f"target.{SHARD}").alias(SHARD), F.col("target.part_id").alias("part_id"))
    return A.belongs_to(lines, p, "part_id", how="inner").groupBy("child.customer", "parent.brand").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey AS id, {rel('c_custkey', 1)} AS user_id, c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0")
def unsharded_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From unsharded rows to sharded ones, and from those to unsharded ones."""
    root, c, n = _tables(spark, sf_dir, "root", "customer", "nation")
    met = A.from_unsharded(root, c, "user_id", P.CATALOG.default.id, how="inner").select(F.col("child.id").alias("id"), F.col("child.user_id").alias("user_id"), "parent.name", "parent.nation_key")
    return A.to_unsharded(met, n, "nation_key").select("child.id", "child.user_id", "child.name", F.col("parent.name").alias("nation"))


@query(f"SELECT {gid('c_custkey')} AS customer, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey AND {SEVERAL} GROUP BY 1")
def assoc_sum_multishard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    met = A.has_many(c, o, "customer_id", shards="associated_shards")
    return met.groupBy(F.col("owner._gid").alias("customer")).agg(F.round(F.sum("child.totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query(f"SELECT {gid('o_orderkey')} AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000")
def where_assoc_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that belong to any row of a set."""
    o, c = _tables(spark, sf_dir, "orders", "customer")
    wanted = c.where("mktsegment = 'MACHINERY' AND acctbal > 5000").select(A.gid("id").alias("_gid"))
    return o.withColumn("_fk", A.gid("customer_id")).join(wanted, F.col("_fk") == F.col("_gid"), "left_semi").select(A.gid("id").alias("id"))


@query(f"SELECT {gid('c_custkey')} AS customer, CASE WHEN o_orderkey IS NOT NULL THEN {gid('o_orderkey')} END AS id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {SEVERAL} AND c_custkey % 5 <> 4 AND c_custkey % 7 <> 0")
def has_many_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners without children stay once, whether their shards are null, empty, or have none."""
    o, c = _tables(spark, sf_dir, "orders", "customer")
    k = F.col("id") - 1
    shards = F.when(k % 7 == 0, F.array().cast("array<int>")).when(k % 5 != 4, F.col("associated_shards"))
    met = A.has_many(c.withColumn("associated_shards", shards), o, "customer_id", shards="associated_shards", how="left")
    return met.select(F.col("owner._gid").alias("customer"), F.when(F.col("child.id").isNotNull(), A.gid("id", "child")).alias("id"))


@query(f"""
SELECT {gid("event_id")} AS id, CASE event_id % 3 WHEN 0 THEN 'Customer' WHEN 1 THEN 'Robot' END AS owner_type, c_name AS owner_value
FROM events LEFT JOIN customer ON event_id % 6 = 0 AND user_id = c_custkey""")
def polymorphic_null_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a null or an unlisted type, and rows whose owner isn't a customer, stay without an owner."""
    c = P.customer(spark, sf_dir)
    k = F.col("id") - 1
    f = P.feature(spark, sf_dir, 1).withColumn("owner_type", F.when(k % 3 == 0, "Customer").when(k % 3 == 1, "Robot"))
    f = f.withColumn("owner_id", F.when(k % 2 == 0, F.col("owner_id")))
    return A.polymorphic(f, "owner_id", "owner_type", {"Customer": c}, {"Customer": "name"}).select(A.gid("id").alias("id"), "owner_type", "owner_value")


@query(f"SELECT {gid('o_orderkey')} AS id, c_name AS name FROM orders JOIN customer ON {rel('o_custkey', sh('o_orderkey'))} = c_custkey + 1 AND {sh('c_custkey')} = 2")
def join_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join whose table is shard 2's, whatever the shard of the rows."""
    o, c = _tables(spark, sf_dir, "orders", "customer")
    return A.pinned(o, c, 2, "customer_id", "id").select(A.gid("id", "a").alias("id"), "b.name")
