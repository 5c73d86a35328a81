"""Scans, shard selection, and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.context import activate
from shardloom.operators import associations
from shardloom.plans.predicate import Raw
from shardloom.queries.base import gid, key, loc, on, query, rel, sh
from shardloom.registry import SHARD
from shardloom.sources import placement

ORDER = "SELECT {id} AS id, {customer} AS customer_id, o_totalprice AS totalprice FROM orders WHERE {where}"
COLUMNS = ("id", "customer_id", "totalprice")


def _orders(where: str, cur: int | str = 1) -> str:
    return ORDER.format(id=rel("o_orderkey", cur), customer=rel("o_custkey", cur), where=where)


@query(f"SELECT {loc('c_custkey')} AS id, c_name AS name FROM customer WHERE {sh('c_custkey')} = 2")
def scan_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "customer").shard(2).rows().select("id", "name")


@query(_orders(f"{sh('o_orderkey')} = 2", 2))
def implicit_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    with activate(2):
        q = on(spark, sf_dir, "orders")
    return q.read(*COLUMNS)


@query(_orders(f"{sh('o_orderkey')} = 3"))
def explicit_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").shard(3).read(*COLUMNS)


@query(_orders(f"{sh('o_orderkey')} IN (2, 4)"))
def multi_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").shard(2, 4).read(*COLUMNS)


@query(_orders(f"{sh('o_orderkey')} IN (3, 4) AND o_custkey = 6"))
def shards_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customer 6 on all shards that the customer has data on."""
    own = on(spark, sf_dir, "customer").find(key(6)).rows()
    shards = own.select(F.explode("associated_shards").alias("id"))
    return on(spark, sf_dir, "orders").shard(shards).where(customer_id=key(6)).read(*COLUMNS)


@query(_orders("o_orderkey = 5"))
def pk_infer_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").where(id=key(5)).read(*COLUMNS)


@query(_orders("o_orderkey IN (0, 1, 2, 4, 9, 100)"))
def pk_infer_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").where(id=[key(k) for k in (1, 0, 2, 4, 9, 100)]).read(*COLUMNS)


@query(_orders(f"{sh('o_orderkey')} = 1 AND o_orderkey <> 4"))
def pk_not_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").compare("id", "<>", key(4)).read(*COLUMNS)


@query(_orders(f"{sh('o_orderkey')} IN (1, 2, 3) AND o_custkey = 7"))
def where_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").shard(1, 2, 3).where(customer_id=key(7)).read(*COLUMNS)


@query(f"""
SELECT {loc('l_orderkey')} AS order_id, l_linenumber AS linenumber, l_quantity AS quantity
FROM lineitem WHERE {sh('l_orderkey')} IN (1, 2) AND l_partkey = 10""")
def where_fk_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local part id is of the catalog vertical's current shard."""
    with activate(1, catalog=3):
        q = on(spark, sf_dir, "lineitem").shard(1, 2).where(part_id=11)
    return q.rows().select("order_id", "linenumber", "quantity")


@query(_orders(f"{sh('o_orderkey')} IN (1, 2, 3, 4) AND o_custkey IN (1, 2, 3, 10, 20)"))
def fk_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").all_shards().where(customer_id=[key(k) for k in (1, 2, 3, 10, 20)]).read(*COLUMNS)


@query(_orders(f"{sh('o_orderkey')} = 2 AND {rel('o_custkey', 2)} BETWEEN 2 AND 90", 2))
def fk_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    with activate(2):
        q = on(spark, sf_dir, "orders").compare("customer_id", "between", (2, 90))
    return q.read(*COLUMNS)


@query(_orders("1 = 0"))
def where_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").where(customer_id=["garbage"]).read(*COLUMNS)


@query(_orders(f"{sh('o_orderkey')} IN (1, 2) AND o_totalprice > 400000 AND o_orderstatus = 'F'"))
def where_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").shard(1, 2).where("totalprice > 400000 AND status = 'F'").read(*COLUMNS)


@query(_orders(f"{sh('o_orderkey')} IN (1, 3) AND (o_custkey = 3 OR o_orderkey IN (2, 8))"))
def or_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    with activate(2):
        a = on(spark, sf_dir, "orders").where(customer_id=key(3))
    b = on(spark, sf_dir, "orders").where(id=[key(2), key(8)])
    return on(spark, sf_dir, "orders").shard(1, 3).where(a.conditions[0] | b.conditions[0]).read(*COLUMNS)


_SEMI = f"SELECT {rel('c_custkey', 1)} AS id, c_name AS name FROM customer c WHERE {{0}} (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND {sh('o.o_orderkey')} = {sh('c.c_custkey')} AND o.o_totalprice > 450000)"


@query(f"SELECT {rel('c_custkey', 1)} AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {sh('o_orderkey')} = {sh('o_custkey')} AND o_totalprice > 450000)")
def in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = on(spark, sf_dir, "orders").where("totalprice > 450000")
    return on(spark, sf_dir, "customer").all_shards().in_query("id", inner, "customer_id").read("id", "name")


@query(_SEMI.format("EXISTS"))
def exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = on(spark, sf_dir, "orders").where("totalprice > 450000")
    return on(spark, sf_dir, "customer").all_shards().exists(inner, ("id", "customer_id")).read("id", "name")


@query(_SEMI.format("NOT EXISTS"))
def not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = on(spark, sf_dir, "orders").where("totalprice > 450000")
    return on(spark, sf_dir, "customer").all_shards().exists(inner, ("id", "customer_id"), negated=True).read("id", "name")


@query(_orders(f"{sh('o_orderkey')} IN (2, 3) AND o_orderstatus = 'O' AND o_totalprice < 50000"))
def merge_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = on(spark, sf_dir, "orders").shard(1, 2, 3).where(status="O")
    return a.merge(on(spark, sf_dir, "orders").shard(3, 2, 4).where("totalprice < 50000")).read(*COLUMNS)


@query(_orders("1 = 0"))
def merge_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").shard(1).merge(on(spark, sf_dir, "orders").shard(2)).read(*COLUMNS)


@query(f"SELECT s.id, s.totalprice FROM (SELECT {loc('o_orderkey')} AS id, o_totalprice AS totalprice FROM orders WHERE {sh('o_orderkey')} = 1 AND o_totalprice > 300000) s WHERE s.id < 5000")
def from_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = on(spark, sf_dir, "orders").where("totalprice > 300000").read("id", "totalprice")
    return inner.alias("s").where("s.id < 5000").select("s.id", "s.totalprice")


@query(f"""
WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000)
SELECT {rel('a.o_custkey', 1)} AS customer_id, count(*) AS n, count(DISTINCT b.o_totalprice) AS prices
FROM big a JOIN big b ON a.o_custkey = b.o_custkey GROUP BY 1""")
def cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One common table read under two names."""
    big = on(spark, sf_dir, "orders").all_shards().where("totalprice > 300000").read("customer_id", "totalprice")
    return spark.sql(
        "WITH big AS (SELECT * FROM {rows}) SELECT a.customer_id, count(*) AS n, count(DISTINCT b.totalprice) AS prices FROM big a JOIN big b ON a.customer_id = b.customer_id GROUP BY a.customer_id",
        rows=big,
    )


@query(f"SELECT {rel('c_custkey', 1)} AS id, c_name AS name FROM customer WHERE c_custkey % 7 = 0 AND {sh('c_custkey')} IN (1, 2)")
def scope_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "customer").shard(1, 2).where(mktsegment_or_null=None).read("id", "name")


@query(f"""
SELECT {rel('event_id', 1)} AS id, value FROM events WHERE {sh('event_id')} IN (1, 2, 3) AND event_id % 2 = 0 AND user_id = 5""")
def poly_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    q = on(spark, sf_dir, "feature", placement.feature(spark, sf_dir, n)).shard(1, 2, 3)
    return q.where_poly("owner_id", "Customer", key(5)).read("id", "value")


@query(f"SELECT {loc('c_custkey')} AS id, c_name AS name FROM customer WHERE {sh('c_custkey')} = 1 AND {loc('c_custkey')} IN (1, 5, 9)")
def where_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals that are compared as they are, whatever the current shard."""
    with activate(3):
        q = on(spark, sf_dir, "customer").shard(1).where(id=[Raw(1), Raw(5), Raw(9)])
    return q.rows().select("id", "name")


@query(f"SELECT lang, count(*) AS n FROM documents WHERE {sh('doc_id')} IN (1, 2) AND CAST(doc_id AS VARCHAR) IN ('4', '5', '8', '9', '10000000000001') GROUP BY lang")
def where_string_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that aren't integers are never translated."""
    q = on(spark, sf_dir, "document").shard(1, 2).where(id=["4", "5", "8", "9", "10000000000001"])
    return q.group("lang").aggregate(F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey IN (1, 3)")
def where_unsharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    with activate(3):
        q = on(spark, sf_dir, "nation").where(region_key=[1, 3])
    return q.read("id", "name")


SHADOW = f"""
WITH rows AS (
  SELECT c_custkey AS k, {sh("c_custkey")} AS s, {loc("c_custkey")} AS id FROM customer
  UNION ALL SELECT c_custkey, 1, {gid("c_custkey")} FROM customer WHERE c_custkey % 10 = 0 AND {sh("c_custkey")} <> 1)
SELECT k, CAST(s AS INTEGER) AS shard, id FROM rows WHERE """


def _shadows(spark: SparkSession, sf_dir: str):
    return placement.shadow_customers(spark, sf_dir).withColumn("k", F.substring("name", 10, 9).cast("long"))


@query(SHADOW + "id < 10000000000000")
def non_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shadows(spark, sf_dir).where(associations.canonical()).select("k", F.col(SHARD).alias("shard"), "id")


@query(SHADOW + "id >= 10000000000000")
def shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shadows(spark, sf_dir).where(associations.shadow()).select("k", F.col(SHARD).alias("shard"), "id")


_LOCAL_ORDER = f"{sh('o.o_orderkey')} = {sh('c.c_custkey')}"


@query(f"""
SELECT {rel('c_custkey', 1)} AS id, c_name AS name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND {_LOCAL_ORDER} AND o.o_totalprice > 450000) AND c_acctbal > 0
  OR NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND {_LOCAL_ORDER})""")
def either_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-queries on both sides of an OR."""
    c, o = on(spark, sf_dir, "customer").all_shards(), on(spark, sf_dir, "orders")
    a = c.exists(o.where("totalprice > 450000"), ("id", "customer_id")).where("acctbal > 0")
    return a.either(c.exists(o, ("id", "customer_id"), negated=True)).read("id", "name")


@query(f"""
SELECT {rel('c_custkey', 1)} AS id, c_name AS name FROM customer WHERE c_custkey IN (
  SELECT o_custkey FROM (
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY {sh('o_orderkey')} ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
  WHERE n BETWEEN 3 AND 60 AND {sh('o_orderkey')} = {sh('o_custkey')})""")
def in_query_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the 3rd to the 60th dearest order of each shard."""
    inner = on(spark, sf_dir, "orders").order("totalprice", descending=True).order("id").offset(2).limit(58)
    return on(spark, sf_dir, "customer").all_shards().in_query("id", inner, "customer_id").read("id", "name")


@query(f"""
SELECT {rel('c_custkey', 1)} AS id, c_name AS name FROM customer WHERE c_custkey IN (
  SELECT o_custkey FROM orders WHERE {sh('o_orderkey')} = {sh('o_custkey')} GROUP BY o_custkey HAVING sum(o_totalprice) > 600000)""")
def in_query_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = on(spark, sf_dir, "orders").group("customer_id").having(F.sum("totalprice") > 600000)
    return on(spark, sf_dir, "customer").all_shards().in_query("id", inner, "customer_id").read("id", "name")


@query(_orders(f"{sh('o_orderkey')} IN (1, 2, 3) AND NOT (o_custkey IN (1, 2, 3, 10, 20) AND o_totalprice > 100000)"))
def where_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = on(spark, sf_dir, "orders").shard(1, 2, 3)
    return (~q.where(customer_id=[key(k) for k in (1, 2, 3, 10, 20)]).where("totalprice > 100000")).read(*COLUMNS)


@query(_orders(f"{sh('o_orderkey')} = 3", 3))
def unscoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard is the one that is current when the rows are read."""
    q = on(spark, sf_dir, "orders").where(status="O").unscoped()
    with activate(3):
        return q.read(*COLUMNS)
