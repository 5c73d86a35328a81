"""Projection, point reads, aggregates, grouping, order, limits and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.context import activate
from shardloom.operators import associations
from shardloom.queries.base import gid, key, loc, on, query, rel, sh

C1 = rel("o_custkey", 1)


def orders(spark: SparkSession, sf_dir: str):
    return on(spark, sf_dir, "orders").all_shards()


@query(f"SELECT {rel('o_orderkey', 2)} AS id FROM orders")
def pluck_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    with activate(2):
        return orders(spark, sf_dir).read("id")


@query(f"SELECT {C1} AS customer_id FROM orders WHERE {sh('o_orderkey')} IN (1, 2)")
def pluck_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").shard(1, 2).read("customer_id")


@query(f"SELECT {rel('o_orderkey', 1)} AS id, {C1} AS customer_id, o_orderstatus AS status FROM orders")
def pluck_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).read("id", "customer_id", "status")


@query(f"SELECT DISTINCT {C1} AS customer_id FROM orders")
def pluck_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).distinct().read("customer_id")


@query(f"SELECT id, row_number() OVER (ORDER BY id) AS place FROM (SELECT {rel('o_orderkey', 1)} AS id FROM orders)")
def pluck_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).order("id").placed("id")


@query(f"SELECT {rel('c_custkey', 1)} AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "customer").all_shards().where(mktsegment="BUILDING").ids()


@query(f"SELECT {rel('c_custkey', 1)} AS id, c_name AS name FROM customer WHERE c_custkey = 6")
def find_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "customer").find(key(6)).read("id", "name")


@query(f"""
WITH k(place, key) AS (VALUES (0, 9), (1, 2), (2, 4), (3, 7))
SELECT {rel('c_custkey', 1)} AS id, c_name AS name, place FROM customer JOIN k ON c_custkey = key""")
def find_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "customer").find_many([f"2~{9 + 1}", key(2), key(4), key(7)], "name")


@query(f"SELECT {rel('o_orderkey', 1)} AS id, o_totalprice AS totalprice FROM orders WHERE o_custkey = 11 AND {sh('o_orderkey')} = 1 ORDER BY o_orderkey LIMIT 1")
def find_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").where(customer_id=key(11)).order("id").limit(1).read("id", "totalprice")


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 499000")
def exists_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).where("totalprice > 499000").any()


@query(f"""
(SELECT 'first' AS which, {loc("o_orderkey")} AS id FROM orders WHERE {sh("o_orderkey")} = 1 ORDER BY o_orderkey LIMIT 1)
UNION ALL (SELECT 'last', {loc("o_orderkey")} FROM orders WHERE {sh("o_orderkey")} = 1 ORDER BY o_orderkey DESC LIMIT 1)""")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = on(spark, sf_dir, "orders")
    return q.first("id").select(F.lit("first").alias("which"), "id").unionByName(q.first("id", last=True).select(F.lit("last").alias("which"), "id"))


@query(f"SELECT {rel('c_custkey', 1)} AS id, c_name AS name, c_acctbal AS acctbal FROM customer")
def select_all_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "customer").all_shards().read("id", "name", "acctbal")


@query(f"SELECT count(*) AS n FROM orders WHERE {sh('o_orderkey')} IN (2, 3)")
def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").shard(2, 3).count()


@query("SELECT round(sum(l_quantity), 2) AS sum FROM lineitem")
def sum(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: A001
    return on(spark, sf_dir, "lineitem").all_shards().sum("quantity").select(F.round("sum", 2).alias("sum"))


@query("SELECT min(o_totalprice) AS least FROM orders")
def min(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: A001
    return orders(spark, sf_dir).aggregate(F.min("totalprice").alias("least"))


@query("SELECT max(o_totalprice) AS most FROM orders")
def max(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: A001
    return orders(spark, sf_dir).aggregate(F.max("totalprice").alias("most"))


@query(f"SELECT max(ts) AS latest, min(ts) AS earliest FROM events WHERE {sh('event_id')} IN (1, 4)")
def max_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "event").shard(1, 4).aggregate(F.max("ts").alias("latest"), F.min("ts").alias("earliest"))


@query("SELECT round(avg(o_totalprice), 6) AS average FROM orders")
def avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).aggregate(F.round(F.avg("totalprice"), 6).alias("average"))


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).count_distinct("customer_id")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders GROUP BY {sh('o_orderkey')})")
def count_distinct_per_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).count_distinct("customer_id", per_shard=True)


@query(f"SELECT {C1} AS customer_id, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).group("customer_id").aggregate(F.round(F.sum("totalprice"), 2).alias("total"))


@query(f"SELECT {C1} AS customer_id, count(*) AS n FROM orders GROUP BY 1")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).group("customer_id").aggregate(F.count("*").alias("n"))


@query(f"SELECT {C1} AS customer_id, min(o_totalprice) AS least FROM orders GROUP BY 1")
def group_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).group("customer_id").aggregate(F.min("totalprice").alias("least"))


@query(f"SELECT {C1} AS customer_id, max(o_totalprice) AS most FROM orders GROUP BY 1")
def group_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).group("customer_id").aggregate(F.max("totalprice").alias("most"))


@query(f"SELECT {C1} AS customer_id, round(avg(o_totalprice), 6) AS average FROM orders GROUP BY 1")
def group_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).group("customer_id").aggregate(F.round(F.avg("totalprice"), 6).alias("average"))


@query(f"""
SELECT {gid('c_custkey')} AS customer, c_name AS name, n, total FROM customer
JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def group_by_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped by the customer's global id first; a group's record is looked up once."""
    o, c = orders(spark, sf_dir).rows(), on(spark, sf_dir, "customer").all_shards().rows()
    groups = o.groupBy(associations.gid("customer_id").alias("customer")).agg(F.count("*").alias("n"), F.round(F.sum("totalprice"), 2).alias("total"))
    own = c.where(associations.canonical()).select(associations.gid("id").alias("customer"), "name")
    return groups.join(own, "customer").select("customer", "name", "n", "total")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def group_expr_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).group(F.trunc("orderdate", "month").alias("month"), "status").aggregate(F.count("*").alias("n"))


@query(f"SELECT c_mktsegment AS mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey AND {sh('o_orderkey')} = {sh('c_custkey')} GROUP BY 1")
def group_joined_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of a table joined within the shards."""
    met = associations.in_shard(orders(spark, sf_dir).rows(), on(spark, sf_dir, "customer").all_shards().rows(), "customer_id", "id")
    return met.groupBy(F.col("b.mktsegment").alias("mktsegment")).agg(F.count("*").alias("n"), F.round(F.sum("a.totalprice"), 2).alias("total"))


@query(f"SELECT {C1} AS customer_id, o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def group_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).group("customer_id", "status", "priority").aggregate(F.count("*").alias("n"))


@query(f"SELECT {C1} AS customer_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
def group_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).group("customer_id").aggregate(F.count("*").alias("n"), having=F.col("n") > 10)


@query(f"SELECT {C1} AS customer_id, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = orders(spark, sf_dir).group("customer_id").aggregate(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "customer_id").limit(10)


RANKED = "SELECT id, name, row_number() OVER (ORDER BY {0}) AS place FROM (SELECT {1} AS id, c_name AS name, c_acctbal AS acctbal, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg FROM customer)"


@query(RANKED.format("name, id", rel("c_custkey", 1)))
def order_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "customer").all_shards().order("name", "id").placed("id", "name")


@query(RANKED.format("acctbal DESC NULLS LAST, id", rel("c_custkey", 1)))
def order_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = on(spark, sf_dir, "customer").all_shards().order("acctbal", descending=True).order("id")
    return q.placed("id", "name", "acctbal").drop("acctbal")


@query(RANKED.format("seg DESC NULLS LAST, id", rel("c_custkey", 1)))
def order_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls come last in descending order too."""
    q = on(spark, sf_dir, "customer").all_shards().order("mktsegment_or_null", descending=True).order("id")
    return q.placed("id", "name", "mktsegment_or_null").drop("mktsegment_or_null")


@query(f"SELECT {rel('o_orderkey', 1)} AS id FROM orders WHERE {sh('o_orderkey')} IN (3, 4) ORDER BY {sh('o_orderkey')}, o_orderkey LIMIT 25")
def limit_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in visiting order, then ids: the first 25 rows."""
    return on(spark, sf_dir, "orders").shard(3, 4).order("id").limit(25).read("id")


@query(f"SELECT {rel('o_orderkey', 1)} AS id, o_totalprice AS totalprice FROM orders WHERE {sh('o_orderkey')} IN (2, 3) ORDER BY o_totalprice DESC, 1 LIMIT 10 OFFSET 5")
def topk_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").shard(2, 3).order("totalprice", descending=True).order("id").offset(5).limit(10).read("id", "totalprice")


@query("SELECT least(count(*), 1000) AS n FROM orders")
def limit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).limit(1000).count()


@query(f"""
SELECT (rn - 1) // 100 AS batch, min(id) AS first_id, max(id) AS last_id
FROM (SELECT {loc('o_orderkey')} AS id, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE {sh('o_orderkey')} = 1) GROUP BY 1""")
def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").id_ranges(100)


@query(f"""
WITH RECURSIVE ids AS (SELECT {loc('o_orderkey')} AS id FROM orders WHERE {sh('o_orderkey')} = 1),
r(batch, first_id) AS (
  SELECT CAST(0 AS BIGINT), min(id) FROM ids
  UNION ALL SELECT batch + 1, (SELECT min(id) FROM ids WHERE id > r.first_id + 1000) FROM r WHERE (SELECT min(id) FROM ids WHERE id > r.first_id + 1000) IS NOT NULL)
SELECT batch, first_id, first_id + 1000 AS last_id FROM r WHERE first_id IS NOT NULL""")
def id_ranges_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").id_ranges_loose(1000)


@query(f"SELECT round(sum(o_totalprice), 2) AS total, max(id) AS last FROM (SELECT o_totalprice, {rel('o_orderkey', 1)} AS id FROM orders ORDER BY id DESC LIMIT 300 OFFSET 11)")
def limit_ordered_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates over rows that are ordered and limited as they are read."""
    q = orders(spark, sf_dir).order("id", descending=True).offset(11).limit(300)
    return q.aggregate(F.round(F.sum("totalprice"), 2).alias("total"), F.max("id").alias("last"))


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).distinct().count(column="customer_id")


@query("SELECT 'sum' AS what, CAST(sum(DISTINCT l_quantity) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'average', round(avg(DISTINCT l_quantity), 6) FROM lineitem")
def distinct_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = on(spark, sf_dir, "lineitem").all_shards().distinct()
    total = q.sum("quantity").select(F.lit("sum").alias("what"), F.col("sum").cast("double").alias("value"))
    return total.unionByName(q.average("quantity").select(F.lit("average").alias("what"), F.round("average", 6).alias("value")))


@query(f"SELECT {C1} AS customer_id, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12 OFFSET 3")
def group_query_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query's own order and limit are those of its groups."""
    q = orders(spark, sf_dir).order("n", descending=True).order("customer_id").offset(3).limit(12)
    return q.group("customer_id").aggregate(F.count("*").alias("n"))


@query("SELECT place FROM (VALUES (0, 9), (1, -7), (2, 900000001), (3, 4)) k(place, key) WHERE key NOT IN (SELECT c_custkey FROM customer)")
def find_many_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of keys without a record, text that is no id among them."""
    return on(spark, sf_dir, "customer").missing([key(9), "no id", key(900_000_001), key(4)])
