"""Queries on the catalog, and on ids and rows by shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators import records
from shardloom.queries.base import query, rel, sh
from shardloom.sources.placement import CATALOG, customer, orders

ROWS = """
WITH s(id, name, server, region, configured) AS (VALUES
  (1, NULL, NULL, 'r1', true), (2, 'shard_2', NULL, 'r1', true), (3, NULL, 'cluster2', 'r2', true), (4, 'shard_4', 'cluster2', 'r2', true), (5, 'shard_5', 'ghost', NULL, false)),
r AS (SELECT *, row_number() OVER (ORDER BY server IS NOT NULL, server NULLS FIRST, id) AS rank, row_number() OVER (ORDER BY id) AS place FROM s)
"""


def _ids(where: str) -> str:
    return f"{ROWS} SELECT CAST(id AS INTEGER) AS id FROM r WHERE {where}"


@query(f"""
WITH t(asked, id) AS (VALUES ('default', 1), ('self', 3), ('2', 2), ('4', 4), ('5', NULL), ('9', NULL)) SELECT asked, CAST(id AS INTEGER) AS id FROM t""")
def shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["default", "self", "2", "4", "5", "9"]
    found = [(a, s.id if (s := CATALOG.lookup(a, current=3)) else None) for a in asked]
    return spark.createDataFrame(found, "asked string, id int")


@query(ROWS + "SELECT CAST(id AS INTEGER) AS id, CAST(rank AS INTEGER) AS rank FROM r")
def shards_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG.frame(spark).select("id", "rank")


@query(_ids("name IS NULL"))
def shards_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG.primary(spark).select("id")


@query(_ids("region = 'r2' AND configured"))
def shards_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG.in_region(spark, "r2").select("id")


@query(_ids("region = 'r1' AND configured"))
def shards_in_current_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG.in_current_region(spark).select("id")


@query(_ids("server IS NULL"))
def server_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG.server_shards(spark, "main").select("id")


@query(f"""{ROWS}
SELECT 'cluster2' AS terms, CAST(id AS INTEGER) AS id FROM r WHERE server = 'cluster2'
UNION ALL SELECT '-cluster2', CAST(id AS INTEGER) FROM r WHERE server IS NULL
UNION ALL SELECT 'open', CAST(id AS INTEGER) FROM r WHERE server = 'cluster2'
UNION ALL SELECT 'main,cluster2', CAST(id AS INTEGER) FROM r WHERE server IS NULL OR server = 'cluster2'""")
def shardset_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for terms in ("cluster2", "-cluster2", "open", "main,cluster2"):
        one = CATALOG.on_servers(spark, terms).select(F.lit(terms).alias("terms"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def _sets(spark: SparkSession, *terms: str) -> DataFrame:
    out = None
    for t in terms:
        one = CATALOG.shard_set(spark, t).select(F.lit(t).alias("terms"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def _union(cases: dict[str, str]) -> str:
    return ROWS + " UNION ALL ".join(f"SELECT '{t}' AS terms, CAST(id AS INTEGER) AS id FROM r WHERE {w}" for t, w in cases.items())


@query(_union({"default": "id = 1", "-default": "id <> 1", "default,-default": "1 = 0", "2,4": "id IN (2, 4)", "-2": "id <> 2", "primary": "id IN (1, 3, 5) AND name IS NULL", "1,3,-3": "id = 1"}))
def shardset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, "default", "-default", "default,-default", "2,4", "-2", "primary", "1,3,-3")


@query(_union({"1..3": "id BETWEEN 1 AND 3", "1...3": "id IN (1, 2)", "..2": "id <= 2", "3..": "id >= 3", "1..4,-2": "id IN (1, 3, 4)", "-2..3": "id IN (1, 4, 5)", "1,3..4,-1": "id IN (3, 4)"}))
def shardset_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, "1..3", "1...3", "..2", "3..", "1..4,-2", "-2..3", "1,3..4,-1")


@query(_union({"1/3": "place <= 2", "2/3": "place IN (3, 4)", "3/3": "place = 5", "4/7": "place = 4", "7/7": "1 = 0", "1/1": "1 = 1", "-1/2": "place > 3"}))
def shardset_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, "1/3", "2/3", "3/3", "4/7", "7/7", "1/1", "-1/2")


@query(f"""
WITH t AS (SELECT CAST({rel('o_custkey', 1)} AS VARCHAR) AS value, CAST({sh('o_custkey')} AS INTEGER) AS shard, o_custkey + 1 AS local_id FROM orders
  UNION ALL SELECT * FROM (VALUES ('9~5', 1, 90000000000005), ('3~-7', 3, -7), ('nothing', 1, NULL), ('-4', 1, -4)))
SELECT value, shard, local_id, count(*) AS n FROM t GROUP BY ALL""")
def partition_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shardloom.functions.ids import relative_id

    o = orders(spark, sf_dir).select(relative_id(F.col("customer_id"), F.col("_shard_id"), 1).cast("string").alias("value"))
    odd = spark.createDataFrame([("9~5",), ("3~-7",), ("nothing",), ("-4",)], "value string")
    dealt = records.partition_by_shard(o.unionByName(odd), "value", 1, CATALOG.live())
    return dealt.groupBy("value", "shard", "local_id").agg(F.count("*").alias("n"))


@query(f"SELECT CAST({sh('c_custkey')} AS INTEGER) AS shard, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def each_shard_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of a block of a shard's rows; the parts are added up."""

    def summary(shard: int, rows):
        import pandas as pd

        return pd.DataFrame([{"n": len(rows), "total": float(rows["acctbal"].sum())}])

    found = records.map_shards(customer(spark, sf_dir).select("_shard_id", "id", "acctbal"), summary, "n long, total double")
    return found.where("error is null").groupBy("shard").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))
