"""Id functions and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions import ids
from shardloom.queries.base import gid, loc, on, query, rel, sh
from shardloom.registry import SHARD
from shardloom.sources.placement import CATALOG

TEXTS = ["12", "-12", "3~12", "3~-12", "7~12", "10000000000012", "-20000000000012", "not an id", "1~10000000000001", "1~10000000000000", "", "~", "3~", "0", "x\n12\ny", "+5", "99999999999999999999"]
NUMBERS = [1, -1, 0, 20_000_000_000_001, -20_000_000_000_001, 30_000_000_000_007, 70_000_000_000_006, -70_000_000_000_006, 40_000_000_000_000]
_TEXTS = ", ".join("('" + t.replace("\n", "' || chr(10) || '") + "')" for t in TEXTS)
_KEYS = f"SELECT {gid('o_orderkey')} AS x FROM orders UNION ALL SELECT -{gid('o_orderkey')} FROM orders UNION ALL SELECT {loc('o_orderkey')} FROM orders"
_NUMBERS = ", ".join(f"({n})" for n in NUMBERS)
_NUMBERS = f"SELECT * FROM (VALUES {_NUMBERS}) UNION ALL {_KEYS}"
KNOWN = [s.id for s in CATALOG.shards]
_OWNER = "abs(x) // 10000000000000"
_LOCAL = "(CASE WHEN x < 0 THEN -1 ELSE 1 END) * (abs(x) % 10000000000000)"


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some odd numbers, and the orders' ids: global, negative and local."""
    o = on(spark, sf_dir, "orders").frame
    own = ids.global_id(F.col("id"), F.col(SHARD))
    return spark.createDataFrame([(n,) for n in NUMBERS], "x long").unionByName(o.select(F.explode(F.array(own, -own, F.col("id"))).alias("x")))


@query(f"""
WITH t(text) AS (SELECT * FROM (VALUES {_TEXTS}) UNION ALL SELECT {sh('o_orderkey')} || '~' || {loc('o_orderkey')} FROM orders UNION ALL SELECT CAST(-{gid('o_orderkey')} AS VARCHAR) FROM orders), p AS (SELECT text, regexp_extract(text, '^([0-9]+)~(-?)([0-9]+)$', ['s', 'g', 'l']) AS m FROM t)
SELECT text, CASE
  WHEN m.s <> '' AND TRY_CAST(m.l AS BIGINT) <= 10000000000000 THEN (CASE WHEN m.g = '-' THEN -1 ELSE 1 END) * (TRY_CAST(m.l AS BIGINT) + TRY_CAST(m.s AS BIGINT) * 10000000000000)
  WHEN regexp_full_match(text, '-?[0-9]+') THEN TRY_CAST(text AS BIGINT) END AS id
FROM p""")
def id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some odd texts, and the orders' ids in their short form and as negative numbers."""
    own = ids.global_id(F.col("id"), F.col(SHARD))
    texts = on(spark, sf_dir, "orders").frame.select(F.explode(F.array(ids.short_id(own), (-own).cast("string"))).alias("text"))
    return spark.createDataFrame([(t,) for t in TEXTS], "text string").unionByName(texts).select("text", ids.parse(F.col("text")).alias("id"))


@query(f"""
WITH t(x) AS ({_NUMBERS})
SELECT x, CAST(CASE WHEN {_OWNER} IN (0, 1, 2, 3, 4, 5) THEN {_LOCAL} END AS BIGINT) AS local, CAST(CASE WHEN {_OWNER} BETWEEN 1 AND 5 THEN {_OWNER} END AS BIGINT) AS shard FROM t""")
def id_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ids.local_id(F.col("x"), KNOWN)
    return numbers(spark, sf_dir).select("x", found["local"].alias("local"), found["shard"].alias("shard"))


@query(f"""
SELECT o_orderkey, {rel("o_custkey", sh("o_orderkey"))} AS stored, {rel("o_custkey", 1)} AS on_1, {rel("o_custkey", 2)} AS on_2 FROM orders""")
def id_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = on(spark, sf_dir, "orders").frame
    there = [ids.relative_id(F.col("customer_id"), F.col(SHARD), c, KNOWN).alias(f"on_{c}") for c in (1, 2)]
    return df.select((F.col("id") - 1).alias("o_orderkey"), F.col("customer_id").alias("stored"), *there)


@query(f"""
WITH t(x) AS ({_NUMBERS})
SELECT x, CASE WHEN {_OWNER} > 0 THEN ({_OWNER}) || '~' || ({_LOCAL}) ELSE CAST(x AS VARCHAR) END AS short FROM t""")
def id_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(spark, sf_dir).select("x", ids.short_id(F.col("x")).alias("short"))


@query(f"SELECT o_orderkey, {gid('o_custkey')} AS customer, {gid('o_orderkey')} AS own FROM orders")
def id_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = on(spark, sf_dir, "orders").frame
    return df.select((F.col("id") - 1).alias("o_orderkey"), ids.global_id(F.col("customer_id"), F.col(SHARD)).alias("customer"), ids.globalize(F.col("id"), F.col(SHARD)).alias("own"))


@query(f"SELECT o_orderkey, CAST({sh('o_custkey')} AS BIGINT) AS shard FROM orders")
def id_shard_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = on(spark, sf_dir, "orders").frame
    return df.select((F.col("id") - 1).alias("o_orderkey"), ids.shard_for(F.col("customer_id"), F.col(SHARD), KNOWN).cast("long").alias("shard"))


@query(f"""
SELECT CASE WHEN {sh("c_custkey")} = 1 THEN CAST({loc("c_custkey")} AS VARCHAR) ELSE {sh("c_custkey")} || '~' || {loc("c_custkey")} END AS param FROM customer""")
def to_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "customer").all_shards().ids().select(ids.short_id(F.col("id")).alias("param"))


@query(f"SELECT {rel('o_orderkey', 1)} AS id, {rel('o_custkey', 1)} AS customer_id FROM orders")
def attr_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, sf_dir, "orders").all_shards().read("id", "customer_id", by_model=False)


@query(f"SELECT o_orderkey, {rel('o_custkey', sh('o_orderkey'))} AS customer_id FROM orders")
def attr_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as shard 3 reads them, assigned to rows of their own shards."""
    df = on(spark, sf_dir, "orders").frame
    seen = df.withColumn("customer_id", ids.relative_id(F.col("customer_id"), F.col(SHARD), 3))
    return seen.select((F.col("id") - 1).alias("o_orderkey"), ids.relative_id(F.col("customer_id"), 3, F.col(SHARD)).alias("customer_id"))


@query(f"SELECT {gid('o_orderkey')} AS global_id, {gid('o_custkey')} AS global_customer_id FROM orders")
def attr_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = on(spark, sf_dir, "orders").frame
    return df.select(*[ids.global_id(F.col(c), F.col(SHARD)).alias(f"global_{c}") for c in ("id", "customer_id")])


@query(f"SELECT {gid('o_orderkey')} AS global_id, {loc('o_custkey')} AS local_customer_id FROM orders")
def attr_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = on(spark, sf_dir, "orders").frame
    return df.select(ids.global_id(F.col("id"), F.col(SHARD)).alias("global_id"), ids.local_part(F.col("customer_id")).alias("local_customer_id"))


@query(f"SELECT {gid('o_orderkey')} AS global_id, {rel('o_custkey', sh('o_orderkey'))} AS original_customer_id FROM orders")
def attr_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = on(spark, sf_dir, "orders").frame
    return df.select(ids.global_id(F.col("id"), F.col(SHARD)).alias("global_id"), F.col("customer_id").alias("original_customer_id"))
