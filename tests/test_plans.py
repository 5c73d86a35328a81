from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shardloom.catalog import Catalog, Server, ShardRow
from shardloom.context import activate
from shardloom.functions.ids import IDS
from shardloom.operators import records
from shardloom.plans.predicate import Raw
from shardloom.plans.query import OrderNotAllowed, RecordNotFound, ShardedQuery
from shardloom.queries.base import key, on
from shardloom.registry import CUSTOMER, NATION, ORDERS, SHARD
from shardloom.sources import placement as P
from shardloom.sources import store


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "orders")
    store.write(P.orders(spark, sf_dir), path)
    return store.read(spark, path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def query(frame) -> ShardedQuery:
    return ShardedQuery.of(ORDERS, frame, P.CATALOG)


def test_inferred_shards_prune_partitions(stored):
    q = query(stored).where(id=[key(0), key(2)])
    assert q.shards == (1, 3)
    text = plan(q.rows())
    filters = text[text.index("PartitionFilters") :]
    assert "IN (1,3)" in filters.split("PushedFilters")[0].replace("_shard_id#", "") or "in (1, 3)" in filters.lower()
    assert sorted(r["id"] for r in q.rows().collect()) == [1, 3]


def test_pushed_down(stored):
    text = plan(query(stored).shard(2).where(id=[key(1)]).rows().select("id"))
    assert "EqualTo(id,2)" in text or "In(id, [2])" in text
    assert "ReadSchema: struct<id:bigint>" in text


def test_inference_rules(stored):
    q = query(stored)
    assert q.where(id=key(3)).shards == (4,)
    assert q.where(id=[key(1), key(0), key(3)]).shards == (1, 2, 4)  # the current shard first
    assert q.where(id=[key(3), key(1)]).shards == (4, 2)
    assert q.compare("id", "<", key(3)).shards == (1,)
    assert q.where("id = 3").shards == (1,)
    assert q.where(id=[]).shards == (1,)
    assert q.where(id="garbage").shards == (1,)
    assert q.shard(2).where(id=key(3)).shards == (2,)
    with activate(2):
        assert query(stored).where(id=7).shards == (2,)


def test_local_literal_is_of_the_current_shard(stored):
    """Not of an explicit one."""
    assert query(stored).shard(2).where(id=2).rows().count() == 0
    assert query(stored).shard(2).where(id=key(1)).rows().count() == 1


def test_a_single_shard_may_give_a_copy(spark, sf_dir):
    c = P.shadow_customers(spark, sf_dir)
    q = ShardedQuery.of(CUSTOMER, c, P.CATALOG)
    assert [r["id"] for r in q.shard(1).find(key(10)).rows().collect()] == [key(10)]  # the copy of shard 3's row
    assert [r[SHARD] for r in q.shard(1, 3).find(key(10)).rows().collect()] == [3]


def test_merge_rules(stored):
    q = query(stored)
    assert q.shard(2).merge(q).shards == (2,)
    assert q.merge(q.shard(2, 3)).shards == (2, 3)
    assert q.shard(1, 2).merge(q.shard(2, 3)).shards == (2,)
    assert q.shard(1).merge(q.shard(2)).none
    assert q.shard(1, source="association").merge(q.shard(2)).shards == (2,)


def test_shard_arguments(stored, spark):
    q = query(stored)
    with pytest.raises(ValueError):
        q.shard(None)
    with pytest.raises(LookupError):
        q.shard(5)
    assert q.shard(2, 2, 3).shards == (2, 3)
    assert q.shard(P.CATALOG.in_region(spark, "r2")).shards == (3, 4)
    assert q.shard(P.CATALOG.frame(spark).where("id > 90")).rows().count() == 0


def test_find(stored):
    assert query(stored).one(key(5))["id"] == key(5)
    with pytest.raises(RecordNotFound):
        query(stored).one(key(10**9))


def test_strict_order(stored):
    strict = ShardedQuery.of(ORDERS, stored, P.CATALOG, strict_order=True)
    with pytest.raises(OrderNotAllowed):
        strict.shard(1, 2).order(F.length("status")).read("id")
    assert strict.shard(1).order(F.length("status")).read("id").count() > 0


def test_not_in_with_nulls(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (1, None), (2, 5), (3, 9)], f"{SHARD} int, v long")
    b = spark.createDataFrame([(1, 1), (2, None), (2, 7)], f"{SHARD} int, w long")
    qa, qb = (ShardedQuery.of(NATION.__class__("t", pk=None), f, P.CATALOG).shard(1, 2, 3) for f in (a, b))
    outside = qa.in_query("v", qb, "w", negated=True)
    assert sorted(map(tuple, outside.rows().collect())) == [(1, 2), (3, 9)]
    # the same as a part of an OR, of a NOT, and in changes
    assert sorted(map(tuple, outside.either(qa.where("v = 5")).rows().collect())) == [(1, 2), (2, 5), (3, 9)]
    assert sorted(map(tuple, (~qa.in_query("v", qb, "w")).rows().collect())) == [(1, 2), (3, 9)]
    assert sorted(map(tuple, (~outside).rows().collect())) == [(1, 1)]
    assert outside.deleted().count() == 3 and outside.touched().first()[0] == 2


def test_attributes_of_key_columns(spark, sf_dir):
    for name in ("global_totalprice", "short_id", "id_global", "_x"):
        with pytest.raises(AttributeError, match="key columns"):
            getattr(ORDERS, name)
    r = P.orders(spark, sf_dir).where("id = 6").select(ORDERS.global_id, ORDERS.local_customer_id, ORDERS.original_customer_id, "customer_id").first()
    assert r[0] == key(5) and r[1] == r[3] % IDS and r[2] == r[3]


def test_changes_with_limits(stored):
    q = query(stored).shard(1, 2)
    three = q.order("id").limit(3)
    assert three.touched().first()[0] == 3 and three.deleted().count() == stored.count() - 3
    assert three.updated(status="X").where("status = 'X'").count() == 3
    for change in (q.limit(3).deleted, lambda: q.offset(2).updated(status="X")):
        with pytest.raises(ValueError, match="order"):
            change()
    gone = {(r[SHARD], r["id"]) for r in stored.collect()} - {(r[SHARD], r["id"]) for r in three.deleted().collect()}
    assert sorted(i if s == 1 else i + s * IDS for s, i in gone) == [r["id"] for r in three.read("id").collect()]


def test_or_of_queries(stored):
    q = query(stored).all_shards()
    a, b = q.where("id < 5"), q.where("id > 9 and id < 12")
    assert a.either(b).count().first()[0] == a.count().first()[0] + b.count().first()[0]
    assert a.either(q).count().first()[0] == stored.count()
    nothing = q.shard(1).merge(q.shard(2))
    assert a.either(nothing).count().first()[0] == a.count().first()[0] and nothing.either(b).conditions == b.conditions
    with pytest.raises(ValueError, match="limit"):
        a.limit(1).either(b)


def test_merge_takes_over_offset_and_distinct(stored):
    q = query(stored)
    assert q.merge(q.order("id").offset(2).distinct()).rows_offset == 2 and q.merge(q.distinct()).unique


def test_limits_in_sub_queries_need_an_order(spark):
    a = spark.createDataFrame([(1, 1)], f"{SHARD} int, v long")
    q = ShardedQuery.of(NATION.__class__("t", pk=None), a, P.CATALOG)
    with pytest.raises(ValueError, match="order"):
        q.in_query("v", q.limit(1), "v").rows()


def test_aggregates_are_of_the_rows_as_read(stored):
    q = query(stored).all_shards()
    three = q.order("id").limit(3)
    assert three.aggregate(F.max("id")).first()[0] == three.read("id").collect()[-1][0]
    assert q.distinct().count(column="customer_id").first()[0] == q.distinct().read("customer_id").count()
    assert q.limit(5).group("customer_id").aggregate(F.count("*").alias("n")).count() == 5
    with pytest.raises(ValueError, match="distinct"):
        q.distinct().group("customer_id").aggregate(F.count("*"))


def test_find_many(stored):
    q = query(stored)
    assert [r["place"] for r in q.find_many([key(4), key(2)]).orderBy("id").collect()] == [0, 1]
    with pytest.raises(RecordNotFound, match="no id.*10001000000001"):
        q.find_many(["no id", key(4), key(10**9)])
    assert q.find_many(["no id", key(4)], strict=False).count() == 1


def test_conditions_over_many_shards(spark, stored):
    """Keys of many shards are compared once, as global ids, and the scan still gets values."""
    shards = tuple(ShardRow(i, f"s{i}") for i in range(2, 60))
    catalog = Catalog((ShardRow(1, default=True), *shards), (Server("main", default=True),))
    rows = [(s, i, (s % 59 + 1) * IDS + i + 1 if i % 2 else i) for s in range(1, 60) for i in range(1, 5)]
    frame = spark.createDataFrame(rows, f"{SHARD} int, id long, customer_id long")
    q = ShardedQuery.of(ORDERS, frame, catalog).all_shards()
    keys = [s * IDS + 2 for s in range(1, 60)]
    want = sorted((s, i, c) for s, i, c in rows if (c if c >= IDS else s * IDS + c) in set(keys))
    for here in (q, q.shard(3, 5, 9)):
        own = [r for r in want if r[0] in here.shards]
        assert sorted(map(tuple, here.where(customer_id=keys).rows().collect())) == own
        assert here.compare("customer_id", "not in", keys).rows().count() == 4 * len(here.shards) - len(own)
        assert here.where(id=keys).rows().count() == len(here.shards)
    found = plan(query(stored).all_shards().where(customer_id=[key(1)]).rows())
    assert "In(customer_id" in found or "EqualTo(customer_id" in found
    assert len(str(q.where(customer_id=keys).rows()._jdf.queryExecution().analyzed().toString())) < 20_000


def test_late_shard_and_batches(stored):
    q = query(stored)
    late = q.where("id < 100").unscoped()
    with activate(3):
        assert late.rows().count() == stored.where(F.col(SHARD) == 3).count() and late.read("id").count() > 0
        assert {r[SHARD] for r in late.rows().select(SHARD).distinct().collect()} == {3}
    small = q.where("id < 200")
    parts = [[r["id"] for r in b.order("id").read("id").collect()] for b in small.find_in_batches(20)]
    assert all(len(p) == 20 for p in parts[:-1])
    assert [i for p in parts for i in p] == [r["id"] for r in small.order("id").read("id").collect()]


def test_errors_know_the_active_shards(stored):
    with activate(3), pytest.raises(RecordNotFound) as e:
        query(stored).one(key(10**9))
    assert e.value.shards["base"] == 3


def test_raw_values_stay(spark, sf_dir):
    with activate(2):
        q = on(spark, sf_dir, "customer").shard(1).where(id=Raw(5))
    assert q.rows().count() == 1


def test_update_and_delete(stored):
    q = query(stored).shard(1, 2).where(status="P")
    n = q.touched().first()[0]
    assert q.updated(status="X").where("status = 'X'").count() == n
    assert q.deleted().count() == stored.count() - n


def test_shadow_copies(spark, sf_dir):
    c = P.customer(spark, sf_dir)
    copies = records.replicate(c, CUSTOMER, 2)
    once = records.save_shadow(c, copies, CUSTOMER)
    assert once.count() == c.count() + copies.count()
    assert records.save_shadow(once, copies, CUSTOMER).count() == once.count()  # again changes nothing
    gids = copies.select(F.col("id").alias("gid"))
    assert records.destroy_shadow(once, gids, CUSTOMER, [2]).count() == c.count()
    assert records.destroy_shadow(once, gids, CUSTOMER, [3]).count() == once.count()
    with pytest.raises(records.NotSharded):
        records.replicate(P.nation(spark, sf_dir), NATION, 2)


def test_move_and_back(spark, sf_dir):
    o = P.orders(spark, sf_dir).where(F.col(SHARD) == 2)
    there = records.move(o, ORDERS, 4)
    assert there.where((F.col("customer_id") < IDS) & (F.col("customer_id") % 4 == 0)).count() > 0
    back = records.move(there, ORDERS, 2)
    assert back.exceptAll(o).count() == 0 and o.exceptAll(back).count() == 0


def test_shard_errors_are_named(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], f"{SHARD} int, v long")

    def odd(shard, rows):
        import pandas as pd

        if shard == 2:
            raise RuntimeError("no")
        return pd.DataFrame([{"n": len(rows)}])

    found = records.map_shards(df, odd, "n long")
    with pytest.raises(records.ShardErrors, match="shard 2: RuntimeError: no"):
        records.raise_errors(found)
    assert records.raise_errors(found.where("shard <> 2")).count() == 2
    assert records.raise_errors(found, "ignore").count() == 2
    with pytest.raises(records.ShardErrors, match="shard 2"):
        records.raise_errors(found, "defer")
    told = []
    assert records.raise_errors(found, lambda s, e: told.append((s, e))).count() == 2 and told == [(2, "RuntimeError: no")]
    large = spark.range(1000).select(F.lit(1).alias(SHARD), F.lit(5).alias("v"))
    sizes = [r["n"] for r in records.map_shards(large, odd, "n long", block_rows=100).collect()]
    assert sum(sizes) == 1000 and len(sizes) > 5


def test_a_task_on_each_shard():
    seen = []

    def task(shard):
        seen.append(shard)
        if shard == 3:
            raise RuntimeError("no")

    events = records.shard_task(P.CATALOG, task, fail_fast=False)
    assert seen == [1, 2, 3, 4]
    assert [(e["shard"], e["type"]) for e in events if e["type"] != "started"] == [(1, "completed"), (2, "completed"), (3, "failed"), (4, "completed")]
    with pytest.raises(records.ShardErrors, match="shard 3"):
        records.shard_task(P.CATALOG, task)


def test_upsert_of_a_stored_table(spark, stored, tmp_path):
    path = str(tmp_path / "u")
    store.write(stored, path)
    untouched = sorted(p.name for p in (tmp_path / "u" / f"{SHARD}=3").iterdir())
    rows = spark.createDataFrame([(2, 2, "X"), (2, 10**9, "N")], f"{SHARD} int, id long, status string")
    store.upsert(spark, path, rows, [SHARD, "id"])
    now = store.read(spark, path)
    assert now.count() == stored.count() + 1 and now.where("status = 'X' and totalprice is not null").count() == 1
    assert sorted(p.name for p in (tmp_path / "u" / f"{SHARD}=3").iterdir()) == untouched
    assert records.insert(stored, rows, [SHARD, "id"]).count() == stored.count() + 1


def test_id_batches(spark):
    from shardloom.operators.batches import greedy_ranges, numbered_batches

    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 10, 11, 12, 13, 30, 31, 100)], "id long")
    got = [tuple(r) for r in numbered_batches(df, 4, block_rows=3).orderBy("batch").collect()]
    assert got == [(0, 1, 10), (1, 11, 30), (2, 31, 100)]
    for block_rows, fan in ((1, 2), (1, 3), (3, 2), (100, 2)):
        got = [tuple(r) for r in greedy_ranges(df, 5, block_rows, fan).orderBy("batch").collect()]
        assert got == [(0, 1, 6), (1, 10, 15), (2, 30, 35), (3, 100, 105)]
    rng = random.Random(1)
    ids = sorted({rng.randrange(3000) for _ in range(400)} | set(range(5000, 5200)))
    want, low = [], -1
    for x in ids:
        if x > low:
            low = x + 40
            want.append((len(want), x, low))
    many = spark.createDataFrame([(x,) for x in ids], "id long")
    for block_rows, fan in ((7, 2), (30, 4), (3, 16)):
        assert [tuple(r) for r in greedy_ranges(many, 40, block_rows, fan).orderBy("batch").collect()] == want
    names = spark.createDataFrame([(x,) for x in "cabed"], "id string")
    assert [tuple(r) for r in numbered_batches(names, 2, block_rows=2).orderBy("batch").collect()] == [(0, "a", "b"), (1, "c", "d"), (2, "e", "e")]
    none = df.where("id < 0")
    assert numbered_batches(none, 3).count() == greedy_ranges(none, 3).count() == 0


def test_store(spark, stored, tmp_path):
    path = str(tmp_path / "t")
    store.write(stored, path)
    new = stored.where(F.col(SHARD) == 1).withColumn("id", F.col("id") + 10**9)
    store.append(new, path)
    assert store.read(spark, path).count() == stored.count() + new.count()
    assert store.drop_shard(spark, path, 1)
    assert store.read(spark, path).where(F.col(SHARD) == 1).count() == 0
