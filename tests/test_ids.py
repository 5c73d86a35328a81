from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.functions import ids
from shardloom.functions.ids import IDS

SHARDS = st.integers(1, 922_336)
LOCALS = st.integers(-IDS + 1, IDS - 1)


@given(SHARDS, LOCALS)
def test_join_and_split(shard, local):
    assert ids.split(ids.join(shard, local)) == (shard, local)


@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 9), LOCALS)
def test_relative_round_trip(owner, a, b, local):
    stored = ids.relative_value(ids.join(owner, local), a, a)
    assert ids.relative_value(ids.relative_value(stored, a, b), b, a) == stored


def test_parse_value():
    assert ids.parse_value("3~12") == 3 * IDS + 12
    assert ids.parse_value("3~-12") == -3 * IDS - 12
    assert ids.parse_value("-7") == -7
    assert ids.parse_value("x\n12\ny") is None
    assert ids.parse_value(None) is None and ids.parse_value(True) is None
    assert ids.parse_value(f"1~{IDS + 1}") is None


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), LOCALS, st.integers(1, 9), st.integers(1, 9)), min_size=200, max_size=200))
def test_columns_agree_with_values(spark, rows):
    rows = [(ids.join(s, v) if s else v, src, cur) for s, v, src, cur in rows]
    df = spark.createDataFrame(rows, "x long, src long, cur long")
    found = df.select("x", "src", "cur", ids.relative_id(F.col("x"), F.col("src"), F.col("cur")).alias("r"), ids.global_id(F.col("x"), F.col("src")).alias("g"), ids.shard_for(F.col("x"), F.col("src")).alias("s")).collect()
    for r in found:
        shard, local = ids.split(r["x"])
        assert r["r"] == ids.relative_value(r["x"], r["src"], r["cur"])
        assert r["g"] == ids.join(shard or r["src"], local)
        assert r["s"] == (shard or r["src"])


def test_unknown_shards_and_nulls(spark):
    df = spark.createDataFrame([(9 * IDS + 5,), (None,), (5,)], "x long")
    r = df.select(ids.relative_id(F.col("x"), 1, 2, [1, 2]).alias("r"), ids.local_id(F.col("x"), [1, 2]).alias("l"), ids.short_id(F.col("x")).alias("s")).collect()
    assert [x["r"] for x in r] == [9 * IDS + 5, None, IDS + 5]
    assert [tuple(x["l"]) for x in r] == [(None, None), (None, None), (5, None)]
    assert [x["s"] for x in r] == ["9~5", None, "5"]
