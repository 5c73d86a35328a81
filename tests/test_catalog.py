import pytest

from shardloom import context
from shardloom.catalog import Catalog, Server, ShardRow
from shardloom.context import NoSuchShard, activate, current
from shardloom.sources.placement import CATALOG


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_lookup():
    assert CATALOG.lookup(None).id == CATALOG.lookup("default").id == 1
    assert CATALOG.lookup("self", current=2).id == 2
    assert CATALOG.lookup("4").id == 4
    assert CATALOG.lookup(5) is None and CATALOG.lookup(77) is None  # no server, no shard
    for bad in (0, "x", "0"):
        with pytest.raises(ValueError):
            CATALOG.lookup(bad)


def test_one_default():
    with pytest.raises(ValueError):
        Catalog((ShardRow(1), ShardRow(2)), (Server("a", default=True),))
    with pytest.raises(ValueError):
        Catalog((ShardRow(1, default=True), ShardRow(2)), (Server("a", default=True),))


def test_add_and_drop():
    more = CATALOG.add(ShardRow(9, "nine"))
    assert more.lookup(9).name == "nine" and more.drop(9) == CATALOG
    with pytest.raises(ValueError):
        CATALOG.drop(1)
    with pytest.raises(ValueError):
        CATALOG.add(ShardRow(2, "again"))
    assert CATALOG.server_for_new_shard().id == "cluster2"


def test_order_and_live():
    assert [s.id for s in CATALOG.ranked()] == [1, 2, 3, 4, 5]
    assert CATALOG.live() == [1, 2, 3, 4]


def test_regions(spark):
    assert ids(CATALOG.in_region(spark, "r2")) == [3, 4]
    assert ids(CATALOG.on_servers(spark, None, "-r2")) == [1, 2]
    assert ids(CATALOG.on_servers(spark, None, "self")) == [1, 2]


@pytest.mark.parametrize("bad", ["x", "..", "0/3", "4/3", "1-3", ""])
def test_bad_sets(spark, bad):
    with pytest.raises(ValueError):
        CATALOG.shard_set(spark, bad)


def test_activation_is_a_stack():
    assert current() == 1
    with activate(2, catalog=3):
        assert current() == 2 and current("catalog") == 3
        with activate(4):
            assert current() == 4 and current("catalog") == 3
        assert current() == 2
    assert current() == 1 and context.active() == {}


def test_errors_remember_shards():
    with activate(3), pytest.raises(NoSuchShard) as e:
        CATALOG.require(88)
    assert e.value.shards == {"base": 3}
