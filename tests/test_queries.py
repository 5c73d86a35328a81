import pytest
from compare import same

from shardloom.queries import ORACLES, QUERIES

EMPTY = {"where_garbage", "merge_none"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    rows = same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])
    assert rows or name in EMPTY or sf_dir.endswith("sf0.001")
