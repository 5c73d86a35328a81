"""Sharding by a hierarchical weighted hash tree (native expressions only).

A tree has regions, regions have racks, racks have shards, and every shard has a weight. A region has a fixed number of places:
``REGION_RACKS`` racks of ``RACK_SHARDS`` shards of weight 1. The descent of a key:

1. Each region throws darts at its places, as a Poisson process whose rate is the number of places; the region with the earliest
   dart that sticks is taken. One hash gives a dart its time, and
2. its rack, and
3. in the rack its shard. The dart sticks if a shard is there, with the probability of the shard's weight.

A dart that meets an empty place is thrown again. After DARTS of them the shards of the region draw each for itself what time is left,
which by the lack of memory of such processes is the same law. What a shard weighs beyond 1, and shards without a place, are draws of
their own. So a shard gets keys in proportion to its weight. A dart depends on the key and on its own region alone, and one that sticks
in a place is the same whatever other places hold. So a changed weight moves keys only into or out of the shard that has it, in whatever region or rack, and a
new shard takes keys only into itself, if the others keep their places: a shard that leaves stays in its rack with weight 0.

Cost: one hash a region and row while the regions are full, instead of one a shard; no shuffle. Slots: the narrow rows are written once and
shuffled once, texts never.

Defined cases: a null key is the empty key and has one shard; null texts have size 8 and CRC 0;
rows that are equal in everything get neighbouring slots; an empty table gives no rows. Other columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shardloom.llm.common import stored

Tree = dict[str, dict[str, dict[int, float]]]

SHARDS = 24
RACK_SHARDS = 4
REGION_RACKS = 2
DARTS = 2
SLOT_BLOCKS = 4096
"""Blocks of a shard that are numbered apart from each other; a shard's rows are never in one task."""


def uniform_tree(shards: int, rack_shards: int = RACK_SHARDS, region_racks: int = REGION_RACKS, weight: float = 1.0) -> Tree:
    """Shards 0, 1, ... filled into racks and racks into regions."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // rack_shards
        tree.setdefault(f"g{rack // region_racks}", {}).setdefault(f"k{rack}", {})[s] = weight
    return tree


def _hex(h: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(h, first, digits), 16, 10).cast("double")


def _time(h: Column, rate: float) -> Column:
    return -F.log((_hex(h, 1, 13) + 0.5) / float(1 << 52)) / rate


def _earliest(nodes: list[Column]) -> Column:
    return nodes[0] if len(nodes) == 1 else F.least(*nodes)


def _at(draw: Column, region: str, rack: Column | str, shard: Column | int) -> Column:
    return F.struct(draw.alias("draw"), F.lit(region).alias("region"), (rack if isinstance(rack, Column) else F.lit(rack)).alias("rack"), (shard if isinstance(shard, Column) else F.lit(shard)).cast("int").alias("shard"))


def _alone(key: Column, region: str, rack: str, shard: int, weight: float, why: str, after: Column | None = None) -> Column:
    """A shard's own draw."""
    time = _time(F.md5(F.concat(key, F.lit(f":{region}:{why}:{shard}"))), weight)
    return _at(time if after is None else after + time, region, rack, shard)


def _dart(key: Column, region: str, places: dict[tuple[int, int], tuple[str, int, float]], racks: int, slots: int, number: int = 0, after: Column | None = None) -> Column:
    """The region's earliest dart that sticks, from a dart's number on."""
    if number == DARTS:
        return _earliest([_alone(key, region, rack, shard, weight, "late", after) for rack, shard, weight in places.values()])
    h = F.md5(F.concat(key, F.lit(f":{region}:{number}")))
    time = _time(h, racks * slots)
    time = time if after is None else after + time
    spot = F.floor(_hex(h, 14, 4) * racks / 65536) * slots + F.floor(_hex(h, 18, 4) * slots / 65536)
    every = [places.get((i, j), ("", -1, 0.0)) for i in range(racks) for j in range(slots)]
    rack, shard, weight = (F.get(F.array(*[F.lit(p[k]) for p in every]), spot.cast("int")) for k in range(3))
    found = _at(time, region, rack, shard)
    if all(w == 1 for _, _, w in every):
        return found
    sticks = _hex(h, 22, 8) / float(1 << 32) < weight
    return F.when(sticks, found).otherwise(_dart(key, region, places, racks, slots, number + 1, time))


def place(key: Column, tree: Tree, racks: int = REGION_RACKS, slots: int = RACK_SHARDS) -> Column:
    """struct(region, rack, shard, draw) that a string key descends to. Weights may not be negative; 0 keeps a place free."""
    found = []
    for region, rack_shards in tree.items():
        places, alone = {}, []
        for i, (rack, shards) in enumerate(rack_shards.items()):
            for j, (shard, weight) in enumerate(shards.items()):
                if weight < 0:
                    raise ValueError(f"rack {rack} has a negative weight")
                if i < racks and j < slots and weight:
                    places[i, j] = (rack, shard, min(float(weight), 1.0))
                    weight -= places[i, j][2]
                if weight:
                    alone.append(_alone(key, region, rack, shard, weight, "more"))
        found += ([_dart(key, region, places, racks, slots)] if places else []) + alone
    if not found:
        raise ValueError("the tree has no shard")
    return _earliest(found)


def shard_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard for every row."""
    key = shard_key(doc_id)
    at = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), place(key, tree).alias("at"), *([place(key, grown)["shard"].alias("grown_shard")] if grown else [F.lit(None).cast("int").alias("grown_shard")]))
    block = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("size").cast("string"))), 1, 3), 16, 10).cast("int") % SLOT_BLOCKS
    narrow = at.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("at.region").alias("region"), F.col("at.rack").alias("rack"), F.col("at.shard").alias("shard"), "grown_shard", block.alias("block"))
    rows = stored(narrow, "shard-rows")
    before = rows.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")) - 1
    return rows.join(before, ["shard", "block"]).select("doc_id", "size", "text_crc32", "law", "region", "rack", "shard", (inside + F.col("before")).cast("long").alias("slot"), "grown_shard")
