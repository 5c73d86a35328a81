"""Associations as joins.

Two kinds of join exist. Within a shard stored values are compared as they are, so a row of another shard is
found only through a copy. Between shards global ids are compared. Both are equi-joins; Spark chooses how.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions import ids
from shardloom.functions.ids import IDS
from shardloom.registry import SHARD


def gid(column: str, side: str | None = None) -> Column:
    """The global id of a stored value."""
    p = f"{side}." if side else ""
    return ids.global_id(F.col(f"{p}{column}"), F.col(f"{p}{SHARD}"))


def canonical(pk: str = "id") -> Column:
    return (F.col(pk) >= 0) & (F.col(pk) < IDS)


def shadow(pk: str = "id") -> Column:
    return F.col(pk) >= IDS


def in_shard(a: DataFrame, b: DataFrame, a_column: str, b_column: str, how: str = "inner", names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows of one shard with equal stored values; columns are read as ``a.x`` and ``b.y``."""
    x, y = names
    return a.alias(x).join(b.alias(y), (F.col(f"{x}.{SHARD}") == F.col(f"{y}.{SHARD}")) & (F.col(f"{x}.{a_column}") == F.col(f"{y}.{b_column}")), how)


def belongs_to(children: DataFrame, parents: DataFrame, fk: str, pk: str = "id", how: str = "left") -> DataFrame:
    """Each child with the canonical parent that its key names; columns are read as ``child.x`` and ``parent.y``."""
    own = parents.where(canonical(pk)).withColumn("_gid", gid(pk))
    return children.withColumn("_fk", gid(fk)).alias("child").join(own.alias("parent"), F.col("child._fk") == F.col("parent._gid"), how)


def has_many(owners: DataFrame, children: DataFrame, fk: str, pk: str = "id", shards: str | None = None, how: str = "inner") -> DataFrame:
    """Each owner with its children on its own shard, or on all shards of its array column ``shards`` (none if that is null or empty).

    ``how="left"`` has each owner without any child once.
    """
    own = owners.withColumn("_gid", gid(pk))
    kids = children.withColumn("_fk", gid(fk))
    if shards:  # children that are where their owner's shards are, and then owners with these
        places = own.select("_gid", F.explode(F.array_distinct(shards)).alias("_on"))
        kids = kids.join(places, (F.col(SHARD) == F.col("_on")) & (F.col("_fk") == F.col("_gid")), "left_semi")
        return own.alias("owner").join(kids.alias("child"), F.col("owner._gid") == F.col("child._fk"), how)
    own = own.withColumn("_on", ids.shard_for(F.col(pk), F.col(SHARD)).cast("int"))
    return own.alias("owner").join(kids.alias("child"), (F.col("owner._on") == F.col(f"child.{SHARD}")) & (F.col("owner._gid") == F.col("child._fk")), how)


def has_one(owners: DataFrame, children: DataFrame, fk: str, pk: str = "id", child_pk: str = "id") -> DataFrame:
    """Each owner with the child of the least id; children are reduced before the join."""
    kids = children.withColumn("_fk", gid(fk))
    columns = [c for c in children.columns]
    first = kids.groupBy(SHARD, "_fk").agg(F.min_by(F.struct(*columns), child_pk).alias("c")).select("_fk", *[F.col(f"c.`{c}`").alias(c) for c in columns])
    own = owners.withColumn("_gid", gid(pk)).withColumn("_on", ids.shard_for(F.col(pk), F.col(SHARD)).cast("int"))
    return own.alias("owner").join(first.alias("child"), (F.col("owner._on") == F.col(f"child.{SHARD}")) & (F.col("owner._gid") == F.col("child._fk")), "left")


def through(owners: DataFrame, middle: DataFrame, target: DataFrame, fk: str, target_fk: str, pk: str = "id", middle_pk: str = "id", shards: str | None = None) -> DataFrame:
    """Owners, their middle rows on each searched shard, and the target rows that those meet within that shard."""
    met = has_many(owners, middle, fk, pk, shards)
    return met.join(target.alias("target"), (F.col(f"child.{SHARD}") == F.col(f"target.{SHARD}")) & (F.col(f"child.{middle_pk}") == F.col(f"target.{target_fk}")))


def polymorphic(rows: DataFrame, fk: str, kind: str, targets: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """All rows with the global id of their owner and a column of it, which is null where the type is null, is not listed, or has no such owner.

    One join: owners of all types together, by type and global id.
    """
    parents = None
    for name, found in targets.items():
        own = found.where(canonical()).select(F.lit(name).alias("_kind"), gid("id").alias("_gid"), F.col(columns[name]).cast("string").alias("owner_value"))
        parents = own if parents is None else parents.unionByName(own)
    keyed = rows.withColumn("_fk", gid(fk))
    return keyed.join(parents, (F.col(kind) == F.col("_kind")) & (F.col("_fk") == F.col("_gid")), "left").drop("_kind", "_gid")


def pinned(a: DataFrame, b: DataFrame, shard: int, a_column: str, b_column: str, how: str = "inner", names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows of any shard with rows of one shard, by stored values: what a join means whose table was named for that shard."""
    x, y = names
    return a.alias(x).join(b.where(F.col(SHARD) == shard).alias(y), F.col(f"{x}.{a_column}") == F.col(f"{y}.{b_column}"), how)


def to_unsharded(rows: DataFrame, unsharded: DataFrame, fk: str, pk: str = "id", how: str = "inner") -> DataFrame:
    """Keys of unsharded tables are plain numbers on every shard."""
    return rows.alias("child").join(unsharded.alias("parent"), F.col(f"child.{fk}") == F.col(f"parent.{pk}"), how)


def from_unsharded(unsharded: DataFrame, rows: DataFrame, fk: str, default_shard: int, pk: str = "id", how: str = "left") -> DataFrame:
    """An unsharded row's key is relative to the default shard."""
    own = rows.where(canonical(pk)).withColumn("_gid", gid(pk))
    return unsharded.withColumn("_fk", ids.global_id(F.col(fk), default_shard)).alias("child").join(own.alias("parent"), F.col("child._fk") == F.col("parent._gid"), how)
