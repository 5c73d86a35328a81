"""The shard catalog: shards and servers, their order, regions, and expressions that name sets of shards.

The catalog has a row for each shard. It is a small table by nature and is held on the driver and as a DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardloom.context import NoSuchShard

SHARDS = "id int, name string, database_server_id string, default boolean"
SERVERS = "server_id string, region string, open boolean"


@dataclass(frozen=True)
class ShardRow:
    id: int
    name: str | None = None
    server: str | None = None
    default: bool = False


@dataclass(frozen=True)
class Server:
    id: str
    region: str | None = None
    open: bool = False
    default: bool = False


@dataclass(frozen=True)
class Catalog:
    shards: tuple[ShardRow, ...]
    servers: tuple[Server, ...]
    region: str | None = None
    _by_id: dict[int, ShardRow] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        if sum(s.default for s in self.shards) != 1 or sum(s.default for s in self.servers) != 1:
            raise ValueError("a catalog has one default shard and one default server")
        if len({(s.server, s.name) for s in self.shards}) != len(self.shards):
            raise ValueError("two shards of a server have the same name")
        self._by_id.update({s.id: s for s in self.shards})

    @property
    def default(self) -> ShardRow:
        return next(s for s in self.shards if s.default)

    @property
    def default_server(self) -> Server:
        return next(s for s in self.servers if s.default)

    def server_of(self, shard: ShardRow) -> Server | None:
        """A shard without a server id is on the default server; None where the server isn't configured."""
        return self.default_server if shard.server is None else next((s for s in self.servers if s.id == shard.server), None)

    def lookup(self, shard: int | str | None, current: int | None = None) -> ShardRow | None:
        """By id, ``"default"``, ``"self"`` or None (the default); None where there is no such shard."""
        if shard in (None, "default"):
            return self.default
        if shard == "self":
            return self._by_id[current] if current is not None else self.default
        if not re.fullmatch(r"\d+", str(shard)) or int(shard) == 0:
            raise ValueError(f"not a shard id: {shard!r}")
        found = self._by_id.get(int(shard))
        return found if found and self.server_of(found) else None

    def require(self, shard: int) -> int:
        if not self.lookup(shard):
            raise NoSuchShard(f"no shard {shard}")
        return shard

    def ranked(self) -> list[ShardRow]:
        """In the order in which shards are visited: the default server's first, then by server and id."""
        return sorted(self.shards, key=lambda s: (s.server is not None, s.server or "", s.id))

    def live(self) -> list[int]:
        """Ids of shards whose server is configured, in visiting order."""
        return [s.id for s in self.ranked() if self.server_of(s)]

    def add(self, shard: ShardRow) -> Catalog:
        if shard.id in self._by_id:
            raise ValueError(f"shard {shard.id} exists")
        return Catalog((*self.shards, shard), self.servers, self.region)

    def drop(self, shard: int) -> Catalog:
        if self.default.id == shard:
            raise ValueError("the default shard can't be dropped")
        return Catalog(tuple(s for s in self.shards if s.id != shard), self.servers, self.region)

    def server_for_new_shard(self) -> Server:
        """The first open server, else the default one."""
        return next((s for s in self.servers if s.open), self.default_server)

    def frame(self, spark: SparkSession) -> DataFrame:
        """shard rows with their server's region, ``configured`` and ``rank`` in visiting order."""
        rows = [(s.id, s.name, s.server, s.default, (v.id if (v := self.server_of(s)) else None), (v.region if v else None), bool(v and v.open), v is not None) for s in self.shards]
        df = spark.createDataFrame(rows, f"{SHARDS}, server_id string, region string, open boolean, configured boolean")
        order = W.orderBy(F.col("database_server_id").isNotNull(), F.col("database_server_id").asc_nulls_first(), "id")
        return df.withColumn("rank", F.row_number().over(order))

    def primary(self, spark: SparkSession) -> DataFrame:
        """Of each server the unnamed shard with the least id."""
        return self.frame(spark).where("name is null").groupBy("database_server_id").agg(F.min("id").alias("id"))

    def in_region(self, spark: SparkSession, region: str | None, include_regionless: bool = True) -> DataFrame:
        near = F.col("region").eqNullSafe(F.lit(region))
        return self.frame(spark).where(F.col("configured") & ((near | F.col("region").isNull()) if include_regionless else near))

    def in_current_region(self, spark: SparkSession, include_regionless: bool = True) -> DataFrame:
        return self.frame(spark).where("configured") if self.region is None else self.in_region(spark, self.region, include_regionless)

    def server_shards(self, spark: SparkSession, server: str) -> DataFrame:
        """Those of the default server include the shards without a server id."""
        return self.frame(spark).where(F.col("server_id") == server)

    def servers_named(self, expression: str | None = None, regions: str | None = None) -> list[Server]:
        """``a,b``: these; ``-a,b``: all but these; ``open``: all open ones (or the default). Regions: ``r``, ``-r``, ``self``, each narrowing the last."""
        found = list(self.servers)
        if expression:
            negative = expression.startswith("-")
            names = expression.removeprefix("-").split(",")
            found = [s for n in names for s in self.servers if s.id == n]
            if "open" in names:
                opened = [s for s in self.servers if s.open] or [self.default_server]
                found += [s for s in opened if s not in found]
            if negative:
                found = [s for s in self.servers if s not in found]
        for region in regions.split(",") if regions else []:
            keep = not region.startswith("-")
            name = region.removeprefix("-")
            wanted = self.region if name == "self" else name
            everywhere = name == "self" and self.region is None
            found = [s for s in found if (everywhere or s.region in (None, wanted)) == keep]
        return found

    def on_servers(self, spark: SparkSession, expression: str | None = None, regions: str | None = None) -> DataFrame:
        df, found = self.frame(spark), self.servers_named(expression, regions)
        if found == list(self.servers):
            return df
        return df.where(F.coalesce("database_server_id", F.lit(self.default_server.id)).isin([s.id for s in found]))

    def shard_set(self, spark: SparkSession, terms: str) -> DataFrame:
        """Shards of a comma list of ``default``, ``primary``, ``n``, ``a..b``, ``a...b`` (open end), ``a..``, ``..b``, ``n/d`` (the
        n-th of d chunks by id), each also with ``-``. Positive terms add up and negative ones take away; without a positive term all
        shards are the start."""
        chunks = [t for t in terms.split(",") if "/" in t]
        df = self.frame(spark).select("id", "name", "database_server_id", "default", "rank")
        if chunks:
            df = df.withColumn("place", F.row_number().over(W.orderBy("id"))).withColumn("total", F.count("*").over(W.partitionBy()))
        ids, without, plus, minus = set(), set(), [], []
        primary = {s.id for s in self.shards if s.name is None and s.id == min(x.id for x in self.shards if x.name is None and x.server == s.server)}
        for term in terms.split(","):
            negative = term.startswith("-")
            body = term[1:] if negative else term
            if body in ("default", "primary") or body.isdecimal():
                (without if negative else ids).update({self.default.id} if body == "default" else primary if body == "primary" else {int(body)})
            elif (m := re.fullmatch(r"(\d+)?\.\.(\.)?(\d+)?", body)) and (m[1] or m[3]):
                low = F.col("id") >= int(m[1]) if m[1] else F.lit(True)
                high = F.lit(True) if not m[3] else F.col("id") < int(m[3]) if m[2] else F.col("id") <= int(m[3])
                (minus if negative else plus).append(low & high)
            elif (m := re.fullmatch(r"(\d+)/(\d+)", body)) and 0 < int(m[1]) <= int(m[2]):
                size = F.ceil(F.col("total") / int(m[2]))
                (minus if negative else plus).append((F.col("place") > (int(m[1]) - 1) * size) & (F.col("place") <= int(m[1]) * size))
            else:
                raise ValueError(f"not a shard or a range of shards: {term!r}")
        keep = F.lit(True)
        if ids or plus:
            keep = F.col("id").isin(sorted(ids - without)) if ids - without else F.lit(False)
            for p in plus:
                keep = keep | p
        for m in minus:
            keep = keep & ~m
        if without:
            keep = keep & ~F.col("id").isin(sorted(without))
        return df.where(keep).drop("place", "total")

