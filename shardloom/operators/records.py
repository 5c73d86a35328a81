"""Copies of rows on other shards, moves between shards, inserts and upserts: as the resulting rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.catalog import Catalog
from shardloom.context import WithShards, activate
from shardloom.functions import ids
from shardloom.operators.associations import shadow
from shardloom.registry import SHARD, Model, id_columns


class NotSharded(WithShards, TypeError):
    """Shadow rows exist for sharded tables only, and of canonical rows only."""


def replicate(df: DataFrame, m: Model, target: int) -> DataFrame:
    """Copies of canonical rows for a shard, under global ids; rows of that shard have none."""
    if not m.sharded or not m.integral:
        raise NotSharded(m.name)
    rows = df.where((F.col(SHARD) != target) & ~shadow(m.pk))
    moved = {c: ids.relative_id(F.col(c), F.col(SHARD), target) for c in id_columns(m, df.columns)}
    return rows.withColumns({**moved, SHARD: F.lit(target).cast(df.schema[SHARD].dataType)})


def save_shadow(df: DataFrame, copies: DataFrame, m: Model) -> DataFrame:
    """The table with the copies in the place of older ones."""
    return upsert(df, copies, [SHARD, m.pk])


def destroy_shadow(df: DataFrame, keys: DataFrame, m: Model, targets: Sequence[int]) -> DataFrame:
    """The table without the copies, on the target shards, of the rows whose global ids are in ``keys`` (gid)."""
    if not m.sharded:
        raise NotSharded(m.name)
    gone = keys.select(F.col("gid").alias("_gid")).distinct()
    hit = F.col(SHARD).isin(list(targets)) & shadow(m.pk)
    return df.withColumn("_copy", F.when(hit, F.col(m.pk))).join(gone, F.col("_copy") == F.col("_gid"), "left_anti").drop("_copy")


def move(df: DataFrame, m: Model, shard: Column | int) -> DataFrame:
    """Rows as another shard stores them; the row's own id keeps its local part."""
    to = shard if isinstance(shard, Column) else F.lit(shard)
    columns = id_columns(m, df.columns)
    moved = {c: ids.relative_id(F.col(c), F.col(SHARD), to) for c in columns if c != m.pk}
    return df.withColumns({**moved, SHARD: to.cast(df.schema[SHARD].dataType)})


def incoming(rows: DataFrame, m: Model, cur: int, target: int) -> DataFrame:
    """Rows with ids as ``cur`` reads them, as ``target`` stores them."""
    return rows.withColumns({**{c: ids.relative_id(F.col(c), cur, target) for c in id_columns(m, rows.columns)}, SHARD: F.lit(target)})


def _one_each(rows: DataFrame, on: list[str]) -> DataFrame:
    """Of rows of equal keys the least one; a null in a key is equal to nothing."""
    keyed = F.lit(True)
    for c in on:
        keyed = keyed & F.col(c).isNotNull()
    least = rows.where(keyed).groupBy(*on).agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")
    return least.unionByName(rows.where(~keyed))


def insert(df: DataFrame, rows: DataFrame, on: list[str] | None = None) -> DataFrame:
    """The table with new rows; with keys, those whose keys exist already or come twice are skipped."""
    return df.unionByName(rows if on is None else new_rows(df, rows, on), allowMissingColumns=True)


def new_rows(df: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows that an insert adds to the table."""
    return _one_each(rows, on).join(df.select(*on), on, "left_anti").select(*rows.columns)


def upsert(df: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The table with the columns of ``rows`` in those of equal keys, whose other columns stay, and with the rest as new rows."""
    given = _one_each(rows, on).select(*[F.col(c).alias(f"_new_{c}") for c in rows.columns], F.lit(True).alias("_given"))
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_new_{c}"))
    both = df.join(given, same, "full")
    columns = [F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in rows.columns else F.col(c) for c in df.columns]
    return both.select(*columns)


def returned(rows: DataFrame, m: Model, target: int, cur: int, columns: Sequence[str]) -> DataFrame:
    """Columns of rows of a shard, with ids as ``cur`` reads them."""
    own = id_columns(m, list(columns))
    return rows.select(*[ids.relative_id(F.col(c), target, cur).alias(c) if c in own else F.col(c) for c in columns])


def partition_by_shard(values: DataFrame, column: str, cur: int, known: list[int]) -> DataFrame:
    """Parsed ids with the shard that each belongs to, in that shard's terms; ids of no known shard stay as they are, on the current one."""
    number = ids.parse(F.col(column))
    named = ids.is_global(number) & ids.shard_part(number).isin(known)
    shard = F.when(named, ids.shard_part(number)).otherwise(F.lit(cur)).cast("int")
    return values.select(column, shard.alias("shard"), F.when(named, ids.local_part(number)).otherwise(number).alias("local_id"))


def partition_records(df: DataFrame, m: Model, shards: str | None = None) -> DataFrame:
    """Records grouped by where they have data: each once for every shard in its array column ``shards`` (its own if that is null or empty), as
    that shard reads it."""
    known = F.when(F.size(shards) > 0, F.array_distinct(shards)) if shards else F.lit(None).cast("array<int>")
    there = df.withColumn("shard", F.explode(F.coalesce(known, F.array(F.col(SHARD)))))
    return there.withColumns({c: ids.relative_id(F.col(c), F.col(SHARD), F.col("shard")) for c in id_columns(m, df.columns)})


BLOCK_ROWS = 100_000


def map_shards(df: DataFrame, f: Callable, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``f(shard, pandas frame)`` on blocks of each shard's rows; errors come back as rows of their own.

    A shard is dealt into as many blocks of about ``block_rows`` rows as it needs, so ``f`` sees a bounded part and its results have to add up.
    """
    import pandas as pd

    names = [x.split()[0] for x in schema.split(",")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            out = f(int(key[0]), rows.drop(columns="_block")).assign(shard=int(key[0]), error=None)
        except Exception as e:  # the driver decides what an error means
            out = pd.DataFrame([{"shard": int(key[0]), "error": f"{type(e).__name__}: {e}"}])
        return out.reindex(columns=["shard", "error", *names])

    blocks = df.groupBy(SHARD).agg(F.ceil(F.count("*") / block_rows).alias("_blocks"))  # a row a shard
    spread = F.xxhash64(*[c for c in df.columns if c != SHARD], F.monotonically_increasing_id() % 1024)
    dealt = df.withColumn("_spread", spread).join(blocks, SHARD).withColumn("_block", F.pmod("_spread", "_blocks")).drop("_spread", "_blocks")
    return dealt.groupBy(SHARD, "_block").applyInPandas(run, f"shard int, error string, {schema}")


class ShardErrors(WithShards, RuntimeError):
    """Some shards failed; names them."""


def raise_errors(results: DataFrame, policy: str | Callable[[int, str], None] = "raise") -> DataFrame:
    """The results of a map without errors. ``raise``: raises for the first failed shard; ``defer``: after all shards, for all that failed;
    ``ignore``: not at all; or a function that gets each failed shard and its error. A row for each failed shard at most is looked at."""
    if policy != "ignore":
        failed = results.where("error is not null").groupBy("shard").agg(F.min("error").alias("error")).orderBy("shard")
        rows = failed.limit(1).collect() if policy == "raise" else failed.collect()
        if callable(policy):
            for r in rows:
                policy(r["shard"], r["error"])
        elif rows:
            raise ShardErrors("; ".join(f"shard {r['shard']}: {r['error']}" for r in rows))
    return results.where("error is null").drop("error")


def shard_task(catalog: Catalog, f: Callable[[int], object], fail_fast: bool = True, log: Callable[[dict], None] | None = None) -> list[dict]:
    """Runs a driver's task on each live shard, with that shard as the current one, and returns what happened: started, completed, failed."""
    events: list[dict] = []

    def note(shard: int, kind: str, message: str = "") -> None:
        server = catalog.server_of(catalog.lookup(shard))
        events.append({"shard": shard, "database_server": server.id, "type": kind, "message": message})
        if log:
            log(events[-1])

    for shard in catalog.live():
        note(shard, "started")
        try:
            with activate(shard):
                f(shard)
        except Exception as e:  # noqa: BLE001
            note(shard, "failed", f"{type(e).__name__}: {e}")
            if fail_fast:
                raise ShardErrors(f"shard {shard}: {type(e).__name__}: {e}") from e
        else:
            note(shard, "completed")
    return events
