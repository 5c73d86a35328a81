"""Global ids as column expressions, and the same rules for single values on the driver.

A stored id is local to the shard that holds its row, or global where it points to another shard. A global
id is ``sign * (|local| + shard * IDS)``. In all functions ``src`` is the shard where a value is stored
and ``cur`` the shard that the result is expressed in; both may be numbers or columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

IDS = 10_000_000_000_000
Shard = int | Column

_SHORT = r"\A(\d+)~(-?)(\d+)\Z"
_INTEGER = r"\A-?\d+\Z"


def _col(x: Shard) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def signed(x: Column, f) -> Column:
    """``f`` of the absolute value, with the sign of ``x``; zero counts as positive."""
    return F.when(x < 0, -f(F.abs(x))).otherwise(f(x))


def parse(text: Column) -> Column:
    """The integer of ``"12"``, ``"-12"`` or ``"3~12"`` (global); null for anything else."""

    shard, local = (F.regexp_extract(text, _SHORT, g).try_cast("bigint") for g in (1, 3))
    sign = F.when(F.regexp_extract(text, _SHORT, 2) == "-", F.lit(-1)).otherwise(F.lit(1)).cast("long")
    whole = F.when(local <= IDS, sign * (local + shard * IDS))
    return F.when(text.rlike(_SHORT), whole).when(text.rlike(_INTEGER), text.try_cast("bigint"))


def is_global(x: Column) -> Column:
    return F.abs(x) >= IDS


def local_part(x: Column) -> Column:
    """The id within its own shard, sign kept."""
    return x % IDS


def shard_part(x: Column) -> Column:
    """The shard that a global id names, 0 for a local one."""
    return F.call_function("div", F.abs(x), F.lit(IDS))


def globalize(x: Column, shard: Shard) -> Column:
    """The global form of a local id."""
    return signed(x, lambda a: a + _col(shard) * IDS)


def global_id(x: Column, src: Shard) -> Column:
    return F.when(is_global(x), x).otherwise(globalize(x, src))


def shard_for(x: Column, src: Shard, known: list[int] | None = None) -> Column:
    """The shard of an id: the one that it names if that exists, else ``src``."""
    named = shard_part(x)
    exists = is_global(x) if known is None else is_global(x) & named.isin(known)
    return F.when(exists, named).otherwise(_col(src))


def relative_id(x: Column, src: Shard, cur: Shard, known: list[int] | None = None) -> Column:
    """An id stored on ``src`` as it reads on ``cur``: local if it belongs there, else global. Ids of unknown shards stay as they are."""
    owner = F.when(is_global(x), shard_part(x)).otherwise(_col(src))
    out = F.when(owner == _col(cur), local_part(x)).otherwise(global_id(x, src))
    return out if known is None else F.when(is_global(x) & ~shard_part(x).isin(known), x).otherwise(out)


def local_id(x: Column, known: list[int] | None = None) -> Column:
    """struct(local, shard): shard is null for a local id, both are null if the shard is unknown."""
    named = shard_part(x)
    found = F.struct(local_part(x).alias("local"), named.alias("shard"))
    none = F.lit(None).cast("bigint")
    near = F.struct(x.cast("bigint").alias("local"), none.alias("shard"))
    out = F.when(~is_global(x), near)
    out = out.otherwise(found) if known is None else out.when(named.isin(known), found)
    return F.coalesce(out, F.struct(none.alias("local"), none.alias("shard")))


def short_id(x: Column) -> Column:
    """``shard~local`` for a global id, the number for a local one, as a string."""
    return F.when(is_global(x), F.concat_ws("~", shard_part(x), local_part(x))).otherwise(x.cast("string"))


def split(value: int) -> tuple[int | None, int]:
    """(shard or None, local) of a number."""
    sign = -1 if value < 0 else 1
    shard, local = divmod(abs(value), IDS)
    return shard or None, sign * local


def join(shard: int, local: int) -> int:
    return -(abs(local) + shard * IDS) if local < 0 else local + shard * IDS


def parse_value(value: object) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        return value
    if isinstance(value, str):
        if m := re.fullmatch(r"(\d+)~(-?\d+)", value):
            local = int(m[2])
            return join(int(m[1]), local) if abs(local) <= IDS else None
        if re.fullmatch(r"-?\d+", value):
            return int(value)
    return None


def relative_value(value: int, src: int, cur: int) -> int:
    shard, local = split(value)
    owner = shard or src
    return local if owner == cur else join(owner, local)
