"""Conditions whose id literals mean the same record on every shard.

A literal is split into its owner and local id when the condition is built; the column for a set of shards
has, for each shard, the literal as that shard stores it. Conditions are plain columns, so partitions are
pruned and row groups skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardloom.catalog import Catalog
from shardloom.context import current
from shardloom.functions import ids
from shardloom.registry import SHARD, Model, key_vertical

MOST_BRANCHES = 32
"""Conditions whose keys belong to more shards of the query than this are written once in global ids instead of for each shard."""


@dataclass(frozen=True)
class Raw:
    """A literal that is left as it is."""

    value: object


@dataclass(frozen=True)
class Key:
    """An id literal."""

    owner: int
    local: int

    def on(self, shard: int) -> int:
        return self.local if self.owner == shard else ids.join(self.owner, self.local)


def literal(m: Model, column: str, value: object, catalog: Catalog) -> Key | object:
    """A Key for an id of a known shard in an id column, else the value itself."""
    vertical = key_vertical(m, column)
    number = ids.parse_value(value)
    if isinstance(value, (Raw, Key)) or vertical is None or number is None:
        return value.value if isinstance(value, Raw) else value
    shard, local = ids.split(number)
    if shard is None:
        return Key(current(vertical, catalog.default.id), local)
    return Key(shard, local) if catalog.lookup(shard) else number


class Condition:
    def column(self, shards: Sequence[int]) -> Column:
        raise NotImplementedError

    def owners(self) -> list[int] | None:
        """The shards of the keys if this names rows by their primary keys."""
        return None

    def semis(self) -> list[Semi]:
        """The sub-queries in it."""
        return []

    def __and__(self, other: Condition) -> Condition:
        return Both(and_, (self, other))

    def __or__(self, other: Condition) -> Condition:
        return Both(or_, (self, other))

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass(frozen=True)
class Both(Condition):
    how: Callable[[Column, Column], Column]
    parts: tuple[Condition, ...]

    def column(self, shards: Sequence[int]) -> Column:
        return reduce(self.how, (p.column(shards) for p in self.parts))

    def semis(self) -> list[Semi]:
        return [s for p in self.parts for s in p.semis()]


@dataclass(frozen=True)
class Not(Condition):
    part: Condition

    def column(self, shards: Sequence[int]) -> Column:
        return ~self.part.column(shards)

    def semis(self) -> list[Semi]:
        return self.part.semis()


@dataclass(frozen=True, eq=False)
class Semi(Condition):
    """Is there a row of another query with equal values within the shard. ``on``: pairs of own and other columns; ``null_aware``: as IN and
    NOT IN treat nulls. The query puts what it finds into the column ``mark``: true, false, or null for an unknown IN."""

    inner: object
    on: tuple[tuple[str, str], ...]
    negated: bool
    null_aware: bool

    @property
    def mark(self) -> str:
        return f"_semi{id(self)}"

    def column(self, shards: Sequence[int]) -> Column:
        return ~F.col(self.mark) if self.negated else F.col(self.mark)

    def semis(self) -> list[Semi]:
        return [self]


@dataclass(frozen=True)
class Sql(Condition):
    """Text on the stored columns; ids in it are not translated."""

    text: str

    def column(self, shards: Sequence[int]) -> Column:
        return F.expr(self.text)


def _in(c: Column, values: list) -> Column:
    found = c.isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
    return found | c.isNull() if None in values else found


OPERATORS: dict[str, Callable[[Column, list], Column]] = {
    "in": _in,
    "not in": lambda c, v: ~_in(c, v),
    "<": lambda c, v: c < v[0],
    "<=": lambda c, v: c <= v[0],
    ">": lambda c, v: c > v[0],
    ">=": lambda c, v: c >= v[0],
    "between": lambda c, v: c.between(*v),
}


@dataclass(frozen=True)
class Compare(Condition):
    name: str
    op: str
    values: tuple
    primary: bool = False

    def owners(self) -> list[int] | None:
        keys = [v for v in self.values if isinstance(v, Key)]
        return list(dict.fromkeys(k.owner for k in keys)) if self.primary and self.op == "in" and keys else None

    def column(self, shards: Sequence[int]) -> Column:
        test = OPERATORS[self.op]
        if not any(isinstance(v, Key) for v in self.values):
            return test(F.col(self.name), list(self.values))
        own = self.primary and self.op == "in" and len(shards) > 1
        keys = [v for v in self.values if isinstance(v, Key)]
        owners = {k.owner for k in keys}
        mine, rest = [s for s in shards if s in owners], [s for s in shards if s not in owners]
        if len(mine) > MOST_BRANCHES and self.op in ("in", "not in") and len(keys) == len(self.values):
            return self._by_global_ids(keys, mine if own else list(shards))
        out = F.lit(False)
        for s in mine:
            here = [v.on(s) if isinstance(v, Key) else v for v in self.values if not own or not isinstance(v, Key) or v.owner == s]
            out = out | ((F.col(SHARD) == s) & test(F.col(self.name), here))
        there = [v.on(0) if isinstance(v, Key) else v for v in self.values if not own or not isinstance(v, Key)]  # on all other shards a key is global
        return out | (F.col(SHARD).isin(rest) & test(F.col(self.name), there)) if rest and there else out

    def _by_global_ids(self, keys: list[Key], shards: list[int]) -> Column:
        """One list of global ids, whatever the number of shards; stored values are compared before, so that they still reach the scan."""
        stored = F.col(self.name)
        found = ids.global_id(stored, F.col(SHARD)).isin(sorted({ids.join(k.owner, k.local) for k in keys}))
        here = F.col(SHARD).isin(shards)
        if self.op == "not in":
            return here & ~found
        return here & stored.isin(sorted({x for k in keys for x in (k.local, ids.join(k.owner, k.local))})) & found


def compare(m: Model, catalog: Catalog, column: str, value: object, op: str | None = None) -> Condition:
    """``value``: a literal, a list of them, or with ``between`` a pair. Text that is no id of an id column matches nothing."""
    several = isinstance(value, (list, tuple, set, range))
    values = tuple(literal(m, column, v, catalog) for v in (value if several else [value]))
    if key_vertical(m, column):
        values = tuple(v for v in values if not isinstance(v, str))
    op = {"=": "in", "<>": "not in", None: "in"}.get(op, op)
    return Compare(column, op, values, column == m.pk)
