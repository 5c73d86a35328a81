"""Immutable queries on a sharded model.

A query keeps the shards that it runs on, where that choice came from, and its conditions. It becomes one
DataFrame: a scan with a condition on the shard, one projection that gives ids as the current shard reads
them, and ordinary grouping, ordering and limits over all shards together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardloom import context
from shardloom.catalog import Catalog, ShardRow
from shardloom.functions import ids
from shardloom.operators.batches import greedy_ranges, numbered_batches
from shardloom.operators.ordered import placed
from shardloom.plans.predicate import Condition, Semi, Sql, compare
from shardloom.registry import SHARD, Model, id_columns, key_vertical

RANK = {"implicit": 0, "association": 1, "explicit": 2}


class RecordNotFound(context.WithShards, LookupError):
    pass


class OrderNotAllowed(context.WithShards, ValueError):
    """Raised by ``strict_order`` queries that order several shards by an expression."""


@dataclass(frozen=True)
class ShardedQuery:
    model: Model
    frame: DataFrame
    catalog: Catalog
    shards: tuple[int, ...] = ()
    source: str = "implicit"
    conditions: tuple[Condition, ...] = ()
    orders: tuple[tuple[str | Column, bool], ...] = ()
    rows_limit: int | None = None
    rows_offset: int = 0
    unique: bool = False
    none: bool = False
    strict_order: bool = False
    late: bool = False
    current: dict[str, int] = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, m: Model, frame: DataFrame, catalog: Catalog, strict_order: bool = False) -> ShardedQuery:
        """On the current shard of the model's vertical."""
        now = context.active()
        home = now.get(m.vertical, catalog.default.id) if m.sharded else catalog.default.id
        return cls(m, frame, catalog, (catalog.require(home),), strict_order=strict_order, current=now)

    def unscoped(self) -> ShardedQuery:
        """The model's rows without conditions, on the shard that is current when the rows are read."""
        return replace(ShardedQuery(self.model, self.frame, self.catalog, strict_order=self.strict_order), late=True)

    def _bound(self) -> ShardedQuery:
        if not self.late:
            return self
        now = ShardedQuery.of(self.model, self.frame, self.catalog)
        return replace(self, late=False, shards=self.shards or now.shards, current=now.current)

    # shards

    @property
    def primary(self) -> int:
        return self.shards[0]

    def shard(self, *which: int | ShardRow | DataFrame, source: str = "explicit") -> ShardedQuery:
        """On these shards: ids, catalog rows, or a (small) DataFrame of the catalog with an ``id`` column."""
        found: list[int] = []
        for w in which:
            found += [r["id"] for r in w.select("id").orderBy("id").collect()] if isinstance(w, DataFrame) else [w.id if isinstance(w, ShardRow) else w]
        if None in found or not which:
            raise ValueError("a shard is needed")
        found = [self.catalog.require(s) for s in dict.fromkeys(found)]
        own = self._bound()
        return replace(own, shards=tuple(found) or own.shards[:1], source=source, none=self.none or not found)

    def all_shards(self) -> ShardedQuery:
        return self.shard(*self.catalog.live())

    def merge(self, other: ShardedQuery) -> ShardedQuery:
        """Conditions of both; the shards of the more explicit one, or of both if they are equally explicit."""
        if self.late or other.late:
            return self._bound().merge(other._bound())
        a, b = RANK[self.source], RANK[other.source]
        chosen = self if a > b or a == b == 0 else other
        shards = tuple(s for s in self.shards if s in other.shards) if a == b > 0 else chosen.shards
        merged = replace(self, shards=shards or chosen.shards[:1], source=chosen.source, conditions=self.conditions + other.conditions, none=self.none or other.none or not shards)
        limit = self.rows_limit if other.rows_limit is None else other.rows_limit
        return replace(merged, orders=other.orders or self.orders, rows_limit=limit, rows_offset=other.rows_offset or self.rows_offset, unique=self.unique or other.unique)

    # conditions

    def where(self, *conditions: Condition | str, **values: object) -> ShardedQuery:
        """Conditions, SQL text on stored values, or columns with values (a list: any of them; None: null)."""
        out = self
        for c in conditions:
            if isinstance(c, str):
                c = Sql(c)
            out = out._with(c)
        for name, value in values.items():
            out = out._with(compare(self.model, self.catalog, name, value))
        return out

    def compare(self, column: str, op: str, value: object) -> ShardedQuery:
        return self._with(compare(self.model, self.catalog, column, value, op))

    def condition(self, column: str, value: object, op: str | None = None) -> Condition:
        return compare(self.model, self.catalog, column, value, op)

    def _with(self, c: Condition) -> ShardedQuery:
        out = replace(self, conditions=(*self.conditions, c))
        owners = c.owners()
        if owners and self.source == "implicit" and len(self.shards) == 1:
            known = [s for s in owners if self.catalog.lookup(s)]
            first = [s for s in known if s == self.primary]
            out = replace(out, shards=tuple(first + [s for s in known if s not in first])) if known else out
        return out

    def where_poly(self, column: str, kind: str, key: object) -> ShardedQuery:
        """A polymorphic reference: its type and its id."""
        return self.where(**{self.model.polymorphic[column]: kind, column: key})

    def either(self, other: ShardedQuery) -> ShardedQuery:
        """Rows of this or of the other, on the shards of this; sub-queries belong to the side that has them."""
        if any(q.rows_limit is not None or q.rows_offset or q.unique for q in (self, other)):
            raise ValueError("queries with a limit, an offset or distinct rows can't be joined by OR")

        def all_of(q: ShardedQuery) -> Condition:
            out = q.conditions[0]
            for c in q.conditions[1:]:
                out = out & c
            return out

        if self.none or other.none:
            return replace(self, conditions=(self if other.none else other).conditions, none=self.none and other.none)
        if not self.conditions or not other.conditions:
            return replace(self, conditions=())
        return replace(self, conditions=(all_of(self) | all_of(other),))

    def in_query(self, column: str, inner: ShardedQuery | Having, inner_column: str, negated: bool = False) -> ShardedQuery:
        """``column IN (SELECT inner_column ...)`` within each shard; the inner query's order, limit, offset, distinct and having are those of each shard."""
        return replace(self, conditions=(*self.conditions, Semi(inner, ((column, inner_column),), negated, True)))

    def exists(self, inner: ShardedQuery | Having, *on: tuple[str, str], negated: bool = False) -> ShardedQuery:
        return replace(self, conditions=(*self.conditions, Semi(inner, on, negated, False)))

    def __invert__(self) -> ShardedQuery:
        """The rows of these shards for which the conditions are false."""
        out = None
        for c in self.conditions:
            out = c if out is None else out & c
        return replace(self, conditions=(~out,)) if out is not None else replace(self, none=True)

    # rows

    def scope(self) -> Column:
        return F.col(SHARD).isin(list(self.shards)) if self.model.sharded else F.lit(True)

    def _keys(self, names: Sequence[str]) -> DataFrame:
        """_s and _k0, _k1, ... of the rows that a sub-query has on each shard."""
        df = self.rows()
        if self.rows_limit is not None or self.rows_offset:
            terms = self._order_terms(stored=True) or ([F.col(self.model.pk).asc()] if self.model.pk else [])
            if not terms:
                raise ValueError("a limit in a sub-query needs an order")
            if self.unique:
                df = df.select(SHARD, *names).distinct()
            place = F.row_number().over(W.partitionBy(SHARD).orderBy(*terms))
            last = F.lit(True) if self.rows_limit is None else F.col("_place") <= self.rows_offset + self.rows_limit
            df = df.withColumn("_place", place).where(last & (F.col("_place") > self.rows_offset))
        return df.select(F.col(SHARD).alias("_s"), *[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)])

    def _met(self, df: DataFrame, c: Semi, how: str) -> DataFrame:
        """Rows with a partner in a sub-query, or without one, or all with a mark."""
        there = replace(c.inner, shards=self.shards, late=False)._keys([b for _, b in c.on])
        same = F.col(SHARD) == F.col("_s")
        for i, (a, _) in enumerate(c.on):
            same = same & (F.col(a) == F.col(f"_k{i}"))
        if how != "mark":
            return df.join(there, same, how)
        some = there.distinct().withColumn("_hit", F.lit(True))
        df = df.join(some, same, "left").drop("_s", *[f"_k{i}" for i in range(len(c.on))])
        found = F.col("_hit").isNotNull()
        if c.null_aware:
            df = self._with_nulls(df, there)
            found = F.when(found, True).when(F.col("_null").isNull(), False).when(F.col("_null") | F.col(c.on[0][0]).isNull(), F.lit(None)).otherwise(False)
        return df.withColumn(c.mark, found).drop("_hit", "_null")

    @staticmethod
    def _with_nulls(df: DataFrame, there: DataFrame) -> DataFrame:
        """``_null``: has the shard's set a null; null where the set is empty."""
        blind = there.groupBy("_s").agg(F.max(F.col("_k0").isNull()).alias("_null"))
        return df.join(blind.withColumnRenamed("_s", SHARD), SHARD, "left")

    def _marked(self, df: DataFrame) -> DataFrame:
        for c in self.conditions:
            for semi in c.semis():
                df = self._met(df, semi, "mark")
        return df

    def rows(self) -> DataFrame:
        """The stored rows that the conditions keep."""
        if self.late:
            return self._bound().rows()
        df = self.frame.where(F.lit(False)) if self.none else self.frame.where(self.scope())
        for c in self.conditions:
            if not c.semis():
                df = df.where(c.column(self.shards))
        for c in self.conditions:
            if isinstance(c, Semi):
                if c.negated and c.null_aware:  # NOT IN: nothing is outside a set with a null, a null is outside no set but the empty one
                    there = replace(c.inner, shards=self.shards, late=False)._keys([b for _, b in c.on])
                    df = self._with_nulls(df, there).where(F.col("_null").isNull() | ~F.col("_null") & F.col(c.on[0][0]).isNotNull()).drop("_null")
                df = self._met(df, c, "left_anti" if c.negated else "left_semi")
            elif c.semis():
                for semi in c.semis():
                    df = self._met(df, semi, "mark")
                df = df.where(c.column(self.shards)).drop(*[x.mark for x in c.semis()])
        return df

    def as_of(self, column: str, by_model: bool) -> Column:
        """A column as the current shard reads it. ``by_model``: of the model's vertical, else of the referenced one's."""
        vertical = key_vertical(self.model, column)
        if not vertical:
            return F.col(column)
        cur = self.current.get(self.model.vertical if by_model and self.model.sharded else vertical, self.catalog.default.id)
        stored = F.col(SHARD) if self.model.sharded else F.lit(self.catalog.default.id)
        return ids.relative_id(F.col(column), stored, cur)

    def read(self, *columns: str, by_model: bool = True) -> DataFrame:
        """The query's rows: conditions, then ids as read, then distinct, order, offset and limit over all shards."""
        if self.late:
            return self._bound().read(*columns, by_model=by_model)
        names = columns or tuple(c for c in self.frame.columns if c != SHARD)
        extra = [c for c, _ in self.orders if isinstance(c, str) and c not in names]
        df = self.rows()
        if self.strict_order and len(self.shards) > 1 and any(isinstance(c, Column) for c, _ in self.orders):
            raise OrderNotAllowed("several shards can only be ordered by columns")
        shown = [self.as_of(c, by_model).alias(c) for c in (*names, *extra)]
        terms = {f"_o{i}": c for i, (c, _) in enumerate(self.orders) if isinstance(c, Column)}
        df = df.select(*shown, *[c.alias(n) for n, c in terms.items()])
        if self.unique:
            df = df.distinct()
        if self.orders:
            keys = [F.col(c) if isinstance(c, str) else F.col(f"_o{i}") for i, (c, _) in enumerate(self.orders)]
            df = df.orderBy(*[k.desc_nulls_last() if d else k.asc_nulls_last() for k, (_, d) in zip(keys, self.orders, strict=True)])
        if self.rows_offset:
            df = df.offset(self.rows_offset)
        if self.rows_limit is not None:
            df = df.limit(self.rows_limit)
        return df.select(*names)

    def placed(self, *columns: str, name: str = "place", by_model: bool = True) -> DataFrame:
        """The query's rows, as ``read`` has them, with their place in its order; the order's columns have to be among them."""
        terms = [F.col(c) if isinstance(c, str) else c for c, _ in self.orders]
        terms = [t.desc_nulls_last() if d else t.asc_nulls_last() for t, (_, d) in zip(terms, self.orders, strict=True)]
        if not terms:
            raise ValueError("a place needs an order")
        if self.rows_limit is None and not self.rows_offset:  # the order is in the places
            return placed(replace(self, orders=()).read(*columns, by_model=by_model), *terms, name=name)
        return placed(self.read(*columns, by_model=by_model), *terms, name=name)

    def _order_terms(self, stored: bool = False) -> list[Column]:
        """The order as columns of the stored rows: as read, or as they are stored."""
        keys = [(c if isinstance(c, Column) else F.col(c) if stored else self.as_of(c, True), d) for c, d in self.orders]
        return [k.desc_nulls_last() if d else k.asc_nulls_last() for k, d in keys]

    def order(self, *columns: str | Column, descending: bool = False) -> ShardedQuery:
        """By columns as read, nulls last."""
        return replace(self, orders=(*self.orders, *((c, descending) for c in columns)))

    def limit(self, n: int) -> ShardedQuery:
        return replace(self, rows_limit=n)

    def offset(self, n: int) -> ShardedQuery:
        return replace(self, rows_offset=n)

    def distinct(self) -> ShardedQuery:
        return replace(self, unique=True)

    def ids(self) -> DataFrame:
        return self.read(self.model.pk)

    # aggregates

    def aggregate(self, *aggregates: Column) -> DataFrame:
        """Over the query's rows as read: of all shards, distinct ones and limited ones if the query says so."""
        return self.read().agg(*aggregates)

    def count(self, name: str = "n", column: str | None = None) -> DataFrame:
        """Rows, or values of a column that aren't null; different ones if the query is distinct."""
        return self.read(*([column] if column else [])).agg(F.count(column or "*").alias(name))

    def sum(self, column: str, name: str = "sum") -> DataFrame:
        """Of the different values if the query is distinct, as for the average."""
        return self.read(column).agg(F.coalesce(F.sum(column), F.lit(0)).alias(name))

    def average(self, column: str, name: str = "average") -> DataFrame:
        return self.read(column).agg(F.avg(column).alias(name))

    def count_distinct(self, column: str, name: str = "n", per_shard: bool = False) -> DataFrame:
        """Of values as read; ``per_shard``: distinct within each shard, then added up."""
        if per_shard:
            return self.rows().groupBy(SHARD).agg(F.count_distinct(column).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
        return self.read(column).agg(F.count_distinct(column).alias(name))

    def group(self, *keys: str | Column) -> Grouped:
        return Grouped(self, keys)

    # single records

    def find(self, key: object) -> ShardedQuery:
        """The query for one record: on its shard if the shards are implicit, else on those where the id is local, or on the only one."""
        number = ids.parse_value(key) if self.model.integral else None
        if number is None:
            return self.where(**{self.model.pk: key}).limit(1)
        return self.where(**{self.model.pk: number}).limit(1)

    def one(self, key: object):
        """The record, or RecordNotFound."""
        found = self.find(key).read().head(1)
        if not found:
            raise RecordNotFound(f"{self.model.name} {key!r}")
        return found[0]

    def _wanted(self, keys: Sequence[object]) -> tuple[DataFrame, list[int]]:
        """place and key of what is asked for, with null for what is no id, and the ids."""
        numbers = [ids.parse_value(k) for k in keys]
        cur = self.current.get(self.model.vertical, self.catalog.default.id)
        rows = [(i, None if n is None else ids.relative_value(n, cur, cur)) for i, n in enumerate(numbers)]
        return self.frame.sparkSession.createDataFrame(rows, "place int, _key long"), [n for n in numbers if n is not None]

    def find_many(self, keys: Sequence[object], *columns: str, strict: bool = True) -> DataFrame:
        """Records in the order of their keys, with their place. If ``strict``, RecordNotFound where one is missing or is no id."""
        own = self._bound()
        wanted, numbers = own._wanted(keys)
        found = own.where(**{own.model.pk: numbers}).read(*{own.model.pk: 0, **dict.fromkeys(columns)})
        if strict and (gone := [keys[r["place"]] for r in own.missing(keys).collect()]):
            raise RecordNotFound(f"{own.model.name} {', '.join(map(repr, gone))}")
        return found.join(F.broadcast(wanted), F.col(own.model.pk) == F.col("_key")).drop("_key")

    def missing(self, keys: Sequence[object]) -> DataFrame:
        """place of the keys without a record."""
        own = self._bound()
        wanted, numbers = own._wanted(keys)
        found = own.where(**{own.model.pk: numbers}).read(own.model.pk)
        return wanted.join(found, F.col(own.model.pk) == F.col("_key"), "left_anti").select("place")

    def any(self, name: str = "found") -> DataFrame:
        """One row: is there a row; reads no further than to the first."""
        some = self.read() if self.rows_offset or self.rows_limit == 0 else self.rows()
        return some.limit(1).agg((F.count("*") > 0).alias(name))

    def first(self, *columns: str, last: bool = False) -> DataFrame:
        return self.order(self.model.pk, descending=last).limit(1).read(*columns)

    # changes, as the rows that they touch

    def touched(self, name: str = "n") -> DataFrame:
        """How many rows an update or a delete of this query would touch; order doesn't matter, and neither does distinct."""
        return replace(self, orders=(), unique=False).count(name)

    def _hits(self) -> tuple[DataFrame, Column, list[str]]:
        """The whole table, which of its rows are the query's, and columns that were added to it.

        Without sub-queries and limits that is one scan. A limit needs an order, so that it is clear which rows it means.
        """
        if self.rows_limit is not None or self.rows_offset:
            if not self.orders or not self.model.pk:
                raise ValueError("a change with a limit needs an order and a primary key")
            picked = self.rows().orderBy(*self._order_terms())
            picked = picked.offset(self.rows_offset) if self.rows_offset else picked
            picked = picked.limit(self.rows_limit) if self.rows_limit is not None else picked
            keys = picked.select(F.col(SHARD).alias("_s"), F.col(self.model.pk).alias("_k"), F.lit(True).alias("_hit"))
            df = self.frame.join(keys, (F.col(SHARD) == F.col("_s")) & (F.col(self.model.pk) == F.col("_k")), "left")
            return df, F.col("_hit").isNotNull(), ["_s", "_k", "_hit"]
        hit = F.lit(not self.none) & self.scope()
        for c in self.conditions:
            hit = hit & c.column(self.shards)
        return self._marked(self.frame), F.coalesce(hit, F.lit(False)), [x.mark for c in self.conditions for x in c.semis()]

    def updated(self, **values: object) -> DataFrame:
        """The whole table with the query's rows changed."""
        df, hit, added = self._bound()._hits()
        return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).drop(*added)

    def deleted(self) -> DataFrame:
        """The whole table without the query's rows."""
        df, hit, added = self._bound()._hits()
        return df.where(~hit).drop(*added)

    # batches of ids, on the primary shard

    def id_ranges(self, size: int = 1000, start: object = None, end: object = None) -> DataFrame:
        """batch, first and last id of each run of ``size`` ids in order."""
        pk = F.col(self.model.pk)
        own = self._bound()
        df = replace(own, shards=own.shards[:1]).rows().select(pk.alias("id"))
        df = df.where(pk >= start) if start is not None else df
        df = df.where(pk <= end) if end is not None else df
        return numbered_batches(df, size)

    def id_ranges_loose(self, size: int = 1000, start: int | None = None, end: int | None = None) -> DataFrame:
        """first and last of ranges of ``size`` + 1 ids' width that start at the least id after the one before."""
        pk = F.col(self.model.pk)
        own = self._bound()
        df = replace(own, shards=own.shards[:1]).rows().select(pk.alias("id"))
        df = df.where(pk >= start) if start is not None else df
        df = df.where(pk <= end) if end is not None else df
        return greedy_ranges(df, size)

    def find_in_batches(self, size: int = 1000) -> Iterator[ShardedQuery]:
        """A query for each run of ``size`` rows in the order of their ids, one after the other."""
        own = self._bound()
        for r in own.id_ranges(size).orderBy("batch").toLocalIterator():
            yield own.where(Between(own.model.pk, r["first_id"], r["last_id"]))


@dataclass(frozen=True)
class Between(Condition):
    """Stored values from one to another."""

    name: str
    first: object
    last: object

    def column(self, shards: Sequence[int]) -> Column:
        return F.col(self.name).between(self.first, self.last)


@dataclass(frozen=True)
class Grouped:
    query: ShardedQuery
    keys: tuple

    def aggregate(self, *aggregates: Column, having: Column | None = None, top: tuple[Column, int] | None = None) -> DataFrame:
        """One grouping over all shards, by keys as the current shard reads them. The query's order, offset and limit are those of the
        groups; it may order by keys and by the names of aggregates."""
        q = self.query._bound()
        if q.unique:
            raise ValueError("a distinct query has no groups; count_distinct counts different values of a group")
        named = [(q.as_of(k, True).alias(k) if isinstance(k, str) else k) for k in self.keys]
        kept = [c for c in q.frame.columns if c not in {k for k in self.keys if isinstance(k, str)}]
        plain = id_columns(q.model, kept)
        df = q.rows().select(*named, *[F.col(c) for c in kept if c not in plain])
        out = df.groupBy(*[k if isinstance(k, str) else df.columns[i] for i, k in enumerate(self.keys)]).agg(*aggregates)
        out = out.where(having) if having is not None else out
        if q.orders:
            terms = [(F.col(c) if isinstance(c, str) else c, d) for c, d in q.orders]
            out = out.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_last() for c, d in terms])
        out = out.offset(q.rows_offset) if q.rows_offset else out
        out = out.limit(q.rows_limit) if q.rows_limit is not None else out
        return out.orderBy(top[0]).limit(top[1]) if top else out

    def having(self, condition: Column) -> Having:
        """The groups of each shard for which a condition on aggregates holds, for use as a sub-query."""
        if any(not isinstance(k, str) for k in self.keys) or self.query.rows_limit is not None or self.query.rows_offset or self.query.unique:
            raise ValueError("a grouped sub-query has columns as keys, no limit and no offset")
        return Having(self.query, self.keys, condition)


@dataclass(frozen=True)
class Having:
    query: ShardedQuery
    keys: tuple[str, ...]
    condition: Column
    shards: tuple[int, ...] = ()
    late: bool = False

    def _keys(self, names: Sequence[str]) -> DataFrame:
        df = replace(self.query, shards=self.shards, late=False).rows().groupBy(SHARD, *self.keys).agg(self.condition.alias("_keep")).where("_keep")
        return df.select(F.col(SHARD).alias("_s"), *[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)])
