"""Models: what a table's columns mean for ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardloom.context import BASE, UNSHARDED
from shardloom.functions import ids

SHARD = "_shard_id"
"""The partition column of every sharded table: the shard that holds the row."""


@dataclass(frozen=True)
class Model:
    name: str
    pk: str | None = "id"
    vertical: str = BASE
    integral: bool = True
    keys: dict[str, str] = field(default_factory=dict, hash=False)
    """Foreign key columns, and the model that each points to."""
    polymorphic: dict[str, str] = field(default_factory=dict, hash=False)
    """Foreign key columns with any target, and the column that names its model."""

    @property
    def sharded(self) -> bool:
        return self.vertical != UNSHARDED

    def __getattr__(self, name: str) -> Column:
        """``global_x``, ``local_x`` and ``original_x`` of a key column ``x``, as columns of the model's rows."""
        form, _, column = name.partition("_")
        if name.startswith("_") or form not in FORMS or not (column == self.pk or column in self.keys or column in self.polymorphic):
            raise AttributeError(f"{self.name} has no {name!r}; only key columns have global and local forms")
        if not key_vertical(self, column):
            return F.col(column)
        return FORMS[form](F.col(column), F.col(SHARD))


FORMS = {"global": ids.global_id, "local": lambda x, shard: ids.local_part(x), "original": lambda x, shard: x}


MODELS: dict[str, Model] = {}


def model(name: str, **what) -> Model:
    MODELS[name] = Model(name, **what)
    return MODELS[name]


def key_vertical(m: Model, column: str) -> str | None:
    """The vertical whose current shard a column's ids are relative to; None if the column isn't an id.

    Keys of unsharded or non-integral targets are ordinary numbers.
    """
    if column == m.pk:
        return m.vertical if m.integral and m.sharded else None
    if column in m.polymorphic:
        return m.vertical
    target = MODELS.get(m.keys.get(column, ""))
    return target.vertical if target and target.sharded and target.integral else None


def id_columns(m: Model, columns: list[str]) -> dict[str, str]:
    return {c: v for c in columns if (v := key_vertical(m, c))}


CUSTOMER = model("customer", keys={"parent_id": "customer", "nation_key": "nation"})
ORDERS = model("orders", keys={"customer_id": "customer"})
LINEITEM = model("lineitem", pk=None, keys={"order_id": "orders", "part_id": "part", "supplier_id": "supplier"})
EVENT = model("event", keys={"user_id": "customer"})
FEATURE = model("feature", polymorphic={"owner_id": "owner_type"})
PART = model("part", vertical="catalog")
SUPPLIER = model("supplier", vertical="catalog", keys={"nation_key": "nation"})
NATION = model("nation", vertical=UNSHARDED, keys={"region_key": "region"})
REGION = model("region", vertical=UNSHARDED)
ROOT = model("root", vertical=UNSHARDED, keys={"user_id": "customer"})
DOCUMENT = model("document", integral=False)
