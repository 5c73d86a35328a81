"""The current shard of each vertical, as a stack of activations that is captured when a query is built."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

BASE = "base"
UNSHARDED = "unsharded"

_current: ContextVar[Mapping[str, int]] = ContextVar("shards", default={})


class WithShards(Exception):
    """An error that knows which shards were active."""

    def __init__(self, *args: object):
        super().__init__(*args)
        self.shards = dict(_current.get())


class NoSuchShard(WithShards, LookupError):
    """A query on a shard that the catalog doesn't have."""


def current(vertical: str = BASE, default: int = 1) -> int:
    return _current.get().get(vertical, default)


def active() -> dict[str, int]:
    return dict(_current.get())


@contextmanager
def activate(shard: int | None = None, **verticals: int) -> Iterator[None]:
    """``activate(2)`` or ``activate(base=2, catalog=3)``; the unsharded vertical never moves."""
    wanted = {**({BASE: shard} if shard is not None else {}), **verticals}
    wanted.pop(UNSHARDED, None)
    token = _current.set({**_current.get(), **wanted})
    try:
        yield
    finally:
        _current.reset(token)
