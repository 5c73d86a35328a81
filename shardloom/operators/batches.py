"""Batches of ids in order: of equal numbers of rows, or greedy ranges of equal width.

Ids are dealt into blocks of their order; blocks are worked on in parallel. How blocks continue each other is followed in Spark, by
groups of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.operators.ordered import BLOCK_ROWS, blocks, placed

FAN = 128
"""Blocks that one task follows at a time."""


def numbered_batches(df: DataFrame, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """batch, first_id and last_id of each run of ``size`` rows in the order of their column ``id`` (numbers or strings)."""
    rows = placed(df.where("id is not null").select("id"), F.col("id"), block_rows=block_rows)
    batch = F.call_function("div", F.col("place") - 1, F.lit(size)).alias("batch")
    return rows.select("id", batch).groupBy("batch").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))


ENTRIES = "block long, top long, entry long, finish long, n long"


def _follow(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], low: int | None) -> list[tuple[int, int] | None]:
    """Through blocks in order, each with its entries, their finishes and numbers of ranges: the entry of each block and the ranges before it, or
    None for a block that the last range covers; and at the end the last finish and the number of ranges."""
    out, number = [], 0
    for entry, finish, n in parts:
        i = 0 if low is None else int(np.searchsorted(entry, low, "right"))
        if i < len(entry):
            out.append((int(entry[i]), number))
            low, number = int(finish[i]), number + int(n[i])
        else:
            out.append(None)
    return [*out, (low, number)]


def greedy_ranges(df: DataFrame, size: int, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """batch, first_id, last_id: each range has the width ``size`` and starts at the least id after the one before.

    Where a block's first range starts depends on the block before, but only ids within one width of the block's least id, and the
    next one, come into question: its entries, at most ``size`` + 2. For each of them a block tells where its last range would end. ``fan`` blocks in a row
    are followed by one task and are a block of the next level, until there is one; then each level tells the one below where its
    blocks start. Nothing but the number of blocks reaches the driver.
    """
    dealt = blocks(df.where("id is not null").select(F.col("id").cast("long").alias("id")), F.col("id"), block_rows=block_rows)

    def starts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.unique(ids)
        return own, np.searchsorted(own, own + size, "right")

    def entries(key: tuple, rows: pa.Table) -> pa.Table:
        own, after = starts(rows["id"].to_numpy())
        end, n = own + size, np.ones(len(own), np.int64)
        for i in range(len(own) - 1, -1, -1):
            if (k := after[i]) < len(own):
                end[i], n[i] = end[k], n[k] + 1
        m = min(int(after[0]) + 1, len(own))
        return pa.table({"block": pa.array([key[0].as_py()] * m, pa.int64()), "top": pa.array([int(own[-1])] * m, pa.int64()), "entry": own[:m], "finish": end[:m], "n": n[:m]})

    def parted(rows: pa.Table) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
        """The blocks of a group in order, their entries, and the greatest id."""
        block, entry, finish, n = (rows[c].to_numpy() for c in ("block", "entry", "finish", "n"))
        order = np.lexsort((entry, block))
        edges = np.append(np.flatnonzero(np.append(True, np.diff(block[order]) != 0)), len(order))
        parts = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [int(block[p[0]]) for p in parts], [(entry[p], finish[p], n[p]) for p in parts], int(rows["top"].to_numpy().max())

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        """A group of blocks as one block: entries within a width of its least id and the next one."""
        _, parts, top = parted(rows)
        every = np.unique(np.concatenate([e for e, _, _ in parts]))
        every = every[: int(np.searchsorted(every, every[0] + size, "right")) + 1]
        ends = [_follow(parts, int(e) - 1)[-1] for e in every]
        m = len(every)
        return pa.table({"block": pa.array([key[0].as_py()] * m, pa.int64()), "top": pa.array([top] * m, pa.int64()), "entry": every, "finish": pa.array([f for f, _ in ends], pa.int64()), "n": pa.array([n for _, n in ends], pa.int64())})

    def told(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        """Where the blocks of a group start."""
        if not len(rows) or not len(above):
            return pa.table({c: pa.array([], pa.int64()) for c in ("block", "entry", "number")})
        names, parts, _ = parted(rows)
        entry, number = above["entry"][0].as_py(), above["number"][0].as_py()
        found = [(b, x[0], number + x[1]) for b, x in zip(names, _follow(parts, entry - 1), strict=False) if x]
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("block", "entry", "number"))})

    def ranges(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(above):
            number = above["number"][0].as_py()
            own, after = starts(rows["id"].to_numpy())
            i = int(np.searchsorted(own, above["entry"][0].as_py()))
            while i < len(own):
                out.append((number + len(out), int(own[i]), int(own[i]) + size))
                i = int(after[i])
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("batch", "first_id", "last_id"))})

    named = dealt.select(F.col("_block").cast("long").alias("block"), "id")
    levels = [named.groupBy("block").applyInArrow(entries, ENTRIES)]
    count = (named.agg(F.max("block")).first()[0] or 0) + 1
    group = F.call_function("div", F.col("block"), F.lit(fan)).alias("group")
    while count > 1:
        levels.append(levels[-1].groupBy(group).applyInArrow(joined, ENTRIES))
        count = -(-count // fan)
    first = levels[-1].groupBy("block").agg(F.min("entry").alias("entry")).select("block", "entry", F.lit(0).cast("long").alias("number"))
    for level in levels[-2::-1]:
        up = first.withColumnRenamed("block", "group")
        first = level.groupBy(group).cogroup(up.groupBy("group")).applyInArrow(told, "block long, entry long, number long")
    return named.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ranges, "batch long, first_id long, last_id long")
