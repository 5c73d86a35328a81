"""Substring dedup by difference-cover anchors.

A passage is ``LENGTH`` consecutive words; a word goes when a passage over it starts anywhere else as
well, in another document or in the same. Positions of a document are numbered from its start, and
``COVER`` is a difference cover modulo ``PERIOD``: for any two positions i and j some shift d below the
period puts i + d and j + d both on cover positions. So two equal passages, wherever they start, share
an aligned anchor of ``LENGTH - PERIOD + 1`` words that starts at cover positions of both, and only
those positions are hashed for the whole corpus: 5 in 21.

1. Each part of the corpus sends its different anchors, one row each; those of several parts, or that a part has twice, are repeated.
2. A passage is a candidate if a repeated anchor lies inside it. The anchor is extended to both sides to
   the whole passages around it, and their 128-bit hashes (two hashes of words and windows that share nothing) are sent and counted in the same way.
3. Passages that are repeated cover the words that go.

Texts are shuffled once, into parts of bounded bytes, and the three steps read that one shuffle. Rows sent are
the different keys of each part, so they grow with the input and a key that a third of all documents share is one row a part.
Rows that are equal in everything are dealt over the parts by the place where they are read. A part finds its repeated
passages among its own by 64 bits; that a passage is repeated was decided by 128.
Passages are judged on the input, not on what is left.

Defined cases: null and empty texts have no words and give an empty text; a document shorter than
LENGTH words loses nothing; equal rows are occurrences of their own and lose all passages; a null
doc_id is an id like others; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardloom.llm import textops as T
from shardloom.llm.common import text_bytes

LENGTH = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
"""All differences modulo 21 occur among these five."""
PART_BYTES = 16 << 20
"""Bytes of text in a part; less where there are more shuffle partitions than such parts."""
DEAL = 1 << 10

KEYS = "h long, g long, at long"
OUT = "doc_id long, text string, n_words long, n_removed long, spans array<struct<first:int,last:int>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _sent(h: np.ndarray, g: np.ndarray, part: int) -> pa.Table:
    """The different keys of a part; ``at`` is twice the part's number, and one more for keys that it has several times."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))[: len(h)])
    more = np.diff(np.append(first, len(h))) > 1
    return pa.table({"h": h[first].view(np.int64), "g": g[first].view(np.int64), "at": 2 * part + more.astype(np.int64)})


def _repeated(sent: DataFrame) -> DataFrame:
    """part, h: for each part its keys that occur more than once in the corpus. One exchange, by the key."""
    several = F.count("*").over(W.partitionBy("h", "g")) > 1
    return sent.withColumn("several", several).where("several or at % 2 = 1").select(F.call_function("div", "at", F.lit(2)).cast("int").alias("part"), "h")


def _told(rows: pa.Table) -> np.ndarray:
    return np.sort(rows["h"].to_numpy().view(np.uint64))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the hashes are among the known ones (sorted)."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


class _Part:
    """The texts of a part."""

    def __init__(self, rows: pa.Table, length: int, period: int, cover: tuple[int, ...]):
        self.length, self.period = length, period
        self.on = np.zeros(period, bool)
        self.on[list(cover)] = True
        self.slices = list(T.slices(rows["text"]))

    def anchors(self) -> Iterator[tuple[T.Slice, np.ndarray, np.ndarray]]:
        """Starts and hashes of a slice's anchors."""
        size = self.length - self.period + 1
        for s in self.slices:
            i = s.window_starts(size)
            i = i[self.on[(i - s.word_at[np.searchsorted(s.word_at, i, side="right") - 1]) % self.period]]
            yield s, i, T.windows(s.word_hashes(), size)[i] if len(i) else np.empty(0, np.uint64)

    def sent_anchors(self, part: int) -> pa.Table:
        h = np.concatenate([np.empty(0, np.uint64), *(h for _, _, h in self.anchors())])
        return _sent(h, np.zeros_like(h), part)

    def sent_passages(self, repeated: np.ndarray, part: int) -> pa.Table:
        """The passages around repeated anchors."""
        found = [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)]]
        for s, at, h in self.anchors():
            marks = np.zeros(len(s.starts) + 1, np.int64)
            marks[1 + at[_among(h, repeated)]] = 1
            np.cumsum(marks, out=marks)
            i = s.window_starts(self.length)
            i = i[marks[i + self.period] > marks[i]]
            if len(i):
                for seed in (0, 1):
                    found[seed].append(T.windows(s.word_hashes(seed=seed), self.length)[i])
        return _sent(np.concatenate(found[0]), np.concatenate(found[1]), part)

    def passages(self, repeated: np.ndarray) -> Iterator[tuple[T.Slice, np.ndarray]]:
        """Starts of a slice's repeated passages."""
        for s in self.slices:
            i = s.window_starts(self.length)
            yield s, i[_among(T.windows(s.word_hashes(), self.length)[i], repeated)] if len(i) and len(repeated) else i[:0]

    def kept(self, doc_id: pa.Array, repeated: np.ndarray) -> pa.Table:
        texts, words, removed, spans = [], [], [], []
        for s, i in self.passages(repeated):
            gone = T.covered(i, self.length, len(s.starts))
            data = s.data.tobytes()
            gone_before = np.concatenate(([0], np.cumsum(gone)))
            keep = ~gone
            for d in range(s.n):
                a, b = int(s.word_at[d]), int(s.word_at[d + 1])
                n = int(gone_before[b] - gone_before[a])
                own = data[s.text_at[d] : s.text_at[d + 1]].split()
                words.append(b - a)
                removed.append(n)
                texts.append(b" ".join(compress(own, keep[a:b].tolist()) if n else own))
                if n:
                    part = gone[a:b].astype(np.int8)
                    edge = np.diff(np.concatenate(([0], part, [0])))
                    spans.append([{"first": x, "last": y - 1} for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
                else:
                    spans.append([])
        return pa.Table.from_arrays([doc_id, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _OUT.field("spans").type)], schema=_OUT)


def dedup(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, the text of the words that stay joined by a space, n_words, n_removed, and the spans of words that go."""
    if not is_cover(cover, period) or not period <= length:
        raise ValueError("the positions are no difference cover of a period within the length")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // part_bytes))
    deal = F.monotonically_increasing_id() % DEAL
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text", deal), F.lit(parts)).cast("int").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def send_anchors(key: tuple, own: pa.Table) -> pa.Table:
        return _Part(own, length, period, cover).sent_anchors(key[0].as_py())

    def send_passages(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        return _Part(own, length, period, cover).sent_passages(_told(told), key[0].as_py())

    def remove(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        return _Part(own, length, period, cover).kept(own["doc_id"].combine_chunks(), _told(told))

    by_part = rows.groupBy("part")
    anchors = _repeated(by_part.applyInArrow(send_anchors, KEYS))
    passages = _repeated(by_part.cogroup(anchors.groupBy("part")).applyInArrow(send_passages, KEYS))
    return by_part.cogroup(passages.groupBy("part")).applyInArrow(remove, OUT)
