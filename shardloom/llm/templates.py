"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and digits; numbers, capitalised names (but for the most common words) and units become typed placeholders
and the rest is compared in lower case. A run of numbers is one placeholder, as is a run of names after a sentence's first
word, so a value of more words changes no positions ("twenty five" for "5", "New York" for "Paris", "3/4" for "2").
Windows of WINDOW template tokens of a document and of a
benchmark item that are equal meet by a hash join. Windows of one alignment (document position less item
position) belong together: the values in their slots have to map onto each other one to one, so a
question with other numbers or names is found as long as it uses them consistently, and passages that
share a pattern but not its logic are not.

A document is contaminated by an item if one alignment covers at least ``NEED`` of the item's tokens (all but
two, or all, of a shorter item) and at most CONFLICTS of its slot values are in conflict.

Texts are read in two forms, which are compared each with its own. In the one, names are placeholders and at least LITERALS
tokens of a window are ordinary. In the other only numbers and units are, so that capitals or their absence change nothing and a
text all in capitals has windows too; windows of numbers and units alone are compared by their values. What the second form finds
doesn't count where the first covers more of the item and its values are in conflict.

The corpus is read once. Its windows are first looked up in a bit map of the items' hashes, of 16 bits for each up to MOST_BITS, and
those that pass are joined with the items, so a map that is too full costs rows but changes nothing. All that is gathered for one
document and item is bounded by the item's length.

Defined cases: null and empty texts match nothing; items of fewer than WINDOW template tokens are one window of
their size; equal rows
are matched alike, and items of equal text or id are items of their own if their texts differ; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textops as T
from shardloom.llm.common import MOST_BITS, bit_map, fresh, in_map, row_key, stored

WINDOW = 8
LITERALS = 4
"""Ordinary tokens that a window has at least (half of a smaller window)."""
NEED = 13
CONFLICTS = 0.1

# Words that count as numbers, as units, and as no name although they start with a capital.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "km cm mm kg mg lb lbs oz mph inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split()

COMMON = "a an the if when while how what which who whose where why and or but so then for to from by with of in on at as is are was were do does did can could will would should has have had i you he she it we they his her its their each every".split()

_NAME, _NUMBER, _UNIT = (np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC949C7DEFAE1E7A5, 0xB492B66FBE98F273))
_LITERAL_KIND, _NUMBER_KIND, _UNIT_KIND, _NAME_KIND = range(4)
_PLACEHOLDER = np.array([0, _NUMBER, _UNIT, _NAME], np.uint64)
_PLACE = np.uint64(0xD6E8FEB86659FD93)
WINDOWS = "id long, k long, form int, size int, pos int, h long, n_tokens int, first int, last int, slots array<long>"

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".?!:;\n"]] = True
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(next(T.slices(pa.array([" ".join(words)]))).word_hashes())


_ODD = re.compile("([" + "".join(c for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x20000)]) if len(c.lower().encode()) != len(c.encode())) + "])")
"""Letters whose lower case has another number of bytes stay as they are."""


def _lowered(data: np.ndarray) -> np.ndarray:
    """Letters of all scripts in lower case; no byte moves."""
    text = data.tobytes().decode("utf-8", "surrogateescape")
    text = "".join(x if _ODD.match(x) else x.lower() for x in _ODD.split(text))
    return np.frombuffer(text.encode("utf-8", "surrogateescape"), np.uint8)


class Tokens(T.Slice):
    """A slice's tokens: ``value`` is the hash of a token in lower case, ``kind`` what it is, ``opens`` which are the first of a sentence."""

    def __init__(self, s: T.Slice):
        d = s.data
        run, digit = _RUN[d], _DIGIT[d]
        if len(d) > 2:
            point = ((d == 44) | (d == 46))[1:-1] & digit[:-2] & digit[2:]  # within a number
            run[1:-1] |= point
        super().__init__(s.row, d, s.text_at, ~run)
        self.data = _lowered(d) if (d > 127).any() else d
        self.value = self.word_hashes(lower=True)
        self.data = d
        first = d[self.starts] if len(self.starts) else np.empty(0, np.uint8)
        second = d[np.minimum(self.starts + 1, len(d) - 1)] if len(self.starts) else first
        name = _UPPER[first] | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        name &= ~np.isin(self.value, _hashes(COMMON))
        number = _DIGIT[first] | np.isin(self.value, _hashes(NUMBERS))
        unit = np.isin(self.value, _hashes(UNITS))
        self.kind = np.select([number, unit, name], [_NUMBER_KIND, _UNIT_KIND, _NAME_KIND], _LITERAL_KIND)
        ends = np.concatenate(([0], np.cumsum(_END[d])))
        self.opens = np.ones(len(self.starts), bool)
        if len(self.starts):
            self.opens[1:] = ends[self.starts[1:]] > ends[self.ends[:-1]]
            at = self.word_at[:-1]
            self.opens[at[at < len(self.starts)]] = True


class Form:
    """Tokens with runs of one kind merged. names: are names placeholders.

    ``head``: each one's first token; ``at``: of each text the first one (one more than texts); ``slot``: the hash of what stands there, 0
    for an ordinary token; ``template``: that of its placeholder or itself.
    """

    def __init__(self, t: Tokens, names: bool):
        self.tokens, self.number = t, int(names)
        kind = t.kind if names else np.where(t.kind == _NAME_KIND, _LITERAL_KIND, t.kind)
        goes_on = np.zeros(len(kind), bool)
        if len(kind):
            same = (kind[1:] == kind[:-1]) & ~t.opens[1:]
            goes_on[1:] = same & ((kind[1:] == _NUMBER_KIND) | (kind[1:] == _NAME_KIND) & ~t.opens[:-1])
        self.head = np.flatnonzero(~goes_on)
        self.at = np.searchsorted(self.head, t.word_at)
        self.kind = kind[self.head]
        place = np.arange(len(kind)) - np.repeat(self.head, np.diff(np.append(self.head, len(kind))))
        value = np.add.reduceat(T.mix(t.value + place.astype(np.uint64) * _PLACE), self.head) if len(kind) else t.value
        self.value = value
        self.slot = np.where(self.kind == _LITERAL_KIND, np.uint64(0), value | np.uint64(1))
        self.template = np.where(self.kind == _LITERAL_KIND, value, _PLACEHOLDER[self.kind])

    def found(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of windows."""
        at = T.starts_of(self.at, size)
        if not len(at):
            return at, np.empty(0, np.uint64)
        literals = np.concatenate(([0], np.cumsum(self.kind == _LITERAL_KIND)))
        n = literals[at + size] - literals[at]
        if self.number:
            at = at[2 * n >= min(2 * LITERALS, size)]
            h = T.windows(self.template, size)[at]
        else:
            h = np.where(n > 0, T.windows(self.template, size)[at], T.windows(self.value, size)[at])
        return at, T.seeded(h, 2 * size + self.number)

    def rows(self, at: np.ndarray, h: np.ndarray, size: int, b: pa.RecordBatch) -> pa.RecordBatch:
        t = self.tokens
        doc = np.searchsorted(self.at, at, side="right") - 1
        slots = self.slot[at[:, None] + np.arange(size)[None, :]].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * size + 1, size, dtype=np.int32)), pa.array(slots.ravel()))
        own, ends = pa.array(doc + t.row), np.append(self.head, len(t.starts))
        columns = [np.full(len(at), self.number), np.full(len(at), size), at - self.at[doc]]
        more = [np.diff(t.word_at)[doc], self.head[at] - t.word_at[doc], ends[at + size] - 1 - t.word_at[doc]]
        return pa.RecordBatch.from_arrays(
            [b["id"].take(own), b["k"].take(own), *(pa.array(c.astype(np.int32)) for c in columns), pa.array(h.view(np.int64)), *(pa.array(c.astype(np.int32)) for c in more), lists],
            names=["id", "k", "form", "size", "pos", "h", "n_tokens", "first", "last", "slots"],
        )


def _forms(s: T.Slice) -> list[Form]:
    t = Tokens(s)
    return [Form(t, names) for names in (False, True)]


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All windows of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b["t"]):
                for f in _forms(s):
                    n = np.diff(f.at)
                    for size in (window, *np.unique(n[(n > 0) & (n < window)]).tolist()):
                        at, h = f.found(size)
                        if size < window:
                            own = n[np.searchsorted(f.at, at, side="right") - 1] == size
                            at, h = at[own], h[own]
                        yield f.rows(at, h, size, b)

    return items.select(F.col(item_id).cast("long").alias("id"), row_key(item_id, text).alias("k"), F.col(text).alias("t")).mapInArrow(cut, WINDOWS)


def _document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[tuple[int, int]], doc_id: str, text: str) -> DataFrame:
    """The documents' windows whose hashes may be among the items'."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            for s in T.slices(b["t"]):
                forms = _forms(s)
                for form, size in sizes:
                    at, h = forms[form].found(size)
                    near = in_map(bits, h)
                    if near.any():
                        yield forms[form].rows(at[near], h[near], size, b)

    return docs.select(F.col(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("k"), F.col(text).alias("t")).mapInArrow(cut, WINDOWS)


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, _k (the row's key), item_id, and of the best alignment n_covered, n_tokens (of the item), n_slots and n_changed (slot
    values, and those that differ) for each document and item that contaminates it."""
    own = stored(item_windows(items.dropDuplicates([item_id, item_text]), item_id, item_text), "item-windows")
    sizes = sorted(map(tuple, own.select("form", "size").distinct().collect()))  # at most WINDOW sizes in two forms
    found = _document_windows(docs, bit_map(own, most_bits), sizes, doc_id, text)
    d, i = found.alias("d"), own.alias("i")
    met = d.join(i, (F.col("d.h") == F.col("i.h")) & (F.col("d.form") == F.col("i.form")) & (F.col("d.size") == F.col("i.size")))
    pairs = F.filter(F.arrays_zip(F.col("i.slots").alias("x"), F.col("d.slots").alias("y")), lambda p: p["x"] != 0)
    spots = F.sequence(F.col("i.first"), F.col("i.last"))
    keys = ["doc_id", "_k", "item_id", "_i", "n_tokens", "form", "shift"]
    each = met.select(F.col("d.id").alias("doc_id"), F.col("d.k").alias("_k"), F.col("i.id").alias("item_id"), F.col("i.k").alias("_i"), F.col("i.n_tokens").alias("n_tokens"), F.col("i.form").alias("form"), (F.col("d.pos") - F.col("i.pos")).alias("shift"), spots.alias("spots"), pairs.alias("pairs"))
    aligned = each.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set("spots"))).alias("spots"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))

    def distinct(side: str):
        return F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))

    need = F.when(F.col("n_tokens") >= NEED, F.least(F.lit(NEED), F.col("n_tokens"))).when(F.col("n_tokens") - 2 >= WINDOW, F.col("n_tokens") - 2).otherwise(F.col("n_tokens"))
    conflicts = 2 * F.size("pairs") - distinct("x") - distinct("y")
    consistent, covered = conflicts <= 2 * CONFLICTS * F.size("pairs"), F.size("spots")
    changed = F.size(F.filter("pairs", lambda p: p["x"] != p["y"]))
    best = F.when(consistent & (covered >= need), F.struct(covered.alias("n_covered"), (-changed).alias("same"), F.size("pairs").alias("n_slots"), "n_tokens"))
    named, blind, refuted = F.max(F.when(F.col("form") == 1, best)), F.max(F.when(F.col("form") == 0, best)), F.max(F.when((F.col("form") == 1) & ~consistent, covered))
    judged = aligned.groupBy("doc_id", "_k", "item_id", "_i").agg(named.alias("named"), blind.alias("blind"), F.coalesce(refuted, F.lit(0)).alias("refuted"))
    chosen = F.greatest("named", F.when(F.col("blind.n_covered") >= F.col("refuted"), F.col("blind")))
    out = judged.withColumn("b", chosen).where("b is not null").groupBy("doc_id", "_k", "item_id").agg(F.max("b").alias("b"))
    return out.select("doc_id", "_k", "item_id", "b.n_covered", "b.n_tokens", "b.n_slots", (-F.col("b.same")).alias("n_changed"))


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    found = stored(matches(docs, items, doc_id, text, **columns).select(F.col("doc_id").alias("_d"), "_k").distinct(), "contaminated")
    key = fresh(docs, "_key")
    own = docs.withColumn(key, row_key(doc_id, text))
    return own.join(found, own[doc_id].cast("long").eqNullSafe(found["_d"]) & (own[key] == found["_k"]), "left_anti").drop(key)
