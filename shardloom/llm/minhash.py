"""MinHash near-dedup with DartMinHash signatures.

A text is a weighted set: its shingles of five words, each weighted with the number of times that it
occurs. Every unit of an element's weight is a region of its own, from rank 0 upwards, at which darts
are thrown as a Poisson process of rate 1; where they land, and the coordinate of the signature that
each belongs to, follow from a hash of the element, the unit and the dart's number. A coordinate holds
the dart of the lowest rank. Only ranks up to ``t / weight`` are looked at, with t about ``k ln k``,
and twice as far where a coordinate is still empty, so most elements of a long text cost one hash. Two
texts share a coordinate with the probability of their weighted Jaccard similarity.

1. Texts that are equal count once. Their signatures are cut into bands; texts with an equal band share a bucket.
2. Each bucket has a centre, one of its texts by a hash, and every other text of the bucket is compared with it, exactly.
3. Pairs of at least the similarity are links, and their connected components are classes.
4. Other pairs of a bucket are compared if they can still change a class: their classes differ, and what
   each of the two has that the other cannot have does not rule the link out.

So a bucket of n copies costs n comparisons, while no link between texts that share a bucket is lost. Step 4 looks at the sketches of at most as
many pairs of a bucket as it has texts outside its largest class, times its texts; that is the square of its size where many texts of one
bucket are each other's neighbours just below the similarity.

Texts are chosen by a bit map of the keys that are wanted before they are shuffled.

Defined cases: a text of one to four words is one shingle; null texts and texts without words are
equal to each other and to no other text; equal rows are in one class; the class id is the least doc_id of its rows (null if
all are null); ties need no rule, as every comparison is exact; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textops as T
from shardloom.llm.common import bit_map, fresh, in_map, stored
from shardloom.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
"""A pair of similarity 0.8 shares one of 24 bands of 5 with probability 0.99993."""
BITS = 8
"""Slots of a sketch for each shingle of a text."""
_DART = 0xA0761D6478BD642F
_UNIT = 0xE7037ED1A0B428DB


def has_words(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def text_key(text: str = "text") -> Column:
    """128 bits of the text; all texts without a word have the same."""
    return F.unhex(F.md5(F.when(has_words(text), F.col(text)).otherwise("")))


def shingles(s: T.Slice, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each shingle of a slice, repeats included; a shorter text's is all its words."""
    h, at = s.word_hashes(), s.window_starts(words)
    n = np.diff(s.word_at)
    short = np.flatnonzero((n > 0) & (n < words))
    keys, docs = [T.windows(h, words)[at]], [s.word_doc()[at]]
    for size in np.unique(n[short]).tolist():
        own = short[n[short] == size]
        keys.append(T.seeded(T.windows(h, size)[s.word_at[own]], size))
        docs.append(own)
    return np.concatenate(keys), np.concatenate(docs)


def _units(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A hash for every unit of weight: the element's, and the unit's number within the element of the text."""
    order = np.argsort(T.mix(keys ^ T.mix(docs.astype(np.uint64) + np.uint64(1))), kind="stable")
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    number = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))
    out = np.empty(len(k), np.uint64)
    out[order] = T.mix(k + number.astype(np.uint64) * np.uint64(_UNIT))
    return out


def _throw(unit: np.ndarray, doc: np.ndarray, most: np.ndarray, k: int, best: np.ndarray, sign: np.ndarray) -> None:
    """Throws the darts of all units up to the rank ``most`` of their text into best (rank) and sign (dart) of each text's coordinates."""
    far = most[doc]
    for step, low, high in ((2, 0, 3), (8, 3, 12), (32, 12, 48), (64, 48, np.inf)):  # about as many darts at a time as are to be expected
        some, most_units = np.flatnonzero((far >= low) & (far < high)), (1 << 19) // step
        for i in range(0, len(some), most_units):
            which = some[i : i + most_units]
            thrown, rank = 0, np.zeros(len(which))
            while len(which):
                number = np.arange(thrown + 1, thrown + step + 1, dtype=np.uint64) * np.uint64(_DART)
                dart = T.mix(unit[which][:, None] + number[None, :])
                ranks = rank[:, None] - np.cumsum(np.log(T.unit_interval(dart)), 1)
                near = ranks <= far[which][:, None]
                row, _ = np.nonzero(near)
                own, at = T.mix(dart[near] + np.uint64(1)), ranks[near]
                slot = doc[which][row] * k + (own % np.uint64(k)).astype(np.int64)
                np.minimum.at(best, slot, at)
                won = best[slot] == at
                sign[slot[won]] = own[won]
                go = near[:, -1]
                which, rank, thrown = which[go], ranks[go, -1], thrown + step


def signatures(s: T.Slice, k: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The signature of every text of a slice (texts x k), and the weight of every text; 0 has no signature."""
    keys, doc = shingles(s, words)
    weight = np.bincount(doc, minlength=s.n)
    best, sign = np.full(s.n * k, np.inf), np.zeros(s.n * k, np.uint64)
    unit = _units(keys, doc)
    most = k * (np.log(k) + 3) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        own = todo[doc]
        _throw(unit[own], doc[own], most, k, best, sign)
        todo &= np.isinf(best.reshape(s.n, k)).any(1)
        most = most * 2
    return sign.reshape(s.n, k), weight


def similarities(a: pa.Array, b: pa.Array, words: int = WORDS) -> np.ndarray:
    """The weighted Jaccard similarity of each pair of texts; 0 where one has no words."""

    def elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, keys = [], []
        for s in T.slices(texts):
            k, d = shingles(s, words)
            rows.append(d + s.row)
            keys.append(_units(k, d))
        row = np.concatenate(rows) if rows else np.empty(0, np.int64)
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        return T.mix(key ^ T.mix(row.astype(np.uint64) + np.uint64(7))), row, np.bincount(row, minlength=len(texts))

    (x, row, n), (y, _, m) = elements(a), elements(b)
    y.sort()
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    same = np.bincount(row[y[at] == x], minlength=len(a)) if len(x) and len(y) else np.zeros(len(a))
    return same / np.maximum(n + m - same, 1)


def banded(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """key, bands: each different text with its bands' hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_UNIT)
        for b in batches:
            for s in T.slices(b["t"]):
                found, _ = signatures(s, bands * rows, words)
                cut = found.reshape(s.n, bands, rows)
                h = np.zeros((s.n, bands), np.uint64)
                for r in range(rows):
                    h = T.mix(h + cut[:, :, r] + np.uint64(r + 1))
                h = T.mix(h + step[None, :]).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, s.n * bands + 1, bands, dtype=np.int32), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([b["key"].slice(s.row, s.n), lists], names=["key", "bands"])

    own = docs.select(text_key(text).alias("key"), F.col(text).alias("t")).where(has_words("t"))
    return own.mapInArrow(sign, "key binary, bands array<long>").groupBy("key").agg(F.first("bands").alias("bands"))


def compared(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """a, b, similarity of each pair of keys, from texts (key, t)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = sum(pc.binary_length(b[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ta", "tb"))
            part = np.cumsum(size, dtype=np.int64) // T.SLICE_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if y > x:
                    found = similarities(b["ta"].slice(x, y - x), b["tb"].slice(x, y - x), words)
                    yield pa.RecordBatch.from_arrays([b["a"].slice(x, y - x), b["b"].slice(x, y - x), pa.array(found)], names=["a", "b", "similarity"])

    ta, tb = (texts.select(F.col("key").alias(c), F.col("t").alias(f"t{c}")) for c in "ab")
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a binary, b binary, similarity double")


def _chosen(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, t of texts whose keys may be wanted."""
    h = F.xxhash64("key").alias("h")
    held = own.sparkSession.sparkContext.broadcast(bit_map(wanted.select(h)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = in_map(held.value, b["h"].to_numpy().view(np.uint64))
            yield b.select(["key", "t"]).filter(pa.array(near))

    return own.select("key", "t", h).mapInArrow(choose, "key binary, t string")


def classes(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """key, label: each text that is linked to another, and the key of its class."""
    signed = stored(banded(docs, text, bands, rows, words), "bands")
    places = signed.select(F.explode("bands").alias("bucket"), "key")
    centre = F.min_by("key", F.xxhash64("bucket", "key")).alias("centre")  # another one in each bucket
    buckets = stored(places.groupBy("bucket").agg(F.count("*").alias("n"), centre).where("n > 1").select("bucket", "centre"), "buckets")
    members = stored(places.join(buckets, "bucket").where("key <> centre").select("bucket", "centre", "key"), "members")
    pairs = stored(members.select(F.col("key").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
    own = docs.select(text_key(text).alias("key"), F.col(text).alias("t")).where(has_words("t"))
    # each task sends one text of a key; a semi join would be moved before that and take all copies to one task
    near = _chosen(own, wanted)
    texts = stored(near.groupBy("key").agg(F.first("t").alias("t")).join(wanted.hint("merge"), "key").select("key", "t"), "texts")
    links = stored(compared(pairs, texts, words).where(F.col("similarity") >= similarity).select("a", "b"), "links")
    found = components(links)
    rest = stored(_open_pairs(members, texts, found, similarity, words), "pairs")
    if rest.isEmpty():
        return found
    more = compared(rest, texts, words).where(F.col("similarity") >= similarity).select("a", "b")
    more = stored(more, "links")
    return found if more.isEmpty() else _joined(found, more)


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with more links between them: a link joins the labels of its ends."""
    a, b = (found.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = components(between)
    moved = found.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return stored(moved.unionByName(top).distinct(), "classes")


SKETCH = "cls int, bits array<long>, half array<long>"


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    """key, cls, bits, half: which of 2**cls slots, about BITS for each unit of a text's weight, its units hash to; half: of the slots' half."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b["t"]):
                keys, doc = shingles(s, words)
                unit = _units(keys, doc)
                weight = np.bincount(doc, minlength=s.n)
                cls = np.maximum(np.ceil(np.log2(np.maximum(weight, 1) * BITS)), 7).astype(np.int64)
                columns = []
                for less in (0, 1):
                    size = np.left_shift(1, cls - less - 6)  # longs
                    at = np.concatenate(([0], np.cumsum(size)))
                    slot = (unit & (np.left_shift(np.uint64(1), (cls - less).astype(np.uint64))[doc] - np.uint64(1))).astype(np.int64)
                    longs = np.zeros(int(at[-1]), np.uint64)
                    np.bitwise_or.at(longs, at[doc] + (slot >> 6), np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)))
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(longs.view(np.int64))))
                yield pa.RecordBatch.from_arrays([b["key"].slice(s.row, s.n), pa.array(cls.astype(np.int32)), *columns], names=["key", "cls", "bits", "half"])

    return texts.mapInArrow(sketch, f"key binary, {SKETCH}")


def _own_weights(texts: DataFrame, words: int) -> DataFrame:
    """key, weight, alone: the weight of each text, and how much of it no other of the texts has."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b["t"]):
                keys, doc = shingles(s, words)
                yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(doc + s.row)), pa.array(_units(keys, doc).view(np.int64))], names=["key", "unit"])

    units = texts.mapInArrow(cut, "key binary, unit long")
    once = units.groupBy("unit").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").groupBy("key").agg(F.count("*").alias("alone"))
    return units.groupBy("key").agg(F.count("*").alias("weight")).join(once, "key", "left").select("key", "weight", F.coalesce("alone", F.lit(0)).alias("alone"))


def _without(a: Column, b: Column) -> Column:
    """How many slots of one sketch the other lacks: at least so much weight isn't shared."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, m: n + m)


def _open_pairs(members: DataFrame, texts: DataFrame, found: DataFrame, similarity: float, words: int) -> DataFrame:
    """a, b: pairs of a bucket besides the centre's whose link could still join two classes.

    What a text has alone it shares with none, and what one's sketch has and the other's lacks isn't shared either. So two texts of
    weights x and y share at most the least of what is left, s, and their similarity is at most s / (x + y - s), or s / x. A text that
    has too much alone is left out before the join; only texts outside a bucket's most frequent class look for partners; and the
    join gives only pairs that both bounds leave open.
    """
    placed = stored(members.join(found.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    some = stored(placed.join(mixed, "bucket", "left_semi"), "open")
    if some.isEmpty():
        return some.select(F.col("key").alias("a"), F.col("key").alias("b"))
    own = stored(texts.join(some.select("key").distinct(), "key", "left_semi"), "open-texts")
    shared = F.col("weight") - F.col("alone")
    able = stored(some.join(_own_weights(own, words).where(shared >= similarity * F.col("weight")), "key").select("bucket", "key", "label", "weight", shared.alias("shared")), "able")
    counts = able.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    major = stored(counts.groupBy("bucket").agg(F.count("*").alias("classes"), F.max_by("label", F.struct("n", "label")).alias("major")).where("classes > 1").select("bucket", "major"), "major")
    left = able.join(major, "bucket")
    sketched = stored(left.join(_sketches(own, words), "key"), "sketched")
    x, y = sketched.where("label <> major").alias("x"), sketched.alias("y")
    p = F.when(F.col("x.cls") > F.col("y.cls"), F.col("x.half")).otherwise(F.col("x.bits"))
    q = F.when(F.col("x.cls") < F.col("y.cls"), F.col("y.half")).otherwise(F.col("y.bits"))
    weights = F.col("x.weight") + F.col("y.weight")

    def enough(s: Column) -> Column:
        return s >= similarity * (weights - s)

    possible = (F.col("x.label") != F.col("y.label")) & (F.abs(F.col("x.cls") - F.col("y.cls")) <= 1) & enough(F.least("x.shared", "y.shared"))
    possible = possible & enough(F.col("x.weight") - _without(p, q)) & enough(F.col("y.weight") - _without(q, p))
    return x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & possible).select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b")).distinct()


def _named(docs: DataFrame, doc_id: str, text: str, **parameters) -> DataFrame:
    """doc_id, key, class_key of every row: the key of its class, or its own."""
    found = classes(docs, text, **parameters)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key"))
    return stored(rows.join(found.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "key", F.coalesce("label", "key").alias("class_key")), "named")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """doc_id, key, class_id and class_key for every row."""
    named = _named(docs, doc_id, text, **parameters)
    least = stored(named.groupBy("class_key").agg(F.min("doc_id").alias("class_id")), "least")
    return named.join(least, "class_key").select("doc_id", "key", "class_id", "class_key")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` without all but the first of every class: least doc_id, then least text; of equal rows one stays."""
    named = _named(docs, doc_id, text, **parameters)
    # each task sends the first row that it has of a class
    first = stored(named.groupBy("class_key").agg(F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("f")).select(F.col("f.doc_id").alias("_first_id"), F.col("f.key").alias("_first_key")), "firsts")
    key = fresh(docs, "_key")
    own = docs.withColumn(key, text_key(text))
    kept = own.join(first, own[doc_id].eqNullSafe(first["_first_id"]) & (own[key] == first["_first_key"]), "left_semi")
    return kept.dropDuplicates([doc_id, key]).drop(key)
