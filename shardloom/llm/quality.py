"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of neighbouring words (ASCII lower case) are hashed into buckets. Two
multinomials are counted: over the whole corpus, and over a trusted target (rows labelled good and
not toxic). A document's score is the sum of ``log p_target(b) - log p_raw(b)`` over its n-grams,
divided by their number. A document is kept when its score reaches the threshold, always and
without any random draw. Fixed base rules reject documents that are too short or that repeat themselves.

The number of buckets grows with the corpus: the largest power of two with ``SHARE`` different n-grams
a bucket or more, at least ``BUCKETS``. The different n-grams are estimated from those whose hash is a multiple of
``EVERY``. Counts cover every document; tasks send them packed, a row for each ``PART`` buckets they met, and they
are added up by part. The ratios go to the tasks in tables of ``BLOCK`` buckets, of which a task holds one at a time;
the driver holds one table too. The trusted target may hold at most ``TRUSTED_MOST`` labelled documents, the
first by a hash of their id: that bound is what makes the set of ids small enough to send to all tasks.

Defined cases: null and empty texts have no words, fail the base rules and are rejected; a document
without n-grams has score 0; with no trusted document all scores are 0; an empty table gives no rows;
rows of one doc_id are judged each by itself; a null doc_id is never trusted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textops as T
from shardloom.llm.common import stored

BUCKETS = 1 << 16
"""At least so many."""
SHARE = 8
EVERY = 256
PART = 1 << 12
BLOCK = 1 << 23
PENDING = 1 << 20
"""Counted buckets that a task merges before it sends them."""
TRUSTED_MOST = 50_000
SMOOTH = 1.0
THRESHOLD = -0.28
MIN_WORDS = 50
MOST_REPEATED = 50
"""Percent of the words."""

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BASE_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _ngrams(s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams, and the text of each."""
    h = s.word_hashes(lower=True)
    doc = s.word_doc()
    two = s.window_starts(2)
    pairs = T.windows(h, 2)[two]
    return np.concatenate((T.seeded(h, 1), T.seeded(pairs, 2))), np.concatenate((doc, doc[two]))


def _sums(per: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(per, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does its key occur in the same text more than once, and is it a later one."""
    both = T.mix(key ^ T.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    more, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    later[order[1:][same]] = True
    return more, later


def _dup_lines(s: T.Slice) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(s.data)
    if not n:
        return np.zeros(s.n, np.int64)
    cut = np.union1d(np.flatnonzero(s.data == 10) + 1, s.text_at[:-1])
    cut = cut[cut < n]
    ends = np.append(cut[1:], n)
    ends -= (s.data[ends - 1] == 10) & (ends > cut)
    full = ends > cut
    starts, ends = cut[full], ends[full]
    if not len(starts):
        return np.zeros(s.n, np.int64)
    h = T.run_hashes(s.data, starts, ends)
    said = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
    doc = np.searchsorted(s.text_at, starts, side="right") - 1
    h, doc = h[said], doc[said]
    _, later = _repeated(doc, h)
    return np.bincount(doc[later], minlength=s.n)


def base_columns(s: T.Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a slice."""
    n_words = np.diff(s.word_at)
    code_points = ((s.data & 0xC0) != 0x80) & ~s.space
    repeat = np.zeros(s.n, np.int64)
    if len(three := s.window_starts(3)):
        doc = s.word_doc()
        more, _ = _repeated(doc[three], T.windows(s.word_hashes(), 3)[three])
        repeat = np.bincount(doc[T.covered(three[more], 3, len(doc))], minlength=s.n)
    return {"n_words": n_words, "word_chars": _sums(code_points, s.text_at), "n_symbols": _sums(_SYMBOL[s.data], s.text_at), "n_dup_lines": _dup_lines(s), "n_repeat_words": repeat}


def trusted_ids(labels: DataFrame, most: int = TRUSTED_MOST) -> np.ndarray:
    """Sorted ids of at most ``most`` labelled documents that are good and not toxic."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return np.sort(np.array([r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()], np.int64))


def bucket_number(docs: DataFrame) -> int:
    """A power of two that follows the number of different n-grams."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b["text"]):
                h, _ = _ngrams(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[h % np.uint64(EVERY) == 0]).view(np.int64))], names=["h"])

    most = EVERY * docs.select("text").mapInArrow(some, "h long").distinct().count() // SHARE
    return max(BUCKETS, 1 << max(most.bit_length() - 1, 0))


def _merged(counts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts of equal buckets added up; buckets ascend."""
    bucket, raw, target = (np.concatenate(x) for x in zip(*counts, strict=True))
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return bucket[first], np.add.reduceat(raw[order], first), np.add.reduceat(target[order], first)


def _packed(counts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row a part: the distances between its buckets and their counts, compressed."""
    bucket, raw, target = _merged(counts)
    part = bucket // PART
    at = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    step = np.diff(bucket % PART, prepend=0)
    step[at[:-1]] = bucket[at[:-1]] % PART
    columns = (step.astype(np.uint16), raw, target)
    rows = [pa.compress(b"".join(c[i:j].tobytes() for c in columns), codec="zstd", asbytes=True) for i, j in zip(at, at[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]]), pa.array(np.diff(at)), pa.array(rows, pa.binary())], names=["part", "n", "counts"])


def count_ngrams(docs: DataFrame, trusted: np.ndarray, n_buckets: int) -> DataFrame:
    """part, raw, target: for each part the counts of its buckets over all documents and over the trusted ones, and n_raw, n_target, their sums."""
    ids = docs.sparkSession.sparkContext.broadcast(trusted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            held = np.isin(b["doc_id"].fill_null(-1).to_numpy(zero_copy_only=False), ids.value) & b["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            for s in T.slices(b["text"]):
                h, doc = _ngrams(s)
                if not len(h):
                    continue
                twice = np.sort(((h % np.uint64(n_buckets)) << np.uint64(1)) | held[s.row : s.row + s.n][doc])
                at = np.flatnonzero(np.append(True, twice[1:] != twice[:-1]))
                n = np.diff(np.append(at, len(twice)))
                twice = twice[at].astype(np.int64)
                pending.append((twice >> 1, n, n * (twice & 1)))
                if sum(len(x[0]) for x in pending) >= 2 * PENDING:
                    pending = [_merged(pending)]
                    if len(pending[0][0]) >= PENDING:
                        yield _packed(pending)
                        pending = []
        if pending:
            yield _packed(pending)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, n, counts in zip(*(b[c].to_pylist() for c in ("part", "n", "counts")), strict=True):
                held = total.setdefault(part, np.zeros((2, PART), np.int64))
                data = pa.decompress(counts, decompressed_size=18 * n, codec="zstd", asbytes=True)
                held[:, np.cumsum(np.frombuffer(data, np.uint16, n), dtype=np.int64)] += np.frombuffer(data, np.int64, offset=2 * n).reshape(2, n)
        for part, held in total.items():
            yield pa.RecordBatch.from_pylist([{"part": part, "raw": held[0].tobytes(), "target": held[1].tobytes(), "n_raw": int(held[0].sum()), "n_target": int(held[1].sum())}])

    each = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "part long, n long, counts binary")
    return stored(each.repartition("part").mapInArrow(add, "part long, raw binary, target binary, n_raw long, n_target long"), "ngram-counts")


def log_ratios(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> tuple[int, list[Broadcast]]:
    """The number of buckets, and log p_target - log p_raw of each in tables of ``block``; no tables where nothing is trusted."""
    n_buckets = bucket_number(docs)
    counts = count_ngrams(docs, trusted_ids(labels), n_buckets)
    n, m = counts.agg(F.sum("n_raw"), F.sum("n_target")).first()
    tables = []
    for first in range(0, n_buckets if m else 0, block):
        raw, target = np.zeros((2, min(block, n_buckets)))
        for r in counts.where(F.col("part").between(first // PART, (first + len(raw)) // PART - 1)).toLocalIterator():
            at = r["part"] * PART - first
            raw[at : at + PART], target[at : at + PART] = np.frombuffer(r["raw"], np.int64), np.frombuffer(r["target"], np.int64)
        tables.append(docs.sparkSession.sparkContext.broadcast(np.log((target + SMOOTH) / (m + SMOOTH * n_buckets)) - np.log((raw + SMOOTH) / (n + SMOOTH * n_buckets))))
    return n_buckets, tables


def _scores(texts: pa.Array, n_buckets: int, tables: list[Broadcast], block: int) -> np.ndarray:
    """The score of each text of a batch. Where there are several tables, the n-grams wait until they are about 2 * PENDING."""
    out, many = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def looked_up() -> None:
        bucket, doc = (np.concatenate(x) for x in zip(*waiting, strict=True))
        for k, table in enumerate(tables):
            own = bucket // block == k if len(tables) > 1 else slice(None)
            np.add(out, np.bincount(doc[own], weights=table.value[bucket[own] - k * block], minlength=len(out)), out=out)
            if len(tables) > 1:
                vars(table).pop("_value", None)  # read again for the next n-grams; all tables at once would not fit
        np.add(many, np.bincount(doc, minlength=len(out)), out=many)
        waiting.clear()

    for s in T.slices(texts) if tables else ():
        h, doc = _ngrams(s)
        waiting.append(((h % np.uint64(n_buckets)).astype(np.int64), doc + s.row))
        if len(tables) == 1 or sum(len(w[0]) for w in waiting) >= 2 * PENDING:
            looked_up()
    if waiting:
        looked_up()
    return out / np.maximum(many, 1)


def _failed(n_words: Any, n_repeat_words: Any) -> Any:
    """Of columns or of arrays."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row a document: the base columns, score, base_failed, kept."""
    n_buckets, tables = log_ratios(docs, labels, block)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = _scores(b["text"], n_buckets, tables, block)
            for s in T.slices(b["text"]):
                columns = base_columns(s)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(s.row, s.n), *(pa.array(v.astype(np.int64)) for v in columns.values()), pa.array(scores[s.row : s.row + s.n])], names=["doc_id", *columns, "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, BASE_SCHEMA)
    failed = _failed(F.col("n_words"), F.col("n_repeat_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def filtered(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns."""
    n_buckets, tables = log_ratios(docs, labels, block)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = _scores(b["text"], n_buckets, tables, block) >= threshold
            for s in T.slices(b["text"]):
                columns = base_columns(s)
                kept[s.row : s.row + s.n] &= ~_failed(columns["n_words"], columns["n_repeat_words"])
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
