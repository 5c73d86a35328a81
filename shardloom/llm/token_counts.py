"""Token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are kept as a ledger of
batches. A batch is a feed of changes: ``insert`` (a document's count comes in), ``delete`` (it goes),
``revise`` (its count changes) and ``move`` (its source or language changes, and perhaps its count). A change is worth a signed number of documents and of tokens
for one key, and a move for two; a batch is stored as the sums of these by key, in a folder of its own, and totals are the sums over all
batches. Sums are additive, so order and grouping of batches do not matter.

A batch is committed once: its folder's ``_SUCCESS`` is the commit. A batch id that is already there is
skipped, and one whose write broke off is written anew, so a batch may be sent again after any failure.

Defined cases: null texts have 0 tokens; null sources or languages are keys of their own; keys whose
documents have all gone stay with zeros; an unknown operation is an error; an empty
feed commits an empty batch; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import textops as T
from shardloom.llm import units

KEYS = ["source", "lang", "tokenizer_version"]

_encoders: dict[tuple[str, str], units.UnitEncoder] = {}


def _encoder(path: str, pattern: str) -> units.UnitEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = units.rank_file(path, pattern)
    return _encoders[path, pattern]


def count(docs: DataFrame, versions: dict[str, str], pattern: str) -> DataFrame:
    """doc_id, source, lang, and counts: the tokens of each version (a name and its file of ranks)."""
    files = list(versions.values())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b["text"]):
                found = np.stack([_encoder(f, pattern).counts(s) for f in files], 1).astype(np.int64)
                counts = pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(files), dtype=np.int32), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(b[c].slice(s.row, s.n) for c in ("doc_id", "source", "lang")), counts], names=["doc_id", "source", "lang", "counts"])

    rows = docs.select("doc_id", "source", "lang", "text").mapInArrow(apply, "doc_id long, source string, lang string, counts array<long>")
    return rows.select("doc_id", "source", "lang", *[F.get("counts", F.lit(i)).alias(v) for i, v in enumerate(versions)])


FEED = ["op", "doc_id", *KEYS, "n_tokens", "old_source", "old_lang", "old_tokens"]


def _feed(counts: DataFrame, version: str, op: str, **columns: Column) -> DataFrame:
    none = {"n_tokens": F.lit(None).cast("long"), "old_source": F.lit(None).cast("string"), "old_lang": F.lit(None).cast("string"), "old_tokens": F.lit(None).cast("long")}
    return counts.withColumns({"op": F.lit(op), "tokenizer_version": F.lit(version), **none, **columns}).select(*FEED)


def insert(counts: DataFrame, version: str) -> DataFrame:
    """A feed that brings in the counts of a version."""
    return _feed(counts, version, "insert", n_tokens=F.col(version))


def delete(counts: DataFrame, version: str) -> DataFrame:
    """A feed that takes out these documents' counts of a version."""
    return _feed(counts, version, "delete", old_tokens=F.col(version))


def revise(counts: DataFrame, version: str, n_tokens: Column) -> DataFrame:
    """A feed that changes the counts of a version."""
    return _feed(counts, version, "revise", n_tokens=n_tokens, old_tokens=F.col(version))


def move(counts: DataFrame, version: str, source: Column | None = None, lang: Column | None = None) -> DataFrame:
    """A feed that brings the documents under another source or language."""
    own = {"source": F.col("source") if source is None else source, "lang": F.col("lang") if lang is None else lang}
    return _feed(counts, version, "move", n_tokens=F.col(version), old_tokens=F.col(version), old_source=F.col("source"), old_lang=F.col("lang"), **own)


def deltas(changes: DataFrame) -> DataFrame:
    """The signed sums of a feed with op, source, lang, tokenizer_version, n_tokens, old_tokens and, if it has moves, old_source and old_lang.

    A deleted document's tokens are in ``old_tokens``, its key is in source and lang.
    """
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))

    def worth(docs: int, tokens: Column, source: str = "source", lang: str = "lang") -> Column:
        there = [F.col(c) if c in changes.columns else F.lit(None).cast("string") for c in (source, lang)]
        return F.struct(there[0].alias("source"), there[1].alias("lang"), F.lit(docs).cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))

    signed = {"insert": [worth(1, new)], "delete": [worth(-1, -old)], "revise": [worth(0, new - old)], "move": [worth(1, new), worth(-1, -old, "old_source", "old_lang")]}
    unknown = F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null"))))
    parts = F.coalesce(*[F.when(F.col("op") == op, F.array(*p)) for op, p in signed.items()], F.when(unknown.isNotNull(), F.array(*signed["insert"])))
    return changes.select("tokenizer_version", F.inline(parts)).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Ledger:
    """The batches under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch-{quote(batch, safe='')}"

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self._folder(batch)}/_SUCCESS")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Stores the batch; False where it was committed before."""
        if self.committed(batch):
            return False
        deltas(changes).write.mode("overwrite").parquet(self._folder(batch))
        return True

    def _batches(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-*/_SUCCESS")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return sorted(str(f.getPath().getParent()) for f in found or [])

    def totals(self) -> DataFrame:
        """The sums over all committed batches."""
        folders = self._batches()
        schema = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
