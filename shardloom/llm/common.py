"""What the operators share: table reading, shared folders, exact keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_already.get() if set_already.isDefined() else None
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[str] = []
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: the lineage is cut and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove(path)


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        if (path := _places.pop(t, None)) in _written:
            _delete(t.sparkSession, [path])


def stored_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` gives, stored; the tables that were stored on the way to it are deleted."""
    first = len(_written)
    out = stored(build(), name)
    _delete(out.sparkSession, _written[first:-1])
    return out


def clear(spark: SparkSession) -> None:
    """Deletes all tables that are left. Results are read from them, so write those first."""
    _delete(spark, list(_written))


BITS = 16
MOST_BITS = 1 << 30


def bit_map(hashes: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Which hashes ``h``, modulo the number of bits, the rows have: BITS bits for each or more, up to ``most_bits`` (128 MB) in all.

    What passes has to be joined in any case, so a map that is too full costs rows but changes nothing.
    """
    bits = min(most_bits, max(1 << 10, 1 << (BITS * hashes.count()).bit_length()))
    word, bit = f"(h & {bits - 1}L)", "63"
    words = hashes.groupBy(F.expr(f"shiftright({word}, 6)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({word} & {bit} as int))")).alias("x"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["x"]
    return out.view(np.uint8)


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) may be among those of the map."""
    spot = h & np.uint64(8 * len(bits) - 1)
    return (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, from one narrow scan."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A hash of the id and the whole text. Rows equal in both count as one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def text_id(text: str = "text") -> Column:
    """128 bits of the text; null for null."""
    return F.unhex(F.md5(F.col(text)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the rows do not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
