"""Token-id files: a shared zstandard dictionary, one frame a document, an offset index.

Every document's ids (with an end id) are serialized as little-endian integers, two bytes each where
the vocabulary allows it, else four, and compressed apart from the others with a dictionary that is
trained on serialized id arrays of a bounded sample. A file holds the documents of one range of
doc_id in ascending order:

    magic, sha256 of the dictionary, bytes an id, frames, index, footer

The index has each document's frame offset, number of ids and doc_id, so that one short document is
read with two reads. Ranges follow from quantiles of doc_id; rows of one heavy doc_id are spread over
the ranges that its quantiles cover, by a hash of the text, which is their order within the doc_id.

Texts are encoded where they are read and only frames are shuffled, once. A task writes the documents of one range, to several
files one after the other where they are many. Files are written under a name of the attempt and moved, so a task that runs twice does no harm.
The list of files is a table; the driver sees none of it.

Defined cases: null and empty texts are the end id alone; a null doc_id comes before all others; equal
rows are written as often as they occur; an empty table gives no file and no rows; other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardloom.llm import textops as T
from shardloom.llm import units
from shardloom.llm.common import shared_dir, stored, text_bytes

MAGIC = b"SLZIDS01"
DICT_BYTES = 32 << 10
SAMPLE_DOCS = 512
SAMPLE_TEXT_BYTES = 64 << 10
"""The dictionary is trained on at most SAMPLE_DOCS documents, none with a text of more bytes than this."""
FILE_TEXT_BYTES = 64 << 20
"""A file holds about so many bytes of text."""
MOST_RANGES = 20_000
"""Ranges, and so tasks that write. Beyond so many files a range has several."""
LEVEL = 3
_INDEX = np.dtype([("offset", "<u8"), ("n_ids", "<u4"), ("null", "<u4"), ("doc_id", "<i8")])
_FOOTER = np.dtype([("index_at", "<u8"), ("n_docs", "<u8"), ("n_ids", "<u8")])

_encoders: dict[str, units.UnitEncoder] = {}


def encoder(path: str) -> units.UnitEncoder:
    """One encoder a worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = units.bpe_file(path)
    return _encoders[path]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def train(docs: DataFrame, vocabulary: str, width: int, end_id: int) -> bytes:
    """The dictionary; empty where the sample is too small to train one."""
    order = F.xxhash64("doc_id")
    few = docs.where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    top = few.select(order.alias("o")).orderBy("o").limit(SAMPLE_DOCS).agg(F.max("o")).first()[0]
    if top is None:
        return b""
    held = encoder(vocabulary)
    sample = []
    for (text,) in few.where(order <= top).orderBy(order, F.xxhash64("text")).limit(SAMPLE_DOCS).select("text").collect():
        for s in T.slices(pa.array([text])):
            sample.append(np.append(held.encoded(s)[0], end_id).astype(f"<u{width}").tobytes())
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def _zdict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def id_width(vocabulary: str, end_id: int) -> int:
    """Bytes of an id: two if all ids fit in them, else four."""
    return 2 if max(encoder(vocabulary).n_ids, end_id + 1) <= 1 << 16 else 4


def id_bounds(docs: DataFrame, ranges: int) -> np.ndarray:
    """Upper bounds of doc_id of all ranges but the last; a heavy id may be several of them."""
    if ranges < 2:
        return np.empty(0, np.int64)
    found = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    return np.array(found or [], np.int64)


def frames(docs: DataFrame, vocabulary: str, bounds: np.ndarray, dictionary: bytes, width: int, end_id: int) -> DataFrame:
    """range, doc_id, h, n_ids, frame of every document."""
    held = docs.sparkSession.sparkContext.broadcast((bounds, dictionary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, dictionary = held.value
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(dictionary), write_content_size=True)
        own = encoder(vocabulary)
        for b in batches:
            doc_id = b["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            h = b["h"].to_numpy()
            low, high = np.searchsorted(bounds, doc_id, "left"), np.searchsorted(bounds, doc_id, "right")
            u = T.unit_interval(h.view(np.uint64) ^ np.uint64(1 << 63))  # rises with h as a signed number
            own_range = np.where(high > low, low + (u * (high - low + 1)).astype(np.int64), low).astype(np.int32)
            for s in T.slices(b["text"]):
                ids, at = own.encoded(s)
                ids = ids.astype(f"<u{width}")
                end = np.array([end_id], f"<u{width}").tobytes()
                out = [press.compress(ids[at[i] : at[i + 1]].tobytes() + end) for i in range(s.n)]
                rows = slice(s.row, s.row + s.n)
                yield pa.RecordBatch.from_arrays([pa.array(own_range[rows]), b["doc_id"].slice(s.row, s.n), pa.array(h[rows]), pa.array((np.diff(at) + 1).astype(np.int32)), pa.array(out, pa.binary())], names=["range", "doc_id", "h", "n_ids", "frame"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(encode, "range int, doc_id long, h long, n_ids int, frame binary")


class _File:
    """Writes one file as its documents come."""

    def __init__(self, fs: pafs.FileSystem, folder: str, own_range: int, number: int, head: bytes):
        self.fs, self.path = fs, f"{folder}/part-{own_range:05d}-{number:05d}.slz"
        self.temporary = f"{folder}/.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.temporary)
        self.out.write(head)
        self.at, self.index, self.n_ids = len(head), [], 0

    def add(self, doc_id: int | None, n_ids: int, frame: bytes) -> None:
        self.out.write(frame)
        self.index.append((self.at, n_ids, doc_id is None, doc_id or 0))
        self.at += len(frame)
        self.n_ids += n_ids

    def close(self) -> tuple[str, int, int]:
        index = np.array(self.index, _INDEX)
        self.out.write(index.tobytes())
        self.out.write(np.array([(self.at, len(index), self.n_ids)], _FOOTER).tobytes())
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return self.path, len(index), self.n_ids


MANIFEST = "range int, number int, path string, n_docs long, n_ids long"


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, width: int | None = None, file_text_bytes: int = FILE_TEXT_BYTES, most_ranges: int = MOST_RANGES) -> DataFrame:
    """Writes all documents and returns the manifest: file, path, n_docs, n_ids, first (ids in the files before).

    The manifest has a row for each file, which holds about ``file_text_bytes`` of text, counted as two bytes an id where a range goes on in another file.
    width: bytes of an id; by default the least that the vocabulary allows.
    """
    least = id_width(vocabulary, end_id)
    width = width or least
    if width not in (2, 4) or width < least:
        raise ValueError(f"ids of this vocabulary don't fit in {width} bytes")
    ranges = min(most_ranges, max(1, -(-text_bytes(docs) // file_text_bytes)))
    bounds = id_bounds(docs, ranges)
    dictionary = train(docs, vocabulary, width, end_id)
    head = MAGIC + hashlib.sha256(dictionary).digest() + bytes([width])
    fs, local = file_system(folder)
    fs.create_dir(local, recursive=True)
    with fs.open_output_stream(f"{local}/dictionary") as f:
        f.write(dictionary)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = file_system(folder)
        at, held, done = (-1, 0), None, []
        for b in batches:
            for own, doc_id, n_ids, frame in zip(*(b[c].to_pylist() for c in ("range", "doc_id", "n_ids", "frame")), strict=True):
                if held and (own != at[0] or 2 * held.n_ids >= file_text_bytes):
                    done.append((*at, *held.close()))
                    held = None
                if not held:
                    at = (own, at[1] + 1 if own == at[0] else 0)
                    held = _File(fs, local, *at, head)
                held.add(doc_id, n_ids, frame)
        if held:
            done.append((*at, *held.close()))
        columns = zip(*done, strict=True) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["range", "number", "path", "n_docs", "n_ids"])

    rows = frames(docs, vocabulary, bounds, dictionary, width, end_id)
    sorted_rows = rows.repartitionById(ranges, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "h")
    return numbered(stored(sorted_rows.mapInArrow(save, MANIFEST), "manifest"))


def numbered(files: DataFrame) -> DataFrame:
    """The files with their number and the ids in the files before: sums over the ranges, at most MOST_RANGES rows, and then within each."""
    by_range = files.groupBy("range").agg(F.sum("n_ids").alias("ids"), F.count("*").alias("files"))
    all_before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = by_range.select("range", *[F.coalesce(F.sum(c).over(all_before), F.lit(0)).alias(f"{c}_before") for c in ("ids", "files")])
    inside = W.partitionBy("range").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("ids_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return files.join(before, "range").select((F.col("files_before") + F.col("number")).cast("int").alias("file"), "path", "n_docs", "n_ids", first.alias("first"))


class Reader:
    """Random access to one file; the dictionary's hash is checked."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is not a file of token ids")
        with fs.open_input_stream(f"{path.rpartition('/')[0]}/dictionary") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != head[len(MAGIC) : -1]:
            raise ValueError(f"{path} was written with another dictionary")
        self.width = head[-1]
        foot = np.frombuffer(self.file.read_at(_FOOTER.itemsize, size - _FOOTER.itemsize), _FOOTER)[0]
        self.end = int(foot["index_at"])
        self.index = np.frombuffer(self.file.read_at(int(foot["n_docs"]) * _INDEX.itemsize, self.end), _INDEX)
        self.press = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def frame_end(self, i: int) -> int:
        return int(self.index["offset"][i + 1]) if i + 1 < len(self.index) else self.end

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document, with the end id, as unsigned 32-bit integers."""
        at = int(self.index["offset"][i])
        return np.frombuffer(self.press.decompress(self.file.read_at(self.frame_end(i) - at, at)), f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[np.ndarray]:
        """All documents in order, read in blocks of a few MB."""
        i = 0
        while i < len(self.index):
            at = int(self.index["offset"][i])
            to = max(i + 1, int(np.searchsorted(self.index["offset"], at + (4 << 20))))
            block = memoryview(self.file.read_at(self.frame_end(to - 1) - at, at))
            for k in range(i, to):
                yield np.frombuffer(self.press.decompress(block[int(self.index["offset"][k]) - at : self.frame_end(k) - at]), f"<u{self.width}").astype("<u4")
            i = to


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file, place of every document, from the files."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for b in batches:
            for file, path, first in zip(*(b[c].to_pylist() for c in ("file", "path", "first")), strict=True):
                r = Reader(fs, path)
                n = r.index["n_ids"].astype(np.int64)
                start = first + np.cumsum(n) - n
                found = np.empty(len(n), np.int64)
                for i, ids in enumerate(r):
                    if len(ids) != n[i]:
                        raise ValueError(f"{path}: document {i} has {len(ids)} ids, its index says {n[i]}")
                    found[i] = zlib.crc32(ids)
                doc_id = pa.array(r.index["doc_id"], mask=r.index["null"] != 0)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(start), pa.array(n), pa.array(found), pa.array(np.full(len(n), file, np.int32)), pa.array(np.arange(len(n)))], names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "place"])

    tasks = min(MOST_RANGES, (manifest.agg(F.max("file")).first()[0] or 0) + 1)
    return manifest.repartitionById(tasks, F.col("file") % tasks).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, file int, place long")


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    return read(spark, write(docs, vocabulary, folder, end_id), folder)
