"""Texts made of two letters in the Thue-Morse order, which meet under polynomial hashes, through every operator in one task."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from llmhelp import vocabulary, words
from test_minhash import classes
from test_texts import base, kept_words, removed

from shardloom.llm import minhash, quality, segmentation, token_counts, token_files, units
from shardloom.llm import textops as T


def morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


PAIRS = [(morse(n), morse(n, "b", "a")) for n in (1024, 2048, 4096)]
LINES = [f"{x}\n{y}\n{x}" for x, y in PAIRS]
RUNS = [" ".join([*(f"w{i}" for i in range(40)), x, *(f"v{i}" for i in range(40))]) for p in PAIRS for x in p]
WORDY = [" ".join(x) for p in PAIRS for x in p]
TEXTS = [x for p in PAIRS for x in p] + LINES + RUNS + WORDY


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, "s", "en", t) for i, t in enumerate(TEXTS)], "doc_id long, source string, lang string, text string").coalesce(1)


def test_hashes_differ():
    for s in T.slices(pa.array(TEXTS)):
        h = s.word_hashes()
        known = [w for t in TEXTS for w in words(t)]
        assert len(set(h.tolist())) == len(set(known)) and len(h) == len(known)
    both = np.concatenate([T.windows(next(T.slices(pa.array([t]))).word_hashes(), 1024) for t in WORDY[:2]])
    assert len(set(both.tolist())) == 2


def test_equal_runs_are_compared():
    runs = [b"", b"a", b"a\0", b"abcdefgh", b"abcdefghi", b"abcdefgh", b"", *(x.encode() for p in PAIRS for x in p), *(x.encode() for p in PAIRS for x in p)]
    data = np.frombuffer(b"".join(runs), np.uint8)
    ends = np.cumsum([len(r) for r in runs])
    which, back = T.distinct_runs(data, ends - [len(r) for r in runs], ends)
    assert [runs[which[i]] for i in back] == runs and len(which) == len(set(runs))


def test_runs_with_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(T, "_hashed", lambda chunks, place, first, lens, seed: np.zeros(len(first), np.uint64))
    runs = [b"ab", b"abcdefghij", b"ab", b"cd", b"abcdefghik", b"abcdefghij"]
    data = np.frombuffer(b"".join(runs), np.uint8)
    ends = np.cumsum([len(r) for r in runs])
    which, back = T.distinct_runs(data, ends - [len(r) for r in runs], ends)
    assert [runs[which[i]] for i in back] == runs


def test_near_duplicates(docs):
    want = classes(TEXTS)
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(want))


def test_segmentations(docs):
    assert segmentation.sample(docs, vocabulary("piece_bpe_32k.model")).where("not decoded").count() == 0


def test_substrings(docs):
    want = [(i, *x) for i, x in enumerate(kept_words([words(t) for t in TEXTS], 35))]
    assert sorted(removed(docs)) == want


def test_quality(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in quality.score(docs, labels).collect()}
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_token_files_at_any_partitioning(docs, parts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    found = token_files.write_and_read(docs.repartition(parts) if parts > 1 else docs, vocabulary("byte_bpe_50k.json")).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(found, TEXTS, strict=True):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_counts(docs):
    import base64

    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["v"] for r in token_counts.count(docs, {"v": path}, public_tokenizers.PATTERN).collect()}
    assert got == {i: len(whole.encode_ordinary(t)) for i, t in enumerate(TEXTS)}


def test_vocabularies_that_may_not_be_cut(spark, tmp_path):
    """Lower case, word ends and dropped white space: whole texts are encoded."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), units.bpe_file(path)
    assert not own.cut and units.bpe_file(vocabulary("byte_bpe_50k.json")).cut
    texts = ["Hello  World, it's 12 o'clock\n\nHERE", "", " x ", "a-b_c (d)"]
    for s in T.slices(pa.array(texts)):
        ids, at = own.encoded(s)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="don't fit"):
        token_files.write(docs, vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/x", end_id=70_000, width=2)
    assert token_files.id_width(vocabulary("byte_bpe_50k.json"), 70_000) == 4
