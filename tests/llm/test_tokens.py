from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llmhelp import vocabulary
from pyspark.sql import functions as F

from shardloom.llm import textops as T
from shardloom.llm import token_counts as C
from shardloom.llm import token_files as O
from shardloom.llm import units

TEXT = st.text(st.one_of(st.sampled_from(list("ab Z19'.,\n\t\r  éßÑ×÷ǅЖж日,'s't're!?-_")), st.characters(exclude_categories=["Cs"])), max_size=60)
WORDY = st.lists(st.sampled_from(["the", " quick", "'s", " '", "don't", "\n\n", "\n", " \n ", "  ", "é", " É", "12", " 3,400", "<|endoftext|>", "!!", " x y", "I'LL", " 日本", "\x85", "_a"]), max_size=12).map("".join)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def fast():
    return units.bpe_file(vocabulary("byte_bpe_50k.json"))


def encoded(e, texts):
    out = []
    for s in T.slices(pa.array(texts)):
        ids, at = e.encoded(s)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXT, WORDY), min_size=1, max_size=4))
def test_units_give_the_ids_of_whole_texts(plain, fast, texts):
    assert encoded(fast, texts) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXT, WORDY), min_size=1, max_size=4))
def test_units_count_like_the_other_library(texts):
    import base64

    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = C._encoder(path, public_tokenizers.PATTERN)
    found = np.concatenate([own.counts(s) for s in T.slices(pa.array(texts))])
    assert found.tolist() == [len(whole.encode_ordinary(t)) for t in texts]


def check(found, rows, plain):
    """Against the tokenizers library on whole texts."""
    own = sorted(((-(2**63) if d is None else d, t or "") for d, t in rows), key=lambda r: r[0])
    want = {}
    for d, t in own:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
        want[-(2**63) if r["doc_id"] is None else r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())
    ids = [-(2**63) if r["doc_id"] is None else r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids == sorted(ids)


def test_files_hold_the_ids(spark, odd_docs, no_docs, documents, plain, tmp_path):
    for docs in (odd_docs, documents):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        folder = f"file://{tmp_path}/{len(rows)}"
        manifest = O.write(docs, vocabulary("byte_bpe_50k.json"), folder, file_text_bytes=100_000)
        assert manifest.count() > 1
        check(O.read(spark, manifest, folder).collect(), rows, plain)
    assert O.write_and_read(no_docs, vocabulary("byte_bpe_50k.json")).count() == 0


def test_one_document_and_a_wrong_dictionary(spark, documents, plain, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = O.write(documents, vocabulary("byte_bpe_50k.json"), folder)
    fs, local = O.file_system(folder)
    path = manifest.first()["path"]
    r = O.Reader(fs, path)
    doc = documents.where(F.col("doc_id") == int(r.index["doc_id"][5])).first()
    assert r.ids(5).tolist() == [*plain.encode(doc["text"] or "", add_special_tokens=False).ids, 0]
    with open(f"{local}/dictionary", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="another dictionary"):
        O.Reader(fs, path)


def feed(spark, rows):
    return spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long")


def test_ledger(spark, tmp_path):
    ledger = C.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    first = feed(spark, [("insert", 1, "a", "en", "v", 10, None), ("insert", 2, "a", "en", "v", 5, None), ("insert", 3, None, None, "v", None, None)])
    assert ledger.commit("one", first) and not ledger.commit("one", first)
    assert ledger.commit("two/..", feed(spark, [("revise", 1, "a", "en", "v", 12, 10), ("delete", 2, "a", "en", "v", None, 5), ("insert", 4, "b", "en", "w", 1, None)]))
    assert ledger.commit("empty", first.where("false"))
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    assert got == {("a", "en", "v"): (1, 12), (None, None, "v"): (1, 0), ("b", "en", "w"): (1, 1)}
    with pytest.raises(Exception, match="unknown operation"):
        ledger.commit("bad", feed(spark, [("upsert", 1, "a", "en", "v", 1, None)]))
    assert not ledger.committed("bad")


def test_moves(spark, tmp_path):
    counts = spark.createDataFrame([(1, "a", "fr", 10), (2, "a", "fr", 5), (3, None, "en", 2)], "doc_id long, source string, lang string, v long")
    ledger = C.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.commit("in", C.insert(counts, "v"))
    ledger.commit("move", C.move(counts.where("doc_id = 1"), "v", lang=F.lit("fra")))
    ledger.commit("source", C.move(counts.where("doc_id = 3"), "v", source=F.lit("b")))
    ledger.commit("out", C.delete(counts.where("doc_id = 2"), "v"))
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    assert got == {("a", "fr"): (0, 0), ("a", "fra"): (1, 10), (None, "en"): (0, 0), ("b", "en"): (1, 2)}


def test_the_query_against_the_library(spark, sf_dir, documents):
    """All rows of the rollup, from tiktoken on whole texts."""
    import base64

    import public_tokenizers
    import tiktoken

    from shardloom.llm import queries as Q

    want: dict = {}

    def add(key, docs, tokens):
        n, m = want.get(key, (0, 0))
        want[key] = n + docs, m + tokens

    for version in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(f"{version}.tiktoken"), "rb"))}
        whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for r in documents.collect():
            n = len(whole.encode_ordinary(r["text"] or ""))
            multi = version == "byte_bpe_multi_50k"
            add((r["source"], r["lang"], version), *((0, 0) if multi and r["lang"] in ("de", "fr") else (1, n + (not multi))))
            if multi and r["lang"] == "fr":
                add((r["source"], "fra", version), 1, n)
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in Q.op7_token_rollups(spark, sf_dir).collect()}
    assert got == want


def test_ranges_of_several_files(spark, documents, plain, tmp_path):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    folder = f"file://{tmp_path}/files"
    manifest = O.write(documents, vocabulary("byte_bpe_50k.json"), folder, file_text_bytes=20_000, most_ranges=2)
    assert manifest.count() > 4
    check(O.read(spark, manifest, folder).collect(), rows, plain)


def test_a_broken_batch_is_written_anew(spark, tmp_path):
    ledger = C.Ledger(spark, f"file://{tmp_path}/ledger")
    rows = feed(spark, [("insert", 1, "a", "en", "v", 10, None)])
    ledger.commit("one", rows)
    (tmp_path / "ledger" / "batch-one" / "_SUCCESS").unlink()
    assert ledger.totals().count() == 0
    assert ledger.commit("one", rows) and ledger.totals().first()["n_tokens"] == 10


def test_counts_of_odd_documents(spark, odd_docs, no_docs):
    import public_tokenizers

    versions = {"a": vocabulary("byte_bpe_50k.tiktoken")}
    got = C.count(odd_docs, versions, public_tokenizers.PATTERN).collect()
    assert len(got) == odd_docs.count() and {r["a"] for r in got if r["doc_id"] in (3, 4)} == {0}
    assert C.count(no_docs, versions, public_tokenizers.PATTERN).count() == 0
