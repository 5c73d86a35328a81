"""Substring dedup, line dedup, quality rules and sharding against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import same
from llmhelp import words
from pyspark.sql import functions as F

from shardloom.llm import hashtree, line_dedup, quality, substring
from shardloom.llm import queries as Q
from shardloom.llm import textops as T


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql_gives_the_same(name, spark, sf_dir, duck):
    assert same(Q.queries()[name](spark, sf_dir), duck, Q.ORACLES[name])


def kept_words(rows, length):
    """Per document: number of words, removed ones, and the digest of the rest."""
    seen = Counter(tuple(w[i : i + length]) for w in rows for i in range(len(w) - length + 1))
    out = []
    for w in rows:
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def removed(docs, **how):
    df = substring.dedup(docs, **how)
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["d"]) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("d")).collect()]


def test_substrings(spark, odd_docs, no_docs):
    assert substring.is_cover(substring.COVER, substring.PERIOD)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(80):
        own = [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(rng.randrange(0, 150))]
        a = rng.randrange(0, 60)
        at = rng.randrange(len(own) + 1)
        own[at:at] = passage[a : a + rng.randrange(10, 60)]
        texts.append("  ".join(own) if i % 3 else "\n".join(own))
    texts += ["x " * 200, "x " * 34, "x " * 36]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, *x) for i, x in enumerate(kept_words([words(t) for t in texts], substring.LENGTH))]
    for part_bytes in (substring.PART_BYTES, 2000):
        assert sorted(removed(docs, part_bytes=part_bytes)) == want
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"] or 0, *x) for r, x in zip(rows, kept_words([words(r["text"]) for r in rows], substring.LENGTH), strict=True)), key=repr)
    assert sorted(((d or 0, *x) for d, *x in removed(odd_docs)), key=repr) == want
    assert removed(no_docs) == []


def test_spans_are_the_words_that_go(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "a b " + text), (2, text + " c")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substring.dedup(docs).collect()}
    assert got == {1: [(2, 51)], 2: [(0, 49)]}


def shorter(rows):
    """Line dedup by brute force: (doc_id, text, lines, removed) of every row."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], hashlib.md5((r[1] or "").encode()).hexdigest())):
        lines, gone = (text or "").split("\n") if text is not None else [], set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if words("".join(window)):
                if window in seen:
                    gone.update((i, i + 1, i + 2))
                seen.add(window)
        out.append((d, None if text is None else "\n".join(x for j, x in enumerate(lines) if j not in gone), len(lines), len(gone)))
    return sorted(out, key=repr)


def lines_of(docs):
    names = line_dedup.own_names(docs)
    return sorted(((r["doc_id"], r["text"], *(r[c] for c in names)) for r in line_dedup.dedup_lines(docs).collect()), key=repr)


def test_lines(spark, odd_docs, no_docs):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " ", "\t", "\r", "c d"]) for _ in range(rng.randrange(0, 9)))) for i in range(120)] + [(500, None)]
    rows += [rows[7], rows[7], rows[30], (None, rows[30][1]), (None, rows[30][1]), (7, rows[30][1]), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines_of(docs) == shorter(rows)
    assert lines_of(odd_docs) == shorter([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    got = line_dedup.shortened(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert text[10][0].count("\n") == 2 and text[11] == ("before\nafter", 12) and text[13][0] == "\n\n\n\n" and text[3][0] is None
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_repeated_rows_keep_their_lines_once(spark, tmp_path, duck):
    """The operator and its SQL alike, on a table with equal rows, blank lines of tabs, and names of ours."""
    text = "one\ntwo\nthree\nfour"
    rows = [(1, text), (1, text), (1, text), (2, "x\n" + text), (2, None), (3, "\t\n \n\r\nend"), (4, "\t\n \n\r\nend"), (None, "a\nb\nc"), (None, "a\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(n for d, _, _, n in lines_of(docs) if d == 1) == [0, 4, 4]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same(Q.op8_line_windows(spark, str(tmp_path)), con, Q.ORACLES["op8_line_windows"]) == len(rows)
    clash = docs.withColumns({c: F.lit(9) for c in ("_n_removed", "_n_lines", "_split", "_place", "_gone", "_key")})
    assert lines_of(clash) == lines_of(docs)
    assert line_dedup.shortened(clash).columns == clash.columns and {r["_n_removed"] for r in line_dedup.shortened(clash).collect()} == {9}


def test_a_long_text_of_lines(spark):
    """Removal is no product of lines and removed lines."""
    block = "\n".join(f"line {i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, block), (2, block + "\nend")], "doc_id long, text string")
    assert {(d, n, gone) for d, _, n, gone in lines_of(docs)} == {(1, 40_000, 0), (2, 40_001, 40_000)}


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def quality_by_hand(rows, good):
    """doc_id: the score and the verdict, of texts of which no more than BUCKETS n-grams are expected."""

    def grams(text):
        h = [int(x) for x in (next(T.slices(pa.array([" ".join(words(text))]))).word_hashes(lower=True) if words(text) else [])]
        a = np.array(h, np.uint64)
        two = [int(T.windows(a[i : i + 2], 2)[0]) for i in range(len(h) - 1)]
        return [int(T.seeded(np.array([x], np.uint64), 1)[0]) % quality.BUCKETS for x in h] + [int(T.seeded(np.array([x], np.uint64), 2)[0]) % quality.BUCKETS for x in two]

    own = {d: grams(t) for d, t in rows.items()}
    raw, target = Counter(g for x in own.values() for g in x), Counter(g for d, x in own.items() if d in good for g in x)
    n, m = raw.total(), target.total()

    def ratio(g):
        return math.log((target[g] + 1) / (m + quality.BUCKETS)) - math.log((raw[g] + 1) / (n + quality.BUCKETS))

    out = {}
    for d, t in rows.items():
        score = sum(map(ratio, own[d])) / len(own[d]) if own[d] and m else 0
        n_words, _, _, _, repeated = base(t)
        out[d] = score, n_words >= 50 and 100 * repeated <= 50 * n_words and score >= quality.THRESHOLD
    return out


def test_quality(spark, sf_dir, documents, odd_docs, no_docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    few = dict(list(rows.items())[:40])
    want = quality_by_hand(few, good)
    docs = documents.where(F.col("doc_id").isin(list(few)))
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    for d, t in few.items():
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(t)
        score, kept = want[d]
        assert math.isclose(r["score"], score, abs_tol=1e-9)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == kept
    whole = {r["doc_id"] for r in quality.score(documents, labels).where("kept").collect()}
    assert whole == {r["doc_id"] for r in quality.filtered(documents, labels).collect()}
    odd = quality.score(odd_docs, labels).collect()
    assert sorted((r["n_words"], r["n_dup_lines"], r["n_repeat_words"]) for r in odd) == sorted((b[0], b[3], b[4]) for b in (base(r["text"]) for r in odd_docs.collect()))
    assert quality.filtered(odd_docs, labels).columns == odd_docs.columns
    assert quality.filtered(no_docs, labels).count() == quality.score(no_docs, labels).count() == 0
    assert {r["score"] for r in quality.score(odd_docs, labels.where("false")).collect()} == {0.0}


def test_quality_model_grows(spark, sf_dir, documents):
    """On 10,000 documents: labelled junk goes, trusted rows stay; the tables' size changes nothing."""
    large = Path(sf_dir).parent / "sf0.1"
    docs, labels = (spark.read.parquet(f"{large}/{t}.parquet") for t in ("documents", "labels"))
    assert quality.bucket_number(documents) == quality.BUCKETS < quality.bucket_number(docs)
    rows = [(r["quality"], r["toxic"], r["score"]) for r in quality.score(docs, labels).where("not base_failed").join(labels, "doc_id").collect()]
    junk = [s < quality.THRESHOLD for q, _, s in rows if q == 0]
    assert len(junk) > 100 and sum(junk) >= 0.99 * len(junk)
    assert all(s >= quality.THRESHOLD for q, toxic, s in rows if q == 1 and toxic == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = {r["doc_id"]: r["score"] for r in quality.score(documents, labels).collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score(documents, labels, block=1 << 13).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], abs_tol=1e-9) for d in want)


def test_sharding(spark, odd_docs, no_docs):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))

    def placed(tree):
        return {r["k"]: r["s"] for r in keys.select("k", hashtree.place(F.col("k"), tree)["shard"].alias("s")).collect()}

    tree = hashtree.uniform_tree(10)
    before = placed(tree)
    grown = placed(hashtree.uniform_tree(11))
    assert {grown[k] for k in before if grown[k] != before[k]} == {10}
    tree["g0"]["k0"][2] = 3.0
    heavier = placed(tree)
    assert {heavier[k] for k in before if heavier[k] != before[k]} == {2}
    share = Counter(heavier.values())
    assert abs(share[2] / 4000 - 3 / 12) < 0.03 and abs(share[7] / 4000 - 1 / 12) < 0.02
    # growth at every count, weights up and down, shards that leave, and trees of unlike shape
    counts = {n: placed(hashtree.uniform_tree(n)) for n in (8, 9, 12, 13, 24, 25, 26)}
    for n in (8, 12, 24, 25):
        assert {counts[n + 1][k] for k in counts[n] if counts[n + 1][k] != counts[n][k]} == {n}
        own = Counter(counts[n + 1].values())
        assert len(own) == n + 1 and all(abs(c / 4000 - 1 / (n + 1)) < 0.03 for c in own.values())
    rack = hashtree.uniform_tree(24)
    rack["g1"]["k2"] = {s: 0.5 for s in rack["g1"]["k2"]}
    lighter = placed(rack)
    moved = {k: (counts[24][k], lighter[k]) for k in lighter if lighter[k] != counts[24][k]}
    assert moved and all(8 <= a < 12 for a, _ in moved.values())
    assert abs(sum(8 <= s < 12 for s in lighter.values()) / 4000 - 2 / 22) < 0.02
    gone = hashtree.uniform_tree(24)
    gone["g0"]["k1"][5] = 0.0
    left = placed(gone)
    assert {counts[24][k] for k in left if left[k] != counts[24][k]} == {5} and 5 not in left.values()
    for shape in ({"a": {"x": {i: 1.0 for i in range(6)}}}, {f"r{i}": {"x": {i: 1.0}} for i in range(6)}, {"a": {"x": {0: 1.0, 1: 1.0}, "y": {2: 1.0}, "z": {3: 1.0}}, "b": {"w": {4: 1.0, 5: 1.0}}}):
        one = placed(shape)
        assert all(abs(c / 4000 - 1 / 6) < 0.03 for c in Counter(one.values()).values())
        rack = list(list(shape.values())[-1].values())[-1]
        rack[6] = 1.0
        more = placed(shape)
        assert {more[k] for k in one if more[k] != one[k]} == {6}
    rows = hashtree.assign(odd_docs, hashtree.uniform_tree(3), hashtree.uniform_tree(4)).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    for s in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert hashtree.assign(no_docs, hashtree.uniform_tree(3)).count() == 0
    with pytest.raises(ValueError):
        hashtree.place(F.lit("x"), {"g": {"k": {0: 0.0}}})
    with pytest.raises(ValueError):
        hashtree.place(F.lit("x"), {"g": {}})
