from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from shardloom.llm import licences as L


def scanned(spark, rows):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    return {r["doc_id"]: r for r in L.scan(df, F.col("path")).collect()}


FILLER = "\n".join(f"some line number {i} with its words" for i in range(30))


def test_headers_files_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    got = scanned(
        spark,
        [
            ("a/LICENSE", "Our terms\n" + mit + "\n" + FILLER),
            ("a/x.py", FILLER),
            ("a/b/c/y.py", FILLER),
            ("a/b/copying.txt", apache),
            ("a/b/z.py", f"# {apache}\n{FILLER}"),
            ("ab/w.py", FILLER),
            ("v.py", None),
            (None, FILLER),
            ("a/b/q.py", ""),
        ],
    )
    said = {i: (r["licence"], r["scope"], r["from_dir"]) for i, r in got.items()}
    assert said == {
        0: ("MIT", "header", None),
        1: ("MIT", "inherited", "a"),
        2: ("Apache-2.0", "inherited", "a/b"),
        3: ("Apache-2.0", "file", None),
        4: ("Apache-2.0", "header", None),
        5: (None, "none", None),
        6: (None, "none", None),
        7: (None, "none", None),
        8: ("Apache-2.0", "inherited", "a/b"),
    }


def test_long_headers_are_paragraphs(spark):
    name, text = next((n, t) for n, t in L.TEMPLATES if n == "GPL-3.0" and len(t) > 200)
    words = text.split()
    block = "\n".join("// " + " ".join(words[i : i + 8]) for i in range(0, len(words), 8))
    got = scanned(spark, [("p/q.c", block + "\n\n" + FILLER)])[0]
    assert (got["licence"], got["scope"]) == (name, "header") and got["cosine"] > 0.95


def test_cosines_are_those_of_brute_force(spark, documents):
    texts = [r["text"] for r in documents.select("text").collect()]
    df = Counter(w for t in texts for w in set(L.words(t or "")))
    n = len(texts)

    def vector(text):
        return {w: c * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in Counter(L.words(text)).items()}

    def cosine(a, b):
        return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    templates = [(name, vector(t)) for name, t in L.TEMPLATES]
    want = {}
    for i, t in enumerate(texts):
        best = [(round(max(cosine(v, b) for _, b in templates), 6)) for line in (t or "").split("\n") if (v := vector(line))]
        if best and max(best) >= L.THRESHOLD:
            want[i] = max(best)
    rows = spark.createDataFrame([(i, f"f{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    own = L.scan(rows, F.col("path")).where("scope in ('header', 'file')").collect()
    got = {r["doc_id"]: r["cosine"] for r in own}
    assert set(want) <= set(got) and want
    assert all(got[i] >= c - 1e-6 for i, c in want.items())


def test_strong_terms_miss_nothing():
    m = L.Model(1000, {"the": 900, "of": 800, "license": 20})
    for _, v in m.vectors:
        assert math.sqrt(sum(w * w for t, w in v.items() if t not in m.strong)) < L.THRESHOLD


def test_odd_documents(odd_docs, no_docs):
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    got = L.scan(odd_docs, path).collect()
    assert len(got) == odd_docs.count() and {r["scope"] for r in got} == {"none"}
    assert L.scan(no_docs, path).count() == 0


def test_frequent_words_around_a_line_weigh_little(spark):
    rows = [(f"a/{i}.py", f"the file of the user {i}") for i in range(300)]
    got = scanned(spark, [("b/x.py", "Released under the MIT License of the user"), *rows])
    assert got[0]["licence"] == "MIT" and got[0]["scope"] in ("header", "file")
