from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from llmhelp import words

from shardloom.llm import minhash as M
from shardloom.llm import textops as T
from shardloom.llm.components import components


def elements(text: str) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both) if both else 0.0


def classes(texts: list[str | None]) -> list[int]:
    """The first position of each text's class, from all pairs."""
    parts, found = [elements(t or "") for t in texts], list(range(len(texts)))

    def top(i: int) -> int:
        while found[i] != i:
            i = found[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (not parts[i] and not parts[j]) or similarity(parts[i], parts[j]) >= M.SIMILARITY:
                a, b = sorted((top(i), top(j)))
                found[b] = a
    return [top(i) for i in range(len(texts))]


def grouped(ids: list, labels: list) -> set:
    out: dict = {}
    for i, c in zip(ids, labels, strict=True):
        out.setdefault(c, []).append(-99 if i is None else i)
    return {tuple(sorted(x)) for x in out.values()}


def test_coordinates_agree_as_often_as_texts_are_similar():
    a = " ".join(f"w{i % 40}" for i in range(100))
    for cut in (0, 8, 30, 70):
        b = " ".join(words(a)[cut:] + [f"z{i}" for i in range(cut)])
        found = [M.signatures(s, 4000)[0] for s in T.slices(pa.array([a, b]))][0]
        assert abs((found[0] == found[1]).mean() - similarity(elements(a), elements(b))) < 0.03


def test_similarities():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(500)] + [(t, t) for t in texts]
    found = M.similarities(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    assert np.allclose(found, [similarity(elements(a), elements(b)) for a, b in pairs])


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((40, 25), (60, 80), (30, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(100, 160)] if m else [])
        found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        label = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in label:
            for a, b in edges:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        assert found == label


def test_odd_documents(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    found = M.near_duplicates(odd_docs).collect()
    texts = [r["text"] for r in rows]
    assert grouped([r["doc_id"] for r in found], [r["class_key"] for r in found]) == grouped([r["doc_id"] for r in rows], classes(texts))
    by_class: dict = {}
    for r in found:
        by_class.setdefault(bytes(r["class_key"]), []).append(r)
    for own in by_class.values():
        assert {r["class_id"] for r in own} == {min((r["doc_id"] for r in own if r["doc_id"] is not None), default=None)}
    kept = M.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(classes(texts)))
    assert M.near_duplicates(no_docs).count() == M.deduplicated(no_docs).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Pairs on both sides of the threshold, chains, and copies that are too far from all others."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(220):
        own = list(base)
        for _ in range(i % 9):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = M.near_duplicates(docs).collect()
    want, got = classes(texts), {r["doc_id"]: r["class_id"] for r in found}
    assert [got[i] for i in range(len(texts))] == want


def test_real_documents(documents):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    found = M.near_duplicates(documents).collect()
    want = classes([r["text"] for r in rows])
    assert grouped([r["doc_id"] for r in found], [r["class_id"] for r in found]) == grouped([r["doc_id"] for r in rows], want)
