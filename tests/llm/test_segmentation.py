from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llmhelp import vocabulary

from shardloom.llm import segmentation as S
from shardloom.llm import textops as T
from shardloom.llm.pieces import Pieces

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pieces():
    return Pieces(vocabulary(MODEL))


def all_ways(p: Pieces, text: str) -> dict[tuple[int, ...], float]:
    """Every segmentation with its probability."""
    t, out = "▁" + text.replace(" ", "▁"), []

    def go(i: int, ids: tuple[int, ...], log_p: float) -> None:
        if i == len(t):
            out.append((ids, log_p))
            return
        for n in range(1, p.longest + 1):
            if (w := t[i : i + n]) in p.words and len(w) == n:
                go(i + n, (*ids, p.words[w]), log_p + p.log_p[p.words[w]])
        if t[i] not in p.words:
            raw = t[i].encode()
            go(i + 1, (*ids, *(int(p.byte_id[b]) for b in raw)), log_p + len(raw) * p.byte_log_p)

    go(0, (), 0.0)
    total = np.logaddexp.reduce([x for _, x in out])
    return {ids: math.exp(x - total) for ids, x in out}


def samples(p: Pieces, text: str, n: int, k: int) -> tuple[list, list]:
    s = next(T.slices(pa.array([text] * n)))
    found, scores = [dict() for _ in range(n)], [dict() for _ in range(n)]
    for rank, (texts, ids, at, log_p, inclusion) in enumerate(S.Search(p, s, T.mix(np.arange(n, dtype=np.uint64)), k).samples()):
        for i, a, b, x, y in zip(texts.tolist(), at[:-1].tolist(), at[1:].tolist(), log_p.tolist(), inclusion.tolist(), strict=True):
            found[i][rank], scores[i][rank] = tuple(ids[a:b].tolist()), (x, y)
    return found, scores


def test_is_a_sample_without_replacement(pieces):
    n, text = 6000, "the\tcat €x"
    ways = all_ways(pieces, text)
    found, scores = samples(pieces, text, n, 3)
    assert all(len(set(f.values())) == 3 for f in found)
    for f, s in zip(found[:200], scores[:200], strict=True):
        for rank, ids in f.items():
            assert math.isclose(math.exp(s[rank][0]), ways[ids], rel_tol=1e-6)
    first = Counter(f[0] for f in found)
    assert max(abs(first[w] / n - p) for w, p in ways.items()) < 0.02
    pairs = Counter((f[0], f[1]) for f in found)
    assert max(abs(c / n - ways[a] * ways[b] / (1 - ways[a])) for (a, b), c in pairs.items()) < 0.02
    weight = [sum(math.exp(x - y) for x, y in s.values()) for s in scores]
    assert abs(np.mean(weight) - 1) < 0.01  # inverse inclusion probabilities are right on average


def test_all_segmentations_are_found_in_the_end(pieces):
    ways = all_ways(pieces, "on a")
    found, scores = samples(pieces, "on a", 20, len(ways) + 3)
    for f, s in zip(found, scores, strict=True):
        assert sorted(f.values()) == sorted(ways)
        assert all(y == 0 for _, y in s.values())


def test_decoding_and_seeds(spark, odd_docs, no_docs, documents):
    got = S.sample(odd_docs, vocabulary(MODEL), k=3, ids=True).collect()
    assert all(r["decoded"] for r in got)
    assert {r["rank"] for r in got} == {0, 1, 2}
    rows = Counter((r["doc_id"], r["decoded_crc32"]) for r in got if r["rank"] == 0)
    assert rows.total() == odd_docs.count()
    empty = [r for r in got if r["n_ids"] == 0]
    assert {r["doc_id"] for r in empty} == {3, 4, None} and all(r["rank"] == 0 and r["log_p"] == 0 for r in empty)
    twins = [r for r in got if r["doc_id"] == 1]
    assert len(twins) == 6 and len({tuple(r["ids"]) for r in twins}) == 3
    again = S.sample(odd_docs.repartition(7), vocabulary(MODEL), k=3, ids=True).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert S.sample(no_docs, vocabulary(MODEL)).count() == 0
    assert S.sample(documents, vocabulary(MODEL)).where("not decoded").count() == 0


def test_decoder_of_the_library_agrees(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))
    texts = ["Hello  world\n x y 123 é日本 𐍈", " a ", "tabs\tand\nlines", "ﬁ ligature"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in S.sample(docs, vocabulary(MODEL), ids=True).collect():
        assert model.decode(r["ids"]) == texts[r["doc_id"]]
