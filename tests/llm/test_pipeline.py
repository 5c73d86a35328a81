from __future__ import annotations

from pyspark.sql import functions as F
from test_minhash import classes
from test_templates import by_hand
from test_texts import quality_by_hand, shorter

import corpus_pipeline as P


def test_stages(spark, sf_dir, documents, tmp_path):
    """Each stage on what the one before kept, against plain Python."""
    docs, after = documents, []
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after.append(docs)
    kept, lines, single, clean, encoded = after
    assert kept.columns == lines.columns == single.columns == clean.columns == documents.columns
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert ids(kept) == sorted(d for d, (_, keep) in quality_by_hand(texts, good).items() if keep)
    assert rows(lines) == sorted((d, t) for d, t, _, _ in shorter(rows(kept)))
    assert [r["n_chars"] for r in lines.where("n_chars <> char_length(text)").collect()] == []
    assert rows(single) == [rows(lines)[c] for c in sorted(set(classes([t for _, t in rows(lines)])))]
    found = by_hand(rows(single), [tuple(r) for r in bench.select("item_id", "text").collect()])
    gone = {m[0] for m in found}
    assert gone and rows(clean) == [r for r in rows(single) if r[0] not in gone]
    assert ids(encoded.where("rank = 0")) == ids(clean) and encoded.where("not decoded").count() == 0
    assert encoded.where(F.size("ids") != F.col("n_ids")).count() == 0


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_odd_documents(spark, sf_dir, odd_docs, no_docs, tmp_path):
    """Nulls, repeated rows, names that clash, and an empty table, through every stage."""
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, sf_dir)
            assert i == len(P.STAGES) - 1 or out.columns == odd_docs.columns
            out.write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
        assert docs.count() == 0 or name == "odd"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 0
