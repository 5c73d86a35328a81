from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _key long, label int, bucket string, t string, k int, h int, _gone int, _starts int, id int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns with the names that operators use inside."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
    line = "\n".join(["the same first line", "the same second line", "the same third line"])
    prose = "Every word of this little text is here so that it has more than five words in it"
    texts = [
        (1, prose),
        (1, prose),
        (2, prose),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (6, "one"),
        (7, "one two three four"),
        (8, long),
        (9, long + " more"),
        (None, prose),
        (None, None),
        (None, None),
        (10, line),
        (11, "before\n" + line + "\nafter"),
        (12, "čeština 日本語 𐍈   nbsp em"),
        (13, "\n\n\n\n"),
        (14, "a " * 70),
        (-5, "negative id " * 3),
    ]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "s", len(t) if t else None, "c", 1, 2, "b", "t", 3, 4, 5, 6, 7) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

