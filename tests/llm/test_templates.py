from __future__ import annotations

import re
from collections import defaultdict

from shardloom.llm import templates as P

ITEM = "If Anna buys 12 apples and Bert buys 7 apples how many kilograms of fruit does Anna carry when each apple weighs 150 grams today"
OTHER = "If Carla buys 33 apples and Dora buys 9 apples how many pounds of fruit does Carla carry when each apple weighs 170 grams today"
WRONG = "If Carla buys 33 apples and Dora buys 9 apples how many pounds of fruit does Emil carry when each apple weighs 33 ounces today"
LONGER = "If Carla buys thirty three apples and Dora buys 3/4 apples how many pounds of fruit does Carla carry when each apple weighs one hundred and 170 grams today"
SHORT = "how many legs have three spiders and two cats"


def found(spark, texts, items, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in P.matches(docs, bench, **how).collect()}


def test_questions_with_other_values(spark):
    got = found(spark, [f"Some words before. {ITEM}? And after.", f"x {OTHER} y", f"x {WRONG} y", "nothing of it", None, ""], [ITEM, SHORT, None, ""])
    assert (0, 0) in got and got[0, 0]["n_changed"] == 0
    assert (1, 0) in got and got[1, 0]["n_changed"] > 0
    assert set(got) == {(0, 0), (1, 0)}


def test_slots_must_be_consistent(spark):
    """A name or a number that stands for two others, or two for one, is another question."""
    one_name = OTHER.replace("Dora", "Carla")
    got = found(spark, [OTHER, WRONG, one_name.replace("9 apples", "33 apples")], [ITEM])
    assert set(got) == {(0, 0)}


def test_case_changes_nothing(spark):
    """Whole passages in capitals, in title case and in lower case, also with other numbers; and items in capitals."""
    other = ITEM.replace("12", "33").replace("150", "170")
    accents = "la éai éonleeau pour an éonqueê aivi ai éenaitreoiaux éoiré anvitre èenreré le ñ жук"
    assert set(found(spark, [accents.upper(), "İİ " + accents.title()], [accents])) == {(0, 0), (1, 0)}
    texts = [ITEM.upper(), ITEM.title(), ITEM.lower(), other.upper(), "NOTHING OF IT IN CAPITALS THAT GO ON AND ON FOR MORE THAN THIRTEEN WORDS"]
    assert set(found(spark, texts, [ITEM, ITEM.upper()])) == {(d, i) for d in range(4) for i in range(2)}


def test_short_items_and_parts(spark):
    words = ITEM.split()
    got = found(spark, [f"so {SHORT} then", "so how many legs", "a " + " ".join(words[:16]) + " b", "a " + " ".join(words[:9]) + " b"], [ITEM, SHORT])
    assert set(got) == {(0, 1), (2, 0)}


def test_a_full_bit_map_changes_nothing(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one, many = (sorted(map(tuple, P.matches(documents, bench, most_bits=m).collect())) for m in (P.MOST_BITS, 1 << 12))
    assert one == many and one


def test_whole_passages_of_the_documents(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in P.matches(documents, bench).collect()}
    texts = [(r["doc_id"], " ".join((r["text"] or "").split())) for r in documents.collect()]
    inside = {(d, r["item_id"]) for r in bench.collect() for d, t in texts if " ".join(r["text"].split()) in t}
    assert inside and inside <= got
    left = {r["doc_id"] for r in P.decontaminated(documents, bench).collect()}
    assert left == {d for d, _ in texts} - {d for d, _ in got}


def tokens(text):
    """(lower case, kind, opens a sentence) of every token."""
    out, end = [], 0
    for m in re.finditer(r"(?:[0-9A-Za-z\u0080-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", text or ""):
        w = m[0]
        lower = "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in w)
        kind = "number" if w[0] in "0123456789" or lower in P.NUMBERS else "unit" if lower in P.UNITS else "name" if re.match("[A-ZÀ-ÖØ-Þ]", w) and lower not in P.COMMON else None
        out.append((lower, kind, not out or any(c in ".?!:;\n" for c in text[end : m.start()])))
        end = m.end()
    return out


def merged(text, names):
    """(values, kind, first token, last token) of every template token."""
    out, before = [], None
    for i, (w, kind, opens) in enumerate(tokens(text)):
        kind = kind if names or kind != "name" else None
        if out and not opens and kind == out[-1][1] and (kind == "number" or kind == "name" and not before):
            out[-1] = (out[-1][0] + (w,), kind, out[-1][2], i)
        else:
            out.append(((w,), kind, i, i))
        before = opens
    return out


def by_hand(docs, items):
    """The matches, from windows in plain Python."""
    out, refuted = {}, defaultdict(int)
    for names in (True, False):
        known = defaultdict(list)

        def windows(own, size, names=names):
            for a in range(len(own) - size + 1):
                part = own[a : a + size]
                literals = sum(k is None for _, k, _, _ in part)
                if not names or literals >= min(P.LITERALS, size / 2):
                    plain = not names and not literals
                    yield a, part, tuple(v if k is None or plain else k for v, k, _, _ in part)

        sizes = set()
        for i, text in items:
            own = merged(text, names)
            size = min(P.WINDOW, len(own))
            for a, part, key in windows(own, size) if size else ():
                known[key].append((i, a, part, len(tokens(text))))
                sizes.add(size)
        for d, text in docs:
            own, met = merged(text, names), defaultdict(lambda: (set(), set()))
            for size in sizes:
                for a, part, key in windows(own, size):
                    for i, at, there, n in known.get(key, ()):
                        spots, pairs = met[i, n, a - at]
                        spots.update(range(there[0][2], there[-1][3] + 1))
                        pairs.update((x, y) for (x, k, _, _), (y, _, _, _) in zip(there, part, strict=True) if k)
            for (i, n, _), (spots, pairs) in met.items():
                need = P.NEED if n >= P.NEED else n - 2 if n - 2 >= P.WINDOW else n
                conflicts = 2 * len(pairs) - len({x for x, _ in pairs}) - len({y for _, y in pairs})
                if conflicts > 2 * P.CONFLICTS * len(pairs):
                    refuted[d, i] = max(refuted[d, i], len(spots) * names)
                elif len(spots) >= need and (names or len(spots) >= refuted[d, i]):
                    found = (len(spots), -sum(x != y for x, y in pairs), len(pairs), n)
                    out[d, i] = max(out.get((d, i), found), found)
    return {(d, i, s, n, p, -c) for (d, i), (s, c, p, n) in out.items()}


def test_matches_are_those_of_plain_python(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, items = ([tuple(r) for r in t.collect()] for t in (documents.select("doc_id", "text"), bench.select("item_id", "text")))
    docs += [(10_000 + k, f(t)) for k, (_, t) in enumerate(items[:60]) for f in (lambda t: re.sub("[0-9]+", "77", t), str.upper) if t]
    docs += [(20_000 + k, t) for k, t in enumerate((ITEM, OTHER, WRONG, SHORT, LONGER, "1 2 3", ""))]
    items += [(9_000 + k, t) for k, t in enumerate((ITEM, SHORT, "12 7 3, 4 km 5 10 kg 8 cm 2 m 1 mm 9 oz", None, ""))]
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    got = P.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {tuple(r) for r in got.select("doc_id", "item_id", "n_covered", "n_tokens", "n_slots", "n_changed").collect()}
    assert got == by_hand(docs, items) and len(got) > 50


def test_values_of_several_words(spark):
    """Longer or shorter values in the slots, of numbers, fractions and names."""
    assert (0, 0) in found(spark, [f"x {LONGER} y"], [ITEM])
    short = "Tom Baker has 12 apples and gives 5 apples to each friend how many apples does he keep"
    long = "so Tom Baker has 12 apples and gives twenty five apples to each friend how many apples does he keep"
    assert (0, 0) in found(spark, [long], [short])
    assert not found(spark, [WRONG.replace("33 ounces", "thirty three ounces").replace("33 apples", "thirty three apples")], [ITEM])


def test_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "Every word of this little text is here so that it has more than five words"), (1, None), (2, "")], "item_id long, text string")
    left = P.decontaminated(odd_docs, bench)
    assert left.columns == odd_docs.columns
    assert sorted(r["doc_id"] is None for r in left.collect()) == [False] * 13 + [True] * 2
    assert P.decontaminated(no_docs, bench).count() == 0
    assert P.decontaminated(odd_docs, bench.where("false")).count() == odd_docs.count()
