"""License scans (native expressions only): sparse TF-IDF cosine to templates, then inheritance by directories.

Terms are runs of ASCII letters and digits in lower case. The document frequencies of all terms are
counted over the whole corpus, into a table. Lines,
paragraphs and whole texts are compared with every template. A line or paragraph of at least THRESHOLD is a
header and gives the file its licence. A whole text of at least THRESHOLD, or a file with a licence's usual
name and such a line or paragraph, is a licence file and gives its directory one. A file without a header
has the licence of the nearest directory upwards that has one: directories are joined with those of licence files over
all their ancestors, and the longest that meets is taken.

A text is looked at only if it has a *strong* term. The most frequent terms are left out of the strong ones
as long as no text of the others alone could reach the threshold (its best cosine is the length of the
template's vector over these terms), so nothing is missed.

What is sent to all tasks, the templates' vectors, has a fixed size. All groups are of one unit of one text,
or are maxima with partial aggregation.

Defined cases: null and empty texts have no header; a null path inherits nothing; ties of the cosine (to nine
digits) go to the greatest licence name; rows of equal id, path and text get equal results; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import stored

THRESHOLD = 0.6
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"

# Licences and the statements, headers and texts that they are known by.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


VOCABULARY = sorted({w for _, t in TEMPLATES for w in words(t)})


def _list(values: list[str]) -> Column:
    return F.split(F.lit(" ".join(values)), " ")


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df of all terms, and the number of documents under the empty term."""
    own = F.array_distinct(F.coalesce(terms(F.col(text)), F.array().cast("array<string>")))
    return docs.select(F.explode(F.array_append(own, F.lit(""))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


class Model:
    """Weights of the templates' terms, unit vectors of the templates, and the strong terms."""

    def __init__(self, n: int, df: dict[str, int], threshold: float = THRESHOLD):
        self.n = n
        self.idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.vectors = []
        strong: set[str] = set()
        for licence, text in TEMPLATES:
            raw = {t: k * self.idf[t] for t, k in Counter(words(text)).items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            vector = {t: w / norm for t, w in raw.items()}
            self.vectors.append((licence, vector))
            weak = 0.0
            for t in sorted(vector, key=lambda t: (-df.get(t, 0), t)):
                weak += vector[t] ** 2
                if weak >= (threshold - 1e-6) ** 2:
                    strong.add(t)
        self.strong = sorted(strong)


def model(frequencies: DataFrame, threshold: float = THRESHOLD) -> Model:
    """From the frequencies of the templates' terms, which are few."""
    counts = {r["term"]: r["df"] for r in frequencies.where(F.col("term").isin(["", *VOCABULARY])).collect()}
    return Model(counts.pop("", 0), counts, threshold)


def cosines(docs: DataFrame, model: Model, frequencies: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """k, kind (line, paragraph, text), licence, cosine of the best template of every unit of ``docs`` (k, text) that reaches the threshold."""
    spark = docs.sparkSession
    strong = _list(model.strong)
    own = docs.where(F.arrays_overlap(terms(F.col(text)), strong)).select("k", F.col(text).alias("t"))

    def numbered(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), p.alias("p")))

    blocks = F.filter(F.split("t", r"\n[ \t]*\n"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    units = F.concat(numbered("line", F.split("t", "\n")), numbered("paragraph", blocks), numbered("text", F.array("t")))
    cut = own.select("k", F.explode(units).alias("u")).select("k", "u.kind", "u.i", terms(F.col("u.p")).alias("w")).where(F.arrays_overlap("w", strong))
    counted = cut.select("k", "kind", "i", F.explode("w").alias("term")).groupBy("k", "kind", "i", "term").agg(F.count("*").alias("tf"))
    entries = spark.createDataFrame([(t, n, w) for n, (_, v) in enumerate(model.vectors) for t, w in v.items()], "term string, template int, weight double")
    by_term = entries.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("template", "weight"))).alias("by"))
    idf = F.log(F.lit(float(model.n + 1)) / (F.col("df") + 1)) + 1
    weighed = counted.join(F.broadcast(by_term), "term", "left").join(frequencies, "term").withColumn("w", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    dots = [F.sum(F.col("w") * F.coalesce(F.col("by")[n], F.lit(0.0))).alias(f"d{n}") for n in range(len(model.vectors))]
    sums = weighed.groupBy("k", "kind", "i").agg(norm.alias("norm"), *dots)
    best = F.greatest(*[F.struct(F.round(F.col(f"d{n}") / F.col("norm"), 9).alias("cosine"), F.lit(licence).alias("licence")) for n, (licence, _) in enumerate(model.vectors)])
    return sums.select("k", "kind", best.alias("b")).select("k", "kind", "b.licence", "b.cosine").where(F.col("cosine") >= threshold)


def directory(path: Column) -> Column:
    """The part before the last slash; the root is the empty string."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def ancestors(folder: Column) -> Column:
    """The directory, those above it, and the root."""
    parts = F.split(folder, "/")
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.lit("")))


def scan(docs: DataFrame, path: Column, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, licence, scope (header, inherited, none), cosine and from_dir of every row."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), path.alias("path"), F.col(text).alias("text"))
    halves = [F.lpad(F.hex(F.xxhash64(*c)), 16, "0") for c in (("doc_id", "path", "text"), (F.lit("second"), "text", "path", "doc_id"))]
    keyed = keyed.withColumn("k", F.unhex(F.concat(*halves)))  # rows equal in all three have equal results
    frequencies = stored(document_frequencies(docs, text), "licence-frequencies")
    units = stored(cosines(keyed, model(frequencies, threshold), frequencies, "text", threshold), "licence-units")
    best = F.max(F.struct("cosine", "licence"))
    headers = units.where("kind <> 'text'").groupBy("k").agg(best.alias("h"))
    files = units.where("kind = 'text'").groupBy("k").agg(best.alias("f"))
    rows = keyed.select("doc_id", "path", "k", directory(F.col("path")).alias("dir"))
    marked = stored(rows.join(stored(headers.join(files, "k", "full"), "licence-rows"), "k", "left"), "licence-marked")
    named = F.regexp_extract(F.col("path"), "[^/]*$", 0).rlike(FILE_NAME)
    declared = marked.where(F.col("dir").isNotNull() & (F.col("f").isNotNull() | named & F.col("h").isNotNull())).groupBy("dir").agg(F.max(F.coalesce("f", "h")).alias("d"))
    folders = marked.where("h is null and dir is not null").select("dir").distinct()
    up = folders.select("dir", F.explode(ancestors(F.col("dir"))).alias("above"))
    met = up.join(declared.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("d", "above"), F.length("above")).alias("n"))
    near = stored(met.select("dir", F.col("n.d").alias("n"), F.col("n.above").alias("above")), "licence-folders")
    full = marked.join(near, "dir", "left")
    own, inherits = F.coalesce("h", "f"), F.col("h").isNull() & F.col("f").isNull() & F.col("n").isNotNull()
    return full.select(
        "doc_id",
        "path",
        F.coalesce(own["licence"], F.col("n.licence")).alias("licence"),
        F.when(F.col("f").isNotNull(), "file").when(F.col("h").isNotNull(), "header").when(inherits, "inherited").otherwise("none").alias("scope"),
        F.coalesce(own["cosine"], F.col("n.cosine")).alias("cosine"),
        F.when(inherits, F.col("above")).alias("from_dir"),
    )
