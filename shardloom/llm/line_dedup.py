"""Line dedup: overlapping windows of three consecutive lines, repeated anywhere in the corpus.

Lines are the parts between ``\\n``, compared exactly. Every window of three lines gets a 128-bit
hash. The first occurrence of a window stays, by doc_id, then the MD5 of the text, then the place where rows equal in
both are read, then the line; of each later one the three lines are removed, and overlapping windows merge. Windows are
judged on the input, and a window whose lines are all white space does not count.

Windows are hashed once, into a table, and counted with partial aggregates, so a window that a third of the documents
share is one row from each task. Repeated windows are written to a table before the join back, so that it is an ordinary
one that adaptive execution splits where it is skewed. Of rows equal in doc_id and text all but the first lose every window, which
needs no join. Texts meet their decisions in one join.

Defined cases: null texts stay null with no lines; texts of fewer than three lines stay as they are;
of rows equal in doc_id and text the first one read keeps its lines, so the input should be read from files, where a task that runs
again reads the same rows; a null doc_id counts as before all others; all columns besides the text pass through, and a name of
ours that the input has already gets another ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import fresh, stored, text_id

LINES = 3
_SAID = r"[^\x20\x09-\x0D]"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _window(lines: Column, i: Column, n: int) -> list[Column]:
    return [F.get(lines, i + j) for j in range(n)]


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """_k, _id, _starts, _first: for each document the starts of windows that occur before, and where there are several equal rows the place of the first."""
    parts = docs.select(text_id(text).alias("_k"), F.col(doc_id).alias("_id"), _lines(text).alias("_l")).where(F.size("_l") >= lines)

    def window(i: Column) -> Column:
        own = _window(F.col("_l"), i, lines)
        return F.struct(i.alias("i"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit("second"), *own[::-1]).alias("h2"), F.concat(*own).rlike(_SAID).alias("said"))

    cut = parts.select("_k", "_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("_l") - lines), window)).alias("w"))
    found = stored(cut.where("w.said").select("_k", "_id", "w.i", "w.h1", "w.h2"), "line-windows")
    firsts = stored(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_k", "i")).alias("first")).where("n > 1").select("h1", "h2", "first"), "line-firsts")
    later = found.join(firsts, ["h1", "h2"]).where(~F.struct("_id", "_k", "i").eqNullSafe(F.col("first"))).select("_k", "_id", "i", F.lit(None).cast("long").alias("place"))
    places = docs.where(F.col(text).isNotNull()).select(text_id(text).alias("_k"), F.col(doc_id).alias("_id"), F.monotonically_increasing_id().alias("place"))
    equal = places.groupBy("_k", "_id").agg(F.count("*").alias("n"), F.min("place").alias("place")).where("n > 1").select("_k", "_id", F.lit(None).cast("int").alias("i"), "place")
    return later.unionByName(equal).groupBy("_k", "_id").agg(F.collect_set("i").alias("_starts"), F.min("place").alias("_first"))


def own_names(docs: DataFrame) -> tuple[str, str]:
    """The columns for the number of lines and of removed ones: ``_n_lines`` and ``_n_removed``, or a longer name where the input has that."""
    return fresh(docs, "_n_lines"), fresh(docs, "_n_removed")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """All rows with the text that is left, and the columns of ``own_names``."""
    found = repeated_windows(docs, doc_id, text, lines)
    key, place, split, mark = (fresh(docs, c) for c in ("_key", "_place", "_split", "_gone"))
    own = docs.withColumns({key: text_id(text), place: F.monotonically_increasing_id(), split: _lines(text)})
    both = own.join(found, (own[key] == found["_k"]) & own[doc_id].eqNullSafe(found["_id"]), "left")
    whole = F.sequence(F.lit(0), F.size(split) - 1)
    said = F.filter(F.slice(whole, 1, F.greatest(F.size(split) - lines + 1, F.lit(0))), lambda i: F.concat(*_window(F.col(split), i, lines)).rlike(_SAID))
    starts = F.when(F.col(place) != found["_first"], said).otherwise(found["_starts"])
    gone = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + lines - 1))))
    kept = F.array_join(F.transform(F.array_except(whole, mark), lambda i: F.get(F.col(split), i)), "\n")
    marked = both.withColumn(mark, gone)
    n_lines, n_removed = own_names(docs)
    return marked.select(
        *[F.when(F.coalesce(F.size(mark), F.lit(0)) <= 0, F.col(text)).otherwise(kept).alias(text) if c == text else own[c] for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long").alias(n_lines),
        F.when(F.col(text).isNull(), 0).otherwise(F.greatest(F.coalesce(F.size(mark), F.lit(0)), F.lit(0))).cast("long").alias(n_removed),
    )


def shortened(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", lines: int = LINES) -> DataFrame:
    """All rows with all columns of ``docs``; a text that lost lines has a new number of characters."""
    found, (_, n_removed) = dedup_lines(docs, doc_id, text, lines), own_names(docs)
    changed = F.col(n_removed) > 0
    return found.select(*[F.when(changed, F.char_length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col(c) for c in docs.columns])
