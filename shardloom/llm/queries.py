"""The queries of the numbered operators, with their production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import hashtree, licences, line_dedup, minhash, quality, segmentation, substring, templates, token_counts, token_files
from shardloom.llm.common import shared_dir, stored, table

TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; it is the same on all machines."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hashtree.assign(table(spark, sf_dir, "documents"), hashtree.uniform_tree(hashtree.SHARDS), hashtree.uniform_tree(hashtree.SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def op3_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmentation.sample(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "rank", "n_ids", "ids_crc32", F.round("log_p", 6).alias("log_p"), F.round("log_inclusion", 6).alias("log_inclusion"), "decoded")


def op4_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_covered", "n_tokens", "n_slots", "n_changed")


def op5_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts under two tokenizer versions, one of them sent twice, a revision that counts an end id too, German documents withdrawn
    from the second version, and French ones moved to the language ``fra``."""
    import public_tokenizers

    versions = {v: vocabulary(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    counts = stored(token_counts.count(table(spark, sf_dir, "documents"), versions, public_tokenizers.PATTERN), "token-counts")
    ledger = token_counts.Ledger(spark, f"{shared_dir(spark)}/token-ledger-{uuid.uuid4().hex}")
    for v in versions:
        ledger.commit(f"load {v}", token_counts.insert(counts, v))
    ledger.commit("load byte_bpe_50k", token_counts.insert(counts, "byte_bpe_50k"))
    ledger.commit("count the end id", token_counts.revise(counts, "byte_bpe_50k", F.col("byte_bpe_50k") + 1))
    ledger.commit("withdraw", token_counts.delete(counts.where("lang = 'de'"), "byte_bpe_multi_50k"))
    ledger.commit("relabel", token_counts.move(counts.where("lang = 'fr'"), "byte_bpe_multi_50k", lang=F.lit("fra")))
    return ledger.totals()


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))


def op10_licence_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, its language and its id."""
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


ORACLES = {
    "op1_dart_minhash": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM w),
c AS (SELECT doc_id, g, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS shared FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE shared >= 0.8 * (a.n + b.n - shared)),
links AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(doc_id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, least FROM reach JOIN links ON x = doc_id)
SELECT doc_id, min(least) AS class_id FROM reach GROUP BY doc_id""",
    "op2_hash_tree": """
WITH table256 AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
docs AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, CAST(length(h) // 2 + 8 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM docs, table256),
darts AS (
  SELECT *, list_transform(range(4), lambda r: md5(key || ':g' || r || ':0')) AS h, md5(key || ':g3:1') AS again, md5(key || ':g3:late:24') AS late,
    CAST('0x' || substr(md5(key || '/' || size), 1, 3) AS INT) % 4096 AS block
  FROM sized),
timed AS (
  SELECT *, list_transform(list_concat(h, [again, late]), lambda x: -ln((CAST(CAST('0x' || substr(x, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)) AS e,
    list_transform(list_concat(h, [again]), lambda x: CAST('0x' || substr(x, 14, 4) AS BIGINT) * 2 // 65536 * 4 + CAST('0x' || substr(x, 18, 4) AS BIGINT) * 4 // 65536) AS spot
  FROM darts),
placed AS (
  SELECT *, list_position(e[1:3], list_min(e[1:3])) AS region,
    CASE WHEN spot[4] = 0 THEN e[4] / 8 WHEN spot[5] = 0 THEN e[4] / 8 + e[5] / 8 ELSE e[4] / 8 + e[5] / 8 + e[6] END AS new_time
  FROM timed),
sharded AS (
  SELECT *, CAST((region - 1) * 8 + spot[region] AS INT) AS shard FROM placed),
grown AS (
  SELECT *, CASE WHEN new_time < e[region] / 8 THEN 24 ELSE shard END AS grown_shard FROM sharded)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard,
  'g' || (shard // 8) AS region, 'k' || (shard // 4) AS rack
FROM grown""",
    "op5_cover_anchors": """
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM p),
gone AS (SELECT doc_id, list(DISTINCT q) AS g FROM (SELECT doc_id, unnest(range(i, i + 35)) AS q FROM seen WHERE n > 1) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, j: NOT list_contains(g, j)), ' ') END) AS kept_sha256
FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id""",
    "op8_line_windows": """
WITH d AS MATERIALIZED (
  SELECT doc_id, text, md5(text) AS h, row_number() OVER () AS r, row_number() OVER (PARTITION BY doc_id, text) AS copy FROM documents),
lines AS (SELECT r, doc_id, h, copy, string_split(text, chr(10)) AS l FROM d WHERE text IS NOT NULL),
w AS (SELECT r, doc_id, h, copy, unnest(range(1, len(l) - 1)) AS i, l FROM lines WHERE len(l) >= 3),
seen AS (
  SELECT r, i, row_number() OVER (PARTITION BY l[i], l[i + 1], l[i + 2] ORDER BY doc_id NULLS FIRST, h, copy, i) AS n
  FROM w WHERE regexp_matches(l[i] || l[i + 1] || l[i + 2], '[^ \\t-\\r]')),
gone AS (SELECT r, list(DISTINCT p) AS g FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM seen WHERE n > 1) GROUP BY r)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN coalesce(d.text, '') ELSE
    array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, j: NOT list_contains(g, j)), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN gone ON d.r = gone.r""",
}


def _licence_sql() -> str:
    """The licence scan in SQL; the templates are the operator's."""
    rows = ", ".join(f"({n}, '{name}', '{body.replace(chr(39), chr(39) * 2)}')" for n, (name, body) in enumerate(licences.TEMPLATES))
    split = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH templates(n, licence, body) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS k, doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
tt AS (SELECT n, licence, term, count(*) AS c FROM (SELECT n, licence, unnest({split.format('body')}) AS term FROM templates) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT k, unnest({split.format('text')}) AS term FROM d) GROUP BY term),
total AS (SELECT count(*) AS docs FROM documents),
idf AS (SELECT term, ln((docs + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT term FROM tt UNION SELECT term FROM df) LEFT JOIN df USING (term), total),
tv AS (SELECT n, licence, term, c * idf / sqrt(sum(c * idf * c * idf) OVER (PARTITION BY n)) AS w FROM tt JOIN idf USING (term)),
u AS (
  SELECT k, 'line' AS kind, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS p FROM d
  UNION ALL SELECT k, 'paragraph', unnest(range(len(regexp_split_to_array(text, '\n[ \t]*\n')))), unnest(regexp_split_to_array(text, '\n[ \t]*\n')) FROM d
  UNION ALL SELECT k, 'text', 0, text FROM d),
tf AS (SELECT k, kind, i, term, count(*) AS tf FROM (SELECT k, kind, i, unnest({split.format('p')}) AS term FROM u WHERE kind <> 'paragraph' OR contains(trim(p), chr(10))) GROUP BY ALL),
weighed AS (SELECT tf.*, tf * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT k, kind, i, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
cosines AS (
  SELECT k, kind, i, n, licence, round(sum(a.w * b.w) / any_value(norm), 9) AS cosine FROM weighed a JOIN tv b USING (term) JOIN norms USING (k, kind, i) GROUP BY k, kind, i, n, licence),
units AS (SELECT k, kind, cosine, licence FROM cosines WHERE cosine >= {licences.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY k, kind, i ORDER BY cosine DESC, licence DESC) = 1),
best AS (SELECT k, kind <> 'text' AS header, cosine, licence FROM units QUALIFY row_number() OVER (PARTITION BY k, kind <> 'text' ORDER BY cosine DESC, licence DESC) = 1),
marked AS (
  SELECT d.*, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, h.licence AS hl, h.cosine AS hc, f.licence AS fl, f.cosine AS fc
  FROM d LEFT JOIN best h ON h.k = d.k AND h.header LEFT JOIN best f ON f.k = d.k AND NOT f.header),
declared AS (SELECT dir AS above, fl AS licence, fc AS cosine FROM marked WHERE fl IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY fc DESC, fl DESC) = 1),
near AS (
  SELECT dir, above, licence, cosine FROM (SELECT DISTINCT dir FROM marked WHERE hl IS NULL) JOIN declared ON dir = above OR starts_with(dir, above || '/') OR above = ''
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, coalesce(hl, fl, near.licence) AS licence,
  CASE WHEN fl IS NOT NULL THEN 'file' WHEN hl IS NOT NULL THEN 'header' WHEN near.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS scope,
  coalesce(hc, fc, near.cosine) AS cosine, CASE WHEN hl IS NULL AND fl IS NULL AND near.licence IS NOT NULL THEN above END AS from_dir
FROM marked LEFT JOIN near ON near.dir = marked.dir"""


ORACLES["op10_licence_cosine"] = _licence_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
