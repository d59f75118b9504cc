"""The registered queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.llm import (
    bpe, conversations, language, mixing, pii, quality, simhash, syncmers, token_counts, toxicity, urls, variants, vectors,
)
from hearthpanel.llm.common import pick, prepare_workers

BPE_FILE = "word_bpe_49k.json"
PIECES_FILE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents")).drop("copies")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = docs.select("doc_id", bpe.transcoded(F.col("text"), public_tokenizers.path(BPE_FILE)).alias("t"))
    return rows.select(
        "doc_id",
        F.floor(F.octet_length("t.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("t.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("t.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES_FILE))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages")).drop("words", "score")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_bpe, op3_token_counts, op4_toxicity, op5_language, op6_simhash, op7_pii, op8_syncmers,
        op9_quality, op10_urls, op11_variants, op12_conversations,
        op13_vectors,
    )
}

_FILL = """,
gaps{i} AS (
  SELECT s.source, s.need - coalesce(sum(g.total) FILTER (WHERE g.more), 0) AS gap
  FROM chosen{p} g JOIN fractions s ON g.source IS NOT DISTINCT FROM s.source WHERE s.need > 0 GROUP BY s.source, s.need),
best{i} AS (
  SELECT g.source, max(struct_pack(total := g.total, k := g.k, id := g.doc_id, size := g.size)) AS b
  FROM chosen{p} g JOIN gaps{i} s ON g.source IS NOT DISTINCT FROM s.source
  WHERE NOT g.more AND g.total > 0 AND g.total <= s.gap GROUP BY g.source),
chosen{i} AS (
  SELECT g.source, g.k, g.doc_id, g.size, g.total,
    g.more OR coalesce(b.b.k = g.k AND b.b.id IS NOT DISTINCT FROM g.doc_id AND b.b.size = g.size, false) AS more
  FROM chosen{p} g LEFT JOIN best{i} b ON g.source IS NOT DISTINCT FROM b.source)"""

ORACLES = {
    "op1_mixing": """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
groups AS (
  SELECT source, doc_id, size, sum(size)::BIGINT AS total, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM sized GROUP BY source, doc_id, size),
sources AS (
  SELECT source, sum(total)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w
  FROM groups GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source IS NULL, source) AS r FROM sources),
levels AS (
  SELECT r, source_size * 2.0::DOUBLE / w AS own,
    (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
level AS (SELECT min_by(level, r) AS level FROM levels WHERE level <= own),
targets AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, w * level) AS target FROM sources, level),
fractions AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    target - whole * source_size AS need FROM targets),
chosen0 AS (
  SELECT g.source, g.k, g.doc_id, g.size, g.total, s.need > 0 AND
    sum(g.total) OVER (PARTITION BY g.source ORDER BY g.k, g.doc_id NULLS FIRST, g.size ROWS UNBOUNDED PRECEDING) <= s.need AS more
  FROM groups g JOIN fractions s ON g.source IS NOT DISTINCT FROM s.source)"""
    + "".join(_FILL.format(i=i, p=i - 1) for i in range(1, mixing.FILL_PASSES + 1))
    + f"""
SELECT d.doc_id, d.size, s.source_size, s.target, (d.size * (s.whole + c.more::BIGINT))::BIGINT AS taken
FROM sized d
JOIN fractions s ON d.source IS NOT DISTINCT FROM s.source
JOIN chosen{mixing.FILL_PASSES} c
  ON d.source IS NOT DISTINCT FROM c.source AND d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.size = c.size""",
    # crc32 byte by byte; near words share a word, or a word with one letter less, as one of their deletions.
    "op11_variants": """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM range(256) r(i))),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(
    unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
per_doc AS (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY id, run),
hashed AS (
  SELECT run, c, xor(list_reduce(
    flatten(list_transform(string_split(id || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM per_doc, crc_table),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word,
    sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1),
vocabulary AS (SELECT word, n FROM words WHERE length(word) >= 5 AND n >= 3),
cuts AS (
  SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS (
  SELECT DISTINCT a.word AS word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocabulary v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocabulary v ON c.rest = v.word),
best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(m := -m, o := encode(other))) AS b FROM near GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * v.n THEN decode(b.o) END AS form,
    CASE WHEN -b.m >= 2 * v.n THEN -b.m END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, coalesce(form, word) AS at, form IS NULL AS last FROM formed
  UNION ALL SELECT c.word, coalesce(f.form, c.at), f.form IS NULL FROM chain c JOIN formed f ON c.at = f.word WHERE NOT c.last)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.last""",
    "op13_vectors": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
able AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.r, b.r AS other, b.vec_id FROM able a JOIN able b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r, r AS other FROM v UNION SELECT c.r, p.other FROM reach c JOIN pairs p ON c.other = p.r),
counts AS (SELECT r, count(*) AS n FROM pairs GROUP BY r),
least AS (SELECT c.r, min(v.vec_id) AS component_id FROM reach c JOIN v ON c.other = v.r GROUP BY c.r)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN counts USING (r)""",
}
