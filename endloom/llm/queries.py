"""The queries opN_<name> of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, ngram_join, packing, pii, quality, token_codec, toxicity, url_filter
from .common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, len(w) < 5 AS short, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common_words AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.short = y.short AND x.doc_id < y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM common_words JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 80 * (p.n + q.n - common)
),
reach AS (
  SELECT a, b FROM (SELECT a, b FROM links UNION SELECT b, a FROM links)
  UNION
  SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON r.b = l.a
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, min(r.b)) AS component_id
FROM words w LEFT JOIN sizes z ON z.doc_id = w.doc_id LEFT JOIN reach r ON r.a = w.doc_id
GROUP BY w.doc_id, n
"""


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="endloom-op2")
    return out.select("doc_id", F.size("pii_entities").cast("long").alias("n_entities"), F.array_join("pii_entities.kind", ",").alias("kinds"), "text")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = url_filter.page_labels(pages, _table(spark, sf_dir, "labels"), url_filter.POLICY)
    rules = url_filter.mine_rules(labelled, verdicts=("block", "allow"))
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, _table(spark, sf_dir, "labels"), learn_from=lambda i: ~held_out(i))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, _table(spark, sf_dir, "labels"), learn_from=lambda i: ~held_out(i))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "op8-tokens")
    token_codec.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_codec.read_tokens(spark, path, with_ids=False)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    return packing.pack(pieces)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP10_SQL = r"""
WITH words_of AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
items AS (
  SELECT id AS item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS gram
  FROM words_of WHERE kind = 'i' AND len(w) > 0
),
sizes AS (SELECT DISTINCT k FROM items),
grams AS (
  SELECT id AS doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words_of, sizes WHERE kind = 'd' AND len(w) >= k)
),
hits AS (SELECT doc_id, g.k, i, item_id FROM grams g JOIN (SELECT DISTINCT item_id, k, gram FROM items) x ON g.k = x.k AND g.gram = x.gram),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM words_of d LEFT JOIN hit_words h ON d.id = h.doc_id LEFT JOIN hit_items t ON d.id = t.doc_id WHERE d.kind = 'd'
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_pii_surrogates": op2_pii_surrogates,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_url_rules": op5_url_rules,
        "op6_quality": op6_quality,
        "op7_toxicity": op7_toxicity,
        "op8_token_codec": op8_token_codec,
        "op9_packing": op9_packing,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op10_decontamination": OP10_SQL}
