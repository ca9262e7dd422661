"""The registered queries of the text operators, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arcweave.llm import bpe, chat, decontam, jaccard, lm, pii, quality, secrets, topk, urls
from arcweave.llm.common import table

#: Rank file of the registered encoding; a file that every executor has.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents"), spark.conf.get("spark.arcweave.surrogates.key", "example key"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("copy")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).drop("patterns_run")


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_surrogates, op3_jaccard, op4_decontaminate, op5_language_model, op6_secrets, op7_chat_format, op8_max_score, op9_quality, op10_url_filter)}


OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
g AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
o AS (SELECT r, i, g.k AS k, item_id FROM g JOIN win ON g.t = win.t AND g.k = win.k),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM o)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM o) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN n ON n.r = d.r
"""


_TOKENS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
OP3 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, w, least(len(w), 3) AS k FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)),
s AS (SELECT r, doc_id, list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d WHERE k > 0),
e AS (SELECT r, len(s) AS n, unnest(s) AS t FROM s WHERE doc_id IS NOT NULL),
links AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.t = b.t AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(r, low) AS (SELECT r, doc_id FROM d UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, CAST(coalesce(max(len(s.s)), 0) AS BIGINT) AS n_shingles, min(reach.low) AS component_id FROM d JOIN reach ON reach.r = d.r LEFT JOIN s ON s.r = d.r GROUP BY d.r, d.doc_id
"""


def _op10_sql() -> str:
    fits = "({h} = '{0}' OR ends_with({h}, '.{0}')) AND starts_with(path, '{1}')"
    rules = sorted(urls.HOST_RULES, key=lambda r: -len(r.text))
    when = lambda what: " ".join(f"WHEN {fits.format(r.host, r.path, h='host')} THEN '{getattr(r, what)}'" for r in rules)
    patterns = " ".join(f"WHEN regexp_matches(low, '{p.pattern}') THEN '{p.verdict}'" for p in urls.PATTERN_RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {lower.format("url")} AS low, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {when("text")} END AS rule, coalesce(CASE {when("verdict")} END, CASE {patterns} ELSE 'allow' END) AS verdict FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard": OP3, "op4_decontaminate": OP4, "op8_max_score": OP8, "op10_url_filter": _op10_sql()}
