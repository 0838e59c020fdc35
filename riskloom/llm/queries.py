"""The registered queries: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, mixing, near_dedup, packing, passages, pieces, secrets, spelling, tool_calls, topk, toxicity, url_filter
from .common import read
from .registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

SQL_URL = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS h0,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
v AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/'))
SELECT page_id, host, path,
  (SELECT rule FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost) DESC, length(rpath) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost) DESC, length(rpath) DESC LIMIT 1), 'allow') AS verdict
FROM v
"""


@query("op1_url_filter", SQL_URL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path"))
    found = url_filter.judge(spark, F.col("host"), F.col("path"), URL_RULES)
    return pages.withColumn("j", found).select("page_id", "host", "path", "j.rule", "j.verdict")


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(read(spark, sf_dir, "documents"))


SQL_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op9_exact_top_k", SQL_TOPK)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op10_order_minhash")
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(read(spark, sf_dir, "documents"))


@query("op5_target_mix", mixing.oracle())
def op5_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


#: conversations as tool use: a user's turn calls a tool, the turn after it (if the assistant's) is the result
TOOLS = {
    "ask": {"type": "object", "required": ["limit", "query"], "additionalProperties": False, "properties": {
        "limit": {"type": "integer", "minimum": 1, "maximum": 60}, "query": {"type": "string", "minLength": 1, "maxLength": 1000}}},
    "open": {"type": "object", "required": ["query", "turn"], "properties": {
        "query": {"type": "string"}, "turn": {"type": "integer", "minimum": 1}}},
}

SQL_CALLS = r"""
WITH u AS (
  SELECT conv_id, 'call-' || turn AS call_id, turn, text, CASE WHEN turn % 4 < 2 THEN 'ask' ELSE 'open' END AS name,
         coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS n FROM conversations WHERE role = 'user' AND turn IS NOT NULL),
c AS (SELECT conv_id, call_id, min(turn) AS turn, min(text) AS text, min(name) AS name, arg_min(n, coalesce(text, '')) AS n, true AS called FROM u GROUP BY conv_id, call_id),
r AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, min(turn) AS turn, min(text) AS content, true AS answered FROM conversations
      WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id, turn),
l AS (  -- a chain of calls two turns apart: the level counts back to its start
  SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level, run
  FROM (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM c)),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, l.level, called, answered,
         CASE WHEN called AND c.turn >= 2 AND l.level = 0 THEN 'call-' || (c.turn - 2) END AS missing, c.name, c.text, c.n, r.content
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN l ON c.conv_id = l.conv_id AND c.call_id = l.call_id),
e AS (
  SELECT *, CASE WHEN NOT called THEN NULL
    WHEN name = 'ask' THEN nullif(concat_ws('; ', CASE WHEN n < 1 THEN '/limit: minimum 1' END, CASE WHEN n > 60 THEN '/limit: maximum 60' END,
         CASE WHEN text IS NULL THEN '/query: not of type string' WHEN length(text) < 1 THEN '/query: minLength 1' WHEN length(text) > 1000 THEN '/query: maxLength 1000' END), '')
    ELSE nullif(concat_ws('; ', CASE WHEN text IS NULL THEN '/query: not of type string' END, CASE WHEN turn < 1 THEN '/turn: minimum 1' END), '') END AS error,
    CASE WHEN NOT called THEN NULL WHEN name = 'ask' THEN '{"limit":' || n || ',"query":' || coalesce(to_json(text)::VARCHAR, 'null') || '}'
         ELSE '{"query":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || turn || '}' END AS args FROM j)
SELECT conv_id, call_id, turn, level, CASE WHEN called IS NULL THEN 'orphan' WHEN answered IS NULL THEN 'unanswered' ELSE 'linked' END AS status, missing,
  CASE WHEN called THEN error IS NULL END AS valid, CASE WHEN called THEN error END AS error,
  '{"arguments":' || coalesce(args, 'null') || ',"id":' || to_json(call_id)::VARCHAR || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null')
  || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS message
FROM e
"""


@query("op4_tool_calls", SQL_CALLS)
def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is a call (named by its turn, its text the query, its words
    the limit) that needs the call two turns earlier; each assistant turn is the
    result of the turn before it."""
    turns = read(spark, sf_dir, "conversations").where("turn is not null")
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    text, turn = F.col("text"), F.col("turn")
    asks = turn % 4 < 2
    keep = {"ignoreNullFields": "false"}
    words = mixing.tokens_of(text)
    arguments = F.when(asks, F.to_json(F.struct(words.alias("limit"), text.alias("query")), keep)).otherwise(F.to_json(F.struct(text.alias("query"), turn.alias("turn")), keep))
    calls = turns.where("role = 'user'").select("conv_id", name(turn).alias("call_id"), "turn", F.when(asks, "ask").otherwise("open").alias("name"), arguments.alias("arguments"),
                                                F.when(turn >= 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = turns.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), "turn", text.alias("content"))
    return tool_calls.link(calls, results, TOOLS)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_lexical_packing")
def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


@query("op6_compact_windows")
def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(read(spark, sf_dir, "documents"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_piece_offsets")
def op11_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), piece_model())


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), byte_tokenizer(), piece_model())


SQL_SPELLING = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM d, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
      FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
v AS (SELECT word, n, i AS at, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM v a JOIN v b ON a.rest = b.rest AND a.at = b.at AND a.word <> b.word
      UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word
      UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
b AS (SELECT word, count(*) AS n_near, max(n) AS most FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 5 * w.n THEN (SELECT min(near) FROM p WHERE p.word = w.word AND p.n = b.most) END AS form,
             CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n FROM w LEFT JOIN b ON w.word = b.word),
c(word, root, steps) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word) e ON f.word = e.word
"""


@query("op13_spelling_variants", SQL_SPELLING)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), noise=199)
