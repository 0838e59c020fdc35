"""Corpus operators on ``documents``, ``benchmark`` and ``pages``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ordering import hash_order
from ..functions.text import py_strip
from ..operators import html as ht
from ..operators import language as la
from ..operators import text_ops as tx
from ..session import shared_dir
from ..sources import json_arrays as ja
from .registry import T, q, query, sql_hash, sql_strip, sql_ws_tokens


@query("union_all_files",
       "SELECT 'documents' AS origin, 0 AS file_no, doc_id AS id, CAST(length(text) AS INTEGER) AS text_len FROM documents UNION ALL "
       "SELECT 'benchmark', 1, item_id, CAST(length(text) AS INTEGER) FROM benchmark")
def union_all_files(spark, sf):
    d = T(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.length("text").alias("text_len"))
    b = T(spark, sf, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), F.length("text").alias("text_len"))
    return tx.union_sources([d, b]).select("origin", "file_no", "id", "text_len")


def _words_sql(table: str, key: str) -> str:
    return (f"(SELECT piece, min(({key}, p)) AS f FROM (SELECT {key}, unnest(l) AS piece, generate_subscripts(l, 1) AS p "
            f"FROM (SELECT {key}, {sql_ws_tokens('text')} AS l FROM {table})) "
            "GROUP BY piece)")


@query("vocab_merge",
       f"WITH a AS {_words_sql('benchmark', 'item_id')}, b AS {_words_sql('documents', 'doc_id')}, "
       "na AS (SELECT count(*) AS n FROM a) "
       "SELECT piece, row_number() OVER (ORDER BY f, piece) - 1 AS pos FROM a UNION ALL "
       "SELECT piece, na.n + row_number() OVER (ORDER BY f, piece) - 1 FROM b, na WHERE piece NOT IN (SELECT piece FROM a)")
def vocab_merge(spark, sf):
    a = tx.first_occurrence_words(T(spark, sf, "benchmark"), "item_id", "text")
    b = tx.first_occurrence_words(T(spark, sf, "documents"), "doc_id", "text")
    return tx.vocab_merge(a, b)


LANGUAGE_SEED = "language"
#: documents of an even hash teach the labels, the others are told by their text alone
TEACHES = f"{sql_hash(LANGUAGE_SEED, 'doc_id')} % 2 = 0"
SQL_TOLD = (
    f"WITH d AS (SELECT doc_id, lang, {TEACHES} AS teaches, ' ' || regexp_replace(translate(text, '{la.UPPER}', '{la.LOWER}'), '[^a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g') || ' ' AS t FROM documents), "
    "b AS (SELECT doc_id, lang, teaches, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::INTEGER) AS l FROM d WHERE length(trim(t)) > 0), "
    f"g AS (SELECT doc_id, lang, teaches, unnest(list_transform(range(1, len(l) - 1), lambda i: ((l[i] * {la.FACTOR} + l[i + 1]) * {la.FACTOR} + l[i + 2]) % {la.BUCKETS})) AS k FROM b), "
    "f AS (SELECT doc_id, lang, teaches, k, count(*) AS c FROM g GROUP BY ALL), "
    "n AS (SELECT lang, k, sum(c) AS n FROM f WHERE teaches AND lang IS NOT NULL GROUP BY lang, k), "
    "m AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang), "
    f"w AS (SELECT m.lang, k, floor({la.UNIT} * ln((coalesce(n.n, 0) + 1)::DOUBLE / (total + {la.BUCKETS})) + 0.5)::BIGINT AS w FROM m CROSS JOIN (SELECT DISTINCT k FROM f) LEFT JOIN n USING (lang, k)), "
    "s AS (SELECT doc_id, w.lang AS language, sum(c * w)::BIGINT AS score FROM f JOIN w USING (k) GROUP BY doc_id, w.lang), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS place, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS next FROM s), "
    "told AS (SELECT d.doc_id, d.lang, d.teaches, r.language, (r.score - coalesce(r.next, r.score))::BIGINT AS lead FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND r.place = 1) ")


def told(spark, sf):
    """Documents with the language that a model of half of them tells."""
    d = T(spark, sf, "documents").select("doc_id", "lang", "text").withColumn("teaches", hash_order(LANGUAGE_SEED, "doc_id") % 2 == 0)
    model = la.learn(d.where("teaches"), "text", "lang")
    return la.identify(d, "text", model)


@query("identify_language", SQL_TOLD + "SELECT doc_id, language, lead FROM told")
def identify_language(spark, sf):
    return told(spark, sf).select("doc_id", "language", "lead")


@query("language_agreement", SQL_TOLD + "SELECT lang AS label, language, count(*) AS n FROM told WHERE NOT teaches GROUP BY ALL")
def language_agreement(spark, sf):
    return la.agreement(told(spark, sf).where("not teaches"))


@query("filter_languages", SQL_TOLD + "SELECT doc_id, lang FROM told WHERE language IN ('en', 'fr')")
def filter_languages(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "lang", "text")
    model = la.learn(d.where(hash_order(LANGUAGE_SEED, "doc_id") % 2 == 0), "text", "lang")
    return la.keep_languages(d, "text", model, ("en", "fr")).select("doc_id", "lang")


@query("count_empty_text",  # some texts are made empty, blank and missing
       "WITH d AS (SELECT CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(9) || chr(160) WHEN 2 THEN NULL ELSE text END AS text FROM documents) "
       "SELECT count(*) AS n_docs, count(*) FILTER (WHERE length(text) = 0) AS n_empty, "
       f"count(*) FILTER (WHERE text IS NULL OR length({sql_strip('text')}) = 0) AS n_blank FROM d")
def count_empty_text(spark, sf):
    r = F.col("doc_id") % 10
    text = F.when(r == 0, F.lit("")).when(r == 1, F.lit(" \t\xa0")).when(r == 2, F.lit(None)).otherwise(F.col("text"))
    d = T(spark, sf, "documents").select(text.alias("text"))
    return d.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.length("text") == 0).alias("n_empty"),
                 F.count_if(F.col("text").isNull() | (F.length(py_strip("text")) == 0)).alias("n_blank"))


def _html_sql():
    e = "html"
    for pat, rep in tx.HTML_STEPS:
        e = f"regexp_replace({e}, {q(pat)}, {q(rep)}, 'g')"
    return f"trim({e})"


@query("html_to_text", f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_to_text(spark, sf):
    return T(spark, sf, "pages").select("page_id", tx.html_to_text("html").alias("text"))


def _markdown_sql():
    """For the markup of the pages at hand: the whole conversion as replacements."""
    steps = [(r"(?is)<head\b.*?</head>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<!doctype[^>]*>", ""), (r"<[^>]*$", ""), (r"[ \t\n\r\f]+", " "),
             (r'<a href="([^"]*)">([^<]*)</a>', r"[\2](\1)"), (r"</?(?:html|body)\b[^>]*>", "\n\n"), (r"</?b>", ""), (r"<h1>", "\n\n# "), (r"</h1>", "\n\n"),
             (r"<li>", "\n- "), (r"</li>", "\n"), (r"<br>", "\n"), (r"</?(?:ul|p|div|nav|article|footer)\b[^>]*>", "\n\n"),
             (r"&copy;", "©"), (r"&middot;", "·"), (r"&quot;", '"'), (r"&amp;?", "&"), (r" *\n[ \n]*\n *", "\n\n"), (r" *\n *", "\n"), (r"\n\n+- ", "\n- "), (r"  +", " ")]
    e = "html"
    for pat, rep in steps:
        e = f"regexp_replace({e}, {q(pat)}, {q(rep)}, 'g')"
    return f"trim({e}, ' ' || chr(10))"


@query("html_to_markdown", f"SELECT page_id, {_markdown_sql()} AS text FROM pages")
def html_to_markdown(spark, sf):
    return T(spark, sf, "pages").select("page_id", ht.html_to_markdown("html").alias("text"))


@query("json_array_round_trip",  # written as one JSON array over part files, and read back by many tasks
       "SELECT doc_id, lang, md5(text) AS text_md5, n_chars FROM documents")
def json_array_round_trip(spark, sf):
    folder = f"{shared_dir(spark)}/array-{uuid.uuid4().hex}"
    ja.write_json_array(T(spark, sf, "documents").select("doc_id", "lang", "text", "n_chars"), folder, ["doc_id"])
    return ja.json_array(spark, folder, "doc_id BIGINT, lang STRING, text STRING, n_chars BIGINT", one_array=True).select("doc_id", "lang", F.md5("text").alias("text_md5"), "n_chars")
