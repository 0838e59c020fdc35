"""Awkward documents that every operator must take: nulls in every column, empty
and very long texts, ties, repeated rows, clashing extra columns, no rows."""

from __future__ import annotations

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} run{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s0", None),
    (2, None, "en", "s0", None),
    (3, "", None, "s1", 0),
    (4, " \n\t ", "fr", None, 3),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s0", 55),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s0", 55),
    (6, LONG, "de", "s1", len(LONG)),
    (None, "no id here but some words to read", "en", "s0", 33),
    (None, None, None, None, None),
    (7, "one two", "en", "s0", 7),
    (8, "left part of eight " + PASSAGE + " right part", "en", "s2", None),
    (9, "nine begins " + PASSAGE + " and ends elsewhere", "en", "s2", None),
    (10, "ünïcode wörds ändern sich 日本語 テキスト", "es", "s3", None),
]
CLASH = ("class_id", "score", "kept", "digest", "rep", "key", "id", "a", "b", "probability", "tokens", "range_", "row_", "mix_source", "class_of", "copies", "TEXT_A")


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, DOCS)


def clashing(df):
    """The same rows with extra columns whose names operators might use."""
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


def duck(sql: str, sf_dir: str, *tables: str):
    import duckdb

    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return sorted(map(tuple, c.execute(sql).fetchall()), key=str)


def shingles(text, k=5):
    w = [x for x in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
