"""Language identification: counts and scores against a plain Python version,
held-out agreement, awkward rows."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from riskloom.operators import language as la

from .conftest import SF01

ROWS = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, "12 + 34 !?", "en"), (6, "THE DOG", None),
        (7, "été à la plage", "fr"), (8, "a", "en"), (8, "a", "en"), (9, "the " * 200_000, "en")]


def buckets(text):
    data = (" " + re.sub("[^a-z\x80-\U0010ffff]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) + " ").encode()
    return [((a * 31 + b) * 31 + c) % la.BUCKETS for a, b, c in zip(data, data[1:], data[2:])]


def brute(rows):
    counts = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(buckets(text))
    out = []
    for doc_id, text, _ in rows:
        told = None
        if text and any(c.isalpha() for c in text):
            scores = []
            for lang in sorted(counts):
                n, total = counts[lang], sum(counts[lang].values())
                scores.append((-sum(math.floor(la.UNIT * math.log((n[b] + 1) / (total + la.BUCKETS)) + 0.5) for b in buckets(text)), lang))
            scores.sort()
            told = scores[0][1], scores[1][0] - scores[0][0]
        out.append((doc_id, *(told or (None, None))))
    return sorted(out, key=str)


def test_scores_are_the_plain_ones(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    model = la.learn(df, "text", "lang")
    assert model.languages == ("en", "fr")
    told = la.identify(df, "text", model).select("doc_id", "language", "lead")
    assert sorted(map(tuple, told.collect()), key=str) == brute(ROWS)
    extra = df.withColumn("bucket", F.lit(1)).withColumn("_letters", F.lit("x")).withColumn("n", F.lit(2))
    assert sorted(map(tuple, la.identify(extra, "text", model).select("doc_id", "language", "lead").collect()), key=str) == brute(ROWS)
    assert [r.doc_id for r in la.keep_languages(df, "text", model, ["fr"]).orderBy("doc_id").collect()] == [r[0] for r in sorted(brute(ROWS)) if r[1] == "fr"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame(ROWS[:2], "doc_id long, text string, lang string")
    model = la.learn(df.limit(0), "text", "lang")
    assert model.languages == ()
    assert [tuple(r) for r in la.identify(df, "text", model).select("language", "lead").collect()] == [(None, None)] * 2
    assert la.identify(df.limit(0), "text", la.learn(df, "text", "lang")).count() == 0


def test_held_out_agreement(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang")
    model = la.learn(d.where("doc_id % 2 = 0"), "text", "lang")
    told = la.agreement(la.identify(d.where("doc_id % 2 = 1"), "text", model)).collect()
    right, total = sum(r.n for r in told if r.label == r.language), sum(r.n for r in told)
    assert total > 400 and right >= 0.98 * total


def test_lots_cut_nothing():
    import pyarrow as pa

    texts = pa.array([" ab cd ", "", " x ", " longer text here "])
    whole, counts = la.trigrams(texts)
    parts = [la.trigrams(texts.slice(lo, hi - lo)) for lo, hi in la._lots(texts, 5)]
    assert [b for p, _ in parts for b in p.tolist()] == whole.tolist()
    assert [c for _, n in parts for c in n.tolist()] == counts.tolist() == [5, 0, 1, 16]


def test_memory_is_that_of_a_lot(spark):
    """Many texts in one batch are told in lots, whatever the batch's size."""
    import tracemalloc

    import pyarrow as pa
    texts = pa.array([" the cat and the dog " * 100] * 4000)  # 8 MB
    tracemalloc.start()
    sizes = [len(la.trigrams(texts.slice(lo, hi - lo))[0]) for lo, hi in la._lots(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 4000 * (21 * 100 - 2) and peak < 8 << 20, peak
