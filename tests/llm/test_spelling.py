"""Spelling variants: near words against brute force, SQL, awkward rows."""

import random
import zlib

import pytest

from riskloom.llm import queries, spelling

from . import cases

SMALL = "/root/testdata/sf0.001"


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=5):
    words = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    near = {w: [v for v in words if one_error(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def test_matches_brute_force_on_a_dense_vocabulary(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(160)] + ["straße" * 3, "é" * 7, "e" + "é" * 6, "x" * 90, "x" * 91, "x" * 45 + "y" + "x" * 44]
    counts = {w: rng.choice([4, 5, 6, 30, 200, 1200]) for w in stems}
    rows = [(1, " ".join(f"{w}, " * n for w, n in counts.items()))]
    got = cases.shown(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(counts)
    assert sum(r[4] for r in got) > 100


@pytest.mark.parametrize("sizes", [{"tile": 3}, {"block": 64}])
def test_cells_and_blocks_change_nothing(spark, sizes):
    rng = random.Random(7)
    words = sorted({"aaa" + "".join(rng.choice("ab") for _ in range(rng.randint(3, 5))) for _ in range(60)})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if one_error(a, b))
    if "tile" in sizes:
        posts = spelling.postings(table, 6, **sizes).withColumn("block", spelling.F.col("cell"))
        got = posts.groupBy("block").applyInArrow(spelling.near_in_block, "word string, near string, near_n long")
    else:
        got = spelling.near_pairs(table, **sizes)
    assert sorted((r.word, r.near) for r in got.collect()) == want


def test_sql(spark):
    assert cases.shown(queries.QUERIES["op13_spelling_variants"](spark, SMALL)) == cases.duck(queries.ORACLE["op13_spelling_variants"], SMALL, "documents")


def test_noise_and_awkward_rows(spark):
    rows = cases.ROWS * 5
    found = spelling.variants(cases.docs(spark, rows), noise=2)
    counts = {}
    for doc_id, text, *_ in rows:
        for w in spelling.re.findall("[a-zÀ-ÿ]+", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 2 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] = counts.get(w, 0) + 1
    assert cases.shown(found) == brute(counts)
    assert cases.shown(spelling.variants(cases.clashing(cases.docs(spark, rows)), noise=2)) == cases.shown(found)
    assert spelling.variants(cases.docs(spark, []).limit(0)).count() == 0


def test_windows_cut_no_run():
    text = "ab" * 700 + " " + "word " * 500 + "é" * 300
    run = spelling.re.compile(f"[{spelling.LETTERS}]+")
    for window in (1, 7, 100, 5000):
        assert list(spelling.runs_of(text, run, window)) == run.findall(text)
