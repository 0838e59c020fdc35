import hashlib

import numpy as np
import pyarrow as pa

from riskloom.llm import fingerprints, queries

from .cases import ROWS, SF, clashing, docs, shingles


def expected(rows):
    """Rows by doc_id (nulls first), then text, with the edited text."""
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        n, after = len(t), rows[(i + 1) % len(rows)][1]
        out.append((d, n, hashlib.sha256((t[:n - n // 4] + after[:n // 4]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edits_equal_brute_force(spark):
    clustered = [(i if i < 1500 else 10**15 + i, f"cluster {i}", "en", "s", 1) for i in range(3000)] + [(-10**17, "far", "en", "s", 1)]
    one_id = [(None if i % 3 else 7, f"text {i * 37 % 1000:04d} of no or one id", "en", "s", 1) for i in range(1200)]
    for rows in (ROWS, clustered, one_id, [ROWS[0]], [(i * 7 % 5000, f"text number {i} " * (i % 9), "en", "s", 1) for i in range(3000)]):
        got = fingerprints.edit_report(clashing(docs(spark, rows))).select("doc_id", "n_chars", "edited_sha256").collect()
        assert sorted(map(tuple, got), key=str) == expected(rows)


def test_likeness_estimates_jaccard(spark):
    rows = queries.op2_fingerprints(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts)
    errors = []
    for r in rows:
        t, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        e = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        for other, near in ((e, r.near_edited), (after, r.near_next)):
            a, b = shingles(t), shingles(other)
            errors.append(abs(len(a & b) / max(1, len(a | b)) - near))
            assert 0 <= near <= 1
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


def test_equal_texts_empty_texts_and_packing(spark):
    got = {r.doc_id: r for r in fingerprints.edit_report(docs(spark)).collect()}
    assert got[1].fingerprint == got[5].fingerprint != ""
    assert got[2].fingerprint == got[3].fingerprint == got[4].fingerprint == "" and got[2].near_next == 1.0
    assert fingerprints.edit_report(docs(spark, [])).count() == 0
    for bits in (1, 2, 4, 8):
        a, b, c = fingerprints.sketch(pa.array(["a b c d e f g", "a b c d e f g", "q r s t u v w x y z"]), bins=64, bits=bits)
        assert a == b and len(a) == 64 * bits // 8
        assert fingerprints.match(a, b, bits) == 1.0 and fingerprints.match(a, c, bits) < 0.6


def test_densified_bins_are_all_filled():
    m = np.full((3, 64), fingerprints.EMPTY)
    m[0, 5], m[1, 7], m[1, 9] = 1, 2, 3
    d = fingerprints.densify(m)
    assert (d[0] == 1).all() and set(d[1].tolist()) == {2, 3} and (d[2] == fingerprints.EMPTY).all()


def test_ranges_stay_small_whatever_the_ids(spark):
    """No window holds much more than the rows it is meant for."""
    rows = [(i if i < 2000 else 10**15 + i, f"cluster {i}") for i in range(4000)] + [(-10**17, "far")] + [(None, f"no id {i:05d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = fingerprints.with_next(df, {"after": "text"}, rows=64)
    sizes = fingerprints.range_sizes(df, rows=64)
    assert plan.count() == len(rows) == sum(sizes) and max(sizes) <= 300
