import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import queries, topk

from .cases import SF, clashing, duck, shown

VECTORS = "vec_id long, embedding array<float>"
ROWS = [(0, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (2, None), (3, [0.1, None, 0.2]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (100, [-1.0, 2.0, 0.5]),
        (7, []), (8, [2.0]), (9, [0.5, -0.25, 1.0]), (None, [1.0, 1.0, 1.0]), (200, [0.0, 0.0, 0.0]), (0, [0.75, 0.0, 0.0]), (9, [0.5, -0.25, 1.0]), (11, [0.0, 0.0, 0.0])]


def brute(rows, k):
    """Best scores of each query id over all its rows and all rows of other ids."""
    sound = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if i % 100 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for j, w in sound if j == q for i, v in sound if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out, key=str)


def test_awkward_rows_equal_brute_force(spark):
    df = clashing(spark.createDataFrame(ROWS, VECTORS))
    for k, block in ((3, 4), (10, 100)):
        assert shown(topk.exact_top_k(df, F.col("vec_id") % 100 == 0, k=k, block_rows=block, block_queries=2)) == brute(ROWS, k)
    assert topk.exact_top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


@given(st.integers(0, 10_000), st.integers(1, 90), st.integers(1, 12), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_bitmap_arithmetic_is_exact(seed, rows, dims, k):
    r = np.random.default_rng(seed)
    x = r.integers(-(1 << int(r.integers(0, 20))), 1 << int(r.integers(1, 20)), (rows, dims))
    x[r.integers(0, rows)] = x[0]
    w = r.integers(-1100, 1100, (2, dims))
    ids = r.permutation(rows * 3)[:rows]
    queries_ids = np.array([ids[0], -5])
    for (q, got, score), v in zip(topk.search_block(ids, x, queries_ids, w, k), w, strict=True):
        want = sorted((-int(s), int(i)) for i, s in zip(ids, x @ v, strict=True) if i != q)[:k]
        assert sorted(zip((-score).tolist(), ids[got].tolist(), strict=True)) == want


def test_rows_that_share_an_id_all_count(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [2.5, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 9.0]), (3, [0.0, 1.0])] + [(4, [0.5, 0.0])] * 30
    df = spark.createDataFrame(rows, VECTORS)
    for k in (2, 5, 40):
        assert shown(topk.exact_top_k(df, F.col("vec_id") % 100 == 0, k=k, block_rows=3)) == brute(rows, k)


def test_query_equals_sql(spark):
    assert shown(queries.op9_exact_top_k(spark, SF)) == duck(queries.SQL_TOPK, SF, "embeddings")
