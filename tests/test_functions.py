"""Python-compatible text helpers and the distributed rank / prefix sum."""

import duckdb
from pyspark.sql import functions as F

from riskloom.functions.ordering import global_rank, hash_order, hash_rank, range_cumsum
from riskloom.functions.text import PY_WS_CHARS, py_float_str, py_strip, py_tuple2, ws_tokens

from .conftest import SF01

FLOATS = [0.0, -0.0, 1.5, -2.25, 0.001, 0.0005, 0.00012, 1e-5, 1.5e-7, 9999999.0, 1e7, 12345678.9,
          -68423460.00000001, 1e15, 1.2345e15, 1e16, 1.5e16, 1e22, 1.7976931348623157e308, 123456.7, 0.1, 2.675]


def test_python_whitespace_set():
    assert PY_WS_CHARS == "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_py_float_str_matches_repr(spark):
    df = spark.createDataFrame([(float(x),) for x in FLOATS], "x double")
    got = [r[0] for r in df.select(py_float_str("x")).collect()]
    assert got == [repr(float(x)) for x in FLOATS]


def test_exact_path_for_subnormals(spark):
    # JDK 17's Double.toString is not shortest for some subnormals
    # ("4.9E-324"); the Arrow-batched exact path uses Python's repr itself.
    from riskloom.functions.text import py_float_str_exact
    df = spark.createDataFrame([(5e-324,), (1.5,)], "x double")
    assert [r[0] for r in df.select(py_float_str_exact("x")).collect()] == ["5e-324", "1.5"]


def test_py_float_str_nulls_and_specials(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r[0] for r in df.select(py_float_str("x")).collect()] == [None, "nan", "inf", "-inf"]


def test_strip_and_split_follow_python(spark):
    texts = ["\xa0 Good \n", "  a b\tc\x1c d  ", "", "　", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(py_strip("t").alias("s"), ws_tokens("t").alias("w")).collect()
    assert [r.s for r in rows] == [t.strip() for t in texts]
    assert [list(r.w) for r in rows] == [t.split() for t in texts]


def test_py_tuple_repr(spark):
    df = spark.createDataFrame([("good", "bad"), ("it's", "x"), ('a"b', "c'd"), ("l\nm", "q")], "a string, b string")
    got = [r[0] for r in df.select(py_tuple2("a", "b")).collect()]
    assert got == [str((a, b)) for a, b in [("good", "bad"), ("it's", "x"), ('a"b', "c'd"), ("l\nm", "q")]]


def test_hash_order_matches_duckdb(spark):
    df = spark.range(0, 50).select(F.col("id"), hash_order(42, "id").alias("h"))
    got = sorted(tuple(r) for r in df.collect())
    exp = sorted(duckdb.sql("select range, ('0x' || substr(md5('42:' || range::varchar), 1, 8))::BIGINT from range(50)").fetchall())
    assert got == exp


def test_global_rank_equals_row_number(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    r = hash_rank(o, 7, "o_orderkey", by=["o_orderstatus"])
    got = sorted((a, b) for a, b in r.select("o_orderkey", "rank").collect())
    exp = sorted(duckdb.sql(
        f"select o_orderkey, row_number() over (partition by o_orderstatus order by ('0x'||substr(md5('7:'||o_orderkey::varchar),1,8))::BIGINT, o_orderkey) "
        f"from '{SF01}/orders.parquet'").fetchall())
    assert got == exp


def test_rank_is_partition_invariant(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet").select("o_orderkey", "o_orderstatus")
    a = global_rank(o, ["o_orderkey"], by=["o_orderstatus"])
    b = global_rank(o.repartition(37), ["o_orderkey"], by=["o_orderstatus"])
    assert sorted(a.collect()) == sorted(b.collect())


def test_range_cumsum_with_null_groups(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3, float(i)) for i in range(40)], "k long, g long, v double")
    r = range_cumsum(df, "v", ["k"], by=["g"])
    got = {row.k: row.cum for row in r.collect()}
    exp = {}
    for g in {None, 0, 1, 2}:
        acc = 0.0
        for i in range(40):
            gi = None if i % 4 == 0 else i % 3
            if gi == g:
                acc += i
                exp[i] = acc
    assert got == exp


def _buckets(df, order):
    from riskloom.functions.ordering import with_bucket
    rows = with_bucket(df, order).groupBy("_rl_b").count().collect()
    return len(rows), max(r["count"] for r in rows)


def test_buckets_follow_the_data(spark):
    n = 40_000
    shared_prefix = spark.range(n).select(F.format_string("Customer#%09d", "id").alias("k"))
    scores = spark.range(n).select((F.col("id") / n).alias("k"))
    sparse = spark.range(n).select((F.xxhash64("id")).alias("k"))
    skewed = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    for df, order in ((shared_prefix, ["k"]), (scores, ["k"]), (sparse, ["k"]), (skewed, ["k", "id"])):
        buckets, largest = _buckets(df, order)
        assert 1000 < buckets < n // 10 and largest < 300
        ranks = global_rank(df, order, out="r").select(F.struct(*order).alias("o"), "r").orderBy("o").collect()
        assert [r.r for r in ranks] == list(range(1, n + 1))


def test_rank_of_strings_is_binary_order(spark):
    words = ["b", "a", "aa", "a\x00", "Z", "é", "ab", "abcdefgh", "abcdefg", "abcdefgi", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in global_rank(df, ["w"]).orderBy("rank").collect()]
    assert got == sorted(words, key=lambda x: x.encode("utf-8"))


def test_one_scan_per_split(spark):
    from riskloom.operators import sampling as sp
    o = spark.read.parquet(f"{SF01}/orders.parquet").select("o_orderkey", "o_orderstatus")
    for df in (sp.split_exact(o, "o_orderkey"), sp.split_stratified(o, "o_orderkey", "o_orderstatus"), sp.sample_n(o, "o_orderkey", 50)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 1


def test_short_kind_matches_python(spark):
    from riskloom.functions.text import py_str
    vals = [0.05, 23.0, 1.5, 100.0, 0.0005, 1e-05, 1e16, 12345678.9, 68423.46, 0.1, -1.0, -0.5, 7.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(py_str("x", "short4_fixed2")).collect()]
    assert got == [str(v) if len(str(v)) <= 4 else f"{v:.2f}" for v in vals]


def test_py_float_str_property(spark):
    import random
    rnd = random.Random(11)
    vals = []
    for _ in range(3000):
        mant = round(rnd.uniform(-10, 10), rnd.randint(0, 17))
        v = mant * 10.0 ** rnd.randint(-12, 22)
        if abs(v) < 9.2e18:
            vals.append(v)
    vals += [rnd.uniform(1e16, 9.2e18) * rnd.choice((1, -1)) for _ in range(3000)]
    vals += [float(rnd.randint(10, 99)) * 10.0 ** rnd.randint(15, 17) for _ in range(300)] + [1e16, 1e17, 1e18, 9e18]
    vals += [round(rnd.uniform(0, 1e5), 2) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(py_float_str("x")).collect()]
    bad = [(v, g) for v, g in zip(vals, got) if g != repr(v)]
    assert not bad, bad[:5]


def test_ws_token_count_matches_split(spark):
    from riskloom.functions.text import ws_token_count
    texts = ["", "  a b\tc\x1c d  ", "　x　y", "one", "a b\x85c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ws_token_count("t")).collect()] == [len(t.split()) for t in texts]


def test_fixed_text_rounds_like_python(spark):
    import random

    from riskloom.functions.text import py_str
    rnd = random.Random(5)
    vals = [1.0005, 2.675, 1.005, 0.125, 0.375, 2.5, 0.5, 1.5, -2.675, -0.125, 0.0005, 0.0015, 0.00049, 12345678.125, 1e22, 0.0, -0.0, 99.995, 0.045, 8.5]
    vals += [round(rnd.uniform(-3, 300), k) for k in (1, 2, 3, 4, 5) for _ in range(3000)] + [rnd.uniform(-1e9, 1e9) for _ in range(2000)]
    vals += [k / 2 ** j for j in range(1, 9) for k in range(1, 90)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for n in (1, 2, 3):
        got = [r[0] for r in df.select(py_str("x", f"fixed{n}")).collect()]
        bad = [(v, g, f"{v:.{n}f}") for v, g in zip(vals, got) if g != f"{v:.{n}f}"]
        assert not bad, bad[:5]


def test_repr_escapes_what_python_escapes(spark):
    texts = ["".join(chr(c) for c in range(lo, lo + 16)) for lo in range(0, 256, 16)] + ["a\\b'", "\x0b\x7f\xa0\xad"]
    df = spark.createDataFrame([(t, "x") for t in texts], "a string, b string")
    assert [r[0] for r in df.select(py_tuple2("a", "b")).collect()] == [str((t, "x")) for t in texts]
