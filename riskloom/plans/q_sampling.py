"""Splits, samples and group heads on ``customer``, ``orders``, ``labels``,
``documents`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators import features as ft
from ..operators import sampling as sp
from .registry import T, query, sql_hash

SPLIT_SEED = 10086
PRIORITY_GROUP = {"1-URGENT": 1, "2-HIGH": 1, "3-MEDIUM": 0, "4-NOT SPECIFIED": 0}

_SPLIT_CTE = (
    "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY h, c_custkey) AS rk, count(*) OVER () AS n "
    f"FROM (SELECT c_custkey, {sql_hash(SPLIT_SEED, 'c_custkey')} AS h FROM customer)), "
    "s AS (SELECT c_custkey, rk, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' "
    "WHEN rk <= floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM r) "
)


def customer_split(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_name")
    return sp.split_exact(c, "c_custkey", seed=SPLIT_SEED)


@query("split_exact", _SPLIT_CTE + "SELECT c_custkey, split FROM s")
def split_exact(spark, sf):
    return customer_split(spark, sf).select("c_custkey", "split")


def _hash_split_sql():
    cum, parts = 0.0, []
    for r, name in zip((0.7, 0.1), ("train", "dev")):
        cum += r
        parts.append(f"WHEN h / 4294967296.0 < {cum!r} THEN '{name}'")
    return (f"SELECT c_custkey, CASE {' '.join(parts)} ELSE 'test' END AS split "
            f"FROM (SELECT c_custkey, {sql_hash(SPLIT_SEED, 'c_custkey')} AS h FROM customer)")


@query("split_hash", _hash_split_sql())
def split_hash(spark, sf):
    return sp.split_hash(T(spark, sf, "customer"), "c_custkey", seed=SPLIT_SEED).select("c_custkey", "split")


@query("split_remainder_anti", _SPLIT_CTE + "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s WHERE split = 'train')")
def split_remainder_anti(spark, sf):
    s = customer_split(spark, sf)
    train = s.where(F.col("split") == "train").select("c_custkey")
    return T(spark, sf, "customer").join(train, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("split_members_semi", _SPLIT_CTE + "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT c_custkey FROM s WHERE split = 'train')")
def split_members_semi(spark, sf):
    s = customer_split(spark, sf)
    train = s.where(F.col("split") == "train").select("c_custkey")
    return T(spark, sf, "customer").join(train, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("split_test_plus_dev", _SPLIT_CTE + "SELECT c_custkey, split AS origin FROM s WHERE split IN ('test', 'dev')")
def split_test_plus_dev(spark, sf):
    s = customer_split(spark, sf)
    test = s.where(F.col("split") == "test").select("c_custkey", F.col("split").alias("origin"))
    dev = s.where(F.col("split") == "dev").select("c_custkey", F.col("split").alias("origin"))
    return test.unionByName(dev)


@query("split_stratified",
       "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS rk, "
       "count(*) OVER (PARTITION BY quality) AS n FROM "
       f"(SELECT doc_id, quality, {sql_hash(SPLIT_SEED, 'doc_id')} AS h FROM labels)) "
       "SELECT doc_id, quality, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' "
       "WHEN rk <= floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM r")
def split_stratified(spark, sf):
    lab = T(spark, sf, "labels").select("doc_id", "quality")
    return sp.split_stratified(lab, "doc_id", "quality", seed=SPLIT_SEED).select("doc_id", "quality", "split")


def _ratio_sql(text="6,2,2", seed=1234):
    rs = [float(s) for s in text.split(",")]
    tot = sum(rs)
    rs = [r / tot for r in rs]
    cums, acc = [], []
    for r in rs:
        acc.append(f"CAST(round_even({r!r} * n, 0) AS BIGINT)")
        cums.append(" + ".join(acc))
    diff = f"(({cums[-1]}) - n)"
    idx = " + ".join(f"CASE WHEN rk > (({c}) - {diff}) THEN 1 ELSE 0 END" for c in cums[:-1])
    return (f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS rk, count(*) OVER () AS n "
            f"FROM (SELECT o_orderkey, {sql_hash(seed, 'o_orderkey')} AS h FROM orders)) "
            f"SELECT o_orderkey, CAST({idx} AS INTEGER) AS split_no FROM r")


@query("split_by_ratio", _ratio_sql())
def split_by_ratio(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey")
    return sp.split_by_ratio(o, "o_orderkey", "6,2,2", seed=1234)


@query("holdout_n",
       "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY h, o_orderkey) <= 1000 THEN 'eval' ELSE 'train' END AS part "
       f"FROM (SELECT o_orderkey, {sql_hash(42, 'o_orderkey')} AS h FROM orders)")
def holdout_n(spark, sf):
    return sp.holdout_n(T(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000, seed=42)


@query("head_tail_split",
       "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 3000 THEN 'valid' ELSE 'train' END AS split FROM orders")
def head_tail_split(spark, sf):
    return sp.head_tail_split(T(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 3000)


@query("split_local_id", _SPLIT_CTE + "SELECT c_custkey, split, row_number() OVER (PARTITION BY split ORDER BY c_custkey) - 1 AS id FROM s")
def split_local_id(spark, sf):
    s = customer_split(spark, sf).select("c_custkey", "split")
    return sp.local_id(s, "split", ["c_custkey"]).select("c_custkey", "split", "id")


@query("sample_n",
       f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash(7, 'o_orderkey')}, o_orderkey) AS rk FROM orders) WHERE rk <= 2000")
def sample_n(spark, sf):
    return sp.sample_n(T(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 2000, seed=7)


@query("shuffle_seeded",
       f"SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) - 1 AS pos FROM orders")
def shuffle_seeded(spark, sf):
    return sp.shuffle_seeded(T(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=42)


def _quota_sql(total_expr: str, seed=42):
    return (
        "WITH c AS (SELECT o_orderstatus AS lbl, count(*) AS nc FROM orders GROUP BY o_orderstatus), "
        "t AS (SELECT lbl, nc, sum(nc) OVER () AS bign FROM c), "
        f"t2 AS (SELECT lbl, nc, bign, CAST({total_expr} AS BIGINT) AS tot FROM t), "
        "t3 AS (SELECT lbl, tot, CAST(tot AS DOUBLE) * CAST(nc AS DOUBLE) / CAST(bign AS DOUBLE) AS share FROM t2), "
        "t4 AS (SELECT lbl, tot, CAST(floor(share) AS BIGINT) AS base, share - floor(share) AS frac FROM t3), "
        "t5 AS (SELECT lbl, base, frac, tot - sum(base) OVER () AS rem FROM t4), "
        "qt AS (SELECT lbl, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, lbl ASC) <= rem THEN 1 ELSE 0 END AS quota FROM t5), "
        "r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY "
        f"{sql_hash(seed, 'o_orderkey')}, o_orderkey) AS rk FROM orders) "
        "SELECT o_orderkey, o_orderstatus FROM r JOIN qt ON r.o_orderstatus = qt.lbl WHERE rk <= quota"
    )


@query("stratified_fraction", _quota_sql(f"bign - ceil({1.0 - 0.2!r} * CAST(bign AS DOUBLE))"))
def stratified_fraction(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sp.stratified_sample(o, "o_orderkey", "o_orderstatus", fraction=0.2, seed=42)


@query("stratified_fixed_n", _quota_sql("least(500, bign)"))
def stratified_fixed_n(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sp.stratified_sample(o, "o_orderkey", "o_orderstatus", total=500, seed=42)


@query("balance_cap",
       "WITH p AS (SELECT count(*) AS n1 FROM labels WHERE toxic = 1) "
       "SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL "
       "SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id) AS rk FROM labels WHERE toxic = 0), p "
       "WHERE rk <= greatest(100 - p.n1, 0)")
def balance_cap(spark, sf):
    lab = T(spark, sf, "labels").select("doc_id", "toxic")
    return sp.balance_cap(lab, "toxic", ["doc_id"], positive=1, negative=0, total=100)


@query("slice_rows",
       "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rk FROM orders) WHERE rk > 25 AND rk <= 43")
def slice_rows(spark, sf):
    return sp.slice_rows(T(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 25, 43)


@query("preview_first_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_first_k(spark, sf):
    return sp.preview_first_k(T(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 5)


@query("group_head_n",
       "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn "
       "FROM documents WHERE lang IS NOT NULL) WHERE rn <= 50")
def group_head_n(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "lang")
    return sp.group_head_n(d, "lang", ["doc_id"], 50)


@query("group_head_n_threshold",
       "SELECT p_partkey, bucket FROM (SELECT p_partkey, bucket, row_number() OVER (PARTITION BY bucket ORDER BY p_partkey) AS rn "
       "FROM (SELECT p_partkey, CASE WHEN p_size <= 25 THEN '<= 25' ELSE '> 25' END AS bucket FROM part)) WHERE rn <= 50")
def group_head_n_threshold(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", ft.threshold_bucket("p_size", 25).alias("bucket"))
    return sp.group_head_n(p, "bucket", ["p_partkey"], 50)


@query("group_head_n_mapped",
       "SELECT o_orderkey, grp FROM (SELECT o_orderkey, grp, row_number() OVER (PARTITION BY grp ORDER BY o_orderkey) AS rn FROM "
       "(SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 "
       "WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 0 END AS grp FROM orders) WHERE grp IS NOT NULL) WHERE rn <= 50")
def group_head_n_mapped(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", ft.recode("o_orderpriority", PRIORITY_GROUP).alias("grp"))
    return sp.group_head_n(o, "grp", ["o_orderkey"], 50)


SHARES = {"train": 0.7, "dev": 0.1, "test": 0.2}


@query("split_shares",  # a split that keeps to its ratios, and one that does not
       _SPLIT_CTE + "SELECT g.split, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / t.n, 6) AS share, g.wanted, abs(coalesce(c.n, 0) / t.n - g.wanted) <= 0.001 AS within "
       "FROM (VALUES ('train', 0.7::DOUBLE), ('dev', 0.1::DOUBLE), ('test', 0.2::DOUBLE), ('holdout', 0.05::DOUBLE)) g(split, wanted) "
       "LEFT JOIN (SELECT split, count(*) AS n FROM s GROUP BY split) c USING (split), (SELECT count(*)::DOUBLE AS n FROM s) t")
def split_shares(spark, sf):
    return ck.share_table(customer_split(spark, sf), "split", {**SHARES, "holdout": 0.05}, 0.001).withColumn("share", F.round("share", 6))
