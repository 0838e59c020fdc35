"""Deterministic order keys and distributed ranking / prefix sums.

Seeded "random" order = md5 of ``'<seed>:<key>'``, first 32 bits as a BIGINT
(the same integer DuckDB computes with ``('0x'||substr(md5(..),1,8))::BIGINT``),
ties broken by the key itself.  Python's Mersenne Twister / NumPy / sklearn
shuffles cannot be reproduced in SQL; sizes and invariants match instead.

Ranking and running sums never use an un-partitioned ``Window.orderBy`` over the
rows.  Rows are cut into order-preserving buckets: equal parts of the range of a
32-bit hash, or, for any other key (numbers of any spread, scores, strings), the
stretches between sample quantiles of the whole order key.  The sample is the
rows with the smallest hash of the key, a pure function of the data, so however
often it is evaluated the cuts are the same; it is a scalar subquery of the plan
and nothing runs while the plan is built.  Rows are shuffled once by (group,
bucket); the windows and the bucket totals both read that shuffle, and the
offset of a bucket is the running total over a table of at most ``MOST_CUTS + 1``
rows a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296
#: equal parts of the range of a hash
HASH_BUCKETS = 1 << 14
#: values of a dense ordinal in a bucket
ORDINALS = 1 << 16
#: rows of the sample, rows between two cuts, and so the most cuts there are
SAMPLE, SPACING = 1 << 15, 16
MOST_CUTS = SAMPLE // SPACING


def hash_order(seed, key) -> Column:
    """32-bit seeded hash of a key, as a non-negative BIGINT in [0, 2^32)."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_uniform(seed, key) -> Column:
    """Seeded pseudo-uniform value in [0, 1) for a key."""
    return hash_order(seed, key) / F.lit(float(TWO_POW_32))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sample_cuts(df: DataFrame, order: Sequence[str]) -> Column:
    """Sorted cuts of the order key: every ``SPACING``-th of the ``SAMPLE`` keys
    with the smallest hash, as a scalar subquery."""
    key = F.struct(*[_c(o) for o in order])
    least = df.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(SAMPLE)
    every = F.filter(F.array_sort(F.collect_list("k")), lambda _, i: i % SPACING == SPACING - 1)
    return least.agg(every.alias("cuts")).scalar()


def with_bucket(df: DataFrame, order: Sequence[str], bounds: tuple | str | None = None, out: str = "_rl_b") -> DataFrame:
    """Add the order-preserving bucket of each row: with ``bounds`` equal parts
    of the first order column's range; with ``bounds="ordinal"``, for a key that
    counts the rows of a group by construction, stretches of ``ORDINALS`` values;
    else the number of sample cuts at or below the row's key (a binary search in
    one expression, which holds the cuts' subquery once)."""
    if bounds == "ordinal":
        return df.withColumn(out, F.floor(_c(order[0]) / ORDINALS).cast("int"))
    if bounds is not None:
        lo, hi = (float(b) for b in bounds)
        scale = F.lit(HASH_BUCKETS / max(hi - lo, 1e-9))
        part = F.floor((_c(order[0]).cast("double") - F.lit(lo)) * scale)
        return df.withColumn(out, F.least(part, F.lit(HASH_BUCKETS - 1)).cast("int"))
    key = F.struct(*[_c(o) for o in order])
    steps = F.array(*[F.lit(MOST_CUTS >> i) for i in range(MOST_CUTS.bit_length())])
    cut = lambda at: F.get(F.col("_rl_c"), at - 1)
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(cut(at + step) <= key, F.lit(False)), step).otherwise(0))
    return df.withColumn("_rl_c", sample_cuts(df, order)).withColumn(out, found).drop("_rl_c")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(r[f"_rk_{k}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, "inner").drop(*[f"_rk_{k}" for k in keys])


def range_cumsum(
    df: DataFrame,
    value,
    order: Sequence[str],
    by: Sequence[str] = (),
    out: str = "cum",
    inclusive: bool = True,
    bounds: tuple | str | None = None,
    total_out: str | None = None,
) -> DataFrame:
    """Running sum of ``value`` in ``order`` inside ``by`` groups
    (``sum(value) over (partition by by order by order rows unbounded preceding)``).

    ``order`` must be a total order inside a group; pass ``bounds=(lo, hi)`` when
    its first column is a hash spread evenly over that range, ``"ordinal"`` when
    it counts the rows of the group.
    ``inclusive=False`` sums only the rows strictly before.
    ``value`` may be a dict ``{out_name: value}`` to compute several running
    sums in the same pass (one shuffle).  ``total_out`` names an extra
    column holding the group total of the first value (from the small
    offsets table, no extra pass over the rows).
    """
    by = list(by)
    order = list(order)
    values = value if isinstance(value, dict) else {out: value}
    t = with_bucket(df, order, bounds)
    names = list(values)
    for i, v in enumerate(values.values()):
        t = t.withColumn(f"_rl_v{i}", F.lit(v) if isinstance(v, (int, float)) else _c(v))
    t = t.repartition(*by, "_rl_b")  # the one shuffle that windows and totals share
    local_w = Window.partitionBy(*by, "_rl_b").orderBy(*[_c(o) for o in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_rl_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    local = t
    aggs, offs = [], []
    for i in range(len(names)):
        local = local.withColumn(f"_rl_l{i}", F.coalesce(F.sum(f"_rl_v{i}").over(local_w), F.lit(0)))
        aggs.append(F.sum(f"_rl_v{i}").alias(f"_rl_t{i}"))
    # the totals read the same columns as the windows (a hash that is never null),
    # so both share the one shuffle whatever the row carries
    rest = [c for c, kind in t.dtypes if "map<" not in kind and "variant" not in kind]
    totals = t.groupBy(*by, "_rl_b").agg(*aggs, F.max(F.xxhash64(*rest)).alias("_rl_all")).where("_rl_all is not null").drop("_rl_all")
    for i in range(len(names)):
        totals = totals.withColumn(f"_rl_o{i}", F.coalesce(F.sum(f"_rl_t{i}").over(before), F.lit(0)))
        offs.append(f"_rl_o{i}")
    if total_out:
        totals = totals.withColumn(total_out, F.coalesce(F.sum("_rl_t0").over(whole), F.lit(0)))
        offs.append(total_out)
    offsets = totals.select(*by, "_rl_b", *offs)
    if not by:  # at most HASH_BUCKETS or MOST_CUTS + 1 rows
        offsets = F.broadcast(offsets)
    joined = _null_safe_join(local, offsets, [*by, "_rl_b"])
    for i, name in enumerate(names):
        own = F.lit(0) if inclusive else F.coalesce(F.col(f"_rl_v{i}"), F.lit(0))
        joined = joined.withColumn(name, F.col(f"_rl_o{i}") + F.col(f"_rl_l{i}") - own)
    drop = ["_rl_b"] + [f"_rl_{k}{i}" for i in range(len(names)) for k in ("v", "l", "o")]
    return joined.drop(*drop)


def global_rank(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "rank",
                bounds: tuple | str | None = None, total_out: str | None = None) -> DataFrame:
    """``row_number() over (partition by by order by order)`` (1-based) without
    a single-task window; hot groups are split into buckets.  ``total_out``:
    the group's number of rows."""
    return range_cumsum(df, F.lit(1).cast("long"), order, by, out=out, bounds=bounds, total_out=total_out)


def hash_rank(df: DataFrame, seed, key: str, by: Sequence[str] = (), out: str = "rank", total_out: str | None = None) -> DataFrame:
    """Rank rows in seeded hash order (``hash_order(seed, key)``, then ``key``)."""
    t = df.withColumn("_rl_h", hash_order(seed, key))
    return global_rank(t, ["_rl_h", key], by, out=out, bounds=(0, TWO_POW_32), total_out=total_out).drop("_rl_h")
