"""Splits, samples, shuffles and group heads.

Exact-size operators rank rows in seeded hash order with
``functions.ordering.hash_rank`` (bucketed, no single-task window) and compare
the rank with quotas computed in DOUBLE arithmetic (``int(n * 0.7)``).
``split_hash`` is the shuffle-free alternative (fraction thresholds on the
hash, sizes only approximately equal to the ratios).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import global_rank, hash_order, hash_rank, hash_uniform

#: so many rows at most are taken by a distributed top-n instead of a rank of all
FEW = 10_000


def _floor_of(n: Column, ratio: float) -> Column:
    return F.floor(n.cast("double") * F.lit(float(ratio))).cast("long")


def split_exact(df: DataFrame, key: str, seed=10086, ratios=(0.7, 0.1), names=("train", "dev", "test"),
                by: Sequence[str] = (), out: str = "split") -> DataFrame:
    """Exact sizes ``int(n*r1)``, ``int(n*r2)``, rest, in seeded hash order
    (per ``by`` group when given: stratified split)."""
    check_ratios(ratios, names)
    t = hash_rank(df, seed, key, by, out="_rank", total_out="_n")
    bounds = []
    acc = None
    for r in ratios:
        q = _floor_of(F.col("_n"), r)
        acc = q if acc is None else acc + q
        bounds.append(acc)
    expr = None
    for b, name in zip(bounds, names):
        expr = F.when(F.col("_rank") <= b, F.lit(name)) if expr is None else expr.when(F.col("_rank") <= b, F.lit(name))
    expr = expr.otherwise(F.lit(names[len(bounds)]))
    return t.withColumn(out, expr).drop("_n", "_rank")


def split_hash(df: DataFrame, key: str, seed=10086, ratios=(0.7, 0.1), names=("train", "dev", "test"),
               out: str = "split") -> DataFrame:
    """Scalable split: a row goes to the bucket its hash fraction falls into.
    No shuffle, no count; sizes match the ratios only in expectation."""
    check_ratios(ratios, names)
    u = hash_uniform(seed, key)
    expr = None
    cum = 0.0
    for r, name in zip(ratios, names):
        cum += r
        expr = F.when(u < F.lit(cum), F.lit(name)) if expr is None else expr.when(u < F.lit(cum), F.lit(name))
    return df.withColumn(out, expr.otherwise(F.lit(names[len(ratios)])))


def split_stratified(df: DataFrame, key: str, label: str, seed=10086, ratios=(0.7, 0.1),
                     names=("train", "dev", "test"), out: str = "split") -> DataFrame:
    """Per-class exact quotas (train ``int(n_c*r1)``, dev ``int(n_c*r2)``,
    rest test) in one ranking pass."""
    return split_exact(df, key, seed, ratios, names, by=[label], out=out)


def split_by_ratio(df: DataFrame, key: str, ratio_text: str = "6,2,2", seed=1234, out: str = "split_no") -> DataFrame:
    """Split by a ratio string: normalise, cumulative ``round(r*n)`` (half to
    even), subtract the overshoot from every boundary, slice the seeded order."""
    rs = [float(s) for s in ratio_text.split(",")]
    total = sum(rs)
    rs = [r / total for r in rs]
    t = hash_rank(df, seed, key, out="_rank", total_out="_n")
    n = F.col("_n").cast("double")
    cum = []
    acc = None
    for r in rs:
        part = F.bround(F.lit(r) * n, 0).cast("long")
        acc = part if acc is None else acc + part
        cum.append(acc)
    diff = cum[-1] - F.col("_n")
    idx = F.lit(0)
    for b in cum[:-1]:
        idx = idx + F.when(F.col("_rank") > (b - diff), 1).otherwise(0)
    return t.withColumn(out, idx.cast("int")).drop("_n", "_rank")


def holdout_n(df: DataFrame, key: str, n: int = 1000, seed=42, out: str = "part") -> DataFrame:
    """Shuffled hold-out of ``n`` rows (``'eval'``), the rest ``'train'``."""
    t = hash_rank(df, seed, key, out="_rank")
    return t.withColumn(out, F.when(F.col("_rank") <= n, F.lit("eval")).otherwise(F.lit("train"))).drop("_rank")


def head_tail_split(df: DataFrame, order: Sequence[str], n: int = 3000, head="valid", tail="train", out="split") -> DataFrame:
    """First ``n`` rows (by an explicit order key) vs the rest."""
    t = global_rank(df, order, out="_rank")
    return t.withColumn(out, F.when(F.col("_rank") <= n, F.lit(head)).otherwise(F.lit(tail))).drop("_rank")


def local_id(df: DataFrame, split_col: str, order: Sequence[str], out: str = "id") -> DataFrame:
    """Re-number rows inside each split from 0 (split-local id)."""
    t = global_rank(df, order, by=[split_col], out="_rank")
    return t.withColumn(out, F.col("_rank") - 1).drop("_rank")


def sample_n(df: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    """Simple random sample of exactly ``min(n, count)`` rows: a top-n by the
    seeded hash for few rows, a rank for many."""
    if n <= FEW:
        return df.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(n).drop("_h")
    return hash_rank(df, seed, key, out="_rank").where(F.col("_rank") <= n).drop("_rank")


def shuffle_seeded(df: DataFrame, key: str, seed=42, out: str = "pos") -> DataFrame:
    """Seeded permutation: each row gets its 0-based position."""
    return hash_rank(df, seed, key, out="_rank").withColumn(out, F.col("_rank") - 1).drop("_rank")


def class_quotas(df: DataFrame, label: str, total: Column | int | None = None, fraction: float | None = None) -> DataFrame:
    """Per-class quotas by largest remainder (ties: label order).

    ``fraction`` keeps ``n - ceil((1-f)*n)`` rows overall; ``total`` a fixed
    number.  Works on the class-count table (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w_all = Window.partitionBy()
    counts = counts.withColumn("_N", F.sum("_nc").over(w_all))
    if fraction is not None:
        T = F.col("_N") - F.ceil(F.lit(1.0 - fraction) * F.col("_N").cast("double"))
    else:
        T = F.least(F.lit(int(total)), F.col("_N"))
    share = T.cast("double") * F.col("_nc").cast("double") / F.col("_N").cast("double")
    counts = counts.withColumn("_T", T.cast("long")).withColumn("_base", F.floor(share).cast("long")).withColumn("_frac", share - F.floor(share))
    counts = counts.withColumn("_rem", F.col("_T") - F.sum("_base").over(w_all))
    counts = counts.withColumn("_rk", F.row_number().over(Window.orderBy(F.desc("_frac"), F.asc(label))))
    return counts.select(label, (F.col("_base") + F.when(F.col("_rk") <= F.col("_rem"), 1).otherwise(0)).alias("quota"))


def stratified_sample(df: DataFrame, key: str, label: str, fraction: float | None = None, total: int | None = None,
                      seed=42) -> DataFrame:
    """Stratified sample with exact per-class quotas (fraction or fixed size),
    members chosen in seeded hash order inside each class."""
    quotas = class_quotas(df, label, total=total, fraction=fraction)
    t = hash_rank(df, seed, key, by=[label], out="_rank")
    return t.join(quotas, label, "inner").where(F.col("_rank") <= F.col("quota")).drop("_rank", "quota")


def _first_ranked(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """At least the first ``n`` rows in order, with ``_rank``: few rows by a
    distributed top-n and a window over those, many by a rank of all."""
    if n <= FEW:
        return df.orderBy(*order).limit(n).withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    return global_rank(df, order, out="_rank")


def balance_cap(df: DataFrame, label: str, order: Sequence[str], positive=1, negative=0, total: int = 100) -> DataFrame:
    """All positives, then the first ``total - n_pos`` negatives in row order
    (none when positives already exceed the total)."""
    n_pos = df.agg(F.count_if(F.col(label) == F.lit(positive))).scalar()
    negs = _first_ranked(df.where(F.col(label) == F.lit(negative)), order, total)
    negs = negs.where(F.col("_rank") <= F.greatest(F.lit(total) - n_pos, F.lit(0))).drop("_rank")
    return df.where(F.col(label) == F.lit(positive)).unionByName(negs)


def slice_rows(df: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    """Positional slice ``[start:stop]`` in an explicit order."""
    t = _first_ranked(df, order, stop)
    return t.where((F.col("_rank") > start) & (F.col("_rank") <= stop)).drop("_rank")


def preview_first_k(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """First ``k`` rows in an explicit order (distributed top-k)."""
    return df.orderBy(*order).limit(k)


def group_head_n(df: DataFrame, group, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows per group in row order, NULL groups dropped.

    ``row_number() <= n`` lets Spark insert a partial per-group limit before
    the shuffle (WindowGroupLimit), so a hot group ships at most ``n`` rows
    per input partition."""
    g = F.col(group) if isinstance(group, str) else group
    t = df.withColumn("_grp", g).where(F.col("_grp").isNotNull())
    w = Window.partitionBy("_grp").orderBy(*order)
    return t.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn", "_grp")


def topk_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int, out: str = "rnk") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def check_ratios(ratios: Sequence[float], names: Sequence[str]) -> None:
    """Named shares, the last one implied, must be non-negative and sum to 1."""
    if len(names) != len(ratios) + 1 or not ratios_valid([*ratios, 1.0 - sum(ratios)]) or min([*ratios, 1.0 - sum(ratios)]) < -1e-9:
        raise ValueError(f"ratios {tuple(ratios)} do not give shares for {tuple(names)}")


def ratios_valid(ratios: Sequence[float]) -> bool:
    """Sanity check: ratios sum to 1 (driver side)."""
    return math.isclose(sum(ratios), 1.0, abs_tol=1e-9)


def content_of(df: DataFrame, key: str) -> str:
    """A fingerprint of a column's values that does not depend on their order:
    how many there are, and the sum and the exclusive or of two hashes."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    one, two = F.xxhash64(text), F.xxhash64(F.lit("2"), text)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y")).first()
    return f"{r.n}-{int(r.s or 0) & ((1 << 128) - 1):x}-{(r.x or 0) & ((1 << 64) - 1):x}-{(r.y or 0) & ((1 << 64) - 1):x}"


def cached_split(spark, df: DataFrame, key: str, path: str, dataset: str, seed=10086, ratios=(0.7, 0.1),
                 names=("train", "dev", "test")) -> DataFrame:
    """Split assignment computed once and kept as Parquet under ``path``, by the data
    set's name, the seed, the ratios, the names and the keys' content, so changed
    rows under an old name are split anew.

    The rows are written to a folder of their own first; a manifest that names it is
    written after, and only what a manifest names is read.  So a folder that a
    failed run left half-written is never used, and of two runs at the same time
    both write, and all later ones read the same one (the smaller name)."""
    tag = f"dataset={dataset}/seed={seed}/ratios={'_'.join(str(r) for r in ratios)}/names={'_'.join(names)}/content={content_of(df, key)}"
    target = f"{path.rstrip('/')}/{tag}"
    run = _published(spark, target)
    if run is None:
        own = uuid.uuid4().hex
        split_exact(df.select(key), key, seed, ratios, names).write.parquet(f"{target}/run-{own}")
        spark.createDataFrame([(own,)], "run string").coalesce(1).write.mode("append").json(f"{target}/manifest")
        run = _published(spark, target)
    return spark.read.parquet(f"{target}/run-{run}")


def _published(spark, target: str) -> str | None:
    try:
        return spark.read.schema("run string").json(f"{target}/manifest").agg(F.min("run")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
