"""The best ``k`` checkpoints as training goes on: who enters and who is evicted.

A checkpoint enters while fewer than ``k`` are kept, and afterwards if its metric
is strictly better than the worst kept one; that with the worst metric, the
earliest of equal ones, then goes.

The metrics kept before a step are the ``k`` best of all earlier ones, and lists of
``k`` best merge (a monoid, like sums but of lists): every bucket of steps gives its
list, lists are scanned over buckets, and each bucket is gone through from the list
before it, so a run of any length is spread over tasks.  Equal metrics leave in the
order in which they entered: the j-th eviction of a metric takes the j-th checkpoint
that entered with it, which is two ranks and a join."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import global_rank, with_bucket


def _best(lists, k: int):
    return F.slice(F.sort_array(F.flatten(lists), asc=False), 1, k)


def _same(a: str, b: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]


def metrics_before(df: DataFrame, metric: str, step: str, by: Sequence[str], k: int) -> DataFrame:
    """Rows (``by``, step, metric) with ``entered``, and the metric that has to go
    for it (``worst``, null if there is room)."""
    keys = [*by, "_lb_b"]
    rows = with_bucket(df.select(*by, step, F.col(metric).cast("double").alias(metric)), [step], out="_lb_b")
    counted = F.col(metric).isNotNull() & ~F.isnan(metric)
    top = Window.partitionBy(*keys).orderBy(F.desc(metric), step)
    lists = rows.where(counted).withColumn("_lb_r", F.row_number().over(top)).where(F.col("_lb_r") <= k)
    lists = lists.groupBy(*keys).agg(F.collect_list(metric).alias("_lb_l"))
    lists = rows.select(*keys).distinct().alias("a").join(lists.alias("b"), _same("a", "b", keys), "left").select(*[F.col(f"a.{c}").alias(c) for c in keys], "_lb_l")
    before = Window.partitionBy(*by).orderBy("_lb_b").rowsBetween(Window.unboundedPreceding, -1)
    seeds = lists.select(*keys, _best(F.collect_list(F.coalesce("_lb_l", F.array().cast("array<double>"))).over(before), k).alias("_lb_seed"))
    seeded = rows.alias("a").join(seeds.alias("b"), _same("a", "b", keys)).select(*[F.col(f"a.{c}").alias(c) for c in rows.columns], "_lb_seed")
    types = {**dict(seeded.dtypes), "entered": "boolean", "worst": "double"}
    out = [*by, step, metric, "entered", "worst"]

    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by(step)
        kept = sorted(bucket.column("_lb_seed")[0].as_py() or [])
        entered, worst = [], []
        for m in bucket.column(metric).to_pylist():
            good = m is not None and m == m
            room = len(kept) < k
            enters = good and (room or m > kept[0])
            entered.append(enters)
            worst.append(kept[0] if enters and not room else None)
            if enters:
                heapq.heappush(kept, m) if room else heapq.heapreplace(kept, m)
        found = {"entered": pa.array(entered, pa.bool_()), "worst": pa.array(worst, pa.float64())}
        return pa.table([found[c] if c in found else bucket.column(c) for c in out], names=out)

    return seeded.groupBy(*keys).applyInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in out))


def history(df: DataFrame, metric: str, step: str, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """``by``, step, metric, ``entered``, ``evicted_step``, ``evicted_metric``: what
    each step does to the board.  Steps must differ within a run; a missing metric
    never enters."""
    by = list(by)
    steps = metrics_before(df, metric, step, by, k)
    first = global_rank(steps.where("entered").select(*by, F.col(step).alias("evicted_step"), F.col(metric).alias("evicted_metric")), ["evicted_step"], by=[*by, "evicted_metric"], out="_lb_no")
    goes = global_rank(steps.where("worst is not null").select(*by, step, "worst"), [step], by=[*by, "worst"], out="_lb_no")
    gone = goes.alias("g").join(first.alias("f"), [*_same("g", "f", by), F.col("g.worst") == F.col("f.evicted_metric"), F.col("g._lb_no") == F.col("f._lb_no")])
    gone = gone.select(*[F.col(f"g.{c}").alias(c) for c in by], F.col(f"g.{step}").alias(step), "evicted_step", "evicted_metric")
    met = steps.alias("s").join(gone.alias("e"), [*_same("s", "e", by), F.col(f"s.{step}") == F.col(f"e.{step}")], "left")
    return met.select(*[F.col(f"s.{c}").alias(c) for c in [*by, step, metric, "entered"]], "evicted_step", "evicted_metric")


def board(df: DataFrame, metric: str, step: str, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """The checkpoints kept at the end: entered and not evicted since."""
    by = list(by)
    h = history(df, metric, step, by, k)
    gone = h.where("evicted_step is not null").select(*[F.col(c).alias(f"_lb_{c}") for c in by], F.col("evicted_step").alias("_lb_gone"))
    same = [F.col(c).eqNullSafe(F.col(f"_lb_{c}")) for c in by]
    return h.where("entered").join(gone, [*same, F.col(step) == F.col("_lb_gone")], "left_anti").select(*by, step, metric)
