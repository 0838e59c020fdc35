"""Metrics of the user's own, as mergeable states.

A metric has ``init() -> state``, ``update(state, batch) -> state`` (an Arrow batch
of the columns it asks for), ``merge(state, state) -> state`` and ``finish(state) ->
float``.  States are made per task and group from Arrow batches, and merged by a
tree: each level merges ``fan`` states of a group in one task, so a hot group and
many partitions meet in no single place.  Merges must not hang on their order for
the result not to."""

from __future__ import annotations

import pickle
from collections.abc import Mapping, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: levels of merging before the last: 64 * 64 tasks leave one state a group, a million leave 256
LEVELS = 2


class Metric(Protocol):
    columns: Sequence[str]

    def init(self) -> Any: ...
    def update(self, state: Any, batch: pa.RecordBatch) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> float | None: ...


def _partials(metrics: Mapping[str, Metric], by: str):
    def run(batches):
        states: dict = {}
        for batch in batches:
            groups = batch.column(by).to_pylist()
            for g in dict.fromkeys(groups):
                part = batch.filter(pa.array([x == g for x in groups]))
                own = states.setdefault(g, {n: m.init() for n, m in metrics.items()})
                for n, m in metrics.items():
                    own[n] = m.update(own[n], part.select(list(m.columns)))
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(states), pa.string()), pa.array([task] * len(states), pa.int64()), pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], [by, "task", "state"])
    return run


def _merge(metrics: Mapping[str, Metric], states: Sequence[bytes]) -> dict:
    total = None
    for s in map(pickle.loads, states):
        total = s if total is None else {n: m.merge(total[n], s[n]) for n, m in metrics.items()}
    return total


def evaluate(df: DataFrame, metrics: Mapping[str, Metric], by: str, fan: int = 64) -> DataFrame:
    """``by`` (as text) and a double for each metric, over the rows of each group."""
    columns = list(dict.fromkeys([by, *[c for m in metrics.values() for c in m.columns]]))
    rows = df.select(*[F.col(c).cast("string").alias(c) if c == by else c for c in columns])
    states = rows.mapInArrow(_partials(metrics, by), f"`{by}` string, task long, state binary")
    def level(group: pa.Table) -> pa.Table:
        state = pickle.dumps(_merge(metrics, group.column("state").to_pylist()))
        return pa.table([group.column(by).slice(0, 1), group.column("task").slice(0, 1), pa.array([state], pa.binary())], names=[by, "task", "state"])

    for _ in range(LEVELS):
        states = states.withColumn("task", F.floor(F.col("task") / fan)).groupBy(by, "task").applyInArrow(level, f"`{by}` string, task long, state binary")

    def last(group: pa.Table) -> pa.Table:
        total = _merge(metrics, group.column("state").to_pylist())
        return pa.table([group.column(by).slice(0, 1), *[pa.array([m.finish(total[n])], pa.float64()) for n, m in metrics.items()]], names=[by, *metrics])

    return states.groupBy(by).applyInArrow(last, f"`{by}` string, " + ", ".join(f"`{n}` double" for n in metrics))
