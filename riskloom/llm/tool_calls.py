"""Chat formatting: tool-call linking.

Calls and results are hash-joined by (conversation, call id).  Calls are put in
topological order: ``level`` is the length of the longest chain of calls that a
call builds on, and (level, turn, call id) is an order in which every call stands
after those it needs.  Arguments are validated against the tool's schema, and
call and result are serialised as canonical JSON (keys sorted by code point, no
blanks, shortest numbers, non-ASCII text as it is).

A conversation of at most ``max_calls`` calls is levelled in one task; the calls
of a longer one (say, a third of all rows) are levelled by Spark joins over
written tables, so no task holds a whole hot conversation.  A need on a call that
has one need alone is passed on to that one's need (pointer doubling), so a chain
takes rounds by the logarithm of its length; only calls of several needs that
stay distinct are taken away level by level.  Both give the same levels.

Defined results: a call without a result is ``unanswered``, a result without a
call ``orphan`` (a row of its own, without level); repeated calls or results of
one id count once, the smallest by (turn, text); a need that names no call of
the conversation is listed in ``missing`` and does not count for the level; calls
on a cycle, and those that need them, have level null; arguments that are null
or no JSON object are invalid; null conversation ids are one conversation, rows
with a null call id are left out; empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from .common import materialise

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    """Canonical JSON of a parsed value."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    return json.dumps(value, ensure_ascii=False)


def violations(value, schema: Mapping, at: str = "") -> list[str]:
    """What of ``value`` breaks the schema (type, enum, minimum, maximum,
    minLength, maxLength, items, required, properties, additionalProperties)."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at or '/'}: not of type {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at or '/'}: not in enum")
    for word, wrong in (("minimum", lambda v, x: v < x), ("maximum", lambda v, x: v > x)):
        if word in schema and isinstance(value, (int, float)) and wrong(value, schema[word]):
            out.append(f"{at or '/'}: {word} {schema[word]}")
    for word, wrong in (("minLength", lambda v, x: len(v) < x), ("maxLength", lambda v, x: len(v) > x)):
        if word in schema and isinstance(value, str) and wrong(value, schema[word]):
            out.append(f"{at or '/'}: {word} {schema[word]}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}/{i}")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}/{k}: required" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in own:
                out += violations(value[k], own[k], f"{at}/{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}/{k}: not allowed")
    return out


def formatter(schemas: Mapping[str, Mapping]):
    kind = StructType([StructField("message", StringType()), StructField("error", StringType())])

    @pandas_udf(kind)
    def run(ids: pd.Series, names: pd.Series, arguments: pd.Series, results: pd.Series) -> pd.DataFrame:
        messages, errors = [], []
        for i, name, text, result in zip(ids, names, arguments, results, strict=True):
            try:
                value = json.loads(text) if text is not None else None
                canonical(value)
            except (ValueError, RecursionError):
                value = None
            if not isinstance(value, dict):
                found = ["/: no JSON object"]
            elif name not in schemas:
                found = ["/: unknown tool"]
            else:
                found = violations(value, schemas[name])
            said = {"id": i, "name": name, "arguments": value if isinstance(value, dict) else text, "result": result}
            messages.append(canonical(said))
            errors.append("; ".join(found) or None)
        return pd.DataFrame({"message": messages, "error": errors}, dtype=object)

    return run


def levels_of(calls: dict[str, list[str | None] | None]) -> dict[str, int]:
    """Levels of the calls of one conversation (id to needs), by taking away calls
    that need no other call that is still there."""
    needs = {i: set() if n is None else {x for x in n if x is not None} for i, n in calls.items()}
    needs = {i: {x for x in n if x in needs} for i, n in needs.items()}
    users: dict = {}
    for i, n in needs.items():
        for x in n:
            users.setdefault(x, []).append(i)
    left = {i: len(n) for i, n in needs.items()}
    level, ready = {}, [i for i, n in left.items() if not n]
    while ready:
        i = ready.pop()
        level[i] = max((level[x] + 1 for x in needs[i]), default=0)
        for u in users.get(i, ()):
            left[u] -= 1
            if not left[u]:
                ready.append(u)
    return level


def _level_runs(batches):
    """Levels of conversations that come one after the other."""
    conv, calls, columns = None, {}, ([], [], [])

    def close():
        level = levels_of(calls)
        for out, values in zip(columns, ([conv] * len(calls), calls, map(level.get, calls)), strict=True):
            out.extend(values)

    def table():
        found = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["conv_id", "call_id", "level"])
        for out in columns:
            out.clear()
        return found

    for batch in batches:
        for c, i, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "call_id", "needs")), strict=True):
            if calls and c != conv:
                close()
                calls = {}
            conv = c
            calls[i] = n
        if len(columns[0]) > 10_000:
            yield table()
    if calls:
        close()
    yield table()


def level_each(calls: DataFrame, rows: int = 20_000) -> DataFrame:
    """Levels of conversations that each fit in a task: dealt over as many tasks as
    there are cores, or more, by conversation, and gone through in order."""
    tasks = max(calls.sparkSession.sparkContext.defaultParallelism, -(-calls.count() // rows))
    return calls.select("conv_id", "call_id", "needs").repartition(tasks, "conv_id").sortWithinPartitions("conv_id").mapInArrow(_level_runs, LEVELS)


LEVELS = "conv_id long, call_id string, level long"


def levels(calls: DataFrame, max_calls: int = 20_000) -> DataFrame:
    """``conv_id, call_id, level`` of ``calls`` (``conv_id, call_id, needs``)."""
    sizes = calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    big = materialise(sizes.where(F.col("n") > max_calls).select(F.col("conv_id").alias("big")), "long-conversations")
    if big.isEmpty():
        return level_each(calls)
    small = level_each(calls.join(big, calls.conv_id.eqNullSafe(big.big), "left_anti"))
    rest = calls.join(big, calls.conv_id.eqNullSafe(big.big), "left_semi")
    nodes = materialise(rest.select("conv_id", "call_id", F.concat_ws("\x00", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), "call_id").alias("node"), "needs"), "calls")
    need = F.concat_ws("\x00", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.col("need"))
    edges = nodes.select("node", "conv_id", F.explode("needs").alias("need")).where("need is not null").select("node", need.alias("on")).distinct()
    edges = materialise(edges.join(nodes.select(F.col("node").alias("on")), "on"), "needs")
    state = materialise(nodes.select("conv_id", "call_id", "node", F.lit(0).cast("long").alias("least"), F.lit(False).alias("cyclic")), "open")
    most, done, turn = nodes.count(), small, 0
    edges = edges.select("node", "on", F.lit(1).cast("long").alias("steps"))
    while True:
        # an edge (node, on, steps): node's level is at least that of on, and so many steps more
        own = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("on").alias("next"), F.first("steps").alias("further"),
                                        F.max((F.col("node") == F.col("on")) | (F.col("steps") > most)).alias("round_"))
        state = state.join(own, "node", "left").withColumn("cyclic", F.col("cyclic") | F.coalesce("round_", F.lit(False))).drop("round_")
        state = materialise(state.withColumn("n", F.coalesce("n", F.lit(0))), "open")
        then = state.select(F.col("node").alias("next"), F.col("least").alias("then_least"), F.col("cyclic").alias("then_cyclic"), F.col("n").alias("then_n"))
        at = state.select(F.col("node").alias("on"), F.col("least").alias("on_least"), F.col("cyclic").alias("on_cyclic"), F.col("n").alias("on_n"), "next", "further").join(then, "next", "left")
        past = (F.col("on_n") == 1) & ~F.col("on_cyclic")  # it needs one call alone: go on to that
        steps, open_end = F.col("steps") + F.col("further"), (F.col("then_n") > 0) & ~F.col("then_cyclic")
        moved = edges.join(state.where("not cyclic").select("node"), "node", "left_semi").join(at, "on").select(
            "node", F.when(past & open_end, F.col("next")).when((F.col("on_n") > 1) & ~F.col("on_cyclic"), F.col("on")).alias("on"), F.when(past, steps).otherwise(F.col("steps")).alias("steps"),
            F.greatest(F.col("on_least") + F.col("steps"), F.when(past, F.col("then_least") + steps)).alias("reach"),
            (F.col("on_cyclic") | past & F.col("then_cyclic")).alias("hit"), (past | F.col("on_cyclic") | (F.col("on_n") == 0)).alias("went"))
        moved = materialise(moved, "needs")
        over = state.where("n = 0 or cyclic").select("conv_id", "call_id", F.when(~F.col("cyclic"), F.col("least")).alias("level"))
        done = done.unionByName(over)
        open_ = state.where("n > 0 and not cyclic")
        if moved.where("went").isEmpty():  # what is left needs calls on cycles of several needs
            return done.unionByName(open_.select("conv_id", "call_id", F.lit(None).cast("long").alias("level")))
        reach = moved.groupBy("node").agg(F.max("reach").alias("reach"), F.max("hit").alias("hit"))
        state = open_.drop("n", "next", "further").join(reach, "node").select("conv_id", "call_id", "node", F.greatest("least", "reach").alias("least"), F.col("hit").alias("cyclic"))
        edges = moved.where("on is not null").groupBy("node", "on").agg(F.max("steps").alias("steps"))
        turn += 1
        if turn % 20 == 0:
            done = materialise(done, "levels")


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], max_calls: int = 20_000) -> DataFrame:
    """One row per call or orphan result: ``conv_id, call_id, turn, level, status,
    missing, valid, error, message``.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), needs (call ids);
    ``results``: conv_id, call_id, turn, content."""
    c = (calls.where("call_id is not null").groupBy("conv_id", "call_id")
         .agg(F.min(F.struct("turn", "name", "arguments", "needs")).alias("c")).select("conv_id", "call_id", "c.*"))
    c = materialise(c, "tool-calls")
    r = (results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
         .select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("r.turn").alias("r_turn"), F.col("r.content").alias("content"), F.lit(True).alias("answered")))
    both = c.withColumn("called", F.lit(True)).join(r, c.conv_id.eqNullSafe(r.r_conv) & (c.call_id == r.r_call), "full")
    at = levels(c.select("conv_id", "call_id", "needs"), max_calls).toDF("l_conv", "l_call", "level")
    both = both.join(at, both.conv_id.eqNullSafe(at.l_conv) & (both.call_id == at.l_call) & F.col("called"), "left")
    wanted = c.select("conv_id", "call_id", F.explode("needs").alias("need")).where("need is not null").distinct()
    there = c.select(F.col("conv_id").alias("t_conv"), F.col("call_id").alias("t_call"))
    lost = (wanted.join(there, wanted.conv_id.eqNullSafe(there.t_conv) & (wanted.need == there.t_call), "left_anti")
            .groupBy("conv_id", "call_id").agg(F.array_join(F.sort_array(F.collect_list("need")), ",").alias("missing")).toDF("m_conv", "m_call", "missing"))
    both = both.join(lost, both.conv_id.eqNullSafe(lost.m_conv) & (both.call_id == lost.m_call), "left")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    out = both.select(F.when(F.col("called"), F.col("conv_id")).otherwise(F.col("r_conv")).alias("conv_id"), F.coalesce("call_id", "r_call").alias("call_id"),
                      F.when(F.col("called"), F.col("turn")).otherwise(F.col("r_turn")).alias("turn"), "level", status.alias("status"), "missing", "name", "arguments", "content", "called")
    out = out.withColumn("f", formatter(schemas)("call_id", "name", "arguments", "content"))
    own = lambda c: F.when(F.col("called"), c)
    return out.select("conv_id", "call_id", "turn", "level", "status", "missing", own(F.col("f.error").isNull()).alias("valid"), own(F.col("f.error")).alias("error"), "f.message")
