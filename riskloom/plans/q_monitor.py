"""Training-loss monitors on ``events`` used as a metric log: ``value`` is
the loss, ``event_id`` the step, ``user_id`` the batch size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leaderboard as lb
from ..operators import metrics as me
from .registry import T, query

EPOCH_STEPS = 1000
REPORT_EVERY = 7


def _r(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("weighted_metric_mean",
       "SELECT event_type, round(sum(value * user_id) / nullif(sum(user_id)::DOUBLE, 0.0), 6) AS weighted_mean FROM events GROUP BY event_type")
def weighted_metric_mean(spark, sf):
    return _r(me.weighted_mean(T(spark, sf, "events"), "value", "user_id", ["event_type"]), ["weighted_mean"])


@query("loss_perplexity",
       "SELECT event_type, round(avg(value / 100), 6) AS mean_loss, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY event_type")
def loss_perplexity(spark, sf):
    e = T(spark, sf, "events")
    return _r(me.perplexity(e, F.col("value") / 100, ["event_type"]), ["mean_loss", "perplexity"])


@query("running_mean_loss",
       "WITH c AS (SELECT event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER w AS s, row_number() OVER w AS n FROM events "
       "WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
       "SELECT event_id, sign(s) * ((abs(s) * 20000 + n) // (2 * n)) / 1000000.0 AS running_mean FROM c")
def running_mean_loss(spark, sf):
    # losses carry two decimals: exact fixed-point running mean
    e = T(spark, sf, "events").select("event_id", "value")
    return me.running_mean(e, "value", ["event_id"], scale=2).select("event_id", "running_mean")


@query("block_mean_loss",
       f"WITH t AS (SELECT event_id // {EPOCH_STEPS} AS epoch, event_id % {EPOCH_STEPS} AS step, value FROM events), "
       f"f AS (SELECT *, CAST((step + 1) % {REPORT_EVERY} = 0 AS INTEGER) AS flag FROM t), "
       "b AS (SELECT *, coalesce(sum(flag) OVER (ORDER BY epoch, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM f) "
       "SELECT CAST(blk AS BIGINT) AS block_no, round(avg(value), 6) AS mean_loss, count(*) AS n FROM b GROUP BY blk HAVING max(flag) = 1")
def block_mean_loss(spark, sf):
    e = T(spark, sf, "events").select(
        F.floor(F.col("event_id") / EPOCH_STEPS).cast("long").alias("epoch"),
        F.pmod("event_id", F.lit(EPOCH_STEPS)).alias("step"), "value")
    return _r(me.block_mean(e, "value", "epoch", "step", REPORT_EVERY).withColumn("block_no", F.col("block_no").cast("long")),
              ["mean_loss"])


@query("topk_checkpoints",
       "SELECT event_type, event_id, value, CAST(rnk AS INTEGER) AS rnk FROM (SELECT event_type, event_id, value, "
       "row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rnk FROM events) WHERE rnk <= 3")
def topk_checkpoints(spark, sf):
    e = T(spark, sf, "events").select("event_type", "event_id", "value")
    return me.topk(e, [F.desc("value"), F.asc("event_id")], 3, by=["event_type"])


SQL_HISTORY = (  # one step after the other: the board is a sorted list of (metric, step)
    "WITH RECURSIVE e AS (SELECT event_type, event_id, floor(value / 4)::DOUBLE AS metric, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), "
    "s(event_type, n, event_id, metric, board, entered, gone) AS ("
    "SELECT event_type, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, []::STRUCT(m DOUBLE, s BIGINT)[], false, NULL::STRUCT(m DOUBLE, s BIGINT) FROM (SELECT DISTINCT event_type FROM e) "
    "UNION ALL SELECT s.event_type, e.n, e.event_id, e.metric, "
    "CASE WHEN len(s.board) < 3 THEN list_sort(list_append(s.board, {'m': e.metric, 's': e.event_id})) "
    "WHEN e.metric > s.board[1].m THEN list_sort(list_append(s.board[2:], {'m': e.metric, 's': e.event_id})) ELSE s.board END, "
    "len(s.board) < 3 OR e.metric > s.board[1].m, CASE WHEN len(s.board) = 3 AND e.metric > s.board[1].m THEN s.board[1] END "
    "FROM s JOIN e ON e.event_type = s.event_type AND e.n = s.n + 1) ")


def metric_log(spark, sf):
    """Events as a metric log: whole-number metrics, so that many are equal."""
    return T(spark, sf, "events").select("event_type", "event_id", F.floor(F.col("value") / 4).cast("double").alias("metric"))


@query("checkpoint_history", SQL_HISTORY + "SELECT event_type, event_id, metric, entered, gone.s AS evicted_step, gone.m AS evicted_metric FROM s WHERE n > 0")
def checkpoint_history(spark, sf):
    return lb.history(metric_log(spark, sf), "metric", "event_id", ["event_type"])


@query("checkpoint_board", SQL_HISTORY + "SELECT event_type, b.s AS event_id, b.m AS metric FROM "
       "(SELECT event_type, unnest(board) AS b FROM s WHERE n = (SELECT max(n) FROM s t WHERE t.event_type = s.event_type))")
def checkpoint_board(spark, sf):
    return lb.board(metric_log(spark, sf), "metric", "event_id", ["event_type"])
