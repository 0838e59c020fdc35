"""Structured Streaming loss monitors.

* ``windowed_loss``: watermarked tumbling-window mean loss per group (late
  rows beyond the watermark are dropped by Spark's state store).
* ``block_means``: the "mean since the last report, reported every N steps"
  monitor as a stateful operator (``applyInPandasWithState``): per run the
  state is three numbers (open sum, open count, next block number), so the
  state never grows with the stream; each micro-batch's rows of a run are
  reduced with vectorised numpy segment sums.  Steps must arrive in order per
  run (an append-only training log).
* ``run_available``: drains all available input once (``availableNow``) into a
  sink, with its checkpoint under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def loss_source(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming parquet source over a folder of loss-log files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def windowed_loss(stream: DataFrame, ts: str, loss: str, group: str, window: str = "1 hour",
                  watermark: str = "10 minutes") -> DataFrame:
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), group)
            .agg(F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), group, "mean_loss", "n"))


_OUT = "run string, block_no long, mean_loss double, n long"
_STATE = "open_sum double, open_n long, next_block long"


def _block_state_fn(every: int, step: str, loss: str):
    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(step)
        open_sum, open_n, next_block = state.get if state.exists else (0.0, 0, 0)
        vals = pdf[loss].to_numpy(dtype=float)
        flags = ((pdf[step].to_numpy() + 1) % every) == 0
        ends = np.nonzero(flags)[0]
        rows = []
        start = 0
        for e in ends:
            seg_sum = open_sum + vals[start:e + 1].sum()
            seg_n = open_n + (e + 1 - start)
            rows.append((key[0], next_block, seg_sum / seg_n, seg_n))
            next_block += 1
            open_sum, open_n, start = 0.0, 0, e + 1
        open_sum += vals[start:].sum()
        open_n += len(vals) - start
        state.update((float(open_sum), int(open_n), int(next_block)))
        yield pd.DataFrame(rows, columns=["run", "block_no", "mean_loss", "n"])
    return fn


def block_means(stream: DataFrame, run: str, step: str, loss: str, every: int) -> DataFrame:
    """Per-run block means reported when ``(step+1) % every == 0``; leftovers
    carry over into the next block (and across micro-batches)."""
    s = stream.select(F.col(run).cast("string").alias("run"), F.col(step).alias(step), F.col(loss).cast("double").alias(loss))
    return s.groupBy("run").applyInPandasWithState(
        _block_state_fn(every, step, loss), _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, name: str, folder: str, output_mode: str = "append", fmt: str = "parquet") -> str:
    """Process everything available now; data and stream checkpoint lie under
    ``folder`` (shared storage on a cluster).  Returns the output location."""
    out = os.path.join(folder, name, "data")
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", os.path.join(folder, name, "checkpoint")).trigger(availableNow=True)
    if fmt == "memory":
        q = w.format("memory").queryName(name).start()
    else:
        q = w.format(fmt).option("path", out).start()
    q.awaitTermination()
    return name if fmt == "memory" else out
