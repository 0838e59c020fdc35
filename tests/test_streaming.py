"""Streaming loss monitors agree with the batch operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics as me
from riskloom.streaming import loss_monitor as lm

SCHEMA = "run string, step long, ts timestamp, loss double"


@pytest.fixture()
def log_dir(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(r, s, base + datetime.timedelta(minutes=7 * s), float((s * 37 + len(r)) % 11) + 0.5)
            for r in ("a", "b") for s in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    # three files, written in step order: the stream sees three micro-batches
    for i, (lo, hi) in enumerate(((0, 13), (13, 29), (29, 40))):
        df.where((F.col("step") >= lo) & (F.col("step") < hi)).coalesce(1).write.parquet(f"{tmp_path}/log/part{i}")
    return str(tmp_path / "log" / "*"), df


def test_stream_block_means_match_batch(spark, log_dir, tmp_path):
    path, df = log_dir
    stream = lm.loss_source(spark, path, SCHEMA)
    name = lm.run_available(lm.block_means(stream, "run", "step", "loss", 7), "blocks_test", str(tmp_path), fmt="memory")
    got = sorted((r.run, r.block_no, round(r.mean_loss, 9), r.n) for r in spark.table(name).collect())
    exp = []
    for run in ("a", "b"):
        part = df.where(F.col("run") == run).withColumn("epoch", F.lit(0))
        exp += [(run, r.block_no, round(r.mean_loss, 9), r.n) for r in me.block_mean(part, "loss", "epoch", "step", 7).collect()]
    assert got == sorted(exp) and len(got) == 10


def test_stream_windowed_loss(spark, log_dir, tmp_path):
    path, df = log_dir
    stream = lm.loss_source(spark, path, SCHEMA)
    name = lm.run_available(lm.windowed_loss(stream, "ts", "loss", "run", "1 hour"), "win_test", str(tmp_path),
                            output_mode="complete", fmt="memory")
    got = {(r.run, r.window_start): r.n for r in spark.table(name).collect()}
    exp = {(r.run, r.ws): r.n for r in df.groupBy("run", F.window("ts", "1 hour").start.alias("ws"))
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == exp
