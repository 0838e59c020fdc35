"""Scoring that goes on where a lost run stopped.

The prompts, a folder of files, are read as micro-batches that are all available
now; each is scored and written to a folder of its own number, replacing what a
lost attempt left there.  What has been written is never scored again: a run
that is started anew goes on with the first batch that was not committed, and
files that have come since are further batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.scoring import batch_score


def score_resumably(spark: SparkSession, prompts: str, ddl: str, out: str, state: str, key: str, prompt: str, scorer, retries: int = 3,
                    files_per_batch: int = 64, on_batch: Callable[[int], None] | None = None) -> DataFrame:
    """Score all of ``prompts`` (Parquet files of ``ddl``) that ``out`` does not hold
    yet, and return ``out``.  ``state`` is the folder where progress is kept;
    ``on_batch`` is called with each batch's number before it is written."""
    def score(batch: DataFrame, number: int) -> None:
        if on_batch is not None:
            on_batch(number)
        batch_score(batch.select(key, prompt), key, prompt, scorer, retries=retries).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).parquet(prompts)
    run = source.writeStream.foreachBatch(score).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).drop("batch")
