"""Distributed batch scoring with a user-supplied scorer.

The scorer is a plain Python callable ``list[str] -> list[str]`` (a model
client, a local model, a rule); it runs inside ``mapInPandas`` on Arrow
batches, so the fan-out is Spark's task parallelism and task retry covers a
lost executor.  Inside a batch a failing call is retried up to ``retries``
times, one prompt at a time; a prompt that keeps failing yields NULL and its
attempt count, never a lost row.  Results carry their key; ordering happens at
the sink only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[list], list]


def _score_batch(prompts: list, scorer: Scorer, retries: int):
    try:
        out = list(scorer(prompts))
        if len(out) == len(prompts):
            return out, [1] * len(prompts)
    except Exception:  # fall back to per-prompt retries
        pass
    results, attempts = [], []
    for p in prompts:
        res, k = None, 0
        while k < retries:
            k += 1
            try:
                res = scorer([p])[0]
                break
            except Exception:
                res = None
        results.append(res)
        attempts.append(k)
    return results, attempts


def batch_score(df: DataFrame, key: str, prompt: str, scorer: Scorer, retries: int = 3,
                out: str = "llm_response") -> DataFrame:
    """Append the scorer's response for every row (``key``, ``out``, ``attempts``)."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            res, att = _score_batch(pdf[prompt].tolist(), scorer, retries)
            yield pd.DataFrame({key: pdf[key], out: res, "attempts": att})

    return df.select(key, prompt).mapInPandas(run, f"{key} {key_type}, {out} string, attempts int")
