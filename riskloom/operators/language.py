"""Language of a text, learned from labelled texts and told from the text alone.

A text is brought to lower-case letters and single blanks (A-Z only are
lower-cased; every character beyond ASCII counts as a letter).  Its features are
the byte trigrams of that form, dealt over ``BUCKETS`` buckets by a polynomial.
Learning is one aggregate, the number of trigrams per (language, bucket), summed
in the task before the shuffle; a model is a whole-number weight for each of
them (a smoothed log-probability in 1/1024), so it is bounded by languages times
buckets, and scores are exact sums that do not depend on their order.  Scoring is
one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

BUCKETS, FACTOR, UNIT = 1 << 14, 31, 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what stands between words
GAP = r"[^a-z\x{80}-\x{10FFFF}]+"
#: languages that a model may tell apart
MOST = 256


def letters_only(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " "), F.lit(" "))


def trigrams(texts: pa.Array):
    """Bucket of each trigram of some texts, end to end, and how many each text has."""
    sizes = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32, len(texts) + texts.offset + 1)[texts.offset:].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[sizes[0]:sizes[-1]].astype(np.int32) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.int32)
    ends = sizes[1:] - sizes[0]
    code = (data[:-2] * FACTOR + data[1:-1]) * FACTOR + data[2:] if len(data) > 2 else np.zeros(0, np.int32)
    whole = np.ones(len(code), bool)
    for back in (1, 2):  # those over a text's end
        at = ends - back
        whole[at[(at >= 0) & (at < len(code))]] = False
    return (code % BUCKETS)[whole], np.maximum(np.diff(ends, prepend=0) - 2, 0)


def _lots(column: pa.Array, most: int = 1 << 18):
    """Runs of texts of about ``most`` bytes, so that temporary arrays stay small."""
    lo, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(column):
        yield lo, len(column)


def trigram_counts(df: DataFrame, text: str, language: str) -> DataFrame:
    """``language, bucket, n`` over all rows that have both."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("language").to_pylist(), dtype=object)
            for lo, hi in _lots(batch.column("text")):
                bucket, counts = trigrams(batch.column("text").slice(lo, hi - lo))
                said = sorted(set(names[lo:hi]))
                of = np.repeat(np.searchsorted(np.array(said, dtype=object), names[lo:hi]).astype(np.int16), counts)
                for i, name in enumerate(said):
                    n = np.bincount(bucket[of == i], minlength=BUCKETS)
                    total[name] = total.get(name, 0) + n
            if len(total) > MOST:
                raise ValueError(f"more than {MOST} languages")
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["language", "bucket", "n"])

    rows = df.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(letters_only(F.col(text)).alias("text"), F.col(language).alias("language"))
    return rows.mapInArrow(run, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # (languages, BUCKETS), whole numbers


def learn(df: DataFrame, text: str, language: str) -> LanguageModel:
    """A model of all languages of ``df``; reads languages x buckets numbers."""
    counts = trigram_counts(df, text, language)
    held = counts.toArrow()  # at most MOST * BUCKETS rows
    names = sorted(set(held.column("language").to_pylist()))
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} languages")
    n = np.zeros((len(names), BUCKETS))
    row = np.searchsorted(np.array(names, dtype=object), np.array(held.column("language").to_pylist(), dtype=object)) if names else np.zeros(0, np.int64)
    n[row, held.column("bucket").to_numpy()] = held.column("n").to_numpy()
    share = (n + 1) / (n.sum(axis=1, keepdims=True) + BUCKETS)
    return LanguageModel(tuple(names), np.floor(UNIT * np.log(share) + 0.5).astype(np.int64))


def identify(df: DataFrame, text: str, model: LanguageModel, out: str = "language", lead: str = "lead") -> DataFrame:
    """``df`` with the likeliest language of each text (the smaller name of equal
    ones) and by how much it leads the next.  A text without letters, null or
    without a model has neither."""
    held = df.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    # only the letters go to Python, in lots; the rows' own columns stay where they are
    @arrow_udf(StructType([StructField("language", StringType()), StructField("lead", LongType())]))
    def tell(texts: pa.Array) -> pa.Array:
        names, weights = held.value
        best, ahead = [], []
        for lo, hi in _lots(pa.compute.fill_null(texts, "")):
            bucket, counts = trigrams(pa.compute.fill_null(texts.slice(lo, hi - lo), ""))
            of = np.repeat(np.arange(hi - lo, dtype=np.int32), counts)
            scores = np.array([np.bincount(of, weights=w[bucket], minlength=hi - lo) for w in weights]).reshape(len(names), hi - lo)
            for i, n in enumerate(counts):
                one = np.argsort(-scores[:, i], kind="stable")[:2]
                said = bool(n and names)
                best.append(names[one[0]] if said else None)
                ahead.append(int(scores[one[0], i] - scores[one[1], i]) if said and len(one) > 1 else 0 if said else None)
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(ahead, pa.int64())], ["language", "lead"])

    shown = F.when(F.length(F.trim(letters_only(F.col(text)))) > 0, letters_only(F.col(text)))
    told = "_told"
    while told in df.columns:
        told += "_"
    return df.withColumn(told, tell(shown)).withColumns({out: F.col(told)["language"], lead: F.col(told)["lead"]}).drop(told)


def keep_languages(df: DataFrame, text: str, model: LanguageModel, keep: Sequence[str]) -> DataFrame:
    """The rows whose text is in one of the languages ``keep``, by the text alone."""
    told = identify(df, text, model, "_language", "_lead")
    return told.where(F.col("_language").isin(*keep)).drop("_language", "_lead")


def agreement(told: DataFrame, language: str = "language", label: str = "lang") -> DataFrame:
    """``label, language, n``: what texts of each label were taken for."""
    return told.groupBy(F.col(label).alias("label"), F.col(language).alias("language")).agg(F.count(F.lit(1)).alias("n"))
