"""Toxicity: a character n-gram linear classifier with naive Bayes features.

Features are the character (byte) n-grams of the lower-cased text, hashed to
``2^BITS`` numbers; each counts once per text.  The log-count ratio of a
feature between toxic and other training texts scales it, and a logistic
regression with an L2 penalty is fitted to the scaled features by L-BFGS.  The model is one weight per feature and a bias.

Training uses at most ``max_train`` labelled texts (a documented bound of the
fit alone: those with the smallest hash of ``doc_id``); the texts of the sample
are turned into features by Spark and every gradient is a Spark job over a
fixed number of partitions, of which each returns one vector.  Scoring reads
whole texts, in one pass without a shuffle, and sees the text only.

Defined results: null and empty texts have no feature and get the bias's score;
very long texts are scored whole; repeated rows get equal scores; several
labels of one ``doc_id`` count as their maximum, null labels not at all;
without a label of either class every score is the smoothed share of toxic
labels (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from .common import forget_shuffles, frugal, materialise, text_blocks, text_bytes
from .shingles import U, mix

BITS, SIZES = 18, (3, 4, 5)
THRESHOLD = 0.7
#: gradients after which the driver's heap gives back what is left of them
FORGET = 5
#: bytes that count as one gap between words
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(texts: pa.Array):
    """The distinct feature numbers of each text."""
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    last = np.zeros(1 << BITS, np.int64)
    for lo, hi in text_blocks(texts):
        data, offsets = text_bytes(pc.utf8_lower(texts.slice(lo, hi - lo)))
        code = np.where(LETTER[data], data, np.uint8(32)).astype(U) + U(1)
        codes = []
        for n in SIZES:
            h = np.full(len(code), U(n))
            for i in range(n):  # the n-gram that starts here; those over a text's end are cut off below
                h[:len(code) - i] = h[:len(code) - i] * U(0x100000001B3) + code[i:]
            codes.append((mix(h) >> U(64 - BITS)).astype(np.int32))
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            f = np.concatenate([c[a:max(a, b - n + 1)] for n, c in zip(SIZES, codes, strict=True)])
            at = np.arange(len(f))
            last[f] = at  # each feature keeps its last place: that place stands for it
            yield f[last[f] == at]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # log-count ratio times fitted weight, per feature
    bias: float

    def score(self, spark, text) -> Column:
        """Probability of label 1, a function of the text alone."""
        held = spark.sparkContext.broadcast((self.weights.astype(np.float32), self.bias))

        @arrow_udf(DoubleType())
        def run(texts: pa.Array) -> pa.Array:
            w, b = held.value
            z = np.array([w[f].sum(dtype=np.float64) + b for f in features(texts)], dtype=np.float64)
            return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return run(text)


def in_training(doc_id) -> Column:
    """Rows that may teach: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def _pack(rows: list[np.ndarray]) -> list[bytes]:
    return [r.astype("<i4").tobytes() for r in rows]


def _featurise(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(_pack(list(features(batch.column("text")))), pa.binary())], ["toxic", "f"])


def _rows(batches, most: int = 256):
    """Features and labels, a few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield [np.frombuffer(x, "<i4") for x in part.column("f").to_pylist()], part.column("toxic").to_numpy(zero_copy_only=False).astype(np.float64)


def _vectors(column: pa.ChunkedArray, kind):
    """The vectors of a column, where they lie: as Arrow batches they reach Python
    without copies as rows on the driver's heap."""
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, rounds: int = 25, parts: int = 6, l2: float = 1.0) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic, of the rows that may teach."""
    spark = docs.sparkSession
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # bounded by max_train narrow rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    table = materialise(texts.repartition(parts, "doc_id").select("toxic", "text").mapInArrow(frugal(_featurise), "toxic int, f binary"), "toxicity-sample").coalesce(parts)

    def count(batches):
        n, ones, rows = np.zeros((2, 1 << BITS), np.float32), 0, 0
        for f, y in _rows(batches):
            for x, label in zip(f, y, strict=True):
                n[int(label > 0), x] += 1
            ones, rows = ones + int((y > 0).sum()), rows + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()]), pa.array([ones]), pa.array([rows])], ["n", "ones", "rows"])

    got = table.mapInArrow(frugal(count), "n binary, ones long, rows long").toArrow()  # at most `parts` vectors
    ones, rows = sum(got["ones"].to_pylist()), sum(got["rows"].to_pylist())
    if not ones or ones == rows:
        share = (ones + 1) / (rows + 2)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    n = sum(x.reshape(2, -1).astype(np.float64) for x in _vectors(got["n"], np.float32))
    p, q = (n[1] + 1) / (ones + 2), (n[0] + 1) / (rows - ones + 2)
    ratio = np.log(p / q)

    def slope(held):
        def run(batches):
            w, b = held.value
            g, bias, loss = np.zeros(1 << BITS), 0.0, 0.0
            for f, y in _rows(batches):
                z = np.array([w[x].sum() for x in f]) + b
                e = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
                for x, d in zip(f, e, strict=True):
                    g[x] += d
                bias, loss = bias + float(e.sum()), loss + float((np.logaddexp(0, z) - y * z).sum())
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([bias]), pa.array([loss])], ["g", "b", "loss"])
        return run

    done = itertools.count(1)

    def evaluate(v):
        """Mean loss with its penalty, and slope, at scaled weights and bias ``v``."""
        held = spark.sparkContext.broadcast((v[:-1] * ratio, v[-1]))
        got = table.mapInArrow(frugal(slope(held)), "g binary, b double, loss double").toArrow()
        held.destroy()
        if next(done) % FORGET == 0:
            forget_shuffles(spark)
        g = np.append(sum(_vectors(got["g"], np.float64)) * ratio, sum(got["b"].to_pylist())) / rows
        g[:-1] += l2 / rows * v[:-1]
        return sum(got["loss"].to_pylist()) / rows + l2 / rows / 2 * float(v[:-1] @ v[:-1]), g

    v = descend(evaluate, np.append(np.zeros(1 << BITS), np.log(ones / (rows - ones))), rounds)
    return Model(v[:-1] * ratio, float(v[-1]))


def descend(evaluate, v: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a halving step, at most ``rounds`` evaluations."""
    loss, g = evaluate(v)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    length = 1.0 / max(1.0, float(np.linalg.norm(g)))
    for _ in range(rounds - 1):
        d, kept = -g, []
        for s, y in reversed(steps):
            a = float(s @ d) / float(s @ y)
            kept.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * (float(s @ y) / float(y @ y))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            d = d + (a - float(y @ d) / float(s @ y)) * s
        new = v + length * d
        new_loss, new_g = evaluate(new)
        if not new_loss <= loss + 1e-4 * length * float(g @ d):
            length /= 4
            if length < 1e-10:
                break
            continue
        s, y = new - v, new_g - g
        if float(s @ y) > 1e-12:
            steps = [*steps[1 - memory:], (s, y)]
        if loss - new_loss < 1e-6 * loss:
            return new
        v, loss, g, length = new, new_loss, new_g, 1.0
    return v


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; labels of
    held-out rows teach nothing."""
    model = fit(docs, labels.where(in_training("doc_id")), **options)
    scored = docs.select("doc_id", F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out"), model.score(docs.sparkSession, F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
