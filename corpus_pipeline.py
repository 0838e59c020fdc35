"""The corpus pipeline: toxicity -> MinHash near-dedup -> secret scan -> target
mix -> packing, over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; all but the last return the columns of ``documents``.  ``run``
writes each stage's result as Parquet in the cluster's shared folder and reads
it again, so a lost executor costs the tasks of one stage at most.

* ``toxicity``: fits the classifier on labelled rows (crc32 of the id modulo 3 is
  not 1) of its input and drops documents that score 0.7 or more.
* ``near_dedup``: one document of each class of near copies stays, that with the
  smallest ``doc_id``.
* ``secrets``: spans of secrets are replaced by ``[SECRET]``; ``n_chars`` follows
  the text (null stays null).
* ``mix``: documents are sampled by probabilities raked to source, language and
  topic targets.
* ``packing``: pieces of the documents in sequences of at most 4,096 tokens.

Defined results: null and empty texts score as the classifier's bias and stay if
that is below 0.7, are one class of copies, and are packed as an end token alone;
repeated rows are one document after the second stage; ties go to the smaller
``doc_id``; very long texts are read whole; empty tables give empty results;
extra columns of ``documents`` are carried through the filtering stages,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import mixing, near_dedup, packing, queries, secrets
from riskloom.llm import toxicity as tox
from riskloom.llm.common import materialise, read


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(tox.in_training("doc_id"))
    model = tox.fit(docs.select("doc_id", "text"), labels)
    return docs.where(model.score(spark, F.coalesce("text", F.lit(""))) < tox.THRESHOLD)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = docs.withColumn("text", secrets.redacted(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.vocabulary())


STAGES = [("toxicity", toxicity), ("near_dedup", near_copies), ("secrets", secret_scan), ("mix", target_mix), ("packing", pack)]

#: SQL can express neither the classifier nor the alignment: tested against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
