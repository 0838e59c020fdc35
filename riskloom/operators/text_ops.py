"""Corpus-side text operators: union of sources, vocabulary merge, language
filter, empty-text counts and HTML -> text cleaning (regex pipeline)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.ordering import range_cumsum
from ..session import written

# The HTML cleaning pipeline (pattern, replacement), applied in order.
HTML_STEPS = (
    (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"<[^>]+>", " "),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\n\r\f\x{0b}]+", " "),
)


def html_to_text(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    for pat, rep in HTML_STEPS:
        x = F.regexp_replace(x, pat, rep)
    return F.trim(x)


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """Union-all of several inputs (files, tables) in the given order, each
    row tagged with its source position; columns matched by name."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("file_no", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


#: words that a task holds at most before it gives them out
HELD_WORDS = 200_000


def first_occurrence_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct white-space words with their first occurrence, the pair
    ``(key, word position)``.  A task keeps the first occurrence of each word it
    meets, so the shuffle moves words of a task and not of a text."""
    def run(batches):
        first: dict[str, tuple] = {}

        def rows():
            keys = pa.array([k for _, k, _ in first.values()], kind)
            return pa.RecordBatch.from_arrays([pa.array(first, pa.string()), keys, pa.array([p for *_, p in first.values()], pa.int32())], ["piece", "key", "pos"])

        kind = pa.null()
        for batch in batches:
            kind = batch.column("key").type
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = t.split()
                at = dict(zip(reversed(words), range(len(words) - 1, -1, -1), strict=True))
                for w, p in at.items():
                    have, new = first.get(w), (k is not None, k, p)  # null keys come first
                    if have is None or (new < have if k is not None and have[0] else (new[0], p) < (have[0], have[2])):
                        first[w] = new
                if len(first) > HELD_WORDS:
                    yield rows()
                    first.clear()
        if first:
            yield rows()

    own = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([StructField("piece", StringType()), StructField("key", own.schema["key"].dataType), StructField("pos", IntegerType())])
    return own.mapInArrow(run, schema).groupBy("piece").agg(F.min(F.struct("key", "pos")).alias("_first"))


def vocab_merge(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Pieces of ``base`` (first-occurrence order) followed by the pieces of
    ``extra`` not in ``base``, de-duplicated, in their own first-occurrence
    order; positions re-numbered from 0.  Inputs: ``(piece, _first)``.

    Both vocabularies meet in one aggregate per piece (a piece of ``base`` keeps
    its place there).  The texts are ranked, by (input, key), with the number of
    pieces that come from each; a piece's place is its text's offset and its number
    within the text.  Where the key is null, every position is a text of its own."""
    both = base.select("piece", F.struct(F.lit(0).alias("no"), "_first").alias("_at")).unionByName(
        extra.select("piece", F.struct(F.lit(1).alias("no"), "_first").alias("_at")))
    key, place = F.col("_at._first.key"), F.col("_at._first.pos")
    pieces = both.groupBy("piece").agg(F.min("_at").alias("_at")).select("piece", F.col("_at.no").alias("no"), key.alias("key"), F.when(key.isNull(), place).alias("part"), place.alias("at"))
    pieces = written(pieces, "vocabulary")
    texts = range_cumsum(pieces.groupBy("no", "key", "part").agg(F.count(F.lit(1)).alias("n")), "n", ["no", "key", "part"], out="start", inclusive=False)
    rows = texts.select("no", "key", "part", "start", F.lit(-1).alias("at"), F.lit(None).cast("string").alias("piece")).unionByName(pieces.withColumn("start", F.lit(None).cast("long")))
    of = Window.partitionBy("no", "key", "part").orderBy("at", "piece")
    rows = rows.withColumn("pos", F.first("start").over(of.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(of) - 2)
    return rows.where("at >= 0").select("piece", "pos")
