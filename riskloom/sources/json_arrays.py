"""JSON arrays of records, read by many tasks and written by many tasks.

A JSON string holds no raw line end, so every line starts outside a string, and
whether a brace counts is decided within its line.  A running sum of braces over
the lines gives the depth at each line's start; where it is that of the array
itself, a chunk of whole records begins.  Chunks are parsed on their own.  Lines
keep their order by (file, block) offsets, without a sort; an array that stands in
one line is one chunk.

The writer gives part files that, one after the other by name, are one array; the
reader takes such a folder as ``one_array``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import range_cumsum
from ..operators.pairing import with_position


def _fail(text: str, kind: str) -> Column:
    return F.raise_error(F.lit(text)).cast(kind)


def _outside_strings(line: Column) -> Column:
    """The line without its strings; an open string fails."""
    plain = F.replace(F.replace(line, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    parts = F.split(plain, '"', -1)
    shown = F.array_join(F.filter(parts, lambda _, i: i % 2 == 0), "")
    return F.when(F.size(parts) % 2 == 1, shown).otherwise(_fail("a JSON string does not end in its line", "string"))


def _number(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def json_array(spark: SparkSession, path, ddl: str, one_array: bool = False) -> DataFrame:
    """The records of files of one JSON array each (or, with ``one_array``, of files
    that make one together), in a declared schema.  Text that is no list of records,
    does not parse or does not close, and a field that cannot be read as its type,
    fail the query that reads it."""
    lines = with_position(spark.read.text(path), "line", parquet=False, file="file")
    lines = lines.where(F.length(F.btrim("value", F.lit(" \t\r\n﻿"))) > 0)
    if one_array:
        lines = lines.withColumn("file", F.lit(""))
    bare = _outside_strings(F.col("value"))
    # numbers alone are shuffled for the running sums; the text meets them once
    marks = lines.select("file", "line", (_number(bare, "{[") - _number(bare, "}]")).cast("long").alias("up"))
    marks = range_cumsum(marks, "up", ["line"], by=["file"], out="depth", inclusive=False, bounds="ordinal", total_out="open")
    marks = marks.withColumn("begins", (F.col("depth") <= 1).cast("long"))
    marks = range_cumsum(marks, "begins", ["line"], by=["file"], out="chunk", bounds="ordinal")
    lines = lines.select("line", "value").join(marks.drop("begins"), "line")
    chunks = lines.groupBy("file", "chunk").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("l"), F.min_by("depth", "line").alias("before"),
                                               F.sum("up").alias("up"), F.max("open").alias("open"))
    text = F.btrim(F.array_join(F.transform("l", lambda x: x["value"]), "\n"), F.lit(" \t\r\n﻿"))
    opened = F.when(F.col("before") > 0, text).when((F.col("chunk") == 1) & text.startswith("["), F.expr("substring(text_, 2)")).otherwise(_fail("not a JSON list of records", "string"))
    chunks = chunks.withColumn("text_", text).withColumn("text_", F.when(F.col("open") == 0, opened).otherwise(_fail("a JSON list does not close", "string")))
    closes = (F.col("before") + F.col("up")) <= 0
    closed = F.when(~closes, F.col("text_")).when(F.col("text_").endswith("]"), F.expr("substring(text_, 1, length(text_) - 1)")).otherwise(_fail("text after a JSON list", "string"))
    chunks = chunks.withColumn("text_", F.btrim(closed, F.lit(" \t\r\n")))
    chunks = chunks.withColumn("text_", F.regexp_replace(F.regexp_replace("text_", r"\A,", ""), r",\z", ""))
    kind = f"ARRAY<STRUCT<{ddl}>>"
    parsed = F.coalesce(F.try_parse_json(F.concat(F.lit("["), "text_", F.lit("]"))), _fail("not a JSON list of records", "variant"))
    return chunks.select(F.inline(F.variant_get(parsed, "$", kind)))


def array_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """The lines of ``df`` as one JSON array, in range partitions by ``order``; rows
    of equal keys share a partition, so the first row of the one that holds the
    least key is the array's first."""
    keys = [f"o_{i}" for i in range(len(order))]
    least = df.select(F.struct(*[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)]).alias("k")).agg(F.min("k")).scalar()
    rows = df.select(F.lit(0).alias("end"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    end = df.sparkSession.range(1).select(F.lit(1).alias("end"), *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys], F.lit("]").alias("value"))
    dealt = rows.unionByName(end).repartitionByRange("end", *keys).sortWithinPartitions("end", *keys)
    dealt = dealt.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).withColumn("least", least)
    first = (F.col("end") == 0) & (F.col("at") == 0) & F.struct(*keys).eqNullSafe(F.col("least"))
    return dealt.select(F.concat(F.when(first, "[\n").when(F.col("end") == 0, ",").when(F.col("least").isNull(), "[\n").otherwise(""), "value").alias("value"))


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """``df`` as one JSON array over the part files of ``path`` in name order, a
    record a line, by ``order``.  ``cat path/part-*`` is the array as one file."""
    array_lines(df, order).write.text(path)
