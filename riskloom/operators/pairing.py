"""Pairing two files row by row, by position, as parallel lists are zipped.

A row's position in a Parquet data set is its file's offset (rows of the files
before it, by path) plus its row index within the file, which the scan gives; in
other files it is the offset of its (file, block) plus its number among the
block's rows, which a task reads in order.  No row is sorted: only the small
table of files or blocks is, and its running sum joins on.  Both sides then meet
in one join on the position, and a row without a partner on either side fails
the query, so unequal lengths never go unseen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import range_cumsum

FILE, BLOCK, ROW = "_pos_file", "_pos_block", "_pos_row"


def with_position(scan: DataFrame, out: str = "position", parquet: bool = True, file: str | None = None) -> DataFrame:
    """``scan``, a file source as read (no filter in between), with each row's
    0-based position over all files, and its file's path as ``file`` if named."""
    if parquet:
        rows = scan.select("*", F.col("_metadata.file_path").alias(FILE), F.lit(0).cast("long").alias(BLOCK), F.col("_metadata.row_index").alias(ROW))
    else:
        rows = scan.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), F.monotonically_increasing_id().alias(ROW))
    parts = rows.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("_pos_n"), F.min(ROW).alias("_pos_first"))
    starts = range_cumsum(parts, "_pos_n", [FILE, BLOCK], out="_pos_start", inclusive=False)
    starts = starts.select(F.col(FILE).alias("_pos_f"), F.col(BLOCK).alias("_pos_b"), "_pos_start", "_pos_first")
    if not parquet:  # a row per block of a file: lines of text are not shuffled for it
        starts = F.broadcast(starts)
    found = rows.join(starts, (F.col(FILE) == F.col("_pos_f")) & (F.col(BLOCK) == F.col("_pos_b")))
    path = [F.col(FILE).alias(file)] if file else []
    return found.select(*scan.columns, *path, (F.col("_pos_start") + F.col(ROW) - F.col("_pos_first")).alias(out))


def pair_by_position(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """Rows of equal position side by side.  A position that only one side has
    fails the query that reads the result."""
    twice = sorted({c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {position.lower()})
    if twice:
        raise ValueError(f"columns on both sides: {twice}")
    a = left.withColumn("_pos_a", F.lit(True))
    b = right.withColumn("_pos_b", F.lit(True))
    met = a.join(b, position, "full_outer")
    alone = F.col("_pos_a").isNull() | F.col("_pos_b").isNull()
    text = F.concat(F.lit("row "), F.col(position).cast("string"), F.when(F.col("_pos_a").isNull(), " has no row on the left").otherwise(" has no row on the right"))
    checked = F.when(alone, F.raise_error(text).cast("long")).otherwise(F.col(position))
    return met.withColumn(position, checked).drop("_pos_a", "_pos_b")


def pair_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join on a key that both sides hold once each: a key without a
    partner, or held twice, fails the query."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n_a"), *[F.min(c).alias(c) for c in left.columns if c != key])
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n_b"), *[F.min(c).alias(c) for c in right.columns if c != key])
    met = a.join(b, key, "full_outer")
    bad = (F.coalesce("_n_a", F.lit(0)) != 1) | (F.coalesce("_n_b", F.lit(0)) != 1)
    text = F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" does not stand once on each side"))
    checked = F.when(bad, F.raise_error(text).cast(left.schema[key].dataType)).otherwise(F.col(key))
    return met.withColumn(key, checked).drop("_n_a", "_n_b")
