"""Label encoders of several columns, fitted per file and kept.

``fit`` is one aggregate over a long form (file, column, value) whatever the
number of columns and files; codes are ranks of the sorted distinct values (text,
by code point) from 0, by a distributed rank, so a column of very many values is
spread over tasks.  The code table can be written and read again, and ``encode``
joins it on: the table of a column is broadcast up to a counted size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import global_rank


def fit(df: DataFrame, columns: Sequence[str], file: str | None = None) -> DataFrame:
    """``file, column, value, code``; without ``file`` all rows are one file (null).
    Missing values have no code."""
    own = F.col(file).cast("string") if file else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(own.alias("file"), F.explode(cells).alias("c")).select("file", "c.*").where("value is not null").distinct()
    return global_rank(long, ["value"], by=["file", "column"], out="_rank").select("file", "column", "value", (F.col("_rank") - 1).alias("code"))


def encode(df: DataFrame, codes: DataFrame, columns: Sequence[str], fitted_on: str | None = None, file: str | None = None, unseen: int | None = -1,
           suffix: str = "_code", max_broadcast: int = 200_000) -> DataFrame:
    """Add each column's code.  Codes are those of the file ``fitted_on``, or, with a
    ``file`` column, of the row's own file.  A missing value stays missing; one
    that the fit has not seen gets ``unseen``, or fails the query if that is None."""
    if fitted_on is not None and file is not None:
        raise ValueError("fitted_on and file exclude each other")
    if file is None:
        codes = codes.where(F.col("file").eqNullSafe(F.lit(fitted_on)))
    sizes = {r.column: r.n for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per fitted column
    missing = [c for c in columns if c not in sizes]
    if missing and df.limit(1).count():
        raise ValueError(f"not fitted: {missing}")
    out = df
    for i, c in enumerate(columns):
        own = codes.where(F.col("column") == c).select(F.col("file").alias(f"_f{i}"), F.col("value").alias(f"_v{i}"), F.col("code").alias(c + suffix))
        if sizes.get(c, 0) <= max_broadcast:
            own = F.broadcast(own)
        same = F.col(c).cast("string") == F.col(f"_v{i}")
        if file is not None:
            same = same & F.col(file).cast("string").eqNullSafe(F.col(f"_f{i}"))
        out = out.join(own, same, "left").drop(f"_f{i}", f"_v{i}")
        text = F.concat(F.lit(f"{c}: no code for "), F.col(c).cast("string"))
        other = F.raise_error(text).cast("long") if unseen is None else F.lit(unseen).cast("long")
        out = out.withColumn(c + suffix, F.when(F.col(c).isNotNull(), F.coalesce(c + suffix, other)))
    return out
