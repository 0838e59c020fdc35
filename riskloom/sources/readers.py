"""Readers and writers with explicit schemas (never inferred: the declared type
decides how a value is rendered as text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (parquet)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional_csv(spark: SparkSession, path, ddl: str, sep: str = ",", header: bool = False) -> DataFrame:
    """Headerless (or header-replaced) delimited file with positional columns
    named by ``ddl`` (e.g. ``"c0 STRING, c1 INT"``)."""
    return spark.read.schema(ddl).option("sep", sep).option("header", header).option("mode", "FAILFAST").csv(path)


def named_csv(spark: SparkSession, path, types: dict[str, str], default: str = "STRING", sep: str = ",") -> DataFrame:
    """Delimited file whose header names the columns: ``types`` declares the
    type of some of them by name (in any order), the others are ``default``.
    A declared name that the header lacks is an error, as is a bad value."""
    raw = spark.read.option("sep", sep).option("header", True).csv(path)  # names only: nothing is inferred
    missing = [c for c in types if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no columns {missing}")
    ddl = ", ".join(f"`{c}` {types.get(c, default)}" for c in raw.columns)
    return spark.read.schema(ddl).option("sep", sep).option("header", True).option("mode", "FAILFAST").csv(path)


def project_reorder(df: DataFrame, columns: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Column pruning + re-ordering; a missing column is an error (analysis
    fails), never a silent NULL column.  Pruning reaches the scan."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[c for c in columns if c not in drop])


def jsonl(spark: SparkSession, path, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def train_validation(spark: SparkSession, train, validation, ddl: str, valid_rows: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Training and validation records (JSON lines) as one table with ``split``.

    With a validation file its rows are ``valid``; without one the first
    ``valid_rows`` training rows in ``order`` are."""
    from ..operators.sampling import head_tail_split

    rows = jsonl(spark, train, ddl)
    if validation is not None:
        return rows.withColumn("split", F.lit("train")).unionByName(jsonl(spark, validation, ddl).withColumn("split", F.lit("valid")))
    if not valid_rows or not order:
        raise ValueError("without a validation file, valid_rows and order are needed")
    return head_tail_split(rows, list(order), valid_rows)


def json_array(spark: SparkSession, path, ddl: str) -> DataFrame:
    """Files of one JSON array of objects each (small exports: Spark reads such a
    file in one task; large data belongs in JSON lines).  A file that is no list
    of objects, or does not parse, fails the query that reads it, and nothing is
    collected; so does a field that cannot be read as its declared type."""
    lines = spark.read.text(path, wholetext=True)
    kind = f"ARRAY<STRUCT<{ddl}>>"
    records = F.try_variant_get(F.try_parse_json("value"), "$", kind)
    return lines.select(F.inline(F.coalesce(records, F.raise_error(F.lit("not a JSON list of records")).cast(kind))))


def arff(spark: SparkSession, paths: Sequence[str], ddl: str) -> DataFrame:
    """ARFF files: data lines parsed with ``from_csv`` (``?`` -> NULL), header
    lines (``@...``, ``%`` comments, blanks) skipped; files are unioned in the
    given order and tagged with their position (``file_no``)."""
    parts = []
    for i, p in enumerate(paths):
        lines = spark.read.text(p)
        data = lines.where(~F.trim("value").startswith("@") & ~F.trim("value").startswith("%") & (F.trim("value") != ""))
        parsed = data.select(F.from_csv("value", ddl, {"nullValue": "?"}).alias("r"), F.lit(i).alias("file_no"))
        parts.append(parsed.select("r.*", "file_no"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def arff_ddl(header_lines: Sequence[str]) -> str:
    """DDL from ``@attribute`` lines (driver side; header only, not data)."""
    cols = []
    for line in header_lines:
        s = line.strip()
        if not s.lower().startswith("@attribute"):
            continue
        _, name, typ = s.split(None, 2)
        t = "DOUBLE" if typ.strip().lower() in ("numeric", "real") else "STRING"
        cols.append(f"`{name.strip(chr(39))}` {t}")
    return ", ".join(cols)


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
