"""Query registry: key -> (Spark builder, oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the given
tables; the SQL is the DuckDB oracle over the same tables (views named like
the tables).  Every computed column is aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import EXTRA_WS_CHARS, PY_WS_CHARS
from ..sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


# ---- SQL helpers (DuckDB spelling of the same semantics) ----

def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_strip(e: str) -> str:
    return f"trim({e}, {q(PY_WS_CHARS)})"


def sql_hash(seed, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


def sql_ws_tokens(e: str) -> str:
    norm = f"translate({e}, {q(EXTRA_WS_CHARS)}, {q(' ' * len(EXTRA_WS_CHARS))})"
    return f"list_filter(string_split_regex({norm}, {q(chr(92) + 's+')}), lambda x: x <> '')"


def sql_token_ids(e: str) -> str:
    """Ids of the default tokenizer, as a DuckDB list."""
    return f"list_transform({sql_ws_tokens(e)}, lambda t: ('0x' || substr(md5(t), 1, 4))::INTEGER + 3)"


def sql_digest(e: str) -> str:
    return f"md5(array_to_string({e}, ','))"


def sql_ws_count(e: str) -> str:
    return f"len({sql_ws_tokens(e)})"
