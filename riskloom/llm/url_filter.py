"""URL filters: longest matching rule in a trie over reversed host labels and
path segments.

A rule is a host and a path (``example.org/en/1``): it fits its host and all
subdomains when the url's path starts with the rule's.  Allow and block rules
share one trie; the longest match wins (more host labels first, then the longer
path, then block over allow).  A url without a matching rule gets ``default``.

The trie is built on the driver from the rule list and broadcast; the list's
size is checked against ``max_rules``.  A longer list is matched by
``judge_by_join``: rules are hash-joined with the url's (host suffix, whole
path segments) keys, which needs no copy of the list on any machine.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule; an empty path matches no rule with a path (rule paths start with
``/``); repeated rows are judged each by itself; an empty table gives an empty
result; extra columns are carried by the caller (``judge`` is a Column).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh

Rule = tuple[str, str]  # verdict (allow or block), host/path
VERDICTS = ("allow", "block")
LOWER = {c: c + 32 for c in range(65, 91)}


def url_host(url) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(LOWER), slash + path


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nested dicts: labels from the top-level domain down, then under ``"/"``
    the whole path segments; a node's ``None`` entry lists ``(rest, verdict,
    rule)``, the rules that end there with a partial last segment ``rest``,
    longest first."""
    root: dict = {}
    for verdict, rule in rules:
        if verdict not in VERDICTS:
            raise ValueError(f"verdict of {rule!r} must be one of {VERDICTS}")
        host, path = split_rule(rule)
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("/", {})
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(None, [])
        ends.append((rest, verdict, rule))
        ends.sort(key=lambda x: (-len(x[0]), -VERDICTS.index(x[1]), x[2]))
    return root


def look_up(trie: dict, host: str, path: str):
    """``(verdict, rule)`` of the longest match, or None."""
    segments, node, paths = path.split("/"), trie, []
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if "/" in node:
            paths.append(node["/"])
    for node in reversed(paths):  # most host labels first
        found = None
        for i in range(len(segments)):
            for rest, verdict, rule in node.get(None, ()):
                # what follows the whole segments starts with the rule's rest
                if not rest or segments[i].startswith(rest):
                    found = (verdict, rule)
                    break
            if i + 1 == len(segments) or (node := node.get(segments[i])) is None:
                break
        if found:
            return found
    return None


def judge(spark: SparkSession, host, path, rules: Sequence[Rule], default: str = "allow", max_rules: int = 100_000) -> Column:
    """Struct ``(rule, verdict)`` for a host and a path column, by a broadcast
    trie of at most ``max_rules`` rules."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules: over max_rules={max_rules}, use judge_by_join")
    trie = spark.sparkContext.broadcast(build_trie(rules))

    @pandas_udf("rule string, verdict string")
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        tree = trie.value
        found = [look_up(tree, h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": [r for _, r in found], "verdict": [v for v, _ in found]}, dtype=object)

    return match(host, path)


def judge_by_join(df: DataFrame, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same verdicts for a rule table ``(verdict, rule)`` of any size: adds
    ``rule`` and ``verdict`` (names lengthened if taken).  Each distinct (host,
    path) meets the rules under its (host suffix, whole segments) keys; the
    narrow keys are shuffled, and adaptive execution splits a hot host."""
    taken = [*df.columns]
    h, p = fresh(taken, "url_host"), fresh(taken, "url_path")
    out_rule, out_verdict = fresh(taken, "rule"), fresh(taken, "verdict")
    urls = df.withColumns({h: url_host(F.col(url)), p: url_path(F.col(url))})
    own = urls.select(F.col(h).alias("host"), F.col(p).alias("path")).distinct()
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    keys = (own.withColumn("n", F.explode(F.sequence(F.lit(1), F.size(labels))))
            .withColumn("suffix", F.concat_ws(".", F.slice(labels, -F.col("n"), F.col("n"))))
            .withColumn("m", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)))
            .select("host", "path", "n", "suffix", F.concat_ws("/", F.slice(parts, F.lit(1), F.col("m"))).alias("dir"),
                    F.when(F.col("m") > 0, 1).otherwise(0).alias("deep")))
    cut = F.locate("/", "rule")
    r = (rules.select("verdict", "rule").distinct()
         .select("verdict", "rule", F.when(cut > 0, F.expr("substring(rule, 1, locate('/', rule) - 1)")).otherwise(F.col("rule")).alias("rhost"),
                 F.when(cut > 0, F.expr("substring(rule, locate('/', rule))")).otherwise(F.lit("")).alias("rpath"))
         .withColumn("rhost", F.translate("rhost", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
         .withColumn("rdir", F.regexp_extract("rpath", r"(?s)^(.*)/[^/]*$", 1))
         .withColumn("rdeep", F.when(cut > 0, 1).otherwise(0)))
    met = keys.join(r, (keys.suffix == r.rhost) & (keys.dir == r.rdir) & (keys.deep == r.rdeep) & F.col("path").startswith(F.col("rpath")))
    best = met.groupBy("host", "path").agg(F.max(F.struct("n", F.length("rpath").alias("l"), "verdict", "rule")).alias("best"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("best.rule").alias(out_rule), F.col("best.verdict").alias("_v"))
    return (urls.join(best, (urls[h] == F.col("_h")) & (urls[p] == F.col("_p")), "left")
            .select(*[urls[c] for c in taken], out_rule, F.coalesce("_v", F.lit(default)).alias(out_verdict)))
