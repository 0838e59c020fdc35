"""Mixing sources to target weights by iterative proportional fitting.

Token counts are added up per cell (source, language, topic).  Each round
scales the cells' weights to the target share of every level of one marginal
after the other (raking).  The mix has a stated budget, a share ``keep`` of all
tokens, and no cell can give more than it has: weights are cut off there in
every step, so later steps rake what is missing from the other cells, and the
last ones fill up the budget in proportion.  A document
of a cell is then kept with probability ``keep * all tokens * weight / tokens`` of
its cell, at most 1, by a hash of its ``doc_id``: in expectation the kept tokens
meet the marginals as far as the cells allow, and a rare odd cell costs no other.

The cells are an aggregate of the corpus.  Up to ``max_cells`` of them (a
counted size) are raked in one task; more are raked by Spark joins, one written
table a round, with the same arithmetic.

Targets: a share for each level by rule, ``tokens ** power`` of the level, or
given shares; levels that occur but are not given have their own share of the
tokens, and the given ones share the rest.

Defined results: a null source, language or topic is a level of its own; texts
without tokens (null, empty, blank) cost nothing and are kept, with probability 1;
repeated rows share one decision (same ``doc_id``), rows without a ``doc_id`` one
for all; very long texts are counted whole; an empty table gives an empty result;
other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

MARGINALS = ("source", "lang", "topic")
ROUNDS, DIGITS = 20, 9
#: steps after the raking that fill the budget from cells that have more to give
FILL = 8
#: the share of all tokens that a mix keeps
KEEP = 0.75


def tokens_of(text) -> Column:
    """Number of words (runs without blanks, tabs and line ends)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def topic_of(text) -> Column:
    """A coarse topic by the text's form: licence lines, contact data, tables, prose."""
    t = F.col(text) if isinstance(text, str) else text
    return (F.when(t.isNull(), None).when(t.contains("icense") | t.contains("opyright"), "legal")
            .when(t.contains("@"), "contact").when(t.contains(" | "), "table").otherwise("prose"))


def targets(cells: DataFrame, wanted: Mapping[str, float | Mapping[str, float]]) -> DataFrame:
    """``(marginal, level, share)``: shares per marginal sum to 1."""
    out = None
    for name in MARGINALS:
        rule = wanted[name]
        level = cells.groupBy(F.col(name).alias("level")).agg(F.sum("tokens").alias("t")).where("t > 0")
        if isinstance(rule, Mapping):
            given = F.create_map(*[F.lit(x) for k, v in rule.items() for x in (k, float(v))])
            own = F.element_at(given, F.coalesce("level", F.lit("")))  # null: not given
            level = level.withColumn("given", own)
            all_tokens = level.agg(F.sum("t")).scalar()
            other = level.agg(F.sum(F.when(F.col("given").isNull(), F.col("t")))).scalar()
            all_given = level.agg(F.sum("given")).scalar()
            rest = 1 - F.coalesce(other, F.lit(0)) / all_tokens
            share = F.when(F.col("given").isNull(), F.col("t") / all_tokens).when(all_given > 0, F.col("given") / all_given * rest).otherwise(0.0)
        else:
            level = level.withColumn("raw", F.pow(F.col("t").cast("double"), F.lit(float(rule))))
            share = F.col("raw") / level.agg(F.sum("raw")).scalar()
        part = level.select(F.lit(name).alias("marginal"), "level", share.alias("share"))
        out = part if out is None else out.unionByName(part)
    return out


def _rake(rounds: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, cap = (pdf[c].to_numpy(dtype=np.float64).copy() for c in ("weight", "cap"))
        at = {m: pd.factorize(pdf[m].map(lambda x: (x is None, x)))[0] for m in MARGINALS}
        share = {m: pdf[f"{m}_share"].to_numpy(dtype=np.float64) for m in MARGINALS}
        for _ in range(rounds):
            for m in MARGINALS:
                total = np.bincount(at[m], weights=w)[at[m]]
                w = np.minimum(np.where(total > 0, w * share[m] / np.where(total > 0, total, 1.0), 0.0), cap)
        for _ in range(FILL):
            full = w >= cap
            room = w[~full].sum()
            w = np.minimum(np.where(full, cap, w * (1 - w[full].sum()) / room if room > 0 else w), cap)
        return pdf.assign(weight=w)
    return run


def rake(cells: DataFrame, shares: DataFrame, rounds: int = ROUNDS, max_cells: int = 200_000, keep: float = KEEP) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, the fitted share of
    the budget, and ``cap``, the share of it that the cell has."""
    t = cells.where("tokens > 0")
    part = F.col("tokens") / t.agg(F.sum("tokens")).scalar()
    t = t.withColumn("weight", part).withColumn("cap", F.col("weight") / F.lit(float(keep)))
    for m in MARGINALS:
        s = shares.where(F.col("marginal") == m).select(F.col("level").alias("level_"), F.col("share").alias(f"{m}_share"))
        t = t.join(s, t[m].eqNullSafe(F.col("level_"))).drop("level_")
    t = materialise(t, "cells")
    if t.count() <= max_cells:
        fitted = t.groupBy().applyInPandas(_rake(rounds), t.schema)
    else:
        for _ in range(rounds):
            for m in MARGINALS:
                sums = t.groupBy(F.col(m).alias("level_")).agg(F.sum("weight").alias("sum_"))
                scaled = F.when(F.col("sum_") > 0, F.col("weight") * F.col(f"{m}_share") / F.col("sum_")).otherwise(0.0)
                t = t.join(sums, t[m].eqNullSafe(F.col("level_"))).withColumn("weight", F.least(scaled, F.col("cap"))).drop("level_", "sum_")
            t = materialise(t, "cells")
        for _ in range(FILL):
            full = F.col("weight") >= F.col("cap")
            sums = t.agg(F.sum(F.when(full, F.col("weight"))).alias("full_"), F.sum(F.when(~full, F.col("weight"))).alias("room_"))
            t = t.crossJoin(F.broadcast(sums))  # one row
            filled = F.when(F.col("room_") > 0, F.col("weight") * (1 - F.coalesce("full_", F.lit(0.0))) / F.col("room_")).otherwise(F.col("weight"))
            t = materialise(t.withColumn("weight", F.least(F.when(full, F.col("cap")).otherwise(filled), F.col("cap"))).drop("full_", "room_"), "cells")
        fitted = t
    return fitted.select(*MARGINALS, "tokens", "weight", "cap")


def probabilities(fitted: DataFrame) -> DataFrame:
    """``probability`` of each cell: the share of its tokens that the fit takes."""
    return fitted.withColumn("probability", F.round(F.least(F.col("weight") / F.col("cap"), F.lit(1.0)), DIGITS))


def draw(doc_id, seed: int = 0) -> Column:
    """A number in [0, 1) that hangs on the document's id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


#: the mix that the query and the pipeline ask for
WANTED: dict = {"source": 0.8, "lang": {"en": 0.54, "fr": 0.17, "de": 0.17, "es": 0.12}, "topic": 0.9}


def chances(docs: DataFrame, wanted: Mapping, rounds: int, keep: float, max_cells: int) -> DataFrame:
    """``mix_source, mix_lang, mix_topic, mix_probability``: a row per cell,
    written, and broadcast if there are at most ``max_cells``."""
    rows = docs.select("source", "lang", topic_of("text").alias("topic"), tokens_of("text").alias("tokens"))
    cells = materialise(rows.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")), "cells")
    found = probabilities(rake(cells, targets(cells, wanted), rounds, max_cells, keep))
    found = materialise(found.select(*[F.col(m).alias(f"mix_{m}") for m in MARGINALS], F.col("probability").alias("mix_probability")), "chances")
    return F.broadcast(found) if found.count() <= max_cells else found


def in_cell(source: Column, lang: Column, topic: Column) -> Column:
    return source.eqNullSafe(F.col("mix_source")) & lang.eqNullSafe(F.col("mix_lang")) & topic.eqNullSafe(F.col("mix_topic"))


def chance() -> Column:
    """A document's probability: its cell's, or 1 without tokens."""
    return F.when(F.col("tokens") == 0, 1.0).otherwise(F.coalesce("mix_probability", F.lit(0.0)))


def mix(docs: DataFrame, wanted: Mapping = WANTED, rounds: int = ROUNDS, keep: float = KEEP, seed: int = 0, max_cells: int = 200_000) -> DataFrame:
    """One row per document: its cell, ``tokens``, ``probability`` and ``kept``."""
    rows = docs.select("doc_id", "source", "lang", topic_of("text").alias("topic"), tokens_of("text").alias("tokens"))
    out = rows.join(chances(docs, wanted, rounds, keep, max_cells), in_cell(rows["source"], rows["lang"], rows["topic"]), "left")
    out = out.withColumn("probability", chance())
    return out.select("doc_id", *MARGINALS, "tokens", "probability", (draw("doc_id", seed) < F.col("probability")).alias("kept"))


def mixed(docs: DataFrame, wanted: Mapping = WANTED, rounds: int = ROUNDS, keep: float = KEEP, seed: int = 0, max_cells: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with their own columns."""
    rows = docs.select(F.struct("*").alias("row_"), F.col("source").alias("s_"), F.col("lang").alias("l_"), topic_of("text").alias("t_"), tokens_of("text").alias("tokens"), draw("doc_id", seed).alias("draw_"))
    kept = rows.join(chances(docs, wanted, rounds, keep, max_cells), in_cell(F.col("s_"), F.col("l_"), F.col("t_")), "left")
    return kept.where(F.col("draw_") < chance()).select("row_.*")


def oracle(wanted: Mapping = WANTED, rounds: int = ROUNDS, table: str = "documents", seed: int = 0, keep: float = KEEP) -> str:
    """DuckDB SQL of ``mix``: one step a marginal and round over the cells."""
    parts = [f"""
d AS MATERIALIZED (SELECT doc_id, source, lang,
  CASE WHEN text IS NULL THEN NULL WHEN contains(text, 'icense') OR contains(text, 'opyright') THEN 'legal' WHEN contains(text, '@') THEN 'contact'
       WHEN contains(text, ' | ') THEN 'table' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS tokens FROM {table}),
c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)"""]
    for m in MARGINALS:
        rule = wanted[m]
        if isinstance(rule, Mapping):
            given = "CASE " + " ".join(f"WHEN {m} = '{k}' THEN {float(v)}::DOUBLE" for k, v in rule.items()) + " END"
            levels = f"SELECT {m}, sum(tokens)::DOUBLE AS t, ({given}) AS given FROM c GROUP BY {m}"
            share = ("CASE WHEN given IS NULL THEN t / sum(t) OVER () WHEN sum(given) OVER () > 0 THEN "
                     "given / sum(given) OVER () * (1 - coalesce(sum(t) FILTER (WHERE given IS NULL) OVER (), 0) / sum(t) OVER ()) ELSE 0 END")
        else:
            levels, share = f"SELECT {m}, pow(sum(tokens)::DOUBLE, {rule}) AS raw FROM c GROUP BY {m}", "raw / sum(raw) OVER ()"
        parts.append(f"s_{m} AS MATERIALIZED (SELECT {m}, {share} AS share FROM ({levels}))")
    parts.append(f"w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS w, tokens / sum(tokens) OVER () / {float(keep)}::DOUBLE AS cap FROM c)")
    n = 0
    for _ in range(rounds):
        for m in MARGINALS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.tokens, a.cap, least(coalesce(a.w * s.share / nullif(sum(a.w) OVER (PARTITION BY a.{m}), 0), 0), a.cap) AS w "
                         f"FROM w{n} a JOIN s_{m} s ON a.{m} IS NOT DISTINCT FROM s.{m})")
            n += 1
    for _ in range(FILL):
        parts.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, cap, least(CASE WHEN w >= cap THEN cap "
                     "WHEN coalesce(sum(w) FILTER (WHERE w < cap) OVER (), 0) > 0 THEN w * (1 - coalesce(sum(w) FILTER (WHERE w >= cap) OVER (), 0)) / (sum(w) FILTER (WHERE w < cap) OVER ()) ELSE w END, cap) AS w "
                     f"FROM w{n})")
        n += 1
    parts.append(f"p AS MATERIALIZED (SELECT source, lang, topic, round(least(w / cap, 1), {DIGITS}) AS probability FROM w{n})")
    draw_sql = f"('0x' || substr(md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return "WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, CASE WHEN d.tokens = 0 THEN 1 ELSE coalesce(p.probability, 0) END AS probability,
  d.tokens = 0 OR {draw_sql} < coalesce(p.probability, 0) AS kept
FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic IS NOT DISTINCT FROM p.topic
"""
