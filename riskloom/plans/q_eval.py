"""Response parsing, evaluation records, quality metrics and fairness on
``documents ⋈ labels`` (truth = ``quality``, 1 = good) and the flagship on
``customer``.

The "model" is a deterministic rule scorer expressed as a Column, so the
whole chain is oracle-checkable: completions depend on ``doc_id`` and
``n_chars`` and include missing, unparseable and marker-less answers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import fairness as fa
from ..operators import metrics as me
from ..operators import pairing as pg
from ..operators import responses as rs
from ..operators import user_metrics as um
from ..operators.scoring import batch_score
from ..session import shared_dir
from ..specs import FairnessSpec
from ..streaming.resumable import score_resumably
from .q_tables import SQL_CHAT, SQL_CUSTOMERS, customer_prompts
from .registry import ORACLE, T, q, query, sql_strip

MODEL = "rule-scorer"
PROMPT_HEAD = "Human: \nJudge the quality of the following "
PROMPT_MID = " document. Respond with only 'good' or 'bad'. \nText: '"
PROMPT_TAIL = "' \nAnswer:\n\nAssistant: \n"
LANG_SPEC = FairnessSpec("quality", 1, "lang", "en", "fr")
LENGTH_SPEC = FairnessSpec("quality", 1, "long_doc", 1, 0)


def completion(doc_id, n_chars, prompt):
    r = F.pmod(doc_id, F.lit(10))
    return (F.when(r == 9, F.lit(None).cast("string"))
            .when(r == 8, F.concat(prompt, F.lit("I cannot decide.")))
            .when(r == 7, F.concat(prompt, F.lit("Not bad, good")))
            .when(r == 6, F.lit("good"))
            .when(r == 5, F.concat(prompt, F.lit("<think>hmm</think> Bad")))
            .otherwise(F.concat(prompt, F.when(n_chars > 3000, F.lit(" Good ")).otherwise(F.lit(" Bad ")), F.lit("\n"))))


def eval_base(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")
    lab = T(spark, sf, "labels").select("doc_id", "quality")
    b = d.join(lab, "doc_id")
    prompt = F.concat(F.lit(PROMPT_HEAD), F.col("lang"), F.lit(PROMPT_MID), F.col("text"), F.lit(PROMPT_TAIL))
    return b.select(
        "doc_id", "lang", "n_chars", "quality",
        (F.col("n_chars") > 2000).cast("int").alias("long_doc"),
        F.when(F.col("quality") == 1, F.lit("good")).otherwise(F.lit("bad")).alias("answer"),
        F.array(F.lit("good"), F.lit("bad")).alias("choices"),
        prompt.alias("prompt_0"),
        completion(F.col("doc_id"), F.col("n_chars"), prompt).alias("llm_response"),
    )


def records(spark, sf, keep=()):
    b = eval_base(spark, sf)
    return rs.eval_records(b, "doc_id", "prompt_0", "llm_response", "answer", "choices", MODEL, parse="match", keep=keep)


def scored(spark, sf, policy="flip"):
    """Records with the truth, the groups and the reconstructed predicted label
    (columns carried through, no join back)."""
    r = records(spark, sf, keep=("lang", "long_doc", "quality")).where(F.col("error").isNull())
    return r.withColumn("pred_label", rs.predicted_label("quality", "acc", 1, 0, "missing", policy))


# ------------------------------------------------------------------ SQL side
_SQL_PROMPT = f"({q(PROMPT_HEAD)} || d.lang || {q(PROMPT_MID)} || d.text || {q(PROMPT_TAIL)})"
_SQL_BASE = (
    "base AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, CAST(d.n_chars > 2000 AS INTEGER) AS long_doc, "
    "CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS answer, "
    f"{_SQL_PROMPT} AS prompt_0 FROM documents d JOIN labels l ON d.doc_id = l.doc_id), "
    "resp AS (SELECT *, CASE doc_id % 10 WHEN 9 THEN NULL WHEN 8 THEN prompt_0 || 'I cannot decide.' "
    "WHEN 7 THEN prompt_0 || 'Not bad, good' WHEN 6 THEN 'good' WHEN 5 THEN prompt_0 || '<think>hmm</think> Bad' "
    f"ELSE prompt_0 || CASE WHEN n_chars > 3000 THEN ' Good ' ELSE ' Bad ' END || {q(chr(10))} END AS llm_response FROM base), "
)
_SQL_CLEAN = (f"CASE WHEN regexp_matches(llm_response, {q(r'\n\nAssistant:')}) THEN "
              f"lower({sql_strip(f'regexp_extract(llm_response, {q(r'(?s)\n\nAssistant:(.*)$')}, 1)')}) "
              "ELSE 'Incomplete response' END")


def _sql_artefacts(e: str) -> str:
    for bad in ("assistant", "<think>", "</think>", "## Thinking", "```", "<|im_end|>"):
        e = f"replace({e}, {q(bad)}, '')"
    return e


_SQL_M = f"lower({sql_strip(_sql_artefacts('clean'))})"
_SQL_PARSED = (
    _SQL_BASE
    + f"cl AS (SELECT *, {_SQL_CLEAN} AS clean FROM resp WHERE llm_response IS NOT NULL), "
    + f"pm AS (SELECT *, {_SQL_M} AS m FROM cl), "
    + "pr AS (SELECT *, CASE WHEN contains(m, 'good') THEN 'good' WHEN contains(m, 'bad') THEN 'bad' ELSE m END AS pred FROM pm), "
    + "rec AS (SELECT doc_id, lang, long_doc, quality, prompt_0, llm_response, pred, answer AS truth, "
    + "CASE WHEN pred = answer THEN '1.0' ELSE '0.0' END AS acc, CASE WHEN pred IN ('good', 'bad') THEN '0' ELSE '1' END AS missing FROM pr), "
    + "sc AS (SELECT *, CASE WHEN acc = '1.0' THEN quality WHEN quality = 1 THEN 0 ELSE 1 END AS pred_label FROM rec) "
)


def _r(e: str) -> str:
    return f"round({e}, 6)"


# ------------------------------------------------------------------ queries
@query("clean_response",
       "WITH " + _SQL_BASE + f"x AS (SELECT doc_id, {_SQL_CLEAN} AS cleaned FROM resp WHERE llm_response IS NOT NULL) SELECT * FROM x")
def clean_response(spark, sf):
    b = eval_base(spark, sf).where(F.col("llm_response").isNotNull())
    return b.select("doc_id", rs.clean_response("llm_response").alias("cleaned"))


@query("match_choice", "WITH " + _SQL_PARSED + "SELECT doc_id, pred FROM pr")
def match_choice(spark, sf):
    b = eval_base(spark, sf).where(F.col("llm_response").isNotNull())
    return b.select("doc_id", rs.match_choice(rs.clean_response("llm_response"), F.col("choices")).alias("pred"))


@query("eval_records",
       "WITH " + _SQL_PARSED + "SELECT doc_id, prompt_0, 'rule-scorer' AS model_name, llm_response, pred AS logit_0, truth, acc, missing, "
       "'(''' || pred || ''', ''' || truth || ''')' AS f1, '(''' || pred || ''', ''' || truth || ''')' AS macro_f1, "
       "'(''' || pred || ''', ''' || truth || ''')' AS mcc, CAST(NULL AS VARCHAR) AS error FROM rec "
       "UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'llm_response key not found' "
       "FROM resp WHERE llm_response IS NULL")
def eval_records(spark, sf):
    return records(spark, sf)


@query("eval_error_rows", "WITH " + _SQL_BASE + "x AS (SELECT doc_id, 'llm_response key not found' AS error FROM resp "
       "WHERE llm_response IS NULL) SELECT * FROM x")
def eval_error_rows(spark, sf):
    return rs.error_rows(records(spark, sf))


def _metric_sql(by: str | None, table: str = "rec", truth: str = "truth", pred: str = "pred", pos: str = "'good'"):
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    conf = (f"SELECT {g}count(*) FILTER (WHERE {truth} = {pos} AND {pred} = {pos}) AS tp, "
            f"count(*) FILTER (WHERE {truth} <> {pos} AND {pred} = {pos}) AS fp, "
            f"count(*) FILTER (WHERE {truth} = {pos} AND ({pred} <> {pos} OR {pred} IS NULL)) AS fn, "
            f"count(*) FILTER (WHERE {truth} <> {pos} AND ({pred} <> {pos} OR {pred} IS NULL)) AS tn FROM {table}{grp}")
    return conf


def _f1(tp, fp, fn):
    return f"CASE WHEN 2*{tp}+{fp}+{fn} = 0 THEN 0.0 ELSE 2.0*{tp}/(2*{tp}+{fp}+{fn}) END"


_MCC = ("CASE WHEN sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)) = 0 THEN 0.0 "
        "ELSE (tp::DOUBLE*tn - fp::DOUBLE*fn) / sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)) END")


def _metrics_select(by: str | None):
    g = f"{by}, " if by else ""
    return (f"SELECT {g}tp+fp+fn+tn AS n, {_r('CASE WHEN tp+fp+fn+tn = 0 THEN NULL ELSE (tp+tn)::DOUBLE/(tp+fp+fn+tn) END')} AS accuracy, "
            f"{_r(_f1('tp', 'fp', 'fn'))} AS f1, {_r('(' + _f1('tp', 'fp', 'fn') + ' + ' + _f1('tn', 'fn', 'fp') + ') / 2')} AS macro_f1, "
            f"{_r(_MCC)} AS mcc FROM c")


def _round_cols(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("eval_summary",
       "WITH " + _SQL_PARSED + ", c AS (" + _metric_sql("lang") + ") "
       "SELECT c.lang, 'rule-scorer' AS model_name, tp+fp+fn+tn AS n, "
       + _r("(SELECT avg(CASE WHEN acc = '1.0' THEN 1.0 ELSE 0.0 END) FROM rec r WHERE r.lang = c.lang)") + " AS acc_mean, "
       + _r("(SELECT avg(CASE WHEN missing = '1' THEN 1.0 ELSE 0.0 END) FROM rec r WHERE r.lang = c.lang)") + " AS missing_rate, "
       + f"{_r(_f1('tp', 'fp', 'fn'))} AS f1, {_r('(' + _f1('tp', 'fp', 'fn') + ' + ' + _f1('tn', 'fn', 'fp') + ') / 2')} AS macro_f1, "
       + f"{_r(_MCC)} AS mcc FROM c")
def eval_summary(spark, sf):
    j = records(spark, sf, keep=("lang",)).where(F.col("error").isNull())
    t, p, pos = F.col("truth"), F.col("logit_0"), F.lit("good")
    # one grouped aggregate: confusion counts and the per-record flag means
    g = j.groupBy("lang", "model_name").agg(
        *me.confusion(t, p, pos),
        F.avg(F.col("acc").cast("double")).alias("acc_mean"),
        F.avg(F.col("missing").cast("double")).alias("missing_rate"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    out = g.select("lang", "model_name", n.alias("n"), "acc_mean", "missing_rate", me.f1_expr().alias("f1"),
                   ((me.f1_expr() + me.f1_expr("tn", "fn", "fp")) / 2).alias("macro_f1"), me.mcc_expr().alias("mcc"))
    return _round_cols(out, ["acc_mean", "missing_rate", "f1", "macro_f1", "mcc"])


@query("strip_prompt_prefix",
       "WITH " + _SQL_BASE + "x AS (SELECT doc_id, substr(llm_response, length(prompt_0) + 1) AS completion FROM resp "
       "WHERE llm_response IS NOT NULL) SELECT * FROM x")
def strip_prompt_prefix(spark, sf):
    b = eval_base(spark, sf).where(F.col("llm_response").isNotNull())
    return b.select("doc_id", rs.strip_prompt_prefix("llm_response", "prompt_0").alias("completion"))


@query("predicted_label_from_acc", "WITH " + _SQL_PARSED + "SELECT doc_id, quality AS truth_label, pred_label FROM sc")
def predicted_label_from_acc(spark, sf):
    return scored(spark, sf).select("doc_id", F.col("quality").alias("truth_label"), "pred_label")


@query("pair_predictions", "WITH " + _SQL_PARSED + "SELECT l.doc_id, l.quality AS truth, r.pred FROM labels l JOIN rec r ON l.doc_id = r.doc_id")
def pair_predictions(spark, sf):
    truth = T(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth"))
    preds = records(spark, sf).where(F.col("error").isNull()).select("doc_id", F.col("logit_0").alias("pred"))
    return truth.join(preds, "doc_id", "inner")


@query("pair_by_position",  # the k-th row of one list with the k-th of the other, as read; a row without partner is an error
       "SELECT doc_id, quality AS truth, toxic AS pred FROM labels")
def pair_by_position(spark, sf):
    truth = pg.with_position(T(spark, sf, "labels")).select("position", "doc_id", F.col("quality").alias("truth"))
    preds = pg.with_position(T(spark, sf, "labels")).select("position", F.col("toxic").alias("pred"))
    return pg.pair_by_position(truth, preds).select("doc_id", "truth", "pred")


@query("pair_by_key", "SELECT l.doc_id, l.quality AS truth, d.lang AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def pair_by_key(spark, sf):
    truth = T(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth"))
    preds = T(spark, sf, "documents").join(truth.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("pred"))
    return pg.pair_by_key(truth, preds, "doc_id")


@query("metrics_binary", "WITH " + _SQL_PARSED + ", c AS (" + _metric_sql(None) + ") " + _metrics_select(None))
def metrics_binary(spark, sf):
    r = records(spark, sf).where(F.col("error").isNull())
    m = me.binary_metrics(r, "truth", "logit_0", "good")
    return _round_cols(m, ["accuracy", "f1", "macro_f1", "mcc"])


class MeanAbsoluteError:
    """A metric of a user: mean and largest distance kept as a state that merges."""

    columns = ("n_chars", "quality")

    def __init__(self, largest: bool = False):
        self.largest = largest

    def init(self):
        return 0, 0, 0

    def update(self, state, batch):
        n, total, most = state
        for x, y in zip(batch.column("n_chars").to_pylist(), batch.column("quality").to_pylist(), strict=True):
            if x is not None and y is not None:
                n, total, most = n + 1, total + abs(x - 1000 * y), max(most, abs(x - 1000 * y))
        return n, total, most

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1], max(a[2], b[2])

    def finish(self, state):
        return None if not state[0] else float(state[2]) if self.largest else state[1] / state[0]


@query("user_metric",
       "SELECT lang, round(avg(abs(n_chars - 1000 * quality)), 6) AS mae, CAST(max(abs(n_chars - 1000 * quality)) AS DOUBLE) AS largest "
       "FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def user_metric(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(T(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return _round_cols(um.evaluate(d, {"mae": MeanAbsoluteError(), "largest": MeanAbsoluteError(largest=True)}, "lang"), ["mae"])


@query("evaluate_by_name", "WITH " + _SQL_PARSED + ", c AS (" + _metric_sql("lang") + ") "
       "SELECT lang, a.accuracy, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 "
       "FROM c JOIN (SELECT lang, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM rec GROUP BY lang) a USING (lang)")
def evaluate_by_name(spark, sf):
    r = records(spark, sf, keep=("lang",)).where(F.col("error").isNull())
    return _round_cols(me.evaluate(r, "truth", "logit_0", "good", ("accuracy", "f1"), by=["lang"]), ["accuracy", "f1"])


@query("confusion_by_group", "WITH " + _SQL_PARSED + ", c AS (" + _metric_sql("lang") + ") SELECT * FROM c")
def confusion_by_group(spark, sf):
    r = records(spark, sf, keep=("lang",)).where(F.col("error").isNull())
    return me.confusion_by(r, "truth", "logit_0", "good", by=["lang"])


@query("cost_weighted_error",
       "WITH " + _SQL_PARSED + ", c AS (" + _metric_sql("lang") + ") SELECT lang, tp+fp+fn+tn AS n, CAST(fp*5.0 + fn*1.0 AS DOUBLE) AS total_cost, "
       + _r("CASE WHEN tp+fp+fn+tn = 0 THEN NULL ELSE (fp*5.0 + fn*1.0) / (tp+fp+fn+tn) END") + " AS mean_cost FROM c")
def cost_weighted_error(spark, sf):
    r = records(spark, sf, keep=("lang",)).where(F.col("error").isNull())
    return _round_cols(me.cost_weighted_error(r, "truth", "logit_0", "good", 5.0, 1.0, by=["lang"]), ["mean_cost"])


class RuleScorer:
    """Deterministic stand-in for a model client: answers by prompt length
    parity and fails (raises) on prompts whose length is a multiple of 97."""

    def __call__(self, prompts):
        out = []
        for p in prompts:
            if len(p) % 97 == 0:
                raise RuntimeError("scorer unavailable")
            out.append("good" if len(p) % 2 == 0 else "bad")
        return out


@query("batch_score",
       "WITH " + _SQL_BASE + "x AS (SELECT doc_id, CASE WHEN length(prompt_0) % 97 = 0 THEN NULL "
       "WHEN length(prompt_0) % 2 = 0 THEN 'good' ELSE 'bad' END AS llm_response, "
       "CAST(CASE WHEN length(prompt_0) % 97 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts FROM base) SELECT * FROM x")
def batch_score_q(spark, sf):
    b = eval_base(spark, sf).select("doc_id", "prompt_0")
    return batch_score(b, "doc_id", "prompt_0", RuleScorer(), retries=3)


@query("score_resumably",  # the same answers from files of prompts, batch by batch, without scoring any twice
       ORACLE["batch_score"])
def score_resumably_q(spark, sf):
    folder = f"{shared_dir(spark)}/scoring-{uuid.uuid4().hex}"
    b = eval_base(spark, sf).select("doc_id", "prompt_0")
    b.repartition(8, "doc_id").write.parquet(f"{folder}/prompts")
    return score_resumably(spark, f"{folder}/prompts", b.schema, f"{folder}/answers", f"{folder}/state", "doc_id", "prompt_0", RuleScorer(), files_per_batch=3)


# ------------------------------------------------------------------ fairness
def _rate_sql(cond: str, given: str) -> str:
    return (f"CASE WHEN count(*) FILTER (WHERE {given}) = 0 THEN NULL "
            f"ELSE (count(*) FILTER (WHERE ({cond}) AND ({given})))::DOUBLE / count(*) FILTER (WHERE {given}) END")


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) IS NULL OR ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END"


def _fair_sql(col: str, unpriv: str, priv: str, table: str = "sc") -> str:
    u, p = f"{col} = {unpriv}", f"{col} = {priv}"
    return (f"SELECT {_rate_sql('quality = 1', u)} AS bt_u, {_rate_sql('quality = 1', p)} AS bt_p, "
            f"{_rate_sql('pred_label = 1', u)} AS bp_u, {_rate_sql('pred_label = 1', p)} AS bp_p, "
            f"{_rate_sql('pred_label = 1', u + ' AND quality = 1')} AS tpr_u, {_rate_sql('pred_label = 1', p + ' AND quality = 1')} AS tpr_p, "
            f"{_rate_sql('pred_label = 1', u + ' AND quality <> 1')} AS fpr_u, {_rate_sql('pred_label = 1', p + ' AND quality <> 1')} AS fpr_p "
            f"FROM {table}")


_EOD = "tpr_u - tpr_p"
_AOD = "((fpr_u - fpr_p) + (tpr_u - tpr_p)) / 2"


@query("group_base_rates",
       "WITH " + _SQL_BASE + "x AS (SELECT lang, count(*) AS n, "
       + _r("avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END)") + " AS base_rate FROM base GROUP BY lang) SELECT * FROM x")
def group_base_rates(spark, sf):
    b = eval_base(spark, sf)
    return _round_cols(fa.base_rates(b, "quality", 1, "lang"), ["base_rate"])


@query("fairness_disparate_impact",
       "WITH " + _SQL_PARSED + ", f AS (" + _fair_sql("lang", "'fr'", "'en'") + ") "
       f"SELECT {_r(_div('bt_u', 'bt_p'))} AS di_truth, {_r(_div('bp_u', 'bp_p'))} AS di_pred FROM f")
def fairness_disparate_impact(spark, sf):
    m = fa.fairness_metrics(scored(spark, sf), LANG_SPEC, "quality", "pred_label")
    return _round_cols(m.select("di_truth", "di_pred"), ["di_truth", "di_pred"])


@query("fairness_eod_aod",
       "WITH " + _SQL_PARSED + ", f AS (" + _fair_sql("lang", "'fr'", "'en'") + ") "
       f"SELECT {_r(_EOD)} AS eod, {_r(_AOD)} AS aod FROM f")
def fairness_eod_aod(spark, sf):
    m = fa.fairness_metrics(scored(spark, sf), LANG_SPEC, "quality", "pred_label")
    return _round_cols(m.select("eod", "aod"), ["eod", "aod"])


@query("fairness_report",
       "WITH " + _SQL_PARSED + ", f1 AS (" + _fair_sql("lang", "'fr'", "'en'") + "), f2 AS (" + _fair_sql("long_doc", "0", "1") + "), "
       "f AS (SELECT 'lang' AS attribute, * FROM f1 UNION ALL SELECT 'long_doc', * FROM f2) "
       f"SELECT 'DI' AS metric, attribute, {_r(_div('bp_u', 'bp_p'))} AS value FROM f UNION ALL "
       f"SELECT 'EOD', attribute, {_r(_EOD)} FROM f UNION ALL SELECT 'AOD', attribute, {_r(_AOD)} FROM f")
def fairness_report(spark, sf):
    rep = fa.fairness_report(scored(spark, sf), [LANG_SPEC, LENGTH_SPEC], "quality", "pred_label")
    return _round_cols(rep, ["value"])


@query("fairness_drop_missing",
       "WITH " + _SQL_PARSED + ", f AS (" + _fair_sql("lang", "'fr'", "'en'", "(SELECT * FROM sc WHERE missing <> '1')") + ") "
       f"SELECT {_r(_div('bp_u', 'bp_p'))} AS di_pred, {_r(_EOD)} AS eod, {_r(_AOD)} AS aod FROM f")
def fairness_drop_missing(spark, sf):
    s = scored(spark, sf, policy="drop").where(F.col("pred_label").isNotNull())
    m = fa.fairness_metrics(s, LANG_SPEC, "quality", "pred_label")
    return _round_cols(m.select("di_pred", "eod", "aod"), ["di_pred", "eod", "aod"])


# ------------------------------------------------------------------ flagship
@query("metrics_by_segment",
       f"WITH x AS (SELECT c_mktsegment, CASE WHEN c_acctbal >= 0 THEN 'good' ELSE 'bad' END AS truth, "
       f"CASE WHEN c_custkey % 13 = 0 THEN 'good' ELSE {SQL_CHAT} || CASE WHEN c_acctbal > 2500 THEN ' Good' ELSE ' Bad' END END AS resp "
       f"FROM {SQL_CUSTOMERS}), rec AS (SELECT c_mktsegment, truth, CASE WHEN regexp_matches(resp, {q(r'\n\nAssistant:')}) THEN "
       f"lower({sql_strip(f'regexp_extract(resp, {q(r'(?s)\n\nAssistant:(.*)$')}, 1)')}) ELSE 'Incomplete response' END AS pred FROM x), "
       "c AS (" + _metric_sql("c_mktsegment") + ") " + _metrics_select("c_mktsegment"))
def metrics_by_segment(spark, sf):
    p = customer_prompts(spark, sf)
    truth = F.when(F.col("c_acctbal") >= 0, F.lit("good")).otherwise(F.lit("bad"))
    resp = F.when(F.pmod("c_custkey", F.lit(13)) == 0, F.lit("good")).otherwise(
        F.concat(F.col("chat_query"), F.when(F.col("c_acctbal") > 2500, F.lit(" Good")).otherwise(F.lit(" Bad"))))
    r = p.select("c_custkey", "c_mktsegment", truth.alias("answer"), "choices", "chat_query", resp.alias("resp"))
    rec = rs.eval_records(r, "c_custkey", "chat_query", "resp", "answer", "choices", MODEL, parse="clean",
                          keep=("c_mktsegment",))
    m = me.binary_metrics(rec, "truth", "logit_0", "good", by=["c_mktsegment"])
    return _round_cols(m, ["accuracy", "f1", "macro_f1", "mcc"])



@query("average_precision",
       "WITH s AS (SELECT d.n_chars AS score, count(*) FILTER (WHERE l.quality = 1) AS tp, count(*) FILTER (WHERE l.quality <> 1) AS fp "
       "FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.n_chars), "
       "c AS (SELECT tp, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM s WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
       "t AS (SELECT sum(tp) AS p FROM s) "
       "SELECT round(sum(tp::DOUBLE / t.p * ctp / (ctp + cfp)), 6) AS average_precision FROM c, t")
def average_precision_q(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "n_chars")
    lab = T(spark, sf, "labels").select("doc_id", "quality")
    ap = me.average_precision(d.join(lab, "doc_id"), "n_chars", "quality", 1)
    return _round_cols(ap, ["average_precision"])
