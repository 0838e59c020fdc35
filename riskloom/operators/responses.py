"""Completion parsing and evaluation records (native Column expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, py_strip_lower, py_tuple2
from ..specs import ARTEFACTS, ARTEFACTS_LOWER, INCOMPLETE

ASSISTANT_MARKER = "\n\nAssistant:"


def clean_response(c) -> Column:
    """Text after the first ``\\n\\nAssistant:`` marker, stripped and lower
    cased; ``'Incomplete response'`` when there is no marker."""
    x = F.col(c) if isinstance(c, str) else c
    at = F.locate(ASSISTANT_MARKER, x)
    return F.when(at > 0, py_strip_lower(F.substring(x, at + len(ASSISTANT_MARKER), F.lit(2147483647)))).otherwise(F.lit(INCOMPLETE))


def remove_artefacts(c, lower_first: bool = False) -> Column:
    """Literal removal of chat artefacts, in order (order matters)."""
    x = F.col(c) if isinstance(c, str) else c
    if lower_first:
        x = F.lower(x)
    for bad in (ARTEFACTS_LOWER if lower_first else ARTEFACTS):
        x = F.replace(x, F.lit(bad), F.lit(""))
    return x


def match_choice(text, choices, lower_first: bool = False) -> Column:
    """First choice (in choice order) contained in the cleaned text; else the
    cleaned text itself."""
    clean = py_strip_lower(remove_artefacts(text, lower_first))
    ch = F.col(choices) if isinstance(choices, str) else choices
    hit = F.try_element_at(F.filter(ch, lambda c: clean.contains(F.lower(c))), F.lit(1))
    return F.coalesce(F.lower(hit), clean)


def eval_records(df: DataFrame, id_col: str, prompt_col: str, response_col: str, answer_col: str,
                 choices_col: str, model_name: Column | str = "unknown", parse: str = "clean",
                 keep: Sequence[str] = ()) -> DataFrame:
    """Evaluation record per row.

    Missing response -> ``error='llm_response key not found'``; empty choices
    -> ``error='missing_choices'``; otherwise prediction (``logit_0``), trimmed
    lower-case truth, ``acc`` ``'1.0'/'0.0'``, ``missing`` ``'0'/'1'`` by
    membership in the lower-cased choice set and the ``(pred, truth)`` tuple
    text for the external F1 / macro-F1 / MCC harness.  ``keep`` carries
    extra input columns (groups, labels) so later metrics need no join back."""
    resp = F.col(response_col)
    choices = F.col(choices_col)
    if parse == "clean":
        pred = clean_response(resp)
    elif parse == "match":
        pred = match_choice(clean_response(resp), choices)
    else:
        pred = resp
    choice_set = F.transform(choices, lambda c: py_strip_lower(c))
    no_choices = F.coalesce(F.size(choices), F.lit(0)) <= 0
    error = F.when(resp.isNull(), F.lit("llm_response key not found")).when(no_choices, F.lit("missing_choices"))
    mn = F.lit(model_name) if isinstance(model_name, str) else model_name
    # the answer is parsed once, then its text once; the record refers to both
    t = df.withColumns({"_ev_error": error, "_ev_pred": pred, "_ev_truth": py_strip_lower(F.coalesce(F.col(answer_col), F.lit("")))})
    pred, truth = F.col("_ev_pred"), F.col("_ev_truth")
    t = t.withColumn("_ev_tuple", py_tuple2(pred, truth))
    ok, tup = F.col("_ev_error").isNull(), F.col("_ev_tuple")
    return t.select(
        F.col(id_col).alias("doc_id"),
        F.when(ok, F.col(prompt_col)).alias("prompt_0"),
        F.when(ok, mn).alias("model_name"),
        F.when(ok, resp).alias("llm_response"),
        F.when(ok, pred).alias("logit_0"),
        F.when(ok, truth).alias("truth"),
        F.when(ok, F.when(pred == truth, F.lit("1.0")).otherwise(F.lit("0.0"))).alias("acc"),
        F.when(ok, F.when(F.array_contains(choice_set, pred), F.lit("0")).otherwise(F.lit("1"))).alias("missing"),
        F.when(ok, tup).alias("f1"),
        F.when(ok, tup).alias("macro_f1"),
        F.when(ok, tup).alias("mcc"),
        F.col("_ev_error").alias("error"),
        *keep,
    )


def error_rows(records: DataFrame) -> DataFrame:
    """Quarantine: records that carry an error instead of a prediction."""
    return records.where(F.col("error").isNotNull()).select("doc_id", "error")


def predicted_label(truth_label, acc, favorable, unfavorable, missing=None, policy: str = "flip") -> Column:
    """Predicted label from (truth, acc): correct -> truth, wrong -> the other
    label.  ``policy`` for unparseable answers: ``flip`` (wrong, the default),
    ``drop`` (NULL, filter afterwards) or ``negative`` (the unfavorable label)."""
    t = F.col(truth_label) if isinstance(truth_label, str) else truth_label
    a = F.col(acc) if isinstance(acc, str) else acc
    other = F.when(t == F.lit(favorable), F.lit(unfavorable)).otherwise(F.lit(favorable))
    pred = F.when(a.cast("double") == 1.0, t).otherwise(other)
    if missing is None or policy == "flip":
        return pred
    m = (F.col(missing) if isinstance(missing, str) else missing).cast("int") == 1
    if policy == "drop":
        return F.when(m, F.lit(None)).otherwise(pred)
    if policy == "negative":
        return F.when(m, F.lit(unfavorable)).otherwise(pred)
    raise ValueError(policy)


def strip_prompt_prefix(output, prompt) -> Column:
    """``output[len(prompt):]``."""
    o = F.col(output) if isinstance(output, str) else output
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.substring(o, F.length(p) + 1, 2147483647)


def allowed_answers(choices: Sequence[str]) -> Column:
    """Distinct stripped lower-case choices (the set used for ``missing``)."""
    return F.array_distinct(F.transform(F.array(*[F.lit(c) for c in choices]), lambda c: py_strip_lower(c)))


__all__ = ["clean_response", "match_choice", "eval_records", "error_rows", "predicted_label",
           "strip_prompt_prefix", "remove_artefacts", "allowed_answers", "py_strip"]
