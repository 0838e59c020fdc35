"""Model-style dispatch: which prompt formatter and which response parser a
model family uses (looked up on the driver by model name; both sides are
Column builders, so the per-row work stays JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import prompts as pr
from . import responses as rs

# Model-name markers -> style.  Callers add their own markers
# (e.g. for models whose output is lower-cased before cleaning: "lowercase").
STYLE_MARKERS = (("qwen", "qwen"), ("distill", "distill"))


def style_of(model_name: str, extra_markers: tuple = ()) -> str:
    name = model_name.lower()
    for marker, style in tuple(extra_markers) + STYLE_MARKERS:
        if marker in name:
            return style
    return "generic"


def format_prompt(style: str, record_cols: dict, auxiliary: str = "") -> Column:
    """``record_cols``: Columns ``normal_query``, ``example``, ``task``,
    ``text``, ``choices``.  Qwen / Distill use the two-shot template, the
    lowercase and generic styles the stored query, all with the strict one-word suffix."""
    if style in ("qwen", "distill"):
        return pr.few_shot(record_cols["example"], record_cols["task"], record_cols["text"], record_cols["choices"], auxiliary)
    return pr.strict_suffix(record_cols["normal_query"], record_cols["choices"], auxiliary)


def system_prompt(style: str, choices: Column, debias: Column) -> Column | None:
    if style == "qwen":
        return pr.system_message(choices, debias, "binary")
    if style == "distill":
        return pr.system_message(choices, debias, "analysis")
    return None


def parse_response(style: str, response: Column, choices: Column) -> Column:
    """Qwen / Distill: artefact removal + first matching choice; lowercase:
    the same after lower-casing first; generic: text after the assistant
    marker."""
    if style in ("qwen", "distill"):
        return rs.match_choice(response, choices)
    if style == "lowercase":
        return rs.match_choice(response, choices, lower_first=True)
    return rs.clean_response(response)


__all__ = ["style_of", "format_prompt", "system_prompt", "parse_response", "F"]
