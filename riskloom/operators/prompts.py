"""Row -> prompt text, all as native Column expressions (no UDF).

The renderers are compiled on the driver from a spec into one ``concat_ws``
over an array of pieces, which keeps very wide specs (95 fields) inside the
codegen method limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import null_text, py_str, py_strip
from ..specs import (
    CHAT_PREFIX,
    CHAT_SUFFIX,
    EXAM_HUMAN,
    FEW_SHOT,
    NORMAL_SUFFIX,
    NOTE_PREFIX,
    STRICT_SUFFIX,
    SYSTEM_ANALYSIS,
    SYSTEM_BINARY,
    FieldSpec,
    PromptSpec,
    RenderSpec,
)
from .features import codebook_lookup


def _template(tpl: str, name: str, value: Column) -> Column:
    before, _, after = tpl.replace("{name}", name).partition("{value}")
    parts = [p for p in (F.lit(before) if before else None, value, F.lit(after) if after else None) if p is not None]
    return F.concat(*parts)


def field_value(f: FieldSpec) -> Column:
    """Rendered value of one field (code book, decode or typed text)."""
    c = F.col(f.col)
    if f.codebook is not None:
        v = codebook_lookup(c, f.codebook, strict=True)
    elif f.decode is not None:
        test_value, yes_text, no_text = f.decode
        return F.when(c.cast("string") == F.lit(str(test_value)), F.lit(yes_text)).otherwise(F.lit(no_text))
    else:
        v = null_text(py_str(c, f.kind), f.null_as or ("nan" if f.kind != "str" else "None"))
    if f.suffix:
        v = F.concat(v, F.lit(f.suffix))
    return v


def render_fields(fields: Sequence[FieldSpec], render: RenderSpec = RenderSpec()) -> Column:
    """``prefix + join(piece_i, sep) + end``; ``piece_i`` = field template
    (or the spec template) with the display name and the rendered value."""
    pieces = []
    for f in fields:
        val = field_value(f)
        if f.decode is not None and f.template is None:
            pieces.append(val)
        else:
            pieces.append(_template(f.template or render.template, f.display, val))
    body = F.concat_ws(render.sep, F.array(*pieces))
    return F.concat(F.lit(render.prefix), body, F.lit(render.end))


def header_fields(df: DataFrame, exclude: Sequence[str] = ()) -> list[FieldSpec]:
    """Feature dictionary from the header at run time (names = columns);
    the render kind comes from the declared schema."""
    out = []
    for fld in df.schema.fields:
        if fld.name in exclude:
            continue
        t = fld.dataType.simpleString()
        kind = "int" if t in ("int", "bigint", "smallint", "tinyint") else "float" if t in ("double", "float") else "str"
        out.append(FieldSpec(fld.name, fld.name, kind))
    return out


def typed_header(schema, fields: Sequence[FieldSpec], intro: str) -> str:
    """Header block with ``(categorical)``/``(numerical)`` tags taken from the
    declared schema (driver side, a constant string)."""
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    out = intro
    for f in fields:
        tag = f.type_tag or ("categorical" if types[f.col] == "string" else "numerical")
        desc = f.description or f.display
        out += f"{f.display}: {desc} ({tag}). \n"
    return out


def field_header(fields: Sequence[FieldSpec], intro: str) -> str:
    """Header block of fields that declare their type tag themselves."""
    return intro + "".join(f"{f.display}: {f.description or f.display} ({f.type_tag}). \n" for f in fields)


def assemble(text: Column, instruction: str, debias: str = "", counter_factual: str = "",
             add_debias: bool = False, add_counter_factual: bool = False, marker: str = " \nText: ",
             quote_text: bool = True, answer_cue: str = NORMAL_SUFFIX):
    """``(normal_query, chat_query)``: instruction + marker + (quoted) text,
    optional notes, then the answer cue (plain or chat-wrapped)."""
    quote = "'" if quote_text else ""
    body = F.concat(F.lit(instruction + marker + quote), text, F.lit(quote))
    if add_debias:
        body = F.concat(body, F.lit(NOTE_PREFIX + debias))
    if add_counter_factual:
        body = F.concat(body, F.lit(NOTE_PREFIX + counter_factual))
    normal = F.concat(body, F.lit(answer_cue))
    chat = F.concat(F.lit(CHAT_PREFIX), body, F.lit(CHAT_SUFFIX))
    return normal, chat


def prompt_columns(df: DataFrame, text: Column, spec: PromptSpec, add_debias=False, add_counter_factual=False) -> DataFrame:
    """Attach the full prompt record columns (text, queries, choices, example, task, notes)."""
    normal, chat = assemble(F.col("text"), spec.instruction, spec.debias_prompt, spec.counter_factual_prompt,
                            add_debias, add_counter_factual, quote_text=spec.quote_text, answer_cue=spec.answer_cue)
    example = F.struct(
        F.struct(F.lit(spec.example1[0]).alias("input"), F.lit(spec.example1[1]).alias("output")).alias("example1"),
        F.struct(F.lit(spec.example2[0]).alias("input"), F.lit(spec.example2[1]).alias("output")).alias("example2"),
    )
    return (
        df.withColumn("text", text)
        .withColumn("normal_query", normal)
        .withColumn("chat_query", chat)
        .withColumn("choices", F.array(*[F.lit(c) for c in spec.choices]))
        .withColumn("example", example)
        .withColumn("task", F.lit(spec.task))
        .withColumn("debias_prompt", F.lit(spec.debias_prompt))
        .withColumn("counter_factual_prompt", F.lit(spec.counter_factual_prompt))
    )


def prose(template: str, values: dict) -> Column:
    """Free prose: ``{name}`` placeholders filled with Columns, in any order."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(before), null_text(values[key], "None")]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def quoted_choices(choices: Column, joiner: str) -> Column:
    return F.array_join(F.transform(choices, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), joiner)


def strict_suffix(prompt: Column, choices: Column, auxiliary: str = "", remove_answer: bool = True) -> Column:
    """Strip a trailing ``Answer:`` cue, then append the auxiliary text and the
    one-word instruction listing the quoted choices."""
    p = prompt
    if remove_answer:
        p = py_strip(F.regexp_replace(p, r"Answer:\s*$", ""))
    if auxiliary:
        p = F.concat(p, F.lit(" " + auxiliary))
    before, _, after = STRICT_SUFFIX.partition("{choices}")
    return F.concat(p, F.lit(before), quoted_choices(choices, " OR "), F.lit(after))


def few_shot(example: Column, task: Column, text: Column, choices: Column, auxiliary: str = "") -> Column:
    """Two-shot prompt from the ``example`` struct, task and text, then the
    strict one-word suffix."""
    parts = []
    rest = FEW_SHOT
    values = {
        "in1": example.getField("example1").getField("input"),
        "out1": example.getField("example1").getField("output"),
        "in2": example.getField("example2").getField("input"),
        "out2": example.getField("example2").getField("output"),
        "task": task,
        "text": text,
    }
    while "{" in rest:
        before, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(before), F.coalesce(values[key], F.lit(""))]
    parts.append(F.lit(rest))
    return strict_suffix(F.concat(*parts), choices, auxiliary)


def system_message(choices: Column, debias: Column, style: str = "binary") -> Column:
    tpl = SYSTEM_BINARY if style == "binary" else SYSTEM_ANALYSIS
    q = quoted_choices(choices, " or ")
    parts = []
    rest = tpl
    while "{" in rest:
        before, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(before), q if key == "choices" else debias]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def chat_messages(user_text: Column, choices: Column, debias: Column, style: str = "binary") -> Column:
    """``array<struct<role, content>>`` with the system and user messages."""
    return F.array(
        F.struct(F.lit("system").alias("role"), system_message(choices, debias, style).alias("content")),
        F.struct(F.lit("user").alias("role"), user_text.alias("content")),
    )


def second_turn(first_output: Column, second_query: Column) -> Column:
    """``first_output + "\\nHuman: q\\nAssistant:"``; a missing second query is an error."""
    q = F.when(second_query.isNull(), F.raise_error(F.lit("second turn requires a second query"))).otherwise(second_query)
    return F.concat(first_output, F.lit("\nHuman: "), q, F.lit("\nAssistant:"))


def exam_prompt(qtype: Column, question: Column, candidates: Column) -> Column:
    """Exam prompt (chat-wrapped) with space-joined candidates."""
    human = EXAM_HUMAN.replace("{{", "\x00").replace("}}", "\x01")
    parts = []
    values = {"type": qtype, "question": question, "candidates": F.array_join(candidates, " ")}
    rest = human
    while "{" in rest:
        before, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(before.replace("\x00", "{").replace("\x01", "}")), values[key]]
    parts.append(F.lit(rest.replace("\x00", "{").replace("\x01", "}")))
    return F.concat(F.lit("Human: \n"), *parts, F.lit("\n\nAssistant: \n"))


def json_answer(reason: Column, answer: Column) -> Column:
    """``json.dumps({"reason": r, "answer": a}, ensure_ascii=False)`` spelling."""
    def js(c):
        return F.regexp_replace(F.regexp_replace(F.to_json(F.array(c)), r"^\[", ""), r"\]$", "")
    return F.concat(F.lit('{"reason": '), js(reason), F.lit(', "answer": '), js(answer), F.lit("}"))


def plain_eval_prompt(question: Column, candidates: Column) -> Column:
    """Plain evaluation template: stripped question, newline-joined candidates."""
    from ..functions.text import py_strip as _strip
    return F.concat(_strip(question), F.lit("\n"), F.array_join(candidates, "\n"))
