"""Instruction-tuning data path: conversations -> token samples -> blocks.

Token ids come from a pluggable tokenizer Column function; the default is a
white-space tokenizer (Python ``str.split()``) whose ids are the first four hex
digits of the token's md5 plus 3 (0 pad, 1 bos, 2 eos), all JVM-side, so SQL can
recompute every id.  A real tokenizer can be
passed as a ``pandas_udf`` returning ``array<int>``.

Per-conversation work (assembling turns, masking, truncation) groups by the
conversation id: a conversation is one record.  Turns that start beyond the
truncation length are dropped before the collect, so the collected group is
bounded by ``max_len`` tokens.  Corpus-wide work (packing) uses distributed
prefix sums and groups by fixed-size blocks only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import global_rank, range_cumsum
from ..functions.text import ws_tokens
from ..session import written
from ..specs import HUMAN_TURN, HUMAN_TURN_COMPACT, IGNORE_INDEX

PAD_ID, BOS_ID, EOS_ID = 0, 1, 2


def ws_token_ids(text: Column) -> Column:
    return F.transform(ws_tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") + 3)


Tokenizer = Callable[[Column], Column]


def is_human(role: Column, human_roles: Sequence[str] = ("human", "user")) -> Column:
    return F.lower(role).isin(*human_roles)


def render_turn(role: Column, value: Column, compact: bool = False, human_roles=("human", "user")) -> Column:
    """Human turn -> ``"Human: \\n" + v + "\\n\\nAssistant: \\n"`` (compact
    variant without the newlines after the colons); other turns unchanged."""
    pre, post = HUMAN_TURN_COMPACT if compact else HUMAN_TURN
    return F.when(is_human(role, human_roles), F.concat(F.lit(pre), value, F.lit(post))).otherwise(value)


def assemble_conversations(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Ordered turns -> ``conversations array<struct<from, value>>``;
    ``user`` is written as ``human``."""
    frm = F.when(F.lower(F.col(role)) == "user", F.lit("human")).otherwise(F.lower(F.col(role)))
    g = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), frm.alias("from"), F.col(text).alias("value")))).alias("_turns"))
    return g.select(conv, F.transform("_turns", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def convert_instructions(df: DataFrame, order: Sequence[str], name: str, id_col: str | None = "id",
                         instruction="instruction", input_="input", output="output") -> DataFrame:
    """Instruction rows -> conversation rows; human value = instruction + input,
    assistant = output; a missing id becomes ``<name>-<n>`` where the counter
    advances on every row (1-based, in row order)."""
    t = global_rank(df, order, out="_n")
    fallback = F.concat(F.lit(name + "-"), F.col("_n").cast("string"))
    cid = F.coalesce(F.col(id_col).cast("string"), fallback) if id_col else fallback
    conv = F.array(
        F.struct(F.lit("human").alias("from"), F.concat(F.col(instruction), F.col(input_)).alias("value")),
        F.struct(F.lit("assistant").alias("from"), F.col(output).alias("value")),
    )
    return t.select(cid.alias("id"), conv.alias("conversations"), *[c for c in df.columns if c not in (id_col,)])


def turn_tokens(turns: DataFrame, conv: str, turn: str, role: str, text: str, tokenizer: Tokenizer = ws_token_ids,
                compact: bool = False, eos_after_other: bool = True, with_labels: bool = True,
                eos_id: int = EOS_ID) -> DataFrame:
    """Per-turn ids and labels: human tokens masked with -100, other turns
    copied, EOS appended after every non-human turn (in both arrays)."""
    human = is_human(F.col(role))
    ids = tokenizer(render_turn(F.col(role), F.col(text), compact))
    if eos_after_other:
        ids = F.when(human, ids).otherwise(F.concat(ids, F.array(F.lit(eos_id))))
    t = turns.select(conv, turn, role, ids.alias("ids"))
    if with_labels:
        t = t.withColumn("labels", F.when(human, F.array_repeat(F.lit(IGNORE_INDEX), F.size("ids"))).otherwise(F.col("ids")))
    return t.withColumn("n", F.size("ids"))


def first_turns(turns: DataFrame, conv: str, turn: str, n: int) -> DataFrame:
    """The first ``n`` turns of every conversation (``row_number() <= n``,
    which Spark evaluates as a group limit before the shuffle)."""
    w = Window.partitionBy(conv).orderBy(turn)
    return turns.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def token_samples(turns: DataFrame, conv: str, turn: str, role: str, text: str, max_len: int,
                  tokenizer: Tokenizer = ws_token_ids, eos_id: int = EOS_ID) -> DataFrame:
    """Conversation -> ``input_ids, attention_mask, labels`` truncated to
    ``max_len``.  Turns starting at or beyond ``max_len`` never reach the
    collect."""
    # every rendered turn has at least one token, so only the first max_len
    # turns of a conversation can start before max_len: a per-conversation
    # row limit (applied before the shuffle) bounds even a huge conversation
    t = first_turns(turns, conv, turn, max_len)
    t = turn_tokens(t, conv, turn, role, text, tokenizer, eos_id=eos_id)
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_start", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("_start") < max_len)
    g = t.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), "ids", "labels"))).alias("_p"))
    ids = F.slice(F.flatten(F.transform("_p", lambda x: x["ids"])), 1, max_len)
    labels = F.slice(F.flatten(F.transform("_p", lambda x: x["labels"])), 1, max_len)
    return g.select(conv, ids.alias("input_ids"), labels.alias("labels")).withColumn(
        "attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def repair_masked(ids: Column, labels: Column, lo: int = 18, hi: int = 24) -> Column:
    """Fully masked labels: copy ``input_ids[lo:hi]`` into them (a no-op when
    shorter than ``lo + 1``)."""
    all_masked = F.forall(labels, lambda x: x == IGNORE_INDEX)
    fixed = F.transform(labels, lambda x, i: F.when((i >= lo) & (i < hi), F.element_at(ids, i + 1)).otherwise(x))
    return F.when(all_masked, fixed).otherwise(labels)


def has_label(labels: Column) -> Column:
    return F.exists(labels, lambda x: x > IGNORE_INDEX)


def pad(arr: Column, length: int, value: int, side: str = "left") -> Column:
    """Pad an array to ``length`` (no-op when already longer)."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(arr), F.lit(0)))
    return F.concat(fill, arr) if side == "left" else F.concat(arr, fill)


def pad_sample(df: DataFrame, length: int, side: str = "left", label_pad: int = PAD_ID) -> DataFrame:
    """Fixed-length padding of a token sample: ids with pad id, mask with 0,
    labels with ``label_pad`` (pad id in one loader, -100 in the other)."""
    return df.withColumn("input_ids", pad(F.col("input_ids"), length, PAD_ID, side)) \
        .withColumn("attention_mask", pad(F.col("attention_mask"), length, 0, side)) \
        .withColumn("labels", pad(F.col("labels"), length, label_pad, side))


def inference_context(turns: DataFrame, conv: str, turn: str, role: str, text: str, max_len: int = 2048,
                      tokenizer: Tokenizer = ws_token_ids) -> DataFrame:
    """All turns but the last, compact human template, EOS after non-human
    turns, no labels, truncated; conversations whose context holds no
    ``Human`` text are skipped.

    Whether ``Human`` occurs is a partial aggregate over the whole context; the
    length limit applies to the tokens alone: turn offsets are a bucketed prefix
    sum, so a long conversation is spread over tasks and only the turns that
    start below ``max_len`` are collected."""
    human = is_human(F.col(role))
    rendered = render_turn(F.col(role), F.col(text), compact=True)
    ids = tokenizer(rendered)
    ids = F.when(human, ids).otherwise(F.concat(ids, F.array(F.lit(EOS_ID))))
    last = turns.groupBy(conv).agg(F.max(turn).alias("_last"))
    t = turns.join(last, conv).where(F.col(turn) < F.col("_last"))
    named = t.groupBy(conv).agg(F.max(rendered.contains("Human")).alias("_has_human")).where("_has_human").select(conv)
    t = t.select(conv, turn, ids.alias("ids")).withColumn("n", F.size("ids").cast("long"))
    t = range_cumsum(t, "n", [turn], by=[conv], out="_start", inclusive=False).where(F.col("_start") < max_len)
    g = t.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), "ids"))).alias("_p"))
    ids_all = F.slice(F.flatten(F.transform("_p", lambda x: x["ids"])), 1, max_len)
    return g.join(named, conv).select(conv, ids_all.alias("input_ids"))


def pack_blocks(docs: DataFrame, group: str, order: str, text: str, block: int, eos: bool = True,
                keep_short: bool = False, tokenizer: Tokenizer = ws_token_ids, eos_id: int = EOS_ID) -> DataFrame:
    """Concatenate the token streams of each group (docs in ``order``, EOS
    after each doc when ``eos``) and cut them into blocks of ``block`` tokens.

    The remainder is dropped; with ``keep_short`` a stream shorter than one
    block is kept as one short block.  Document offsets are a distributed
    prefix sum; each document is cut into the pieces that fall into each
    block it overlaps (``slice``), and the pieces are regrouped by
    (group, block) — so the shuffle moves about one row per document and
    block, and no task ever holds more than one block per group."""
    ids = tokenizer(F.col(text))
    if eos:
        ids = F.concat(ids, F.array(F.lit(eos_id)))
    # tokenised once, in the scan; from there only ids move
    t = docs.select(group, order, ids.alias("_ids")).withColumn("_len", F.size("_ids").cast("long")).where(F.col("_len") > 0)
    t = range_cumsum(t, "_len", [order], by=[group], out="_start", inclusive=False, total_out="_total")
    full = F.floor(F.col("_total") / block)
    limit = F.when(F.lit(keep_short) & (F.col("_total") < block), F.lit(1)).otherwise(full)
    first_b = F.floor(F.col("_start") / block)
    last_b = F.floor((F.col("_start") + F.col("_len") - 1) / block)
    pieces = t.select(group, order, "_start", "_len", "_ids", limit.alias("_nblocks"),
                      F.explode(F.sequence(first_b, last_b)).alias("_block"))
    lo = F.greatest(F.col("_block") * block, F.col("_start"))
    hi = F.least((F.col("_block") + 1) * block, F.col("_start") + F.col("_len"))
    pieces = pieces.where(F.col("_block") < F.col("_nblocks")).select(
        group, order, "_block", lo.alias("_lo"),
        F.slice("_ids", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")).alias("_piece"))
    blocks = pieces.groupBy(group, "_block").agg(
        F.sort_array(F.collect_list(F.struct("_lo", "_piece"))).alias("_s"),
        F.min(order).alias("first_doc"), F.max(order).alias("last_doc"))
    ids_col = F.flatten(F.transform("_s", lambda x: x["_piece"]))
    return blocks.select(group, F.col("_block").cast("long").alias("block_no"), ids_col.alias("input_ids"),
                         ids_col.alias("labels"), "first_doc", "last_doc")


def preference_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``prompt`` = the text up to the first assistant turn, ``chosen`` = the
    first and ``rejected`` = the last assistant turn; conversations without two
    assistant turns are skipped.  Partial aggregates; only the turns in front of
    the first answer are collected."""
    said = turns.where(F.lower(role) == "assistant").groupBy(conv).agg(
        F.min(turn).alias("_first"), F.min_by(text, turn).alias("chosen"), F.max_by(text, turn).alias("rejected"), F.count(F.lit(1)).alias("_n"))
    said = said.where(F.col("_n") >= 2)
    lead = turns.join(said.select(conv, "_first"), conv).where(F.col(turn) < F.col("_first"))
    lead = lead.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(text).alias("v")))).alias("_l"))
    out = said.join(lead, conv, "left")
    prompt = F.array_join(F.transform("_l", lambda x: x["v"]), "\n")
    return out.select(conv, F.coalesce(prompt, F.lit("")).alias("prompt"), "chosen", "rejected")


def stack_pairs(pref: DataFrame, conv: str) -> DataFrame:
    """Chosen rows stacked on rejected rows (one row each)."""
    return pref.select(conv, F.explode(F.array(
        F.struct(F.lit("chosen").alias("kind"), F.col("chosen").alias("response")),
        F.struct(F.lit("rejected").alias("kind"), F.col("rejected").alias("response")),
    )).alias("_r")).select(conv, "_r.kind", "_r.response")


def phase_projection(pref: DataFrame, conv: str, phase: int) -> DataFrame:
    """Phase 1: prompt+chosen; 2: prompt+chosen and prompt+rejected; 3: prompt only."""
    if phase == 1:
        return pref.select(conv, F.concat("prompt", "chosen").alias("sample"))
    if phase == 2:
        return pref.select(conv, F.concat("prompt", "chosen").alias("chosen_sample"),
                           F.concat("prompt", "rejected").alias("rejected_sample"))
    return pref.select(conv, F.col("prompt"))


def align_token_probs(df: DataFrame, key: str, probs: str) -> DataFrame:
    """Token i gets the probability stored for it (position i-1 of the
    stored array); the first token gets 0.0."""
    aligned = F.concat(F.array(F.lit(0.0)), F.slice(F.transform(probs, lambda x: x.cast("double")), 1, F.size(probs) - 1))
    return df.select(key, F.posexplode(aligned).alias("pos", "prob"))


def conversation_units(turns: DataFrame, conv: str, turn: str, role: str, text: str, max_tokens: int,
                       tokenizer: Tokenizer = ws_token_ids) -> DataFrame:
    """What a cut keeps together: ``conv, unit`` (from 1), ``n`` tokens, ``turns``,
    ``end`` (tokens up to its end), ``total``.  A unit is a pair, that is a human
    turn with what follows it up to the next one (leading other turns go with the
    first), or, where a pair has more than ``max_tokens``, each of its turns."""
    t = turn_tokens(turns, conv, turn, role, text, tokenizer, with_labels=False)
    t = t.select(conv, turn, F.col("n").cast("long").alias("n"), is_human(F.col(role)).cast("long").alias("_human"))
    t = range_cumsum(t, "_human", [turn], by=[conv], out="pair").withColumn("pair", F.greatest("pair", F.lit(1)))
    large = t.groupBy(conv, "pair").agg(F.sum("n").alias("_pair_n")).where(F.col("_pair_n") > max_tokens)
    alone = t.join(large, [conv, "pair"], "left").withColumn("_alone", F.when(F.col("_pair_n").isNotNull(), F.col(turn)))
    units = alone.groupBy(conv, "pair", "_alone").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("turns"), F.min(turn).alias("_at"))
    return range_cumsum(units.drop("pair", "_alone"), {"end": F.col("n"), "unit": F.lit(1).cast("long")}, ["_at"], by=[conv], total_out="total").drop("_at")


def greedy_cuts(units: DataFrame, conv: str, max_tokens: int) -> DataFrame:
    """``conv, unit`` of the units that open a segment, if every segment takes
    units as long as it has at most ``max_tokens`` (one unit at least).

    Each unit points to the first one that no longer fits behind it (a rank of
    unit ends among the points where a segment opened there is full).  From the
    first unit, pointers of 1, 2, 4, ... steps mark all units that are reached; so
    a conversation of any length is spread over tasks and is done in a
    logarithmic number of rounds, each a written table."""
    last = F.floor(F.col("end") - F.col("n") + max_tokens)
    ends = units.select(conv, F.col("end").alias("at"), F.lit(0).alias("asks"), "unit", "total", F.lit(1).cast("long").alias("one"))
    full = units.select(conv, last.alias("at"), F.lit(1).alias("asks"), "unit", "total", F.lit(0).cast("long").alias("one"))
    ranked = range_cumsum(ends.unionByName(full), "one", ["at", "asks", "unit"], by=[conv], out="fit").where("asks = 1")
    onward = F.greatest(F.col("fit"), F.col("unit")) + 1
    steps = written(ranked.where(F.col("at") < F.col("total")).select(conv, "unit", onward.alias("to")), "unit-steps")
    marks = reached = units.where("unit = 1").select(conv, "unit")
    while True:
        reached = written(marks.join(steps, [conv, "unit"]).select(conv, F.col("to").alias("unit")), "unit-marks")
        if reached.isEmpty():
            return marks
        marks = marks.unionByName(reached)
        on = steps.select(conv, F.col("unit").alias("to"), F.col("to").alias("far"))
        steps = written(steps.join(on, [conv, "to"]).select(conv, "unit", F.col("far").alias("to")), "unit-steps")


def split_long_conversations(turns: DataFrame, conv: str, turn: str, role: str, text: str, max_tokens: int,
                             tokenizer: Tokenizer = ws_token_ids) -> DataFrame:
    """Cut conversations greedily into segments of at most ``max_tokens``:
    ``conv, segment`` (from 0), ``n_turns, n_tokens``.  No segment is larger unless
    it is one turn that is; a pair that fits is never cut (``conversation_units``)."""
    units = written(conversation_units(turns, conv, turn, role, text, max_tokens, tokenizer), "units")
    whole = units.where(F.col("total") <= max_tokens).withColumn("segment", F.lit(0).cast("long"))
    long = units.where(F.col("total") > max_tokens)
    cuts = greedy_cuts(long, conv, max_tokens).withColumn("_opens", F.lit(1).cast("long"))
    opened = long.join(cuts, [conv, "unit"], "left").withColumn("_opens", F.coalesce("_opens", F.lit(0).cast("long")))
    cut = range_cumsum(opened, "_opens", ["unit"], by=[conv], out="_segment", bounds="ordinal").withColumn("segment", F.col("_segment") - 1)
    columns = [conv, "segment", "turns", "n"]
    return whole.select(*columns).unionByName(cut.select(*columns)).groupBy(conv, "segment").agg(
        F.sum("turns").alias("n_turns"), F.sum("n").alias("n_tokens"))


def pad_batches(samples: DataFrame, key: str, batch: int = 8, multiple: int = 8) -> DataFrame:
    """Batches of ``batch`` samples in key order, each padded on the right to the
    batch's longest sample rounded up to ``multiple`` (ids with the pad id, mask
    with 0, labels with -100): one rank, one window over a batch."""
    t = global_rank(samples, [key], out="_rank").withColumn("batch_no", F.floor((F.col("_rank") - 1) / batch).cast("long"))
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_no"))
    t = t.withColumn("padded_len", (F.ceil(longest / multiple) * multiple).cast("long")).drop("_rank")
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), (F.col("padded_len") - F.size(c)).cast("int")))
    return t.withColumns({"input_ids": fill("input_ids", PAD_ID), "attention_mask": fill("attention_mask", 0), "labels": fill("labels", IGNORE_INDEX)})
