"""Instruction-tuning data path on ``conversations`` (role ``user`` = human;
``assistant`` and ``system`` = other), ``documents`` (instruction rows and
packing streams), ``benchmark`` (exam items) and ``embeddings`` (stored
probabilities).

Token ids follow from md5, so the oracles recompute every id, label and mask;
arrays are compared by the md5 of their joined text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators import packing_udtf as tf
from ..operators import prompts as pr
from ..operators import sft
from ..specs import HUMAN_TURN, HUMAN_TURN_COMPACT, IGNORE_INDEX
from .registry import T, q, query, sql_digest, sql_strip, sql_token_ids, sql_ws_count

HUMAN_SQL = "lower(role) IN ('human', 'user')"
SFT_MAX = 256
REPAIR_MAX = 24


def turns(spark, sf):
    return T(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def _count_if(arr, pred):
    return F.size(F.filter(arr, pred)).cast("long")


def digest(c):
    """md5 of an array's joined values."""
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))


def _ids_sql(around) -> str:
    """Ids of a rendered turn, EOS after a non-human one."""
    human = sql_token_ids(f"{q(around[0])} || text || {q(around[1])}")
    return f"CASE WHEN {HUMAN_SQL} THEN {human} ELSE list_append({sql_token_ids('text')}, {sft.EOS_ID}) END"


def _trunc_sql(max_len: int) -> str:
    return (f"WITH t AS (SELECT conv_id, turn, {HUMAN_SQL} AS hum, {_ids_sql(HUMAN_TURN)} AS ids FROM conversations), "
            f"l AS (SELECT *, CASE WHEN hum THEN list_transform(ids, lambda x: {IGNORE_INDEX}) ELSE ids END AS labels FROM t), "
            f"a AS (SELECT conv_id, list_slice(flatten(list(ids ORDER BY turn)), 1, {max_len}) AS ids, "
            f"list_slice(flatten(list(labels ORDER BY turn)), 1, {max_len}) AS labels FROM l GROUP BY conv_id), "
            f"g AS (SELECT conv_id, ids, labels, CAST(len(ids) AS BIGINT) AS n_input, CAST(len(list_filter(labels, lambda x: x = {IGNORE_INDEX})) AS BIGINT) AS n_masked, "
            f"CAST(len(list_filter(labels, lambda x: x <> {IGNORE_INDEX})) AS BIGINT) AS n_kept FROM a) ")


def samples(spark, sf, max_len):
    return sft.token_samples(turns(spark, sf), "conv_id", "turn", "role", "text", max_len)


@query("conversation_assemble",
       "SELECT conv_id, count(*) AS n_turns, string_agg(CASE WHEN lower(role) = 'user' THEN 'human' ELSE lower(role) END, ',' ORDER BY turn) AS roles, "
       "md5(string_agg(text, chr(30) ORDER BY turn)) AS texts_md5 FROM conversations GROUP BY conv_id")
def conversation_assemble(spark, sf):
    c = sft.assemble_conversations(turns(spark, sf), "conv_id", "turn", "role", "text")
    return c.select(
        "conv_id", F.size("conversations").cast("long").alias("n_turns"),
        F.array_join(F.transform("conversations", lambda x: x["from"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform("conversations", lambda x: x["value"]), "\x1e")).alias("texts_md5"))


@query("conversation_convert",
       "SELECT coalesce(CASE WHEN doc_id % 3 = 0 THEN 'doc-' || CAST(doc_id AS VARCHAR) END, "
       "'documents-' || CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR)) AS id, "
       "'Summarize the following ' || lang || ' text from ' || source || ': ' || text AS human_value, "
       "split_part(text, chr(10), 1) AS assistant_value FROM documents")
def conversation_convert(spark, sf):
    d = T(spark, sf, "documents")
    inst = d.select(
        "doc_id",
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("id"),
        F.concat(F.lit("Summarize the following "), F.col("lang"), F.lit(" text from "), F.col("source"), F.lit(": ")).alias("instruction"),
        F.col("text").alias("input"),
        F.substring_index("text", "\n", 1).alias("output"))
    conv = sft.convert_instructions(inst, ["doc_id"], "documents")
    return conv.select("id", F.col("conversations")[0]["value"].alias("human_value"),
                       F.col("conversations")[1]["value"].alias("assistant_value"))


@query("sft_render",
       f"SELECT conv_id, turn, CASE WHEN {HUMAN_SQL} THEN {q('Human: ' + chr(10))} || text || {q(chr(10) + chr(10) + 'Assistant: ' + chr(10))} "
       "ELSE text END AS rendered FROM conversations")
def sft_render(spark, sf):
    t = turns(spark, sf)
    return t.select("conv_id", "turn", sft.render_turn(F.col("role"), F.col("text")).alias("rendered"))


_COUNTS = "conv_id, n_input, n_masked, n_kept"


@query("sft_mask_labels", _trunc_sql(SFT_MAX) + f"SELECT {_COUNTS}, {sql_digest('ids')} AS ids_md5, {sql_digest('labels')} AS labels_md5 FROM g")
def sft_mask_labels(spark, sf):
    s = samples(spark, sf, SFT_MAX)
    return s.select("conv_id", F.size("input_ids").cast("long").alias("n_input"),
                    _count_if("labels", lambda x: x == IGNORE_INDEX).alias("n_masked"),
                    _count_if("labels", lambda x: x != IGNORE_INDEX).alias("n_kept"), digest("input_ids").alias("ids_md5"), digest("labels").alias("labels_md5"))


_REPAIRED = ("CASE WHEN n_kept = 0 THEN list_concat(list_slice(labels, 1, 18), list_concat(list_slice(ids, 19, 24), list_slice(labels, 25, n_input))) ELSE labels END")


@query("sft_repair_masked", _trunc_sql(REPAIR_MAX) + f"SELECT conv_id, CAST(n_kept = 0 AS INTEGER) AS repaired, {sql_digest(_REPAIRED)} AS labels_md5 FROM g")
def sft_repair_masked(spark, sf):
    s = samples(spark, sf, REPAIR_MAX)
    all_masked = F.forall("labels", lambda x: x == IGNORE_INDEX)
    fixed = sft.repair_masked(F.col("input_ids"), F.col("labels"))
    return s.select("conv_id", all_masked.cast("int").alias("repaired"), digest(fixed).alias("labels_md5"))


@query("sft_drop_all_masked", _trunc_sql(REPAIR_MAX - 1) + f"SELECT conv_id, {sql_digest('ids')} AS ids_md5, {sql_digest('labels')} AS labels_md5 FROM g WHERE n_kept > 0")
def sft_drop_all_masked(spark, sf):
    s = samples(spark, sf, REPAIR_MAX - 1)
    return s.where(sft.has_label(F.col("labels"))).select("conv_id", digest("input_ids").alias("ids_md5"), digest("labels").alias("labels_md5"))


@query("sft_drop_count",  # how many samples the drop takes, and of how many
       _trunc_sql(REPAIR_MAX - 1) + "SELECT count(*) AS n_in, count(*) FILTER (WHERE n_kept = 0) AS n_dropped FROM g")
def sft_drop_count(spark, sf):
    kept = sft.has_label(F.col("labels"))
    return samples(spark, sf, REPAIR_MAX - 1).agg(*[c.alias(n) for n, c in ck.dropping(kept).numbers.items()])


def _padded_sql(side: str, label_pad: int, to: str = str(SFT_MAX)) -> str:
    def both(a, value):
        fill = f"list_transform(range(greatest({to} - n_input, 0)), lambda x: {value})"
        return sql_digest(f"list_concat({fill}, {a})" if side == "left" else f"list_concat({a}, {fill})")
    mask = "list_transform(ids, lambda x: 1)"
    return f"{both('ids', sft.PAD_ID)} AS ids_md5, {both(mask, 0)} AS mask_md5, {both('labels', label_pad)} AS labels_md5"


def _padded(s):
    return s.select("conv_id", digest("input_ids").alias("ids_md5"), digest("attention_mask").alias("mask_md5"), digest("labels").alias("labels_md5"))


@query("pad_fixed_left", _trunc_sql(SFT_MAX) + f"SELECT conv_id, {_padded_sql('left', sft.PAD_ID)} FROM g")
def pad_fixed_left(spark, sf):
    return _padded(sft.pad_sample(samples(spark, sf, SFT_MAX), SFT_MAX, "left", label_pad=sft.PAD_ID))


@query("pad_fixed_right", _trunc_sql(SFT_MAX) + f"SELECT conv_id, {_padded_sql('right', IGNORE_INDEX)} FROM g")
def pad_fixed_right(spark, sf):
    return _padded(sft.pad_sample(samples(spark, sf, SFT_MAX), SFT_MAX, "right", label_pad=IGNORE_INDEX))


_CTX_SQL = ("WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), "
            f"t AS (SELECT c.conv_id, turn, {_ids_sql(HUMAN_TURN_COMPACT)} AS ids, {HUMAN_SQL} OR contains(text, 'Human') AS named "
            "FROM conversations c JOIN m ON c.conv_id = m.conv_id WHERE turn < last), "
            "g AS (SELECT conv_id, list_slice(flatten(list(ids ORDER BY turn)), 1, 2048) AS ids FROM t GROUP BY conv_id HAVING bool_or(named)) ")


@query("infer_context", _CTX_SQL + f"SELECT conv_id, CAST(len(ids) AS INTEGER) AS n_context, {sql_digest('ids')} AS ids_md5 FROM g")
def infer_context(spark, sf):
    c = sft.inference_context(turns(spark, sf), "conv_id", "turn", "role", "text", 2048)
    return c.select("conv_id", F.size("input_ids").alias("n_context"), digest("input_ids").alias("ids_md5"))


@query("filter_has_human", _CTX_SQL + "SELECT conv_id FROM g")
def filter_has_human(spark, sf):
    return sft.inference_context(turns(spark, sf), "conv_id", "turn", "role", "text", 2048).select("conv_id")


@query("split_long_conversation",  # greedy, one segment after the other
       f"WITH RECURSIVE t AS (SELECT conv_id, turn, greatest(sum(CAST({HUMAN_SQL} AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn), 1) AS pair, {sql_ws_count('text')} + CASE WHEN {HUMAN_SQL} THEN 2 ELSE 1 END AS n FROM conversations), "
       f"p AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY conv_id, pair) > {SFT_MAX} THEN turn END AS alone FROM t), "
       "v AS (SELECT conv_id, min(turn) AS opens, sum(n) AS n, count(*) AS turns FROM p GROUP BY conv_id, pair, alone), "
       "u AS (SELECT conv_id, n, turns, row_number() OVER w AS unit, sum(n) OVER w AS stop FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY opens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
       f"j AS (SELECT conv_id, unit, (SELECT min(b.unit) FROM u b WHERE b.conv_id = a.conv_id AND b.unit > a.unit AND b.stop > a.stop - a.n + {SFT_MAX}) AS onward FROM u a), "
       "c(conv_id, segment, unit) AS (SELECT conv_id, 0, unit FROM u WHERE unit = 1 UNION ALL SELECT c.conv_id, segment + 1, onward FROM c JOIN j ON c.conv_id = j.conv_id AND c.unit = j.unit WHERE onward IS NOT NULL), "
       "d AS (SELECT conv_id, segment, unit, coalesce(lead(unit) OVER (PARTITION BY conv_id ORDER BY segment), 9223372036854775807) AS until FROM c) "
       "SELECT d.conv_id, CAST(segment AS BIGINT) AS segment, CAST(sum(turns) AS BIGINT) AS n_turns, CAST(sum(n) AS BIGINT) AS n_tokens "
       "FROM d JOIN u ON u.conv_id = d.conv_id AND u.unit >= d.unit AND u.unit < d.until GROUP BY d.conv_id, segment")
def split_long_conversation(spark, sf):
    return sft.split_long_conversations(turns(spark, sf), "conv_id", "turn", "role", "text", SFT_MAX)


@query("batch_pad",
       _trunc_sql(SFT_MAX) + ", b AS (SELECT *, CAST((row_number() OVER (ORDER BY conv_id) - 1) // 8 AS BIGINT) AS batch_no FROM g), "
       "p AS (SELECT *, CAST(ceil(max(n_input) OVER (PARTITION BY batch_no) / 8.0) * 8 AS BIGINT) AS padded_len FROM b) "
       f"SELECT conv_id, batch_no, padded_len, {_padded_sql('right', IGNORE_INDEX, 'padded_len')} FROM p")
def batch_pad(spark, sf):
    p = sft.pad_batches(samples(spark, sf, SFT_MAX), "conv_id")
    return p.select("conv_id", "batch_no", "padded_len", digest("input_ids").alias("ids_md5"), digest("attention_mask").alias("mask_md5"), digest("labels").alias("labels_md5"))


EXAM_TYPE = "single choice"
# quotes and backslashes, which JSON must escape, behind every other question
SQL_ITEMS = "(SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'He said \"no\" \\ ' || text ELSE text END AS text FROM benchmark)"


def items(spark, sf):
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('He said "no" \\ '), F.col("text"))).otherwise(F.col("text"))
    return T(spark, sf, "benchmark").select("item_id", text.alias("text"))


@query("plain_eval_prompt", f"SELECT item_id, {sql_strip('text')} || chr(10) || 'A. yes' || chr(10) || 'B. no' AS prompt FROM {SQL_ITEMS}")
def plain_eval_prompt(spark, sf):
    return items(spark, sf).select("item_id", pr.plain_eval_prompt(F.col("text"), F.array(F.lit("A. yes"), F.lit("B. no"))).alias("prompt"))



@query("exam_prompt_json",
       f"SELECT item_id, {q('Human: ' + chr(10) + '回答下面的' + EXAM_TYPE + '题，用json返回答案，包括原因和答案，如{\"reason\":..., \"answer\":...}' + chr(10))} "
       f"|| text || {q(chr(10) + '选项：A. yes B. no' + chr(10) + chr(10) + 'Assistant: ' + chr(10))} AS human_prompt, "
       "'{\"reason\": ' || to_json(split_part(text, '.', 1))::VARCHAR || ', \"answer\": ' || to_json(CASE WHEN item_id % 2 = 0 THEN 'A' ELSE 'B' END)::VARCHAR || '}' AS answer_json "
       f"FROM {SQL_ITEMS}")
def exam_prompt_json(spark, sf):
    b = items(spark, sf)
    cands = F.array(F.lit("A. yes"), F.lit("B. no"))
    answer = F.when(F.pmod("item_id", F.lit(2)) == 0, F.lit("A")).otherwise(F.lit("B"))
    return b.select("item_id", pr.exam_prompt(F.lit(EXAM_TYPE), F.col("text"), cands).alias("human_prompt"),
                    pr.json_answer(F.substring_index("text", ".", 1), answer).alias("answer_json"))


PACK_BLOCK = 128
SHORT_BLOCK = 16384


def _pack_sql(block: int, eos: bool, keep_short: bool) -> str:
    ids = f"list_append({sql_token_ids('text')}, {sft.EOS_ID})" if eos else sql_token_ids("text")
    limit = f"CASE WHEN total < {block} AND total > 0 THEN 1 ELSE total // {block} END" if keep_short else f"total // {block}"
    return (f"WITH d AS (SELECT source, doc_id, {ids} AS ids FROM documents), "
            "o AS (SELECT source, doc_id, len(ids) AS len, CAST(coalesce(sum(len(ids)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st, "
            "CAST(sum(len(ids)) OVER (PARTITION BY source) AS BIGINT) AS total FROM d), "
            f"x AS (SELECT source, doc_id, total, UNNEST(range(st // {block}, (st + len - 1) // {block} + 1)) AS block_no FROM o WHERE len > 0), "
            f"b AS (SELECT source, block_no, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM x WHERE block_no < {limit} GROUP BY source, block_no), "
            "s AS (SELECT source, flatten(list(ids ORDER BY doc_id)) AS ids FROM d GROUP BY source), "
            f"y AS (SELECT b.*, list_slice(ids, block_no * {block} + 1, block_no * {block} + {block}) AS piece FROM b JOIN s USING (source)) "
            f"SELECT source, CAST(block_no AS BIGINT) AS block_no, CAST(len(piece) AS INTEGER) AS n_tokens, {sql_digest('piece')} AS ids_md5, first_doc, last_doc FROM y")


@query("pack_blocks", _pack_sql(PACK_BLOCK, True, False))
def pack_blocks(spark, sf):
    b = sft.pack_blocks(T(spark, sf, "documents"), "source", "doc_id", "text", PACK_BLOCK, eos=True)
    return b.select("source", "block_no", F.size("input_ids").alias("n_tokens"), digest("input_ids").alias("ids_md5"), "first_doc", "last_doc")


@query("pack_blocks_keep_short", _pack_sql(SHORT_BLOCK, False, True))
def pack_blocks_keep_short(spark, sf):
    b = sft.pack_blocks(T(spark, sf, "documents"), "source", "doc_id", "text", SHORT_BLOCK, eos=False, keep_short=True)
    return b.select("source", "block_no", F.size("input_ids").alias("n_tokens"), digest("input_ids").alias("ids_md5"), "first_doc", "last_doc")


_PREF_SQL = ("WITH a AS (SELECT conv_id, min(turn) AS first, arg_min(text, turn) AS chosen, arg_max(text, turn) AS rejected FROM conversations "
             "WHERE lower(role) = 'assistant' GROUP BY conv_id HAVING count(*) >= 2), "
             "l AS (SELECT c.conv_id, string_agg(text, chr(10) ORDER BY turn) AS prompt FROM conversations c JOIN a USING (conv_id) WHERE turn < first GROUP BY c.conv_id), "
             "p AS (SELECT a.*, coalesce(l.prompt, '') AS prompt FROM a LEFT JOIN l USING (conv_id)) ")


@query("pairwise_stack",
       _PREF_SQL + "SELECT conv_id, 'chosen' AS kind, chosen AS response FROM p UNION ALL SELECT conv_id, 'rejected', rejected FROM p")
def pairwise_stack(spark, sf):
    p = sft.preference_rows(turns(spark, sf), "conv_id", "turn", "role", "text")
    return sft.stack_pairs(p, "conv_id")


@query("pairwise_prompt_response",
       _PREF_SQL + "SELECT conv_id, prompt || chosen AS chosen_sample, prompt || rejected AS rejected_sample FROM p")
def pairwise_prompt_response(spark, sf):
    p = sft.preference_rows(turns(spark, sf), "conv_id", "turn", "role", "text")
    return sft.phase_projection(p, "conv_id", 2)


@query("pairwise_phase_sft", _PREF_SQL + "SELECT conv_id, prompt || chosen AS sample FROM p")
def pairwise_phase_sft(spark, sf):
    return sft.phase_projection(sft.preference_rows(turns(spark, sf), "conv_id", "turn", "role", "text"), "conv_id", 1)


@query("pairwise_phase_prompt", _PREF_SQL + "SELECT conv_id, prompt FROM p")
def pairwise_phase_prompt(spark, sf):
    return sft.phase_projection(sft.preference_rows(turns(spark, sf), "conv_id", "turn", "role", "text"), "conv_id", 3)


@query("token_prob_align",
       "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CASE WHEN i = 1 THEN 0.0 ELSE CAST(embedding[i - 1] AS DOUBLE) END, 6) AS prob "
       "FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def token_prob_align(spark, sf):
    a = sft.align_token_probs(T(spark, sf, "embeddings"), "vec_id", "embedding")
    return a.select("vec_id", "pos", F.round("prob", 6).alias("prob"))


BATCH_BLOCK = 512


@query("pack_batches",  # each batch of documents packed by itself, through the table function
       f"WITH d AS (SELECT doc_id // 100 AS batch, flatten(list(list_append({sql_token_ids('text')}, {sft.EOS_ID}) ORDER BY doc_id)) AS ids FROM documents GROUP BY ALL), "
       f"x AS (SELECT batch, ids, unnest(range(0, CASE WHEN len(ids) < {BATCH_BLOCK} THEN 1 ELSE len(ids) // {BATCH_BLOCK} END)) AS block_no FROM d WHERE len(ids) > 0), "
       f"y AS (SELECT batch, block_no, list_slice(ids, block_no * {BATCH_BLOCK} + 1, block_no * {BATCH_BLOCK} + {BATCH_BLOCK}) AS piece FROM x) "
       f"SELECT batch, block_no, CAST(len(piece) AS INTEGER) AS n_tokens, {sql_digest('piece')} AS ids_md5 FROM y")
def pack_batches(spark, sf):
    ids = F.concat(sft.ws_token_ids(F.col("text")), F.array(F.lit(sft.EOS_ID)))
    rows = T(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("batch"), "doc_id", ids.alias("input_ids"))
    packed = tf.pack_batches(rows, "batch", "doc_id", BATCH_BLOCK)
    return packed.select("batch", "block_no", F.size("input_ids").alias("n_tokens"), digest("input_ids").alias("ids_md5"))
