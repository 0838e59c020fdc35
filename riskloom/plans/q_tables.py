"""Scans, labels, code books, encoders and prompt rendering on driver tables.

Mappings: ``orders.o_orderstatus`` is the label (F = good), priorities are the
coded feature, ``customer ⋈ nation`` / ``part`` / ``lineitem`` are the
profiles rendered into prompts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import py_float_str
from ..operators import dispatch as dp
from ..operators import encoder as en
from ..operators import features as ft
from ..operators import prompts as pr
from ..sources.readers import project_reorder
from ..specs import ARTEFACTS, ARTEFACTS_LOWER, CHAT_PREFIX, CHAT_SUFFIX, INCOMPLETE, NORMAL_SUFFIX, NOTE_PREFIX, TEXT_MARKER, FieldSpec, PromptSpec, RenderSpec
from ..specs import SYSTEM_ANALYSIS
from .registry import T, q, query, sql_strip

# Fixed values for the driver-table mappings (our own wording).
PRIORITY_BOOK = {
    "1-URGENT": "urgent",
    "2-HIGH": "high priority",
    "3-MEDIUM": "medium priority",
    "4-NOT SPECIFIED": "unspecified priority",
    "5-LOW": "low priority",
}
SEGMENT_GROUP = {"AUTOMOBILE": 1, "MACHINERY": 1, "BUILDING": 0, "FURNITURE": 0, "HOUSEHOLD": 0}
MODEL_CONFIG = [("llama2-chat", "chat_query", 16), ("qwen", "normal_query", 8), ("distill", "normal_query", 32)]
CUSTOMER_PROMPT = PromptSpec(
    instruction=(
        "Assess the credit risk of a customer with the following account profile. "
        "Respond with only either 'good' or 'bad'."
    ),
    choices=("good", "bad"),
    task="customer credit risk",
    debias_prompt="Ensure that the assessment is free from any bias related to the nation or the market segment.",
    counter_factual_prompt="Your assessment must stay the same even if the nation or the market segment change.",
    example1=("The customer has a negative account balance and a small market segment.", "bad"),
    example2=("The customer has a large positive account balance.", "good"),
)
AUXILIARY = "Consider the account balance first."
SECOND_QUERY = "Please answer again with exactly one word."

CUSTOMER_FIELDS = (
    FieldSpec("c_name", "Customer name", "str"),
    FieldSpec("n_name", "Nation", "str"),
    FieldSpec("c_acctbal", "Account balance", "float"),
    FieldSpec("c_mktsegment", "Market segment", "str"),
)


def customers(spark, sf):
    return T(spark, sf, "customer").join(T(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def customer_text():
    return pr.render_fields(CUSTOMER_FIELDS, RenderSpec())


SQL_CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey"
SQL_CUSTOMER_TEXT = (
    "'The state of Customer name is ' || c_name || '. The state of Nation is ' || n_name || "
    "'. The state of Account balance is ' || CAST(c_acctbal AS VARCHAR) || "
    "'. The state of Market segment is ' || c_mktsegment || '. '"
)


def customer_prompts(spark, sf, debias=True, counter=True):
    df = customers(spark, sf)
    return pr.prompt_columns(df, customer_text(), CUSTOMER_PROMPT, debias, counter)


def sql_body(debias=True, counter=True):
    b = f"{q(CUSTOMER_PROMPT.instruction + TEXT_MARKER + chr(39))} || {SQL_CUSTOMER_TEXT} || ''''"
    if debias:
        b += f" || {q(NOTE_PREFIX + CUSTOMER_PROMPT.debias_prompt)}"
    if counter:
        b += f" || {q(NOTE_PREFIX + CUSTOMER_PROMPT.counter_factual_prompt)}"
    return b


SQL_NORMAL = f"({sql_body()} || {q(NORMAL_SUFFIX)})"
SQL_CHAT = f"({q(CHAT_PREFIX)} || {sql_body()} || {q(CHAT_SUFFIX)})"
SQL_STRICT_TAIL = q(" FINAL ANSWER MUST BE EXACTLY ONE WORD FROM 'good' OR 'bad':")


# ---------------------------------------------------------------- scans/labels
@query("scan_project_reorder",
       "SELECT o_orderpriority, o_totalprice, o_orderstatus, o_orderkey FROM orders")
def scan_project_reorder(spark, sf):
    return project_reorder(T(spark, sf, "orders"), ["o_orderpriority", "o_totalprice", "o_orderstatus", "o_orderkey", "o_custkey"],
                           drop=["o_custkey"])


@query("filter_label_classes",
       "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def filter_label_classes(spark, sf):
    return ft.filter_label_classes(T(spark, sf, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query("distinct_labels", "SELECT DISTINCT o_orderstatus AS label FROM orders")
def distinct_labels(spark, sf):
    return T(spark, sf, "orders").select(F.col("o_orderstatus").alias("label")).distinct()


@query("class_balance", "SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY o_orderstatus")
def class_balance(spark, sf):
    return T(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("label_answer_gold",
       "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'good' ELSE 'bad' END AS answer, "
       "CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS INTEGER) AS gold FROM orders")
def label_answer_gold(spark, sf):
    answer, _, gold = ft.answer_gold("o_orderstatus", ["F"], ("good", "bad"))
    return T(spark, sf, "orders").select("o_orderkey", answer.alias("answer"), gold.alias("gold"))


# ---------------------------------------------------------------- code books
_BOOK_VALUES = ", ".join(f"({q(k)}, {q(v)})" for k, v in PRIORITY_BOOK.items())


@query("codebook_decode",
       f"SELECT o_orderkey, b.phrase AS priority_text FROM orders JOIN (VALUES {_BOOK_VALUES}) b(code, phrase) "
       "ON o_orderpriority = b.code")
def codebook_decode(spark, sf):
    o = T(spark, sf, "orders")
    return ft.codebook_decode(o, {"o_orderpriority": PRIORITY_BOOK}).select(
        "o_orderkey", F.col("o_orderpriority_text").alias("priority_text"))


_GROUP_VALUES = ", ".join(f"({q(k)}, {v})" for k, v in SEGMENT_GROUP.items())


@query("recode_binary_group",
       f"SELECT c_custkey, c_mktsegment, CAST(g.grp AS INTEGER) AS grp FROM customer LEFT JOIN (VALUES {_GROUP_VALUES}) g(seg, grp) "
       "ON c_mktsegment = g.seg")
def recode_binary_group(spark, sf):
    c = T(spark, sf, "customer")
    return c.select("c_custkey", "c_mktsegment", ft.recode("c_mktsegment", SEGMENT_GROUP).cast("int").alias("grp"))


@query("label_encode",
       "SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer")
def label_encode(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return ft.label_encode(c, "c_mktsegment", "code").select("c_custkey", "c_mktsegment", "code")


@query("label_encode_columns",  # fitted on one part of the rows, applied to all: values that it lacks get -1
       "WITH f AS (SELECT * FROM customer WHERE c_nationkey < 20), "
       "m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM f)), "
       "n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS v FROM f)) "
       "SELECT c_custkey, coalesce(m.code, -1) AS c_mktsegment_code, coalesce(n.code, -1) AS c_nationkey_code "
       "FROM customer LEFT JOIN m ON c_mktsegment = m.v LEFT JOIN n ON CAST(c_nationkey AS VARCHAR) = n.v")
def label_encode_columns(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    names = ["c_mktsegment", "c_nationkey"]
    codes = en.fit(c.where("c_nationkey < 20"), names)
    return en.encode(c, codes, names).select("c_custkey", "c_mktsegment_code", "c_nationkey_code")


@query("label_encode_files",  # every file has its own codes
       "WITH d AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, o_custkey % 3 AS file FROM orders WHERE o_custkey % 3 <> 1 OR o_orderstatus <> 'P'), "
       "x AS (SELECT o_orderkey, dense_rank() OVER (PARTITION BY file ORDER BY p) - 1 AS p_code, dense_rank() OVER (PARTITION BY file ORDER BY s) - 1 AS s_code FROM d) SELECT * FROM x")
def label_encode_files(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), (F.col("o_custkey") % 3).alias("file"))
    o = o.where("file <> 1 or s <> 'P'")
    return en.encode(o, en.fit(o, ["p", "s"], "file"), ["p", "s"], file="file").select("o_orderkey", "p_code", "s_code")


@query("binarize_threshold",
       "SELECT p_partkey, p_size, CAST(CASE WHEN p_size <= 25 THEN 0 WHEN p_size > 25 THEN 1 END AS INTEGER) AS size_bin FROM part")
def binarize_threshold(spark, sf):
    return T(spark, sf, "part").select("p_partkey", "p_size", ft.binarize_threshold("p_size", 25).alias("size_bin"))


_CFG_VALUES = ", ".join(f"({q(m)}, {q(k)}, {n})" for m, k, n in MODEL_CONFIG)


@query("config_lookup",
       f"SELECT c_custkey, cfg.model_name, cfg.query_key, CAST(cfg.max_new_tokens AS INTEGER) AS max_new_tokens, "
       f"CAST(length(CASE WHEN cfg.query_key = 'chat_query' THEN {SQL_CHAT} ELSE {SQL_NORMAL} END) AS INTEGER) AS prompt_len "
       f"FROM {SQL_CUSTOMERS} JOIN (VALUES {_CFG_VALUES}) cfg(model_name, query_key, max_new_tokens) "
       f"ON cfg.model_name = CASE c_custkey % 3 WHEN 0 THEN 'llama2-chat' WHEN 1 THEN 'qwen' ELSE 'distill' END")
def config_lookup(spark, sf):
    p = customer_prompts(spark, sf)
    names = F.array(*[F.lit(m) for m, _, _ in MODEL_CONFIG])
    p = p.withColumn("model_name", F.element_at(names, (F.pmod(F.col("c_custkey"), F.lit(3)) + 1).cast("int")))
    cfg = spark.createDataFrame(MODEL_CONFIG, "model_name string, query_key string, max_new_tokens int")
    # the config table is a fixed handful of rows: broadcast is size-bounded
    j = p.join(F.broadcast(cfg), "model_name", "left")
    qk = F.when(F.col("query_key").isNull(), F.raise_error(F.concat(F.lit("unknown model: "), F.col("model_name")))) \
        .otherwise(F.col("query_key"))
    prompt = F.when(qk == "chat_query", F.col("chat_query")).otherwise(F.col("normal_query"))
    return j.select("c_custkey", "model_name", qk.alias("query_key"), "max_new_tokens", F.length(prompt).alias("prompt_len"))


@query("impute_clip",
       "WITH c AS (SELECT event_id, CASE WHEN value > 300 THEN 300.0 ELSE value END AS capped FROM events), "
       "m AS (SELECT trunc(avg(capped)) AS mean_int FROM c) "
       "SELECT event_id, CASE WHEN capped < 1 THEN m.mean_int ELSE capped END AS value_clean FROM c, m")
def impute_clip(spark, sf):
    return ft.impute_clip(T(spark, sf, "events"), "value", 300, 1, "value_clean").select("event_id", "value_clean")


@query("impute_mode_mean",  # every seventh value and every fifth type is missing
       "WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events), "
       "m AS (SELECT avg(value) AS mv FROM e), "
       "md AS (SELECT event_type AS mt FROM e WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) "
       "SELECT event_id, round(coalesce(value, m.mv), 6) AS value_imp, coalesce(event_type, md.mt) AS event_type_imp FROM e, m, md")
def impute_mode_mean(spark, sf):
    e = T(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
                                      F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))
    return ft.impute_mode_mean(e, ["value"], ["event_type"]).select("event_id", F.round("value_imp", 6).alias("value_imp"), "event_type_imp")


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return T(spark, sf, "events").select("event_id", F.from_json("props", "k LONG")["k"].alias("k"))


# ---------------------------------------------------------------- rendering
@query("prompt_sentences", f"SELECT c_custkey, {SQL_CUSTOMER_TEXT} AS text FROM {SQL_CUSTOMERS}")
def prompt_sentences(spark, sf):
    return customers(spark, sf).select("c_custkey", customer_text().alias("text"))


PART_PCT = (FieldSpec("p_name", "Part name"), FieldSpec("p_size", "Size", "int", suffix="%"),
            FieldSpec("p_retailprice", "Retail price", "float"))


@query("prompt_sentences_pct",
       "SELECT p_partkey, 'The part has attributes as follows: The state of Part name is ' || p_name || "
       "'. The state of Size is ' || CAST(p_size AS VARCHAR) || '%. The state of Retail price is ' || "
       "CAST(p_retailprice AS VARCHAR) || '.' AS text FROM part")
def prompt_sentences_pct(spark, sf):
    spec = RenderSpec(prefix="The part has attributes as follows: ", sep=". ", end=".")
    return T(spark, sf, "part").select("p_partkey", pr.render_fields(PART_PCT, spec).alias("text"))


@query("prompt_header_named",
       "SELECT p_partkey, 'The part has attributes: p_name: ' || p_name || ', p_brand: ' || p_brand || ', p_type: ' || p_type "
       "|| ', p_size: ' || CAST(p_size AS VARCHAR) || ', p_retailprice: ' || CAST(p_retailprice AS VARCHAR) || '.' AS text FROM part")
def prompt_header_named(spark, sf):
    p = T(spark, sf, "part")
    fields = pr.header_fields(p, exclude=["p_partkey"])
    spec = RenderSpec(template="{name}: {value}", sep=", ", end=".", prefix="The part has attributes: ")
    return p.select("p_partkey", pr.render_fields(fields, spec).alias("text"))


# products and halves have more decimals than are printed, so the text is rounded
LINE_VALUES = {"l_quantity": "l_quantity / 8", "net": "l_extendedprice * (1 - l_discount)", "taxed": "l_extendedprice * l_discount * l_tax", "l_tax": "l_tax"}
LINE_FIELDS = (("l_quantity", "Quantity"), ("net", "Net price"), ("taxed", "Taxed discount"), ("l_tax", "Tax"))


def _line_values(spark, sf):
    return T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).cast("double").alias(c) for c, e in LINE_VALUES.items()])


_LINES = "(SELECT l_orderkey, l_linenumber, " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in LINE_VALUES.items()) + " FROM lineitem)"


def _line_sql(fmt):
    parts = " || ', ' || ".join(f"'{d}: ' || {fmt(c)}" for c, d in LINE_FIELDS)
    return f"'The line has attributes: ' || {parts} || '.'"


@query("prompt_fixed_precision",
       f"SELECT l_orderkey, l_linenumber, {_line_sql(lambda c: f'printf(' + chr(39) + '%.3f' + chr(39) + f', {c})')} AS text FROM {_LINES}")
def prompt_fixed_precision(spark, sf):
    fields = [FieldSpec(c, d, "fixed3") for c, d in LINE_FIELDS]
    spec = RenderSpec(template="{name}: {value}", sep=", ", end=".", prefix="The line has attributes: ")
    return _line_values(spark, sf).select("l_orderkey", "l_linenumber", pr.render_fields(fields, spec).alias("text"))


def _cond_sql(c):
    return (f"CASE WHEN length(CAST({c} AS VARCHAR)) <= 4 THEN CAST({c} AS VARCHAR) "
            f"ELSE printf('%.2f', {c}) END")


@query("prompt_conditional_precision",
       f"SELECT l_orderkey, l_linenumber, {_line_sql(_cond_sql)} AS text FROM {_LINES}")
def prompt_conditional_precision(spark, sf):
    fields = [FieldSpec(c, d, "short4_fixed2") for c, d in LINE_FIELDS]
    spec = RenderSpec(template="{name}: {value}", sep=", ", end=".", prefix="The line has attributes: ")
    return _line_values(spark, sf).select("l_orderkey", "l_linenumber", pr.render_fields(fields, spec).alias("text"))


PROSE_FIELDS = (
    FieldSpec("c_mktsegment", "", decode=("HOUSEHOLD", "is a household client", "is a business client")),
    FieldSpec("c_nationkey", "nation number", "int"),
    FieldSpec("c_acctbal", "account balance", "float"),
    FieldSpec("c_mktsegment", "market segment", "str"),
)


@query("prompt_prose_decode",
       "SELECT c_custkey, 'The client ' || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'is a household client' "
       "ELSE 'is a business client' END || ', the nation number is ' || CAST(c_nationkey AS VARCHAR) || "
       "', the account balance is ' || CAST(c_acctbal AS VARCHAR) || ', the market segment is ' || c_mktsegment || '.' AS text "
       "FROM customer")
def prompt_prose_decode(spark, sf):
    spec = RenderSpec(template="the {name} is {value}", sep=", ", end=".", prefix="The client ")
    return T(spark, sf, "customer").select("c_custkey", pr.render_fields(PROSE_FIELDS, spec).alias("text"))


PROSE_TEMPLATE = "The {p_type} part '{p_name}' of brand {p_brand} comes in size {p_size} and sells for {p_retailprice}."


@query("prompt_prose_template",
       "SELECT p_partkey, 'The ' || p_type || ' part ''' || p_name || ''' of brand ' || p_brand || ' comes in size ' || "
       "CAST(p_size AS VARCHAR) || ' and sells for ' || CAST(p_retailprice AS VARCHAR) || '.' AS text FROM part")
def prompt_prose_template(spark, sf):
    p = T(spark, sf, "part")
    values = {"p_type": F.col("p_type"), "p_name": F.col("p_name"), "p_brand": F.col("p_brand"),
              "p_size": F.col("p_size").cast("string"), "p_retailprice": py_float_str("p_retailprice")}
    return p.select("p_partkey", pr.prose(PROSE_TEMPLATE, values).alias("text"))


TYPED_FIELDS = (FieldSpec("p_name", "Part name", description="the name of the part"),
                FieldSpec("p_type", "Part type", description="the type of the part"),
                FieldSpec("p_size", "Size", "int", description="the size of the part"),
                FieldSpec("p_retailprice", "Retail price", "float", description="the retail price"))
TYPED_INTRO = "Predict whether the part is expensive using the following table attributes: \n"


def _typed_header_text():
    # the header depends only on the declared schema of ``part``
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
    schema = StructType([StructField("p_name", StringType()), StructField("p_type", StringType()),
                         StructField("p_size", IntegerType()), StructField("p_retailprice", DoubleType())])
    return pr.typed_header(schema, TYPED_FIELDS, TYPED_INTRO)


@query("prompt_typed_header",
       f"SELECT p_partkey, {q(_typed_header_text() + TEXT_MARKER + chr(39))} || "
       "'Part name: ' || p_name || ', Part type: ' || p_type || ', Size: ' || CAST(p_size AS VARCHAR) || ', Retail price: ' || "
       f"CAST(p_retailprice AS VARCHAR) || '.''' || {q(NORMAL_SUFFIX)} AS normal_query FROM part")
def prompt_typed_header(spark, sf):
    p = T(spark, sf, "part")
    header = pr.typed_header(p.schema, TYPED_FIELDS, TYPED_INTRO)
    text = pr.render_fields(TYPED_FIELDS, RenderSpec(template="{name}: {value}", sep=", ", end="."))
    normal, _ = pr.assemble(text, header, marker=TEXT_MARKER)
    return p.select("p_partkey", normal.alias("normal_query"))


@query("prompt_assemble", f"SELECT c_custkey, {SQL_NORMAL} AS normal_query, {SQL_CHAT} AS chat_query FROM {SQL_CUSTOMERS}")
def prompt_assemble(spark, sf):
    return customer_prompts(spark, sf).select("c_custkey", "normal_query", "chat_query")


SQL_STRICT = (f"({sql_strip(f'regexp_replace({SQL_NORMAL}, {q(chr(65) + "nswer:" + chr(92) + "s*$")}, {q("")})')} || "
              f"{q(' ' + AUXILIARY)} || {SQL_STRICT_TAIL})")


@query("prompt_strict_suffix", f"SELECT c_custkey, {SQL_STRICT} AS strict_prompt FROM {SQL_CUSTOMERS}")
def prompt_strict_suffix(spark, sf):
    p = customer_prompts(spark, sf)
    return p.select("c_custkey", pr.strict_suffix(F.col("normal_query"), F.col("choices"), AUXILIARY).alias("strict_prompt"))


def _few_shot_sql():
    e1, e2 = CUSTOMER_PROMPT.example1, CUSTOMER_PROMPT.example2
    head = (f"Example:\nInput: {e1[0]}\nOutput: {e1[1]}\n\nExample:\nInput: {e2[0]}\nOutput: {e2[1]}\n\n"
            f"Now classify the following profile for {CUSTOMER_PROMPT.task}:\n\nInput: '")
    raw = f"({q(head)} || {SQL_CUSTOMER_TEXT} || {q(chr(39) + chr(10) + 'Final Answer:')})"
    stripped = sql_strip(f"regexp_replace({raw}, {q('Answer:' + chr(92) + 's*$')}, '')")
    return f"({stripped} || {SQL_STRICT_TAIL})"


@query("prompt_few_shot", f"SELECT c_custkey, {_few_shot_sql()} AS prompt FROM {SQL_CUSTOMERS}")
def prompt_few_shot(spark, sf):
    p = customer_prompts(spark, sf)
    return p.select("c_custkey", pr.few_shot(F.col("example"), F.col("task"), F.col("text"), F.col("choices")).alias("prompt"))


def _system_sql():
    from ..specs import SYSTEM_BINARY
    return q(SYSTEM_BINARY.replace("{debias}", CUSTOMER_PROMPT.debias_prompt + " ").replace("{choices}", "'good' or 'bad'"))


@query("chat_messages",
       f"SELECT c_custkey, {_system_sql()} AS system_content, {SQL_STRICT.replace(q(' ' + AUXILIARY) + ' || ', '')} AS user_content, "
       f"2 AS n_messages FROM {SQL_CUSTOMERS}")
def chat_messages(spark, sf):
    p = customer_prompts(spark, sf)
    user = pr.strict_suffix(F.col("normal_query"), F.col("choices"))
    msgs = pr.chat_messages(user, F.col("choices"), F.concat(F.col("debias_prompt"), F.lit(" ")))
    return p.select("c_custkey", msgs[0]["content"].alias("system_content"), msgs[1]["content"].alias("user_content"),
                    F.size(msgs).alias("n_messages"))


def _analysis_sql():
    return q(SYSTEM_ANALYSIS.replace("{debias}", CUSTOMER_PROMPT.debias_prompt + " ").replace("{choices}", "'good' or 'bad'"))


@query("chat_messages_analysis", f"SELECT c_custkey, {_analysis_sql()} AS system_content FROM {SQL_CUSTOMERS}")
def chat_messages_analysis(spark, sf):
    p = customer_prompts(spark, sf)
    msgs = pr.chat_messages(F.col("normal_query"), F.col("choices"), F.concat(F.col("debias_prompt"), F.lit(" ")), "analysis")
    return p.select("c_custkey", msgs[0]["content"].alias("system_content"))


MODEL_NAMES = ("Qwen2.5-7B", "my-model-7b", "llama-2")
OWN_MARKERS = (("my-model", "lowercase"),)


def _matched_sql(e: str, artefacts) -> str:
    for bad in artefacts:
        e = f"replace({e}, {q(bad)}, '')"
    clean = sql_strip(e)
    return f"CASE WHEN contains(lower({clean}), 'good') THEN 'good' WHEN contains(lower({clean}), 'bad') THEN 'bad' ELSE lower({clean}) END"


_SQL_SAID = ("(SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'x' || chr(10) || chr(10) || 'Assistant:  GOOD<|im_end|> ' WHEN c_custkey % 4 = 1 THEN '<THINK>' || c_name || '</THINK> Bad' "
             "WHEN c_custkey % 4 = 2 THEN 'None of them ' || c_name ELSE chr(10) || chr(10) || 'Assistant: ' || c_name END AS said FROM customer)")


@query("parse_by_model",
       f"SELECT c_custkey, {_matched_sql('said', ARTEFACTS)} AS qwen, {_matched_sql('lower(said)', ARTEFACTS_LOWER)} AS lowercase, "
       f"CASE WHEN contains(said, chr(10) || chr(10) || 'Assistant:') THEN lower({sql_strip('split_part(said, chr(10) || chr(10) || ' + q('Assistant:') + ', 2)')}) ELSE {q(INCOMPLETE)} END AS generic FROM {_SQL_SAID}")
def parse_by_model(spark, sf):
    key, name = F.col("c_custkey"), F.col("c_name")
    said = (F.when(key % 4 == 0, F.lit("x\n\nAssistant:  GOOD<|im_end|> ")).when(key % 4 == 1, F.concat(F.lit("<THINK>"), name, F.lit("</THINK> Bad")))
            .when(key % 4 == 2, F.concat(F.lit("None of them "), name)).otherwise(F.concat(F.lit("\n\nAssistant: "), name)))
    choices = F.array(F.lit("good"), F.lit("bad"))
    styles = [dp.style_of(m, OWN_MARKERS) for m in MODEL_NAMES]
    return T(spark, sf, "customer").select(key, *[dp.parse_response(s, said, choices).alias(s) for s in styles])


@query("prompt_second_turn",
       f"SELECT c_custkey, {SQL_CHAT} || CASE WHEN c_acctbal >= 0 THEN 'good' ELSE 'bad' END || "
       f"{q(chr(10) + 'Human: ' + SECOND_QUERY + chr(10) + 'Assistant:')} AS second_prompt FROM {SQL_CUSTOMERS}")
def prompt_second_turn(spark, sf):
    p = customer_prompts(spark, sf)
    first = F.concat(F.col("chat_query"), F.when(F.col("c_acctbal") >= 0, F.lit("good")).otherwise(F.lit("bad")))
    return p.select("c_custkey", pr.second_turn(first, F.lit(SECOND_QUERY)).alias("second_prompt"))


@query("py_float_text",
       "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * (1 - l_discount) * 1000 AS VARCHAR) AS x_text FROM lineitem")
def py_float_text(spark, sf):
    li = T(spark, sf, "lineitem")
    x = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) * F.lit(1000)
    return li.select("l_orderkey", "l_linenumber", py_float_str(x).alias("x_text"))
