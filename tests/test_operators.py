"""Hand-computed cases (FIXTURES.md §3) for metrics, fairness, missing
policies, response parsing, token samples, packing, padding and loss monitors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import fairness as fa
from riskloom.operators import metrics as me
from riskloom.operators import responses as rs
from riskloom.operators import sampling as sp
from riskloom.operators import sft
from riskloom.specs import FairnessSpec

CASES = [(1, "good", "good", "A"), (2, "good", "bad", "A"), (3, "bad", "good", "A"), (4, "bad", "bad", "A"),
         (5, "good", "good", "B"), (6, "good", "good", "B"), (7, "bad", "bad", "B"), (8, "bad", "good", "B")]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(CASES, "id int, truth string, pred string, grp string")


def test_binary_metrics(cases):
    r = me.binary_metrics(cases, "truth", "pred", "good").first()
    assert r.n == 8
    assert r.accuracy == pytest.approx(0.625)
    assert r.f1 == pytest.approx(2 / 3, abs=1e-6)
    assert r.mcc == pytest.approx(0.258199, abs=1e-6)
    c = me.confusion_by(cases, "truth", "pred", "good").first()
    assert (c.tp, c.fp, c.fn, c.tn) == (3, 2, 1, 2)


def test_metrics_degenerate(spark):
    df = spark.createDataFrame([("bad", "bad"), ("bad", "bad")], "truth string, pred string")
    r = me.binary_metrics(df, "truth", "pred", "good").first()
    assert (r.f1, r.mcc, r.accuracy) == (0.0, 0.0, 1.0)


def test_fairness_hand_case(cases):
    spec = FairnessSpec("truth", "good", "grp", "B", "A")
    r = fa.fairness_metrics(cases, spec, "truth", "pred").first()
    assert r.di_pred == pytest.approx(2 / 3, abs=1e-6)
    assert r.eod == pytest.approx(-0.5)
    assert r.aod == pytest.approx(-0.25)
    rep = {(x.metric, x.attribute): x.value for x in fa.fairness_report(cases, [spec], "truth", "pred").collect()}
    assert rep[("DI", "grp")] == pytest.approx(2 / 3, abs=1e-6)
    assert rep[("EOD", "grp")] == pytest.approx(-0.5)


def test_fairness_empty_group_is_null(cases):
    spec = FairnessSpec("truth", "good", "grp", "B", "Z")
    r = fa.fairness_metrics(cases, spec, "truth", "pred").first()
    assert r.di_pred is None and r.eod is None


def test_identical_groups_have_unit_di(spark):
    df = spark.createDataFrame([(t, p, g) for g in ("A", "B") for t, p in (("good", "good"), ("bad", "good"), ("good", "bad"))],
                               "truth string, pred string, grp string")
    r = fa.fairness_metrics(df, FairnessSpec("truth", "good", "grp", "B", "A"), "truth", "pred").first()
    assert r.di_pred == pytest.approx(1.0) and r.eod == 0.0 and r.aod == 0.0


def test_missing_policies(spark):
    # truth bad (0), answer unparseable (acc 0.0, missing 1), favorable = good (1)
    df = spark.createDataFrame([(0, "0.0", "1")], "t int, acc string, missing string")
    got = df.select(rs.predicted_label("t", "acc", 1, 0, "missing", "flip").alias("flip"),
                    rs.predicted_label("t", "acc", 1, 0, "missing", "drop").alias("drop"),
                    rs.predicted_label("t", "acc", 1, 0, "missing", "negative").alias("neg")).first()
    assert (got.flip, got.drop, got.neg) == (1, None, 0)


def test_response_cleaning(spark):
    rows = [("Human: \nq \nAnswer:\n\nAssistant: \n Good \n",), ("no marker here",), ("x\n\nAssistant:\xa0bad\xa0",)]
    df = spark.createDataFrame(rows, "r string")
    got = [x[0] for x in df.select(rs.clean_response("r")).collect()]
    assert got == ["good", "Incomplete response", "bad"]
    m = spark.createDataFrame([("not bad, good",), ("<think>x</think> Bad",), ("maybe",)], "t string")
    got = [x[0] for x in m.select(rs.match_choice(F.col("t"), F.array(F.lit("good"), F.lit("bad")))).collect()]
    assert got == ["good", "bad", "maybe"]


def test_eval_record_error_routing(spark):
    df = spark.createDataFrame([(1, "p", None, "good"), (2, "p", "\n\nAssistant: good", "good")],
                               "id long, prompt string, resp string, answer string")
    df = df.withColumn("choices", F.array(F.lit("good"), F.lit("bad")))
    r = {x.doc_id: x for x in rs.eval_records(df, "id", "prompt", "resp", "answer", "choices").collect()}
    assert r[1].error == "llm_response key not found" and r[1].acc is None
    assert (r[2].acc, r[2].missing, r[2].f1, r[2].error) == ("1.0", "0", "('good', 'good')", None)


def _int_tokens(text):
    return F.transform(F.split(text, " "), lambda x: x.cast("int"))


def test_label_masking_truncation_and_repair(spark):
    # human turn renders to 3 tokens, assistant turn to 2 tokens, EOS id 2
    turns = spark.createDataFrame([(1, 0, "human", "h"), (1, 1, "assistant", "4 5")], "c int, t int, role string, text string")

    def tok(rendered):
        return F.when(rendered.startswith("Human"), F.array(F.lit(11), F.lit(12), F.lit(13))).otherwise(_int_tokens(rendered))

    full = sft.token_samples(turns, "c", "t", "role", "text", 16, tokenizer=tok, eos_id=2).first()
    assert list(full.labels) == [-100, -100, -100, 4, 5, 2]
    assert list(full.input_ids) == [11, 12, 13, 4, 5, 2]
    cut = sft.token_samples(turns, "c", "t", "role", "text", 3, tokenizer=tok, eos_id=2)
    r = cut.select(sft.repair_masked(F.col("input_ids"), F.col("labels")).alias("fixed"),
                   sft.has_label(F.col("labels")).alias("keep")).first()
    assert list(r.fixed) == [-100, -100, -100] and r.keep is False


def test_repair_copies_positions_18_to_23(spark):
    df = spark.createDataFrame([(list(range(30)), [-100] * 30)], "ids array<int>, labels array<int>")
    fixed = df.select(sft.repair_masked(F.col("ids"), F.col("labels"))).first()[0]
    assert fixed[:18] == [-100] * 18 and fixed[18:24] == list(range(18, 24)) and fixed[24:] == [-100] * 6


def test_packing_blocks_and_keep_short(spark):
    docs = spark.createDataFrame([(1, "g", "1 2 3"), (2, "g", "4 5"), (3, "g", "6")], "d long, g string, text string")
    b = sft.pack_blocks(docs, "g", "d", "text", 4, eos=True, tokenizer=_int_tokens, eos_id=0)
    assert [list(r.input_ids) for r in b.orderBy("block_no").collect()] == [[1, 2, 3, 0], [4, 5, 0, 6]]
    k = sft.pack_blocks(docs, "g", "d", "text", 16, eos=False, keep_short=True, tokenizer=_int_tokens)
    assert [list(r.input_ids) for r in k.collect()] == [[1, 2, 3, 4, 5, 6]]


def test_packing_conserves_tokens(spark):
    rows = [(i, f"s{i % 3}", " ".join(str(j) for j in range(1, 2 + i % 7))) for i in range(60)]
    docs = spark.createDataFrame(rows, "d long, g string, text string")
    b = sft.pack_blocks(docs, "g", "d", "text", 5, eos=True, tokenizer=_int_tokens, eos_id=0)
    per_group = b.groupBy("g").agg(F.sum(F.size("input_ids")).alias("n")).collect()
    totals = {}
    for _, g, text in rows:
        totals[g] = totals.get(g, 0) + len(text.split()) + 1
    assert {r.g: r.n for r in per_group} == {g: (n // 5) * 5 for g, n in totals.items()}


def test_left_pad(spark):
    df = spark.createDataFrame([([5, 6], [1, 1], [5, 6])], "input_ids array<int>, attention_mask array<int>, labels array<int>")
    r = sft.pad_sample(df, 4, "left").first()
    assert list(r.input_ids) == [0, 0, 5, 6] and list(r.attention_mask) == [0, 0, 1, 1]


def test_block_mean_carry_over(spark):
    df = spark.createDataFrame([(e, s, float(e * 3 + s + 1)) for e in range(2) for s in range(3)], "epoch long, step long, v double")
    got = [(r.block_no, r.mean_loss, r.n) for r in me.block_mean(df, "v", "epoch", "step", 2).orderBy("block_no").collect()]
    assert got == [(0, 1.5, 2), (1, 4.0, 3)]


def test_running_mean_exact_and_float(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.25, 2.5, 0.01, 3.0])], "k long, v double")
    exact = [r.running_mean for r in me.running_mean(df, "v", ["k"], scale=2).orderBy("k").collect()]
    assert exact == [1.25, 1.875, 1.253333, 1.69]
    flt = [r.running_mean for r in me.running_mean(df, "v", ["k"]).orderBy("k").collect()]
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(flt, exact))


def test_perplexity_overflow_is_infinite(spark):
    df = spark.createDataFrame([(1000.0,)], "loss double")
    assert me.perplexity(df, F.col("loss")).first().perplexity == float("inf")


def test_metric_registry_matches_binary_metrics(cases):
    r = me.evaluate(cases, "truth", "pred", "good").first()
    b = me.binary_metrics(cases, "truth", "pred", "good").first()
    assert r.accuracy == pytest.approx(b.accuracy) and r.f1 == pytest.approx(b.f1) and r.mcc == pytest.approx(b.mcc)


def test_model_style_dispatch(spark):
    from riskloom.operators import dispatch as dp
    assert [dp.style_of(m) for m in ("Qwen2.5-7B", "DeepSeek-R1-Distill-Llama", "llama-2")] == \
        ["qwen", "distill", "generic"]
    assert dp.style_of("my-model-7b", extra_markers=(("my-model", "lowercase"),)) == "lowercase"
    df = spark.createDataFrame([("x\n\nAssistant: <think>.</think> Good",)], "r string")
    ch = F.array(F.lit("good"), F.lit("bad"))
    got = df.select(dp.parse_response("qwen", F.col("r"), ch).alias("q"), dp.parse_response("generic", F.col("r"), ch).alias("g")).first()
    assert got.q == "good" and got.g == "<think>.</think> good"


def splits_of(df):
    return sorted(map(tuple, df.collect()))


def test_cached_split_is_reused(spark, tmp_path, monkeypatch):
    base, path = spark.range(300).withColumnRenamed("id", "k"), str(tmp_path / "splits")
    a = sp.cached_split(spark, base, "k", path, "one")
    assert a.count() == 300
    monkeypatch.setattr(sp, "split_exact", None)  # from here on nothing is split
    assert splits_of(sp.cached_split(spark, base.orderBy(F.desc("k")).repartition(3), "k", path, "one")) == splits_of(a)


def test_cached_split_follows_the_content(spark, tmp_path):
    path = str(tmp_path / "splits")
    base = spark.range(300).withColumnRenamed("id", "k")
    for changed in (base.where("k <> 7"), base.withColumn("k", F.when(F.col("k") == 7, 1007).otherwise(F.col("k"))), base.unionByName(base.where("k = 7")), base.limit(0)):
        sp.cached_split(spark, base, "k", path, "one")
        assert [r[0] for r in splits_of(sp.cached_split(spark, changed, "k", path, "one"))] == sorted(r.k for r in changed.collect())
    assert len({sp.content_of(spark.createDataFrame(rows, "k string"), "k") for rows in ([("a",), ("b",)], [("a",), ("b",), ("b",)], [("a",), (None,)], [("a",)], [("ab",)])}) == 5


def test_a_half_written_split_is_never_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "splits")
    base = spark.range(300).withColumnRenamed("id", "k")
    good = sp.split_exact

    def aborted(df, *options):
        return good(df, *options).withColumn("split", F.when(F.col("k") == 250, F.raise_error(F.lit("lost"))).otherwise(F.col("split")))

    monkeypatch.setattr(sp, "split_exact", aborted)
    with pytest.raises(Exception, match="lost"):
        sp.cached_split(spark, base, "k", path, "one")
    monkeypatch.setattr(sp, "split_exact", good)
    assert sp.cached_split(spark, base, "k", path, "one").count() == 300
    # a folder with rows, but without a manifest
    content = sp.content_of(base.where("k < 9"), "k")
    base.where("k < 3").withColumn("split", F.lit("train")).write.parquet(f"{path}/dataset=two/seed=10086/ratios=0.7_0.1/names=train_dev_test/content={content}/run-0")
    assert sp.cached_split(spark, base.where("k < 9"), "k", path, "two").count() == 9


def _hot_conversation(spark):
    import random
    rnd = random.Random(4)
    rows = []
    for c, n_turns in ((1, 300), (2, 3), (3, 1)):
        for t in range(n_turns):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, " ".join(f"w{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 6)))))
    return rows, spark.createDataFrame(rows, "c long, t long, role string, text string")


def test_token_samples_hot_conversation_matches_brute_force(spark):
    rows, df = _hot_conversation(spark)
    got = {r.c: (len(r.input_ids), sum(1 for x in r.labels if x == -100))
           for r in sft.token_samples(df, "c", "t", "role", "text", 40).collect()}
    exp = {}
    for c in {r[0] for r in rows}:
        seq = []
        for _, t, role, text in sorted(r for r in rows if r[0] == c):
            n = len(text.split())
            seq += [-100] * (n + 2) if role == "user" else [0] * (n + 1)
        seq = seq[:40]
        exp[c] = (len(seq), seq.count(-100))
    assert got == exp


def test_split_long_conversations_multi_bucket(spark):
    rows, df = _hot_conversation(spark)
    got = sorted(tuple(r) for r in sft.split_long_conversations(df, "c", "t", "role", "text", 25).collect())
    # the greedy rule (no segment over the limit), not a division of the offset by it
    exp = [(c, i, *s) for c in {r[0] for r in rows} for i, s in enumerate(greedy([x[2:] for x in sorted(rows) if x[0] == c], 25))]
    assert got == sorted(exp)


def test_average_precision_brute_force(spark):
    import random
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 30), 1 if rnd.random() < 0.3 else 0) for _ in range(400)]
    df = spark.createDataFrame(rows, "s long, y int")
    got = me.average_precision(df, "s", "y", 1).first()[0]
    pos_total = sum(y for _, y in rows)
    ap, ctp, cfp = 0.0, 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(1 for x, y in rows if x == s and y == 1)
        fp = sum(1 for x, y in rows if x == s and y == 0)
        ctp, cfp = ctp + tp, cfp + fp
        ap += tp / pos_total * ctp / (ctp + cfp)
    assert got == pytest.approx(ap, abs=1e-12)


def test_human_far_behind_the_length_limit_keeps_the_conversation(spark):
    rows = [(1, t, "assistant" if t < 2090 else "user", "x y") for t in range(2100)] + [(2, t, "assistant", "no one") for t in range(3)]
    df = spark.createDataFrame(rows, "c long, t long, role string, text string")
    got = {r.c: len(r.input_ids) for r in sft.inference_context(df, "c", "t", "role", "text", 2048).collect()}
    assert got == {1: 2048}


def test_pairs_follow_roles(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "A1"), (1, 3, "user", "R"), (1, 4, "assistant", "A2"), (1, 5, "user", "T"),
            (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "assistant", "first"), (3, 1, "assistant", "last")]
    df = spark.createDataFrame(rows, "c long, t long, role string, text string")
    got = sorted(map(tuple, sft.preference_rows(df, "c", "t", "role", "text").collect()))
    assert got == [(1, "S\nQ", "A1", "A2"), (3, "", "first", "last")]
    cut = sorted(map(tuple, sft.split_long_conversations(df.where("c = 1"), "c", "t", "role", "text", 6).collect()))
    # the first pair (7 tokens) has more than 6, so its turns stand alone; the others stay whole
    assert cut == [(1, 0, 2, 5), (1, 1, 1, 2), (1, 2, 2, 5), (1, 3, 1, 3)]


def test_vocabulary_order_of_very_long_texts(spark):
    from riskloom.operators import text_ops as tx
    d = spark.range(2).select(F.col("id").alias("k"), F.when(F.col("id") == 0, F.concat(F.repeat(F.lit("w "), 1_000_003), F.lit("late"))).otherwise(F.lit("next w")).alias("t"))
    v = tx.vocab_merge(tx.first_occurrence_words(d.where("k < 0"), "k", "t"), tx.first_occurrence_words(d, "k", "t"))
    assert [r.piece for r in v.orderBy("pos").collect()] == ["w", "late", "next"]


def test_vocabulary_of_repeated_and_null_keys(spark):
    from riskloom.functions.text import PY_WS_CHARS
    from riskloom.operators import text_ops as tx
    rows = [(2, "b a b c"), (2, "d b"), (None, "z c y"), (None, "y z"), (1, f"a{PY_WS_CHARS}q"), (3, None), (4, " "), (5, "new \u2009 q")]
    base = [(9, "q r"), (None, "s r")]
    make = lambda x: spark.createDataFrame(x, "k long, t string")

    def first(rows):
        out = {}
        for k, t in rows:
            for p, w in enumerate((t or "").split()):
                at = (k is not None, k or 0, p)
                out[w] = min(out.get(w, at), at)
        return out
    one, two = first(base), first(rows)
    want = sorted(one, key=lambda w: (one[w], w)) + sorted(two.keys() - one.keys(), key=lambda w: (two[w], w))
    got = tx.vocab_merge(tx.first_occurrence_words(make(base), "k", "t"), tx.first_occurrence_words(make(rows), "k", "t"))
    assert [(r.piece, r.pos) for r in got.orderBy("pos").collect()] == [(w, i) for i, w in enumerate(want)]


def test_a_task_gives_a_word_once(spark):
    from riskloom.operators import text_ops as tx
    d = spark.range(0, 500, 1, 1).select(F.col("id").alias("k"), F.lit("the same words in each text").alias("t"))
    plan = tx.first_occurrence_words(d, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_packing_spreads_one_hot_source(spark):
    rows = spark.range(4000).select(F.lit("s").alias("g"), F.col("id").alias("k"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" x")).alias("t"))
    b = sft.pack_blocks(rows, "g", "k", "t", 100, eos=True).collect()
    assert len(b) == 120 and all(len(r.input_ids) == 100 for r in b)
    from riskloom.functions.ordering import with_bucket
    assert with_bucket(rows, ["k"]).select("_rl_b").distinct().count() > 50


def test_running_mean_never_cuts_decimals(spark):
    df = spark.createDataFrame([(1, 0.25), (2, 0.125)], "k long, v double")
    with pytest.raises(Exception, match="more than 2 decimals"):
        me.running_mean(df, "v", ["k"], scale=2).collect()
    assert [r.running_mean for r in me.running_mean(df, "v", ["k"], scale=3).orderBy("k").collect()] == [0.25, 0.1875]


def greedy(turns, most):
    """Segments (turns, tokens) of one conversation, turn by turn."""
    def size(role, text):
        return len(text.split()) + (2 if role == "user" else 1)

    pairs = []
    for role, text in turns:
        if role == "user" and any(r == "user" for p in pairs for r, _ in p):
            pairs.append([])
        elif not pairs:
            pairs.append([])
        pairs[-1].append((role, text))
    units = []
    for p in pairs:
        n = [size(*x) for x in p]
        units += [(1, x) for x in n] if sum(n) > most else [(len(p), sum(n))]
    out = []
    for k, n in units:
        if out and out[-1][1] + n <= most:
            out[-1] = out[-1][0] + k, out[-1][1] + n
        else:
            out.append((k, n))
    return out


def test_greedy_cut_is_the_sequential_one(spark):
    rng = random.Random(2)
    talks = {c: [(rng.choice(["user", "assistant", "assistant", "system"]), " ".join("w" * rng.randint(0, 9))) for _ in range(rng.choice([1, 2, 5, 40, 700]))] for c in range(12)}
    talks[99] = [("user" if i % 2 == 0 else "assistant", "a b c") for i in range(4000)]  # one hot conversation
    rows = [(c, i, r, t) for c, talk in talks.items() for i, (r, t) in enumerate(talk)]
    df = spark.createDataFrame(rows, "c long, t long, role string, text string")
    for most in (4, 12, 64):
        got = sorted(map(tuple, sft.split_long_conversations(df, "c", "t", "role", "text", most).collect()))
        assert got == sorted((c, i, *s) for c, talk in talks.items() for i, s in enumerate(greedy(talk, most)))
        assert all(n <= most or k == 1 for _, _, k, n in got)
    assert sft.split_long_conversations(df.limit(0), "c", "t", "role", "text", 8).count() == 0
