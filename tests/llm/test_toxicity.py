import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskloom.llm import queries, toxicity

from .cases import clashing, docs

#: the smaller tables have only 33 toxic texts to learn from (held-out AUC 0.94 there)
SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_contract(spark):
    rows = queries.op3_toxicity(spark, SF).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    ones, zeros = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert auc > 0.95 and sum(s >= 0.7 for s in zeros) <= 0.01 * len(zeros)


def test_features_are_distinct_and_of_the_text_alone():
    a, b, c, d = toxicity.features(pa.array(["You IDIOT!", "you idiot?", None, ""]))
    assert set(a) == set(b) and len(set(a)) == len(a) and len(c) == len(d) == 0


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 3, 5, 6, 7, 8, 9, 10)] + [(1, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    got = toxicity.judge(clashing(docs(spark)), clashing(labels)).collect()
    assert len(got) == docs(spark).count() and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[1] == by[5] and by[2] == by[3] and len(by[5]) == 1
    none = labels.where("false")
    assert {r.score for r in toxicity.judge(docs(spark), none).collect()} == {0.5}
    assert toxicity.judge(docs(spark, []), none).count() == 0


def plain_features(text):
    """Feature numbers of a text, one n-gram after the other."""
    m = (1 << 64) - 1

    def mixed(h):
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & m
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & m
        return h ^ h >> 32

    letters = {*range(48, 58), *range(97, 123), *range(128, 256)}
    codes = [(c if c in letters else 32) + 1 for c in (text or "").lower().encode()]
    found = set()
    for n in toxicity.SIZES:
        for at in range(len(codes) - n + 1):
            h = n
            for c in codes[at:at + n]:
                h = (h * 0x100000001B3 + c) & m
            found.add(mixed(h) >> (64 - toxicity.BITS))
    return found


def plain_scores(texts, labels, l2=1.0):
    """Probabilities of a logistic regression on features times log-count ratio,
    by Newton steps on the dual weights of the texts (labels None: not learned)."""
    rows = [plain_features(t) for t in texts]
    y = np.array([v for v in labels if v is not None], float)
    learned = [r for r, v in zip(rows, labels, strict=True) if v is not None]
    names = sorted(set().union(*rows))
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r]] = 1
    t = x[[i for i, v in enumerate(labels) if v is not None]]
    assert len(learned) == len(t)
    ratio = np.log((t[y > 0].sum(0) + 1) / (y.sum() + 2)) - np.log((t[y == 0].sum(0) + 1) / (len(y) - y.sum() + 2))
    kernel, n = (t * ratio) @ (t * ratio).T, len(y)
    f = np.zeros(n)
    for _ in range(60):
        p = 1 / (1 + np.exp(-f))
        w = np.maximum(p * (1 - p), 1e-12)
        system = np.zeros((n + 1, n + 1))
        system[:n, :n] = kernel + l2 * np.diag(1 / w)
        system[:n, n] = system[n, :n] = 1
        solved = np.linalg.solve(system, np.append(f + (y - p) / w, 0))
        step = kernel @ solved[:n] + solved[n] - f
        f = f + step * min(1, 5 / np.abs(step).max(initial=1e-9))
    return 1 / (1 + np.exp(-((x * ratio) @ ((t * ratio).T @ solved[:n]) + solved[n])))


def test_scores_are_those_of_a_plain_fit(spark):
    rng = random.Random(6)
    bad, good = ["grub", "snarl", "vile", "scum"], ["lamp", "river", "stone", "bread"]
    words = ["the", "of", "and", "über", "12", "tree", "walk"]
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        own = rng.choices(words, k=6) + rng.choices(bad if toxic else good, k=2) + rng.choices(bad + good, k=1)
        rng.shuffle(own)
        rows.append((i, " ".join(own) if i % 50 else None))
        labels.append(None if i % 5 == 2 else int(toxic))
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.createDataFrame([(i, v) for i, v in enumerate(labels) if v is not None], "doc_id long, toxic int")
    model = toxicity.fit(docs_, held, rounds=400)
    got = {r.doc_id: r.s for r in docs_.select("doc_id", model.score(spark, F.coalesce("text", F.lit(""))).alias("s")).collect()}
    want = plain_scores([t for _, t in rows], labels)
    assert [set(f.tolist()) for f in toxicity.features(pa.array([t or "" for _, t in rows]))] == [plain_features(t) for _, t in rows]
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 0.01


def test_the_fit_gives_the_drivers_heap_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "forget_shuffles", calls.append)
    rows = [(i, "you idiot %d" % i if i % 2 else "a kind word %d" % i, "en", "s", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    toxicity.fit(docs(spark, rows).select("doc_id", "text"), labels, rounds=toxicity.FORGET, parts=2)
    assert len(calls) == 1  # one for every FORGET gradients
