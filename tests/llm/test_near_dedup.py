import collections
import random

import numpy as np
import pyarrow as pa

from riskloom.llm import near_dedup, queries
from riskloom.llm.components import components

from .cases import SF, clashing, docs, shingles


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, a, edits):
    b = list(a)
    for _ in range(edits):
        i = r.randrange(len(b) + 1)
        kind = r.random()
        if kind < 0.3:
            b.insert(i, r.randint(2, 9))
        elif i < len(b):
            b[i:i + 1] = [] if kind < 0.6 and len(b) > 1 else [r.randint(2, 9)]
    return b


def test_alignment_equals_dynamic_programming():
    r = random.Random(5)
    pairs = [(a, edited(r, a, r.randint(0, 16))) for a in ([r.randint(2, 9) for _ in range(r.randint(0, 70))] for _ in range(400))]
    pairs += [([], []), ([5], []), ([4] * 300, [4] * 301)]
    got = near_dedup.similarities([tuple(np.array(x, np.uint64) for x in p) for p in pairs], 0.8)
    for (a, b), s in zip(pairs, got, strict=True):
        want = 1 - distance(a, b) / max(len(a), len(b), 1)
        assert abs(s - (want if want >= 0.8 - 1e-9 else 0)) < 1e-9


def brute_classes(rows, least=0.8):
    """Classes by all pairs (rows with an id)."""
    rows = [(i, (t or "").split()) for i, t in rows if i is not None]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a == b and (a or True) or a and b and shingles(" ".join(a)) & shingles(" ".join(b)) and 1 - distance(a, b) / max(len(a), len(b)) >= least:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i, _ in rows}


def test_planted_copies_equal_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    shared = [word() for _ in range(60)]
    for _ in range(30):
        base = [word() for _ in range(r.randint(60, 120))]
        if r.random() < 0.4:
            base[10:10] = shared  # a passage that unlike texts share
        for copy in range(r.randint(1, 6)):
            text = list(base)
            for _ in range(r.randint(0, 3) if copy else 0):
                text[r.randrange(len(text))] = word()
            rows.append((n, " ".join(text), "en", "s", 1))
            n += 1
    r.shuffle(rows)
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(docs(spark, rows)).collect()}
    assert got == brute_classes([(a, b) for a, b, *_ in rows])


def test_star_families_are_one_class_wherever_the_base_stands(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, want = [], {}
    for family, (size, base_at) in enumerate([(21, 0), (21, 10), (21, 20), (61, 30), (61, 60)]):
        base = [word() for _ in range(200)]
        for i in range(size):
            at = r.randrange(len(base) + 1)
            text = base if i == base_at else base[:at] + [word() for _ in range(38)] + base[at:]
            rows.append((100 * family + i, " ".join(text), "en", "s", 1))
            want[100 * family + i] = 100 * family
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(docs(spark, rows)).collect()}
    assert got == want


def test_like_texts_meet_behind_hubs_that_link_nothing(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    line = [word() for _ in range(60)]

    def band(text):
        _, _, h, doc, at, _, _ = next(near_dedup.batches(pa.array([text]), 5))
        return near_dedup.order_sketch(h, doc, at, 1, 1)[0, 0]
    tails = [[word() for _ in range(80)] for _ in range(200)]
    texts = [" ".join(line + t) for t in tails]
    common = collections.Counter(map(band, texts)).most_common(1)[0][0]
    tails = [t for t, x in zip(tails, texts, strict=True) if band(x) == common][:24]
    assert len(tails) == 24
    near = tails[-1][:-3] + [word() for _ in range(3)]
    rows = [(i, " ".join(line + t), "en", "s", 1) for i, t in enumerate([*tails, near])]
    assert len({band(x[1]) for x in rows}) == 1  # one bucket: 23 texts that are unlike all, then the pair
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(docs(spark, rows), bands=1).collect()}
    assert got == {**{i: i for i in range(24)}, 24: 23}


def test_awkward_rows(spark):
    rows = clashing(docs(spark))
    got = near_dedup.near_classes(rows).collect()
    assert len(got) == rows.count()
    by = {x.doc_id: x for x in got if x.doc_id is not None}
    assert by[1].class_id == by[5].class_id == 1 and by[2].class_id == by[3].class_id == 2 and by[4].class_id == 4 and by[9].class_id == 8
    assert sorted((x.class_id for x in got if x.doc_id is None), key=str) == [2, None]
    kept = near_dedup.deduplicated(rows)
    assert kept.columns == rows.columns
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted([1, 2, 4, 6, 7, 8, 10, None], key=str)  # 9 is 8 but for six words
    again = docs(spark, [(5, "a b c", "en", "s", 1), (5, "a b c", "en", "s", 1), (5, "other words of the same id here", "en", "s", 1), (4, "a b c", None, None, None)])
    assert {x.class_id for x in near_dedup.near_classes(again).collect()} == {4}
    assert [x.doc_id for x in near_dedup.deduplicated(again).collect()] == [4]
    assert near_dedup.near_classes(docs(spark, [])).count() == 0 == near_dedup.deduplicated(docs(spark, [])).count()


def test_query_finds_every_pair_of_like_texts(spark):
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {x.doc_id: x.class_id for x in queries.op10_order_minhash(spark, SF).collect()}
    s = {i: shingles(t) for i, t in texts.items()}
    like = [(i, j) for i in s for j in s if i < j and s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])]
    assert like and all(got[i] == got[j] for i, j in like)
    classes = {}
    for i, c in got.items():
        classes.setdefault(c, []).append(i)
    for c in classes.values():  # no member without a like text in its class
        assert len(c) == 1 or all(not s[i] or any(s[i] & s[j] for j in c if j != i) for i in c)


def test_texts_with_too_many_own_words_are_not_aligned(spark):
    r = random.Random(13)
    common = [f"w{i}" for i in range(780)]

    def text(edits):
        out = list(common)
        for at in r.sample(range(780), edits):
            out[at] = f"x{r.randrange(10**9)}"
        return " ".join(out)
    texts = [text(100) for _ in range(12)] + [text(20) for _ in range(2)]
    members = spark.createDataFrame([(7, i, 780, i, 1, True) for i in range(14)], "key long, rep long, n_words int, label long, salts int, hub boolean")
    own = near_dedup.word_bags(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    got = {tuple(x) for x in near_dedup.hub_pairs(members.join(own, "rep"), 0.8).collect()}
    words = [set(t.split()) for t in texts]
    lacking = {(i, j): len(words[i] ^ words[j]) for i in range(14) for j in range(i + 1, 14)}
    assert got >= {p for p, n in lacking.items() if n <= 312}  # 2 * floor(0.2 * 780): none that may be alike is left out
    assert got <= {p for p, n in lacking.items() if n <= 330} and any(n > 330 for n in lacking.values())


def test_order_counts():
    h = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two = np.zeros(40, np.int64), np.arange(40)
    a = near_dedup.order_sketch(h, one, two, 1, 16)
    b = near_dedup.order_sketch(h[::-1].copy(), one, two, 1, 16)
    assert (a != b).all() and (a == near_dedup.order_sketch(h, one, two, 1, 16)).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(60, 90)] + [(5, 3), (3, 9), (9, 5), (20, 2), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(60, 91)} == {60} and {got[i] for i in (3, 5, 9)} == {3} and got[20] == got[2] == 2 and 7 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
