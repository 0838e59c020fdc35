"""Alignment of two tokenizers against a brute force over whole texts."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

from riskloom.llm import alignment, queries

from . import cases

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SMALL = "/root/testdata/sf0.001"
ODD = [" ", "  a  b ", "a▁b", "\x00ab\x00", "<|endoftext|> x", "<s> </s>", "\n\nx \ny", "日本語テキスト と", "a" * 500, "é" * 50 + " é", "🙂🙂 🙂", " \t \n", "12 345's it's", "x\x1c y", "a" + " " * 40 + "b", "tab\t next", "nb sp", "wide　space here", "ｆｕｌｌ wídth"]


def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.byte_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def groups_of(text, a, b, letters):
    """Groups of (A ids, B ids) of the whole text, or none."""
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    out, i, j, end_a, end_b, one, two = [], 0, 0, 0, 0, [], []
    while i < len(ids_a) or j < len(ids_b):
        if end_a <= end_b and i < len(ids_a):
            end_a += len(bytes_a[i])
            one.append(ids_a[i])
            i += 1
        else:
            end_b += len(bytes_b[j])
            two.append(ids_b[j])
            j += 1
        if end_a == end_b:
            out.append((one, two))
            one, two = [], []
    return out


def brute(rows):
    a, b = sides()
    letters = alignment.byte_letters()
    docs = [(r[0], groups_of(r[1], a, b, letters)) for r in rows]
    counts = Counter(p for _, g in docs for p in {(x, y) for one, two in g for x in one for y in two})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, g in docs:
        links = [(x, y) for one, two in g for x in one for y in two]
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in g)
        out.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def aligned(docs):
    return alignment.align(docs, queries.byte_tokenizer(), queries.piece_model())


def test_query_is_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert cases.shown(queries.QUERIES["op12_token_alignment"](spark, SMALL)) == brute(rows)


@pytest.mark.parametrize("block", [None, 40])
def test_odd_and_awkward_rows(spark, block, monkeypatch):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice("ab  \n▁é日,.'19\x1c\t") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = cases.ROWS + [(100 + i, t, None, None, None) for i, t in enumerate(texts)] + [(900 + i, "copies of one text", "en", "s", None) for i in range(30)]
    if block:  # few pairs a block
        monkeypatch.setattr(alignment, "BLOCK_PAIRS", block)
    found = aligned(cases.docs(spark, rows))
    want = brute(rows)
    assert cases.shown(found) == want
    assert any(r[1] == 0 and r[0] is not None for r in want)  # the mark in a text
    if not block:
        assert cases.shown(aligned(cases.clashing(cases.docs(spark, rows)))) == want
        assert aligned(cases.docs(spark, rows).limit(0)).count() == 0


def test_one_group_of_many_tokens():
    """Links of a large group are counted by ids, not token by token."""
    import numpy as np

    a, b = np.array([1, 2, 1, 1]), np.array([5, 5, 6])
    pairs, times = alignment.linked(a, b, np.zeros(4, np.int64), np.zeros(3, np.int64), 10)
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == {15: 6, 16: 3, 25: 2, 26: 1}


def test_forgetting_changes_nothing():
    with open(queries.byte_tokenizer(), encoding="utf-8") as f, open(queries.piece_model(), "rb") as g:
        definition, model = f.read(), g.read()
    texts = [t for t in ODD if t] * 2
    kept, forgetful = alignment.Aligner(definition, model), alignment.Aligner(definition, model, memory=0)
    for t in texts:
        x, y = next(kept.align([t])), next(forgetful.align([t]))
        assert (x is None) == (y is None)
        assert x is None or [w.groups for w in x] == [w.groups for w in y]
