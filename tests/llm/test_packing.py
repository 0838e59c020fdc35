import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskloom.llm import packing, queries

from .cases import SF, clashing, docs


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.vocabulary())


def check(rows, texts, tokenizer, window=4096):
    """Every id in one piece, no gaps, no sequence too long; returns the padding."""
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == ids.keys()
    for i, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[i][at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_query_round_trip(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check(queries.op8_lexical_packing(spark, SF).collect(), texts, tokenizer) == 0


def test_awkward_rows(spark, tokenizer):
    rows = docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert check(packing.pack(clashing(rows), queries.vocabulary(), shard_tokens=50, part_tokens=3000).collect(), texts, tokenizer) == 0
    again = packing.pack(docs(spark), queries.vocabulary()).collect()  # repeated ids, and none
    assert sum(r.start == 0 for r in again) == docs(spark).count()
    assert packing.pack(docs(spark, []), queries.vocabulary()).count() == 0


def test_runs_encode_like_whole_texts(tokenizer):
    with open(queries.vocabulary(), encoding="utf-8") as f:
        tokens = packing.WordTokens(f.read(), "<u2", most=12)
    texts = ("The end. THE END!? don't can't'll İstanbul ΣΑΣ. x y z 12,345.67 <|endoftext|>a<|startoftext|> naïve, été. ... a.b.c ÿ! ß. ﬁn.\x0b\x1c\tq日本。", "", "  \n ", "Word word. wOrd; word")
    for lot in (1, 3):
        for text, got in zip(texts, tokens.encode(list(texts), lot), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_neighbours_share_windows():
    r = np.random.default_rng(0)
    topics = [r.integers(k * 100, k * 100 + 30, (8, 64)) for k in range(4)]
    shard = [topics[k][i].astype("<u2") for i in range(8) for k in range(4)]  # topics alternate
    windows = packing.Windows(512)
    packing.fill_shard(shard, windows, np.ones(500), 64.0, lambda d: (d, len(shard[d])))
    assert [{doc % 4 for (doc, _), _, _ in w} for w in windows.done] == [{k} for k in (0, 1, 2, 3)] and not windows.fill


def test_scores_are_bm25():
    shard = [np.array(x, "<u2") for x in ([1, 2, 2], [2, 3], [4])]
    idf, mean = np.array([0, 1.5, 0.5, 2.0, 3.0]), 2.0
    got = packing.Shard(shard, idf, mean).scores(np.array([2, 3, 3], "<u2"))
    part = lambda w, tf, n: w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2))
    assert np.allclose(got, [part(0.5, 2, 3), part(0.5, 1, 2) + part(2.0, 1, 2), 0])


def test_last_window_is_cut_into_powers_of_two():
    w = packing.Windows(4096)
    w.place("a", 1000)
    w.place("b", 300)
    w.finish()
    assert [sum(n for *_, n in s) for s in w.done] == [1024, 256, 16, 4]
