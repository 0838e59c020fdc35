"""Offset-preserving encoding against the sentencepiece library: ids, decoding,
normalisation with its alignment, spans; awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece as spm
from sentencepiece import sentencepiece_model_pb2 as proto

from riskloom.llm import pieces, queries

from . import cases

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  ", "▁", "a▁▁b", "\x00ab\x00", "<s>", "</s> <unk>", "<0x0A>", "\n\nx", "日本語テキスト", "a" * 1000, "é" * 50, "🙂🙂", " \t \n", "x▁ y", "aab" * 300, "12 345", "a" + " " * 40 + "b"]


def texts(n=400):
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("abé  \n▁19日,.'<>0x́Aﬁ①Ａ　​ ½ßK") for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=queries.piece_model())


@pytest.fixture(scope="module", params=["nmt_nfkc", "nfkc_cf", "identity squeezed"])
def other_model(request, tmp_path_factory):
    """The same vocabulary behind another normaliser."""
    m = proto.ModelProto()
    with open(queries.piece_model(), "rb") as f:
        m.ParseFromString(f.read())
    if request.param == "identity squeezed":
        m.normalizer_spec.remove_extra_whitespaces = True
    else:
        own = proto.ModelProto()
        own.ParseFromString(spm.SentencePieceNormalizer(rule_name=request.param).serialized_model_proto())
        m.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
        m.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path_factory.mktemp("model") / "other.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def check_spans(text, ids, starts, ends, model):
    """Spans go forward and lie in the text; a piece that is the source's own text stands over it."""
    data = text.encode()
    assert (starts <= ends).all() and (starts[1:] == ends[:-1]).all()
    assert not len(ids) or (starts[0] >= 0 and ends[-1] <= len(data))


def compare(path, rows):
    sp = spm.SentencePieceProcessor(model_file=path)
    model = pieces.PieceModel.load(path)
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for text in rows:
        ids, starts, ends = encoder.spans(text)
        assert ids.tolist() == sp.encode(text), text
        assert decoder.decode(ids.tolist()).decode() == sp.decode(ids.tolist()), text
        check_spans(text, ids, starts, ends, model)
        # the library's offsets leave a character's byte pieces together: compare where its pieces end
        found = sp.encode(text, return_type="proto").pieces
        for p, i, end in zip(found, ids.tolist(), ends.tolist(), strict=True):
            if model.kinds[i] == pieces.NORMAL:
                assert end == p.end, (text, p)


def test_library_on_the_documents(library):
    import pyarrow.parquet as pq

    rows = [t or "" for t in pq.read_table(f"{SMALL}/documents.parquet").column("text").to_pylist()]
    compare(queries.piece_model(), rows)


def test_library_on_odd_texts():
    compare(queries.piece_model(), texts())


def test_other_normalisers(other_model):
    compare(other_model, texts())


def test_spans_are_the_source(library):
    model = pieces.PieceModel.load(queries.piece_model())
    encoder = pieces.Encoder(model)
    for text in texts():
        data = text.encode()
        ids, starts, ends = encoder.spans(text)
        assert b"".join(data[a:b] for a, b in zip(starts, ends, strict=True)) == data
        for i, a, b in zip(ids.tolist(), starts, ends, strict=True):
            piece, own = model.pieces[i], data[a:b]
            want = bytes([int(piece[3:5], 16)]) if model.kinds[i] == pieces.BYTE else piece.replace("▁", " ").encode()
            got = own if model.kinds[i] == pieces.BYTE else own.decode().replace("▁", " ").encode()
            assert got == want or (a == 0 and b" " + got == want)  # the first mark stands for nothing


def test_decoding_of_any_ids(library):
    model = pieces.PieceModel.load(queries.piece_model())
    decoder, rng = pieces.Decoder(model), random.Random(8)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 29871, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        assert decoder.decode(ids).decode() == library.decode(ids)


def test_windows_and_forgetting_change_nothing(library):
    model = pieces.PieceModel.load(queries.piece_model())
    text = "  ".join(ODD) * 3
    for window, memory in ((1, 96 << 20), (17, 0), (100, 5_000)):
        encoder = pieces.Encoder(model, memory=memory)
        got = np.concatenate(list(encoder.encode(encoder.normalise(text)[0], window)))
        assert got.tolist() == library.encode(text)


def test_both_ways_to_merge_agree():
    encoder, rng = pieces.Encoder(pieces.PieceModel.load(queries.piece_model())), random.Random(4)
    texts = ["".join(rng.choice("▁thean é日") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    found = encoder.learn(texts)
    assert found == {t: encoder.spelled(encoder.merged_by_heap(t)) for t in texts}


def test_other_kinds_of_model_are_refused(tmp_path):
    m = proto.ModelProto()
    with open(queries.piece_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceModel.load(str(path))


def test_query_and_awkward_rows(spark, library):
    def brute(rows):
        out = []
        for doc_id, text, *_ in rows:
            ids = library.encode(text or "")
            out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        return sorted(out, key=str)

    docs = cases.docs(spark, cases.ROWS + [(20 + i, t, None, None, None) for i, t in enumerate(ODD)])
    found = pieces.digests(docs, queries.piece_model())
    assert sorted((tuple(r)[:4] for r in found.collect()), key=str) == brute(docs.collect())
    assert cases.shown(pieces.digests(cases.clashing(docs), queries.piece_model())) == cases.shown(found)
    assert pieces.digests(docs.limit(0), queries.piece_model()).count() == 0
    full = queries.QUERIES["op11_piece_offsets"](spark, SMALL)
    source = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r)[:4] for r in full.collect()), key=str) == brute(source)
    # the digest of the spans is that of the arrays
    spans = {r.doc_id: r.spans_crc32 for r in found.collect() if r.doc_id is not None}
    for r in pieces.encoded(docs, queries.piece_model()).collect():
        if r.doc_id is not None and len(r.ids) < 5000:
            assert spans[r.doc_id] == zlib.crc32(np.array([*r.starts, *r.ends], "<i8").tobytes())
