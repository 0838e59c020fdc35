"""Offset-preserving subword encoding and decoding with a SentencePiece BPE model.

A text is normalised by longest-prefix matches in the model's compiled character
map (a double-array trie over UTF-8); for every byte of the normalised text the
byte of the source that it stands for is recorded.  The normalised text is cut
where no piece of the vocabulary can span (before a space mark that no piece has
inside, and around characters that only stand alone), so each distinct stretch is
merged once per task and remembered, in a memory bounded by bytes that goes with
the partition.  Merges follow the pieces' scores, the leftmost first among
equals; what is no piece falls back to byte pieces.  Every piece is projected
through the recorded alignment to the bytes of the source it covers; spans tile
the text but for what normalisation drops.  Decoding joins the pieces' bytes
again, without the space mark that stands before the text.

Taken are BPE models with byte fallback and without pieces of the user's own;
others are refused with an error.

Defined results: null and empty texts have no pieces and decode to the empty text;
very long texts are read whole, a window of stretches at a time; repeated rows
have equal results; a null ``doc_id`` stays null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, frugal
from .merging import PairTable

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: letters of a stretch that is merged side by side with others
SHORT = 64


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a model file, as plain values that can be broadcast."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    charsmap: bytes
    prefix: bool  # a space mark is put before the text
    squeeze: bool  # spaces at the ends go, runs of spaces become one
    escape: bool  # spaces become space marks

    @staticmethod
    def load(path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:  # the model is a parameter of the driver, not data
            m.ParseFromString(f.read())
        kinds = tuple(p.type for p in m.pieces)
        if m.trainer_spec.model_type != proto.TrainerSpec.BPE or not m.trainer_spec.byte_fallback or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model must be BPE with byte fallback and space marks before words")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with pieces of the user's own or unused pieces are not taken")
        n = m.normalizer_spec
        return PieceModel(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), kinds, n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces)


class Merges:
    """The merges of a model.  Symbols are the normal pieces, by their ids, and
    characters that only stand in longer ones."""

    def __init__(self, model: PieceModel):
        self.symbols = [p if k == NORMAL else None for p, k in zip(model.pieces, model.kinds, strict=True)]
        number = {p: i for i, p in enumerate(self.symbols) if p is not None}
        self.pieces = len(self.symbols)
        longer = [p for p in number if len(p) > 1]
        for c in sorted(set("".join(longer)).difference(number)):
            number[c] = len(self.symbols)
            self.symbols.append(c)
        rank = {s: r for r, s in enumerate(sorted({-model.scores[number[p]] for p in longer}))}
        self.table = PairTable(((number[p[:i]], number[p[i:]], rank[-model.scores[number[p]]], number[p])
                                for p in longer for i in range(1, len(p)) if p[:i] in number and p[i:] in number), len(self.symbols))
        single = sorted((ord(c), i) for c, i in number.items() if len(c) == 1)
        self.code, self.single = (np.array(x, np.int64) for x in zip(*single, strict=True))

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of code points, -1 for those that are none."""
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        return np.where(self.code[at] == codes, self.single[at], -1)

    def merged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text numbers, symbols and code points where they begin, after all merges."""
        code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        of, symbol, place = self.table.merged(self.of(code), np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
        return of, symbol, code[place]


class CharacterMap:
    """The compiled map: a little-endian length, that many bytes of double-array
    units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.text = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes | None, int]:
        """Replacement and length of the longest key that starts at ``at``."""
        units, found, length = self.units, None, 0
        node = self._child(0)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            has_value = units[node] >> 8 & 1
            node = self._child(node)
            if has_value:
                found, length = units[node] & 0x7FFFFFFF, i + 1 - at
        return (None, 0) if found is None else (self.text[found:self.text.index(0, found)], length)

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit >> 9 & 1) * 8)


class Normaliser:
    def __init__(self, model: PieceModel):
        self.model = model
        self.map = CharacterMap(model.charsmap) if model.charsmap else None

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of
        the UTF-8 source that it stands for."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.map is None and not self.model.squeeze:
            return self._spaces_only(text)
        data, out, source = text.encode(), [], []
        at, after_space = 0, self.model.squeeze
        while at < len(data):
            new, size = self.map.longest(data, at) if self.map else (None, 0)
            if new is None:
                lead = data[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new, places = data[at:at + size], range(at, at + size)
            else:
                places = [at] * len(new)
            if after_space:
                gone = len(new) - len(new.lstrip(b" "))
                new, places = new[gone:], places[gone:]
            out.append(new)
            source.extend(places)
            if new:
                after_space = self.model.squeeze and new.endswith(b" ")
            at += size
        flat, end = b"".join(out), len(data)
        if self.model.squeeze:
            kept = len(flat.decode().rstrip(" " + SPACE if self.model.escape else " ").encode())
            end = source[kept] if kept < len(flat) else end
            flat, source = flat[:kept], source[:kept]
        if not flat:
            return "", np.zeros(1, np.int64)
        return self._marked(flat.decode(), np.array([*source, end], np.int64))

    def _spaces_only(self, text: str) -> tuple[str, np.ndarray]:
        return self._marked(text, np.arange(len(text.encode()) + 1))

    def _marked(self, text: str, source: np.ndarray) -> tuple[str, np.ndarray]:
        """Space marks for spaces and before the text; a mark's bytes stand for its space."""
        mark, size = (SPACE, 3) if self.model.escape else (" ", 1)
        if self.model.escape:
            copies = np.where(np.frombuffer(text.encode(), np.uint8) == 32, 3, 1)
            source = np.append(np.repeat(source[:-1], copies), source[-1])
            text = text.replace(" ", SPACE)
        if self.model.prefix:
            text, source = mark + text, np.append(np.full(size, source[0]), source)
        return text, source


class Encoder:
    """Encodes texts within a task."""

    def __init__(self, model: PieceModel, merges: Merges | None = None, memory: int = 96 << 20):
        self.model, self.normalise, self.merges = model, Normaliser(model), merges or Merges(model)
        normal = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        self.id_of = normal
        self.rank = {p: -model.scores[i] for p, i in normal.items() if len(p) > 1}
        self.byte_id = [0] * 256
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if k == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        #: bytes of the normalised text that a piece covers
        self.size = np.array([len(p.encode()) if k == NORMAL else 1 for p, k in zip(model.pieces, model.kinds, strict=True)])
        joined = set("".join(self.rank))
        inside = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        letters = "".join(map(re.escape, sorted(joined if inside else joined - {SPACE})))
        # stretches that no piece crosses: letters that occur in longer pieces, with the marks before them; else single ones
        self.stretch = re.compile((f"[{letters}]+|" if inside else f"{SPACE}*[{letters}]+|{SPACE}+|") + ".", re.DOTALL)
        self.cut = re.compile(f"(?<=[^{SPACE}]){SPACE}")
        self.inside = inside
        self.known = Remembered(memory)

    def merged_by_heap(self, text: str) -> list[str]:
        """The symbols of a long stretch after all merges, in the same order."""
        symbols: list[str | None] = list(text)
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[s], i, s) for i in range(n - 1) if (s := text[i:i + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, s = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or len(symbols[i]) + len(symbols[j]) != len(s) or symbols[i] + symbols[j] != s:
                continue
            symbols[i], symbols[j] = s, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := s + symbols[k]) in rank:
                    heapq.heappush(heap, (rank[pair], i, pair))
            if (h := before[i]) >= 0 and (pair := symbols[h] + s) in rank:
                heapq.heappush(heap, (rank[pair], h, pair))
        return [s for s in symbols if s is not None]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of some stretches, as little-endian 32-bit numbers."""
        short = [t for t in new if len(t) <= SHORT]
        of, symbols, codes = self.merges.merged(short)
        ends = np.searchsorted(of, np.arange(len(short) + 1)).tolist()
        data = symbols.astype("<i4").tobytes()
        found = {t: data[4 * a:4 * b] for t, a, b in zip(short, ends[:-1], ends[1:], strict=True)}
        for i in np.unique(of[(symbols < 0) | (symbols >= self.merges.pieces)]).tolist():  # with characters that are no piece
            part = slice(ends[i], ends[i + 1])
            found[short[i]] = self.spelled([chr(c) if s < 0 else self.merges.symbols[s] for s, c in zip(symbols[part].tolist(), codes[part].tolist(), strict=True)])
        found.update({t: self.spelled(self.merged_by_heap(t)) for t in new if len(t) > SHORT})
        return found

    def spelled(self, symbols: list[str]) -> bytes:
        """Ids of symbols; one that is no piece is spelled in bytes."""
        ids = []
        for s in symbols:
            if (i := self.id_of.get(s)) is not None:
                ids.append(i)
            else:
                ids += [self.byte_id[b] for b in s.encode()]
        return np.array(ids, "<i4").tobytes()

    def stretches(self, text: str, window: int) -> Iterator[list[str]]:
        at = 0
        while len(text) - at > window and not self.inside:
            m = self.cut.search(text, at + window)
            if m is None:
                break
            yield self.stretch.findall(text, at, m.start())
            at = m.start()
        yield self.stretch.findall(text, at)

    def encode(self, normalised: str, window: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of a normalised text, a window of it at a time."""
        for parts in self.stretches(normalised, window):
            if parts:
                yield np.frombuffer(b"".join(self.known.all(parts, self.learn)), "<i4")

    def normalised(self, texts: Iterable[str], lot: int = 256, most: int = 1 << 20) -> Iterator[tuple[str, np.ndarray]]:
        """Normalised texts with their alignment; the stretches of a lot of short
        ones are learned together."""
        held, size = [], 0
        for text in itertools.chain(texts, [None]):
            if held and (text is None or len(held) == lot or size + len(text) > most):
                self.known.all([p for t, _ in held if len(t) < most for p in self.stretch.findall(t)], self.learn)
                yield from held
                held, size = [], 0
            if text is not None:
                held.append(self.normalise(text))
                size += len(text)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text's pieces, and the bytes of the source where each starts and ends."""
        return self.aligned(*self.normalise(text))

    def aligned(self, normalised: str, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([np.zeros(0, "<i4"), *self.encode(normalised)])
        ends = np.cumsum(self.size[ids])
        return ids, source[ends - self.size[ids]], source[ends]


class Decoder:
    """Texts of ids.  The first piece's space mark goes, if the model puts one there."""

    def __init__(self, model: PieceModel):
        self.model = model
        plain = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), CONTROL: lambda p: b"", UNKNOWN: lambda p: UNKNOWN_TEXT.encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.surface = [plain[k](p) for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.silent = {i for i, k in enumerate(model.kinds) if k == CONTROL}

    def head(self, ids: list[int]) -> tuple[bytes, int]:
        """What the first pieces say, up to the first that says something, and how many they are."""
        strips = self.model.prefix or self.model.squeeze
        for at, i in enumerate(ids):
            kind, piece = self.model.kinds[i], self.model.pieces[i]
            if kind == NORMAL and strips and piece.startswith(SPACE):
                said = piece[1:].replace(SPACE, " ")
                if said or not self.model.squeeze:
                    return said.encode(), at + 1
            elif kind != CONTROL:
                return self.surface[i], at + 1
        return b"", len(ids)

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text; bytes that are no UTF-8 become U+FFFD each."""
        if not self.silent.isdisjoint(ids):  # a control piece parts bytes
            return self._mended(ids)
        said, n = self.head(ids)
        surface = self.surface
        data = said + b"".join([surface[i] for i in ids[n:]])
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return self._mended(ids)

    def _mended(self, ids: list[int]) -> bytes:
        out, held = [], b""
        said, n = self.head(ids)
        rows = [(self.model.kinds[ids[n - 1]] == BYTE, said)] if n else []
        for is_byte, s in [*rows, *((self.model.kinds[i] == BYTE, self.surface[i]) for i in ids[n:]), (False, b"")]:
            if is_byte:
                held += s
                continue
            while held:
                size = next((k for k in (1, 2, 3, 4) if _is_character(held[:k])), 0)
                out.append(held[:size] if size else "�".encode())
                held = held[max(size, 1):]
            out.append(s)
        return b"".join(out)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def shared(docs: DataFrame, path: str):
    """The model and its merges, broadcast (as large as the vocabulary)."""
    model = PieceModel.load(path)
    return docs.sparkSession.sparkContext.broadcast((model, Merges(model)))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, starts, ends``: every piece of each text with the bytes of
    the UTF-8 source that it covers."""
    held = shared(docs, path)

    def run(batches):
        encoder = Encoder(*held.value)
        for batch in batches:
            rows = [encoder.aligned(*n) for n in encoder.normalised(t or "" for t in batch.column("text").to_pylist())]
            lists = [pa.array([r[k] for r in rows], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32``: what
    ``encoded`` gives, digested in the task (ids as decimal text, the decoded
    text, the spans as little-endian 64-bit numbers: all starts, then all ends,
    a window after the other)."""
    held = shared(docs, path)

    def row(encoder: Encoder, decoder: Decoder, decimal: list[str], normalised: str, source: np.ndarray):
        at, crc, said, ids = 0, 0, hashlib.sha256(), []
        for e in encoder.encode(normalised):
            sizes = encoder.size[e]
            ends = at + np.cumsum(sizes)
            crc = zlib.crc32(source[ends].astype("<i8").tobytes(), zlib.crc32(source[ends - sizes].astype("<i8").tobytes(), crc))
            at = int(ends[-1])
            said.update(("," if ids else "").encode() + ",".join([decimal[i] for i in e.tolist()]).encode())
            ids += e.tolist()
        return len(ids), said.hexdigest(), hashlib.sha256(decoder.decode(ids)).hexdigest(), crc

    def run(batches):
        encoder, decoder = Encoder(*held.value), Decoder(held.value[0])
        decimal = [str(i) for i in range(len(held.value[0].pieces))]
        for batch in batches:
            rows = [row(encoder, decoder, decimal, *n) for n in encoder.normalised(t or "" for t in batch.column("text").to_pylist())]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
