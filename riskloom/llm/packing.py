"""Packing by lexical retrieval: a sharded BM25 index fills each window with the
unused neighbours of its seed document.

Documents are tokenised once into a written table.  Document frequencies and
the mean length are taken over all documents (one number per vocabulary entry,
so what reaches the driver and is broadcast is bounded by the vocabulary).  The
table is then range-partitioned by two salient tokens of each document and its
``doc_id``, so documents with the same salient words come together and a hot
group is split.  Each partition streams through shards of about ``shard_tokens``
tokens: a shard's inverted index gives the unused neighbours of the document
that opens the window, best first, which fill it; the last is cut where the
window is full, and its rest opens the next one and is the next seed.  A window
that is open when a shard ends goes on in the next shard.  At the end of a
partition the last window is cut into sequences of powers of two, which need no
padding, so there is none at all.

Defined results: a null or empty text is one document of the end token alone;
very long texts span as many windows as they need; repeated rows are packed
each by itself (their pieces carry the same ``doc_id``); ties of the score go to
the document that comes first by (salient tokens, ``doc_id``, ids); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialise

WINDOW, END = 4096, 2
K1, B = 1.2, 0.75


TAIL = ".,;:!?"
#: bytes that a remembered run takes besides its letters and ids
ENTRY = 200


class WordTokens:
    """Token ids of texts, by a tokenizer that lower-cases and drops white space:
    every run between blanks and line ends is encoded by itself and remembered,
    in about ``most`` bytes.  A run of letters (up to U+00FF) with marks
    at its end is looked up as its lower-case letters and its marks, which that
    tokenizer splits anyway."""

    def __init__(self, definition: str, kind: str, most: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.most = Tokenizer.from_str(definition), kind, most
        self.known: dict[str, bytes] = {"": b""}
        self.size = 0

    def _learn(self, runs) -> None:
        runs = list(runs)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in found], dtype=np.int64) * np.dtype(self.kind).itemsize
        data = np.fromiter(itertools.chain.from_iterable(found), dtype=self.kind).tobytes()
        self.known.update(zip(runs, (data[a:b] for a, b in zip([0, *ends[:-1]], ends)), strict=True))
        self.size += len(data) + sum(map(len, runs)) + ENTRY * len(runs)

    def learn(self, texts: list[list[str]]) -> None:
        """Encode all runs of a lot of texts that aren't known, in one call."""
        seen = set().union(*texts)
        new = seen.difference(self.known)
        if self.size > self.most:
            self.known, self.size = {"": b""}, 0
            new = seen.difference(self.known)
        parts = {}
        for r in new:
            core = r.rstrip(TAIL)
            if core.isalpha() and max(core) <= "\xff":
                parts[r] = core.lower(), r[len(core):]
        cores = {core for core, _ in parts.values()} | {tail for _, tail in parts.values()}
        self._learn(cores.difference(self.known) | (new - parts.keys()))
        known = self.known
        known.update({r: known[core] + known[tail] for r, (core, tail) in parts.items()})
        self.size += sum(map(len, parts)) + 2 * ENTRY * len(parts)

    def encode(self, texts: list[str], lot: int = 256) -> Iterator[bytes]:
        """The ids' bytes of each text."""
        for at in range(0, len(texts), lot):
            runs = [t.replace("\n", " ").split(" ") for t in texts[at:at + lot]]
            self.learn(runs)
            look = self.known.__getitem__
            for r in runs:
                yield b"".join(map(look, r))


def salient(ids: np.ndarray) -> tuple[int, int]:
    """The two tokens of most weight, by their number in the text and their
    place in the vocabulary (a later one is a longer, rarer piece)."""
    n = np.bincount(ids)
    seen = np.flatnonzero(n)
    weight = np.sqrt(n[seen]) * np.log2(seen + 2.0)
    one = int(weight.argmax())
    weight[one] = -1.0
    return int(seen[one]), int(seen[weight.argmax()])


def tokenised(docs: DataFrame, path: str, end: int = END) -> tuple[DataFrame, str, int]:
    """``doc_id, ids, one, two`` of each document, written; the ids' numpy type;
    the vocabulary's size."""
    with open(path, encoding="utf-8") as f:  # the vocabulary is a parameter of the driver, not data
        definition = f.read()
    from tokenizers import Tokenizer

    size = Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    held = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        tokens, last = WordTokens(held.value, kind), np.array([end], dtype=kind).tobytes()
        for batch in batches:
            ids = [x + last for x in tokens.encode([t or "" for t in batch.column("text").to_pylist()])]
            keys = [salient(np.frombuffer(x, kind)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32())], ["doc_id", "ids", "one", "two"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(own.mapInArrow(frugal(run), "doc_id long, ids binary, one int, two int"), "tokens"), kind, size


def statistics(table: DataFrame, kind: str, size: int):
    """Documents, tokens, and the number of documents that hold each token."""
    def run(batches):
        n, last = np.zeros(size + 2, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                ids = np.frombuffer(x, kind)
                at = np.arange(len(ids))
                last[ids] = at  # a token's last place stands for it
                n[ids[last[ids] == at]] += 1
                n[size] += 1
                n[size + 1] += len(ids)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["token", "n"])

    total = np.zeros(size + 2, np.int64)
    for r in table.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # vocabulary-sized
        total[r.token] = r.n
    return int(total[size]), int(total[size + 1]), total[:size]


class Shard:
    """BM25 inverted index of some documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(docs)
        lengths = np.array([len(d) for d in docs])
        pair = np.repeat(np.arange(n, dtype=np.int64), lengths) + np.concatenate(docs).astype(np.int64) * n
        pair, tf = np.unique(pair, return_counts=True)
        self.n, self.doc = n, pair % n
        term = pair // n
        norm = K1 * (1 - B + B * lengths / mean)
        self.impact = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.start = np.searchsorted(term, np.arange(len(idf) + 1))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        terms = np.unique(ids)
        lo, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n)


class Windows:
    """Fills windows piece by piece; a piece is (document, start, length)."""

    def __init__(self, window: int):
        self.window, self.open, self.fill, self.done = window, [], 0, []

    def place(self, doc, length: int) -> bool:
        """True if the document's rest opened the window that is open now."""
        start = 0
        while start < length:
            n = min(length - start, self.window - self.fill)
            self.open.append((doc, start, n))
            self.fill += n
            start += n
            if self.fill == self.window:
                self.done.append(self.open)
                self.open, self.fill = [], 0
        return len(self.open) == 1 and self.open[0][1] > 0

    def finish(self) -> None:
        """Cut the open window into powers of two, largest first."""
        room = 0
        for doc, start, n in self.open:
            while n:
                if not room:
                    room = 1 << (self.fill.bit_length() - 1)
                    self.fill -= room
                    self.done.append([])
                take = min(n, room)
                self.done[-1].append((doc, start, take))
                start, n, room = start + take, n - take, room - take
        self.open, self.fill = [], 0


def fill_shard(docs: list[np.ndarray], windows: Windows, idf: np.ndarray, mean: float, name) -> None:
    """Place every document of the shard; ``name`` gives what a piece carries."""
    index = Shard(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    first = 0
    seed = None
    while True:
        if seed is None:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return
            seed = first
            unused[seed] = False
            windows.place(name(seed), len(docs[seed]))
        if not windows.fill:
            seed = None
            continue
        score = np.where(unused, index.scores(docs[seed]), 0.0)
        near = np.argsort(-score, kind="stable")
        seed = None
        for d in near:
            if score[d] <= 0:
                break
            unused[d] = False
            if windows.place(name(d), len(docs[d])):
                seed = int(d)  # its rest opened the window that comes next
                break
            if not windows.fill:
                break


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packer(kind: str, idf, mean: float, window: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]):
        base, number = TaskContext.get().partitionId() << 32, 0
        windows, held, ids, size = Windows(window), [], [], 0

        def rows():
            nonlocal number
            cols: list[list[int]] = [[] for _ in range(7)]
            for pieces in windows.done:
                offset = 0
                for (doc_id, x), start, n in pieces:
                    crc = zlib.crc32(x[start:start + n].astype("<u4").tobytes())
                    for c, v in zip(cols, (doc_id, start, n, crc, len(x), base + number, offset), strict=True):
                        c.append(v)
                    offset += n
                number += 1
            windows.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def shard():
            fill_shard(ids, windows, idf.value, mean, lambda d, n=held, x=ids: (n[d], x[d]))

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                x = np.frombuffer(x, kind)
                held.append(doc_id)
                ids.append(x)
                size += len(x)
                if size >= shard_tokens:
                    shard()
                    yield rows()
                    held, ids, size = [], [], 0
        if ids:
            shard()
        windows.finish()
        yield rows()
    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard_tokens: int = 1 << 20, part_tokens: int = 1 << 22) -> DataFrame:
    """Pieces of every document: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``; sequences are full windows or powers of two."""
    table, kind, size = tokenised(docs, path)
    n, tokens, df = statistics(table, kind, size)
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))
    parts = max(1, -(-tokens // part_tokens))
    order = ["one", "two", "doc_id"]
    dealt = table.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids").select("doc_id", "ids")
    return dealt.mapInArrow(frugal(packer(kind, idf, tokens / max(n, 1), window, shard_tokens)), OUT)
