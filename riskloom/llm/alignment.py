"""Two tokenizers over one corpus: which tokens of one stand for which of the other.

Exact copies are folded first: texts are shuffled whole, and every distinct text
is tokenised and aligned once, with the number of its copies.  Both tokenizers
read a text as bytes from its front; where tokens of both end, a group ends, and
all tokens of a group are linked with one another.  A text is cut at single
spaces between words, where both tokenizers end a token whatever stands around,
so each distinct word is tokenised and aligned once a task and remembered, in a
memory bounded by bytes.

Measures of a text, its linked id pairs and how often it links each are written
once, in blocks of texts.  Pair counts weigh each text by its copies, partially
summed in the task.  A block then gets the counts of just those pairs that it
holds (a join on the pair, of blocks and pairs, not of texts and pairs), and gives
each text its counted measures.  Texts with very many copies, of which there can be no more than
``HOT`` by their share of the rows, are broadcast when measures are joined to
documents; the rest is joined by the text's digest.

Defined results: null and empty texts, and those that either tokenizer does not
give back byte for byte (after a leading space), have no tokens: zeros and an
empty digest; repeated rows and copies each get their text's measures and all
count; a null ``doc_id`` stays null; ties for the highest count are all highest;
very long texts are read whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialise
from .merging import PairTable

#: most texts whose copies are so large a share of the rows that they are broadcast
HOT = 1024
#: pairs (one per text that links it) and texts of a block
BLOCK_PAIRS, BLOCK_TEXTS = 1 << 21, 1 << 13
#: pairs of a word that are written out one by one
SMALL = 4096
ONE = np.ones(1, "<u4").tobytes()
#: letters of a word that is merged side by side with others
LONG = 64
#: Fixed value: the pattern that cuts words for a byte-level vocabulary
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: a single space between two characters that neither side takes for white space
WORD_END = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary:
    printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary; special strings are plain text.  Words of
    letters up to U+024F are merged side by side; others go through the library."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        parts = json.loads(definition)
        split, model = parts["pre_tokenizer"] or {}, parts["model"]
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True)  # its pattern ends a token before a space between words
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.data = [b""] * (max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
        for entry, i in vocabulary.items():
            self.data[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        self.byte = np.array([vocabulary.get(c, -1) for c, _ in sorted(letters.items(), key=lambda x: x[1])])
        self.table = None
        if self.by_word and plain and parts["normalizer"] is None and not split.get("add_prefix_space") and (self.byte >= 0).all():
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            self.table = PairTable(((vocabulary[x], vocabulary[y], r, vocabulary[x + y]) for r, (x, y) in enumerate(merges)), len(self.data))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        own = [self.table is not None and len(t) <= LONG and max(t) < "ɐ" for t in texts]
        parts = [PARTS.findall(t) for t, o in zip(texts, own, strict=True) if o]
        flat = [p for ps in parts for p in ps]
        data = "".join(flat).encode()
        of = np.repeat(np.arange(len(flat)), [len(p.encode()) for p in flat])
        of, ids, _ = self.table.merged(self.byte[np.frombuffer(data, np.uint8)], of) if flat else (of.astype(np.int64), of.astype(np.int64), None)
        counts = np.zeros(len(texts), np.int64)
        text = np.repeat(np.flatnonzero(own), [len(ps) for ps in parts])
        counts += np.bincount(text[of], minlength=len(texts))
        rest = [i for i, o in enumerate(own) if not o]
        if not rest:
            return ids, counts
        found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        counts[rest] = [len(x) for x in found]
        out, mine = np.empty(int(counts.sum()), np.int64), np.repeat(np.array(own), counts)
        out[mine] = ids
        out[~mine] = np.fromiter(itertools.chain.from_iterable(found), np.int64)
        return out, counts


class Pieces:
    """A SentencePiece model, which puts the leading space itself."""

    def __init__(self, definition: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=definition)
        n = self.model.get_piece_size()
        self.data = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]
        # a word may be encoded by itself if no piece goes on after its end with a space
        self.by_word = not any(re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(n)) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with a space each, end to end, and how many each has."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return np.fromiter(itertools.chain.from_iterable(found), np.int64), np.array([len(x) for x in found], np.int64)


class Word(NamedTuple):
    """A word's alignment: numbers of tokens, groups and links, the groups' text,
    and the linked pairs as 32-bit numbers.  ``times`` says how often each pair is
    linked; if it is empty, the pairs come one by one."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: bytes
    times: bytes


def ends_of(ids: list[int], sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes[ids]) if ids else np.zeros(0, np.int64)


def linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair codes ``a * width + b`` and how often tokens of a group link them;
    within a group each id counts once, with its number of tokens."""
    def folded(ids, group):
        return np.unique(group * (1 << 32) + ids, return_counts=True)

    key_a, n_a = folded(a, group_a)
    key_b, n_b = folded(b, group_b)
    group = key_b >> 32
    lo, hi = np.searchsorted(group, key_a >> 32), np.searchsorted(group, key_a >> 32, side="right")
    size = hi - lo
    left = np.repeat(np.arange(len(key_a)), size)
    right = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    code = (key_a[left] & 0xFFFFFFFF) * width + (key_b[right] & 0xFFFFFFFF)
    pairs, at = np.unique(code, return_inverse=True)
    return pairs, np.bincount(at, weights=n_a[left] * n_b[right], minlength=len(pairs)).astype(np.int64)


class Aligner:
    """Aligns texts within a task."""

    def __init__(self, a: str, b: bytes, memory: int = 200 << 20):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.size_a, self.size_b = (np.array([len(x) for x in side.data], np.int64) for side in (self.a, self.b))
        self.width = len(self.b.data)
        if len(self.a.data) * self.width > 1 << 32:
            raise ValueError("pair codes of these vocabularies need more than 32 bits")
        self.most, self.size, self.known = memory, 0, {}
        decimal = [str(i) for i in range(max(len(self.a.data), self.width))]
        self.plain, self.comma, self.semicolon, self.bar = (np.array([mark + d for d in decimal], object) for mark in ("", ",", ";", "|"))

    def learn(self, texts: list[str]) -> dict[str, Word | None]:
        """Alignments of some words side by side; None, if the tokens' bytes are not
        the word's."""
        (a, n_a), (b, n_b) = self.a.encode(texts), self.b.encode(texts)
        data = [t.encode() for t in texts]
        sizes = np.array([len(d) for d in data], np.int64)
        word_a, word_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        good = self._same(self.a.data, a, word_a, data, sizes) & self._same(self.b.data, b, word_b, data, sizes)
        found: dict[str, Word | None] = {t: None for t, g in zip(texts, good, strict=True) if not g}
        a, word_a, b, word_b = a[good[word_a]], word_a[good[word_a]], b[good[word_b]], word_b[good[word_b]]
        # a group ends where tokens of both end
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at_a, at_b = (np.zeros(int(sizes[good].sum()) + 1, bool) for _ in range(2))
        at_a[end_a], at_b[end_b] = True, True
        last_a, last_b = at_b[end_a], at_a[end_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        word = word_a[last_a]  # of each group
        many = np.unique(word[in_a * in_b > SMALL])
        n_groups, n_links = np.bincount(word, minlength=len(texts)), np.bincount(word, weights=in_a * in_b, minlength=len(texts)).astype(np.int64)
        # the groups' text: tokens by group, first those of A, each with what stands before it
        first_a, first_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
        opens = np.diff(word_a, prepend=-1) > 0
        spelled = np.concatenate([np.where(opens, self.plain[a], np.where(first_a, self.semicolon[a], self.comma[a])), np.where(first_b, self.bar[b], self.comma[b])])
        start_b = np.cumsum(in_b) - in_b
        place = np.concatenate([np.arange(len(a)) + start_b[group_a], np.arange(len(b)) + np.cumsum(in_a)[group_b]])
        flat = np.empty(len(place), object)
        flat[place] = spelled
        flat = flat.tolist()
        tokens_to = np.cumsum(np.where(good, n_a + n_b, 0)).tolist()
        # all pairs of a group
        small = in_a * in_b <= SMALL
        each = np.where(small[group_a], in_b[group_a], 0)
        right = np.repeat(start_b[group_a] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        pairs = (np.repeat(a, each) * self.width + b[right]).astype("<u4").tobytes()
        pairs_to = (4 * np.cumsum(np.bincount(word_a, weights=each, minlength=len(texts)).astype(np.int64))).tolist()
        t0 = p0 = 0
        for i, (text, g, t1, p1, x, y, n, m) in enumerate(zip(texts, good.tolist(), tokens_to, pairs_to, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), strict=True)):
            if g:
                found[text] = Word(x, y, n, m, "".join(flat[t0:t1]), pairs[p0:p1], b"")
            t0, p0 = t1, p1
        for i in many.tolist():
            found[texts[i]] = self._long_word(a[word_a == i].tolist(), b[word_b == i].tolist())
        return found

    def _same(self, tokens: list[bytes], ids: np.ndarray, word: np.ndarray, data: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether each word's tokens spell it."""
        spelled = [tokens[i] for i in ids.tolist()]
        held = np.bincount(word, weights=[len(x) for x in spelled], minlength=len(data)) if len(ids) else np.zeros(len(data))
        good = held == sizes
        if good.all() and b"".join(spelled) == b"".join(data):
            return good
        ends = np.searchsorted(word, np.arange(len(data) + 1)).tolist()
        return np.array([b"".join(spelled[x:y]) == d for x, y, d in zip(ends[:-1], ends[1:], data, strict=True)], bool)

    def _long_word(self, ids_a: list[int], ids_b: list[int]) -> Word:
        """The same for a word of many tokens, whose groups may be large."""
        end_a, end_b = ends_of(ids_a, self.size_a), ends_of(ids_b, self.size_b)
        common = end_a[np.isin(end_a, end_b)]
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        n = len(common)
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        said, at, to = [], 0, 0
        for i, j in zip(in_a.tolist(), in_b.tolist(), strict=True):
            said.append(",".join(map(str, ids_a[at:at + i])) + "|" + ",".join(map(str, ids_b[to:to + j])))
            at, to = at + i, to + j
        pairs, times = linked(np.array(ids_a, np.int64), np.array(ids_b, np.int64), group_a, group_b, self.width)
        return Word(len(ids_a), len(ids_b), n, int(in_a @ in_b), ";".join(said), pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes())

    def words(self, text: str) -> list[str]:
        """The stretches of a space and ``text`` that are encoded by themselves."""
        if not (self.a.by_word and self.b.by_word):
            return [" " + text]
        first, *rest = WORD_END.split(" " + text)
        return [first, *[" " + w for w in rest]]

    def align(self, texts: list[str]) -> Iterator[list[Word] | None]:
        """The words' alignments of each text; None, if it has no tokens."""
        lot = [self.words(t) for t in texts]
        if self.size > self.most:
            self.known, self.size = {}, 0
        new = list(set().union(*lot).difference(self.known))
        if new:
            made = self.learn(new)
            self.known.update(made)
            self.size += sum(2 * len(text) + (len(w.groups) + len(w.pairs) if w else 0) + 400 for text, w in made.items())
        for words in lot:
            found = list(map(self.known.__getitem__, words))
            yield None if None in found else found


def measured(words: list[Word]) -> tuple:
    """Numbers of tokens, groups and links, digest, pairs and their times of a text."""
    n_a, n_b, n_groups, n_links, groups, pairs, times = zip(*words, strict=True)
    codes = np.frombuffer(b"".join(pairs), "<u4")
    if any(times):
        counts = np.frombuffer(b"".join([t or ONE * (len(p) // 4) for t, p in zip(times, pairs, strict=True)]), "<u4")
        codes, at = np.unique(codes, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(codes))
    else:
        codes, total = np.unique(codes, return_counts=True)
    return sum(n_a), sum(n_b), sum(n_groups), sum(n_links), hashlib.sha256(";".join(groups).encode()).hexdigest(), codes, total


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
RESULT = ["digest", "copies", *MEASURES, "groups_sha256"]
TEXTS = "block long, digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(texts: DataFrame, a: str, b: str) -> DataFrame:
    """``TEXTS`` of the distinct ``texts`` (text, digest, copies) with tokens.  Pair
    codes are ``id of a * size of b + id of b``; pairs and times are little-endian."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:  # the vocabularies are parameters of the driver, not data
        held = texts.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches):
        aligner = Aligner(*held.value)
        base, number, in_block, texts_in = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            rows = []
            for words, digest, copies in zip(aligner.align(batch.column("text").to_pylist()), batch.column("digest").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                if words is None:
                    continue
                *numbers, codes, times = measured(words)
                if in_block + len(codes) > BLOCK_PAIRS or texts_in == BLOCK_TEXTS:
                    number, in_block, texts_in = number + 1, 0, 0
                in_block, texts_in = in_block + len(codes), texts_in + 1
                rows.append((base + number, digest, copies, *numbers, codes.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
            kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in TEXTS.split(", ")])

    return texts.mapInArrow(frugal(run), TEXTS)


def pair_rows(weighted: bool, most: int = 1 << 20):
    """``block, pair`` once for each block, or ``pair, n`` (texts that link it, with copies)."""
    def table(block, codes, n):
        codes, at = np.unique(np.concatenate(codes), return_inverse=True)
        if weighted:
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(np.bincount(at, weights=np.concatenate(n)).astype(np.int64))], ["pair", "n"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block, np.int64)), pa.array(codes.astype(np.int64))], ["block", "pair"])

    def run(batches):
        held, n, size, block = [], [], 0, None
        for batch in batches:
            for b, copies, pairs in zip(*(batch.column(c).to_pylist() for c in ("block", "copies", "pairs")), strict=True):
                if held and (size > most or (not weighted and b != block)):
                    yield table(block, held, n)
                    held, n, size = [], [], 0
                block = b
                held.append(np.frombuffer(pairs, "<u4"))
                n.append(np.full(len(held[-1]), copies, np.float64))
                size += len(held[-1])
        if held:
            yield table(block, held, n)
    return run


def counted(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's texts with ``n_best, count_sum``, by the counts of its pairs."""
    pair = counts.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, n, best = pair[order], counts.column("n").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
    n_best, total = [], []
    for pairs, times in zip(texts.column("pairs").to_pylist(), texts.column("times").to_pylist(), strict=True):
        at, t = np.searchsorted(pair, np.frombuffer(pairs, "<u4")), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int(t[best[at]].sum()))
        total.append(int((t * n[at]).sum()))
    columns = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
    return pa.table([columns[c] if c in columns else texts.column(c) for c in RESULT], names=RESULT)


def pair_counts(texts: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: documents that link the pair, and whether no pair of the
    same first id has more."""
    own = texts.select("block", "copies", "pairs").mapInArrow(pair_rows(True), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own = materialise(own, "pair-counts")
    first = F.floor(F.col("pair") / F.lit(width))
    top = own.groupBy(first.alias("a")).agg(F.max("n").alias("top"))  # a row per id of the vocabulary
    return own.join(F.broadcast(top), first == top.a).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``doc_id``, ``MEASURES`` and ``groups_sha256`` of every document; ``a`` is
    the definition of a byte-level tokenizer, ``b`` a SentencePiece model."""
    width = _size(b)
    digest = F.unhex(F.md5("text"))
    texts = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select("text", digest.alias("digest"), "copies")
    table = materialise(aligned(texts, a, b), "aligned-texts")
    counts = pair_counts(table, width)
    wanted = table.select("block", "copies", "pairs").mapInArrow(pair_rows(False), "block long, pair long").distinct()
    held = wanted.join(counts, "pair").select("block", "pair", "n", "best")
    kinds = {"digest": "binary", "groups_sha256": "string"}
    joined = table.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(counted, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in RESULT))
    measures = materialise(joined, "measures")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    least = max(1, docs.count() // HOT)
    hot = measures.where(F.col("copies") > least)  # at most HOT rows
    many = rows.join(F.broadcast(hot), "digest")
    few = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(measures.where(F.col("copies") <= least), "digest", "left")
    out = many.unionByName(few)
    return out.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def _size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
