"""Spelling variants: words of a corpus that differ by one code point, found with a
bit-sliced position index over the vocabulary.

Words are the maximal runs of Latin letters of whole texts, lower-cased A-Z only.
Partial counts are made per task before the one shuffle of words.  Two words
within one error share the first or the second half of either, so each word is
posted under both halves of its own length (index) and under the halves that it
would share with words one shorter, equally long or one longer (query).  Postings
of equal halves meet in one task, many halves in one block of vocabulary; a half
with very many words is dealt over a grid of tasks.  In a block every
(position, letter) has a bitset over the block's words, and for all queries at
once the recurrences over query letters carry two sets per query, words without
error so far and words with one; an inserted or deleted letter reads the bitsets
one position on or back.  Only words that are near leave the task.

A word's ``form`` is its most frequent near word, if that is ``ratio`` times as
frequent; ``root`` follows forms by pointer doubling (each step multiplies the
frequency, so the rounds are few).

Defined results: null and empty texts have no words; a null ``doc_id`` has no
noise applied; repeated rows count again; ties of frequency go to the smaller
word in code-point order; very long texts and runs are read whole; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
LETTERS = "a-zÀ-ÿ"
#: words of a block's index, queries that run side by side, positions of a slab
WORDS, QUERIES, SLAB = 4096, 1024, 32


def runs_of(text: str, run: re.Pattern, window: int = 1 << 20):
    """The runs of a lower-cased text, a window of it at a time."""
    letter = re.compile(f"[{LETTERS}]*")
    at = 0
    while len(text) - at > window:
        end = letter.match(text, at + window).end()  # not inside a run
        yield from run.findall(text, at, end)
        at = end
    yield from run.findall(text, at)


def counter(least: int, noise: int | None, most: int = 200_000):
    """Partial word counts of a task; with ``noise``, a run whose crc32 (of
    ``<doc_id>:<run>``) it divides loses one code point."""
    run = re.compile(f"[{LETTERS}]{{{least},}}")

    def words(doc_id, text):
        found = Counter(runs_of(text, run) if len(text) > 1 << 20 else run.findall(text))
        if noise and doc_id is not None:
            start = zlib.crc32(f"{doc_id}:".encode())
            for w in list(found):
                h = zlib.crc32(w.encode(), start)
                if h % noise == 0:
                    n, at = found.pop(w), h % len(w)
                    if len(w) > least:
                        yield w[:at] + w[at + 1:], n
        yield from found.items()

    def table(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            texts = pc.ascii_lower(batch.column("text")).to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                for w, n in words(doc_id, text or ""):
                    counts[w] += n
                if len(counts) > most:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)
    return count


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, noise: int | None = None) -> DataFrame:
    """``word, n``: words of enough letters with enough occurrences in all texts."""
    own = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return own.mapInArrow(counter(least_letters, noise), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def postings(words: DataFrame, least_letters: int, tile: int = 1 << 15) -> DataFrame:
    """``word, n, query, side, half, size, cell``: the halves that a word is indexed
    under and asks for.  A half with more than ``tile`` words on a side is a grid of cells."""
    m = F.char_length("word")

    def post(query: bool, side: str, size: Column) -> Column:
        cut = F.floor(size / 2).cast("int")
        half = F.substring("word", F.lit(1), cut) if side == "head" else F.substring("word", m - (size - cut) + 1, size - cut)
        return F.struct(F.lit(query).alias("query"), F.lit(side).alias("side"), half.alias("half"), size.alias("size"))

    sides = ("head", "tail")
    index = [post(False, s, m) for s in sides]
    query = [post(True, s, m + d) for s in sides for d in (-1, 0, 1)]
    rows = words.select("word", "n", F.explode(F.array(*index, *query)).alias("p")).select("word", "n", "p.*").where(F.col("size") >= least_letters)
    key = ["side", "half", "size"]
    n = rows.groupBy(*key).agg(F.count_if("query").alias("asks"), F.count_if(~F.col("query")).alias("has")).where("asks > 0 and has > 0")
    cells = lambda c: F.ceil(F.col(c) / F.lit(tile)).cast("int")
    met = rows.join(n.select(*key, cells("asks").alias("across"), cells("has").alias("down")), key)
    deal = lambda c: F.pmod(F.xxhash64("word"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = F.when(F.col("query"), F.transform(every("down"), lambda i: i * F.col("across") + deal("across"))).otherwise(
        F.transform(every("across"), lambda j: deal("down") * F.col("across") + j))
    return met.select("word", "n", "query", *key, F.explode(own).alias("cell"))


def letters(words: list[str], size: int) -> np.ndarray:
    """Code points (rows: words, all of ``size`` letters)."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), size)


class PositionIndex:
    """Bitsets over words of one length: which have a letter at a position."""

    def __init__(self, words: list[str]):
        self.n, self.size = len(words), len(words[0])
        self.codes = letters(words, self.size)
        self.alphabet = np.unique(self.codes)
        self.letter = np.searchsorted(self.alphabet, self.codes)
        self.bit = np.uint64(1) << (np.arange(self.n, dtype=np.uint64) & np.uint64(63))
        self.low, self.high, self.sets = 0, 0, None

    def known(self, codes: np.ndarray) -> np.ndarray:
        """Letter numbers; one that no word has gets the number after the last."""
        at = np.searchsorted(self.alphabet, codes)
        return np.where(self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes, at, len(self.alphabet))

    def at(self, position: int) -> np.ndarray:
        """Bitsets of a position, a row per letter (the last: none); slabs of
        positions are made as they are reached, so long words need little memory."""
        if not self.low <= position < self.high:
            self.low, self.high = max(0, position - 1), min(self.size, position + SLAB)
            self.sets = np.zeros((self.high - self.low, len(self.alphabet) + 1, -(-self.n // 64)), np.uint64)
            word = np.arange(self.n) >> 6
            for p in range(self.low, self.high):
                np.bitwise_or.at(self.sets[p - self.low], (self.letter[:, p], word), self.bit)
        return self.sets[position - self.low]

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) that are one error apart, for queries of one length."""
        m = asked.shape[1]
        shift = m - self.size  # 1: the query has a letter more, -1: the word has
        codes = self.known(asked)
        zero = np.full((len(asked), -(-self.n // 64)), np.uint64(0xFFFFFFFFFFFFFFFF))
        one = np.zeros_like(zero)
        for j in range(m):
            here = self.at(j)[codes[:, j]] if j < self.size else np.zeros_like(zero)
            if shift == 0:
                one = (one & here) | (zero & ~here)
            elif shift < 0:
                one = (one | zero) & self.at(j + 1)[codes[:, j]]
            else:
                one = (one & self.at(j - 1)[codes[:, j]]) | zero if j else zero.copy()
            zero &= here
            if not (zero.any() or one.any()):
                break
        if shift < 0:
            one |= zero
        query, word = np.nonzero(one)
        if not len(query):
            return query, word
        bits = np.unpackbits(one[query, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        query, word = query[hit], word[hit] * 64 + bit
        inside = word < self.n
        return query[inside], word[inside]


def near_in_block(rows: pa.Table) -> pa.Table:
    """Near pairs of a block of postings: each pair is given by the posting of its
    common head, or, if the heads differ, by that of its tail."""
    out = {"word": [], "near": [], "near_n": []}
    column = {c: rows.column(c).to_pylist() for c in ("word", "n", "query", "side", "half", "size", "cell")}
    keys: dict[tuple, int] = {}
    blocks: dict[int, tuple[list[int], dict[int, list[int]]]] = {}
    key = np.empty(rows.num_rows, np.int64)
    for i, (w, q, side, half, size, cell) in enumerate(zip(*(column[c] for c in ("word", "query", "side", "half", "size", "cell")), strict=True)):
        key[i] = keys.setdefault((side, half, size, cell), len(keys))
        index, asked = blocks.setdefault(size, ([], {}))
        asked.setdefault(len(w), []).append(i) if q else index.append(i)
    word = column["word"]
    for size, (index, asked) in blocks.items():
        for lo in range(0, len(index), WORDS):
            has = np.array(index[lo:lo + WORDS])
            table = PositionIndex([word[i] for i in has])
            for m, all_asks in asked.items():
                for at in range(0, len(all_asks), QUERIES):
                    asks = np.array(all_asks[at:at + QUERIES])
                    q, w = table.near(letters([word[i] for i in asks], m))
                    a, b = asks[q], has[w]
                    same = key[a] == key[b]
                    for i, j in zip(a[same].tolist(), b[same].tolist(), strict=True):
                        cut = size // 2
                        if column["side"][i] == "head" or word[i][:cut] != word[j][:cut]:
                            out["word"].append(word[i])
                            out["near"].append(word[j])
                            out["near_n"].append(column["n"][j])
    return pa.table([pa.array(out["word"], pa.string()), pa.array(out["near"], pa.string()), pa.array(out["near_n"], pa.int64())], names=list(out))


def near_pairs(words: DataFrame, least_letters: int = LEAST_LETTERS, block: int = 1 << 13) -> DataFrame:
    """``word, near, near_n``: all ordered pairs of words one error apart.  ``words``
    (word, n) is a written table: its size sets the number of blocks."""
    blocks = max(1, -(-8 * words.count() // block))
    rows = postings(words, least_letters)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("side", "half", "size", "cell"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    return rows.groupBy("block").applyInArrow(near_in_block, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain of ``forms`` (word, form), whose
    rounds of pointer doubling are written tables."""
    up = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        on = up.select(F.col("word").alias("at"), F.col("root").alias("far"))
        up = materialise(up.join(on, up.root == on["at"], "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if up.where("moved").isEmpty():
            return up.select("word", "root")


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, noise: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    words = materialise(vocabulary(docs, least_letters, least_count, noise), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(words, least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    table = materialise(found.select("word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                     F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(table.where("form is not null").select("word", "form"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
