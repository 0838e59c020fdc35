"""Word and shingle hashes of whole batches of texts in numpy.

A word is a run of bytes other than ASCII white space.  Its hash is a
polynomial over its UTF-8 bytes modulo 2^64, taken from prefix sums, so no
Python object is made per word.  A shingle is ``k`` consecutive words; a text
of fewer words (but one at least) is one shingle; a text without words has
none.  The hashes depend on the text alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_blocks, text_bytes

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
STEP = U(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), on a copy."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = U(1)
    return np.cumprod(out, dtype=U)


INVERSE = U(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = _powers(base, max(n, 1 << 20))
        if n <= 1 << 22:  # a very long text's table isn't kept
            _POWERS[name] = have
    return have


def words(data: np.ndarray, offsets: np.ndarray):
    """Start, end (bytes) and text number of each word, and its hash."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inner = ~space
    first = inner.copy()
    first[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inner[heads]
    starts = np.flatnonzero(first)
    last = inner.copy()
    last[:-1] &= space[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inner[tails]
    ends = np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    sums = np.zeros(len(data) + 1, U)
    terms = data.astype(U)
    terms += U(1)
    terms *= _table("up", BASE, len(data))[: len(data)]
    np.cumsum(terms, out=sums[1:])
    h = sums[ends] - sums[starts]
    h *= _table("down", INVERSE, len(data))[starts] if len(data) else U(1)
    return starts, ends, doc, mix(h + (ends - starts).astype(U))


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int):
    """Hash, text number and first word (number within its text) of each
    shingle, and the word counts."""
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    sdoc = np.repeat(np.arange(n_docs), n)
    pos = first[sdoc] + at
    out = np.zeros(len(pos), U)
    size = np.minimum(counts, k)[sdoc]
    for i in range(k):
        out *= STEP
        inside = size > i
        if inside.all():
            out += h[pos + i]
        else:
            out[inside] += h[pos[inside] + i]
    return mix(out + size.astype(U)), sdoc, at, counts


def batches(texts: pa.Array, k: int, limit: int = 1 << 20):
    """``(lo, hi, hash, text number from lo, first word, word counts, word
    hashes)`` for each run of texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for lo, hi in text_blocks(texts, limit):
        data, offsets = text_bytes(texts.slice(lo, hi - lo))
        _, _, doc, h = words(data, offsets)
        yield (lo, hi, *shingles(h, doc, hi - lo, k), h)
