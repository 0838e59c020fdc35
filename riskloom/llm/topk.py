"""Exact top-k inner-product search with a bit-sliced index.

Each component is quantised to ``floor(scale * x)``.  The index holds, for a
block of rows, the bit slices of every attribute: bitmap (attribute, bit) has
one bit per row.  A query's scores are added up by bitmap arithmetic: for each
attribute and each one-bit of the query's weight, the attribute's slices enter
at their place value, and full adders (xor and majority of three bitmaps)
reduce all bitmaps of a place until one is left, which gives the bit slices of
all scores.  The best k rows are then selected from the most significant slice
downward; rows that tie at the boundary are resolved exactly by their id.

A negative weight uses the complemented slices, since ``-w*x = w*((2^b-1)-x) -
w*(2^b-1)``, so all place values are positive and the correction is one
constant per query and block.

Rows are dealt into blocks by a hash of id and vector (equal rows once, with their
number), queries into blocks too; the
stated query set meets all rows block by block, each pair of blocks in a task
of its own with bounded memory, and gives k rows a query; the k best of these
are the result.

Defined results: a vector that is null or holds a null, NaN or infinite
component takes no part, nor does a null id; shorter vectors count as padded
with zeros; rows that share an id all count (a query id's results are the best of
all its rows', equal results as often as they come); ties go to the smaller id; an empty table gives an empty result.  A
quantised component beyond 2^27 is an error, as scores might leave the range
of a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

U = np.uint64
LARGEST = 1 << 27


def quantised(vector, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component, or null if any is not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    x = F.transform(v, lambda c: c.cast("double"))
    sound = v.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    q = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long"))
    small = F.forall(q, lambda c: F.abs(c) <= LARGEST)
    return F.when(sound, F.when(small, q).otherwise(F.raise_error(F.lit("topk: a quantised component is beyond 2^27")).cast("array<long>")))


def build_slices(x: np.ndarray):
    """Slices of the rows' attributes: ``(bitmaps, attribute, bit, least, bits)``;
    each bitmap is packed into 64-bit words."""
    rows, dims = x.shape
    least = x.min(axis=0)
    u = (x - least).astype(U)
    bits = np.array([int(m).bit_length() for m in u.max(axis=0)], dtype=np.int64)
    words = -(-rows // 64)
    attribute = np.repeat(np.arange(dims), bits)
    bit = np.arange(len(attribute)) - np.repeat(np.cumsum(bits) - bits, bits)
    maps = np.zeros((len(attribute), words), U)
    for i, (a, b) in enumerate(zip(attribute, bit, strict=True)):
        plane = np.zeros(words * 64, np.uint8)
        plane[:rows] = (u[:, a] >> U(b)) & U(1)
        maps[i] = np.packbits(plane, bitorder="little").view(U)
    return maps, attribute, bit, least, bits


def score_slices(maps, attribute, bit, weights: np.ndarray) -> list[np.ndarray]:
    """Bit slices (least significant first) of ``sum(|w| * u)``, with the
    complemented slices where ``w < 0``."""
    places: dict[int, list[np.ndarray]] = {}
    size = np.abs(weights)
    for s in range(int(size.max(initial=0)).bit_length()):
        on = ((size >> s) & 1).astype(bool)
        use = np.flatnonzero(on[attribute])
        if len(use):
            got = np.where((weights[attribute[use]] < 0)[:, None], ~maps[use], maps[use])
            at = bit[use] + s
            for p in np.unique(at):
                places.setdefault(int(p), []).append(got[at == p])
    out, p = [], 0
    while places:
        stack = np.concatenate(places.pop(p)) if p in places else np.zeros((0, maps.shape[1]), U)
        carries = []
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third:2 * third], stack[2 * third:3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third:]])
            else:  # two are left: a half adder
                carries.append(stack[:1] & stack[1:2])
                stack = stack[:1] ^ stack[1:2]
        if carries:
            places.setdefault(p + 1, []).extend(carries)
        out.append(stack[0] if len(stack) else np.zeros(maps.shape[1], U))
        p += 1
    return out


def count_bits(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def select_top(slices: list[np.ndarray], allowed: np.ndarray, k: int):
    """``(sure, boundary, missing)``: from the most significant slice downward,
    the rows that are among the best k, the rows that tie at the boundary, and
    how many of those are still to take."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    missing = k
    for s in reversed(slices):
        high = tied & s
        n = count_bits(high)
        if n <= missing:
            sure |= high
            missing -= n
            tied &= ~s
        else:
            tied = high
        if not missing:
            break
    return sure, tied, missing


def row_numbers(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """The k best rows of the block for each query, but for rows of its own id:
    (query id, row, score)."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    maps, attribute, bit, least, bits = build_slices(x)
    everyone = np.zeros(maps.shape[1] * 64, np.uint8)
    everyone[:len(ids)] = 1
    everyone = np.packbits(everyone, bitorder="little").view(U)
    span = (np.int64(1) << bits) - 1
    for q, w in zip(query_ids, queries, strict=True):
        allowed = everyone.copy()
        for own in range(np.searchsorted(ids, q), np.searchsorted(ids, q, side="right")):
            allowed[own >> 6] &= ~(U(1) << U(own & 63))
        slices = score_slices(maps, attribute, bit, w)
        sure, tied, missing = select_top(slices, allowed, k)
        rows = np.concatenate([row_numbers(sure), row_numbers(tied)[:missing]])  # rows stand by id
        bits_of = [(s[rows >> 6] >> (rows & 63).astype(U)) & U(1) for s in slices]
        total = np.zeros(len(rows), np.int64)
        for p, b in enumerate(bits_of):
            total += b.astype(np.int64) << p
        shift = int((w * least).sum()) - int((np.where(w < 0, -w, 0) * span).sum())
        yield q, order[rows], total + shift


def _search(k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "copies": []}, dtype="int64")
        dims = max(rows["q"].map(len).max(), queries["q"].map(len).max())
        x, w = (np.zeros((len(t), dims), np.int64) for t in (rows, queries))
        for m, t in ((x, rows), (w, queries)):
            for i, v in enumerate(t["q"]):
                m[i, :len(v)] = v
        found = list(search_block(rows["vec_id"].to_numpy(), x, queries["vec_id"].to_numpy(), w, k))
        size = [len(f[1]) for f in found]
        row = np.concatenate([f[1] for f in found])
        copies = np.minimum(np.repeat(queries["copies"].to_numpy(), size) * rows["copies"].to_numpy()[row], k)
        return pd.DataFrame({"query_id": np.repeat([f[0] for f in found], size), "vec_id": rows["vec_id"].to_numpy()[row],
                             "score": np.concatenate([f[2] for f in found]), "copies": copies}).astype("int64")
    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int = 8192, block_queries: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of highest inner product for
    each query id among all rows of other ids; rows that share an id all count, as
    queries and as candidates.  ``vectors`` has ``vec_id`` and
    ``embedding``; ``is_query`` is a condition on ``vec_id``."""
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale).alias("q")).where("q is not null and vec_id is not null")
    n = sound.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, parts = max(1, -(-n[0] // block_rows)), max(1, -(-n[1] // block_queries))
    one = sound.groupBy("vec_id", "q").agg(F.count(F.lit(1)).alias("copies"))  # equal rows are looked at once
    deal = lambda m: F.pmod(F.xxhash64("vec_id", "q"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = one.withColumn("block", deal(blocks)).withColumn("part", every(parts))
    queries = one.where(is_query).withColumn("part", deal(parts)).withColumn("block", every(blocks))
    met = rows.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(_search(k), "query_id long, vec_id long, score long, copies long")
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
