"""Document fingerprints: one-permutation MinHash with optimal densification,
packed low-order bits and a bias-corrected likeness.

The 5-word shingles of a text are hashed once; the top bits of a hash choose
its bin, the rest is its value, and each bin keeps its minimum.  An empty bin
copies a bin that a fixed sequence of hashes of (bin, attempt) reaches first
(optimal densification), so equal texts agree in every bin.  The lowest
``BITS`` bits of each bin are packed; two different values agree in them by
chance with probability 2^-BITS, which ``likeness`` takes off.

Defined results: null and empty texts (and texts of white space only) have no
shingle and the empty fingerprint, which is like itself (1.0) and unlike any
other (0.0); a text of one to four words is one shingle; very long texts are
hashed whole, in bounded runs; repeated rows and ties get equal fingerprints;
an empty table gives an empty result.  ``with_next`` orders rows by ``doc_id``
(nulls first), equal ids by text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import BinaryType, DoubleType

from ..functions.ordering import MOST_CUTS, with_bucket
from .common import materialise
from .shingles import U, batches, mix

BINS, BITS, WORDS = 256, 8, 5
#: letters of a text that order rows of one id before the whole text does
HEAD = 64
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def _targets(attempt: int, bins: int, tables: dict = {}) -> np.ndarray:  # noqa: B006 - kept on purpose
    """The bin that each bin tries at this attempt: a fixed hash of both."""
    if (attempt, bins) not in tables:
        tables[attempt, bins] = (mix((np.arange(bins, dtype=U) << U(32)) + U(attempt)) >> U(40)).astype(np.int64) % bins
    return tables[attempt, bins]


def densify(m: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a full one; ``m`` is rows x bins."""
    bins = m.shape[1]
    full = m != EMPTY
    row, at = np.nonzero(~full & full.any(axis=1)[:, None])
    out, attempt = m.copy(), 0
    while len(row):
        to = _targets(attempt, bins)[at]
        hit = full[row, to]
        out[row[hit], at[hit]] = m[row[hit], to[hit]]
        row, at = row[~hit], at[~hit]
        attempt += 1
    return out


def sketch(texts: pa.Array, bins: int = BINS, bits: int = BITS, k: int = WORDS) -> list[bytes]:
    """Packed fingerprints; ``bins`` is a power of two, ``bits`` at most 8."""
    shift = U(64 - bins.bit_length() + 1)
    out: list[bytes] = []
    for lo, hi, h, doc, _, counts, _ in batches(texts, k):
        m = np.full((hi - lo) * bins, EMPTY, U)
        np.minimum.at(m, doc * bins + (h >> shift).astype(np.int64), h & ((U(1) << shift) - U(1)))
        m = densify(m.reshape(hi - lo, bins))
        low = (m & U((1 << bits) - 1)).astype(np.uint8)
        packed = np.packbits(np.unpackbits(low[:, :, None], axis=2, bitorder="little", count=bits).reshape(hi - lo, -1), axis=1, bitorder="little")
        out += [packed[i].tobytes() if counts[i] else b"" for i in range(hi - lo)]
    return out


@arrow_udf(BinaryType())
def fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array(sketch(texts), pa.binary())


def match(a: bytes, b: bytes, bits: int = BITS) -> float:
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if bits == 8:
        same = float((x[0] == x[1]).mean())
    else:
        u, v = (np.unpackbits(y, bitorder="little").reshape(-1, bits) for y in x)
        same = float((u == v).all(axis=1).mean())
    chance = 2.0 ** -bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


@pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bias-corrected estimate of the Jaccard likeness of two fingerprints."""
    return pd.Series([match(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def in_ranges(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``df`` with ``cut_, part_`` (its range) and ``head_``; the number of rows."""
    keyed = with_bucket(df.withColumn("head_", F.substring("text", 1, HEAD)), ["doc_id", "head_"], out="cut_")
    stats = keyed.groupBy("cut_").agg(F.min("doc_id").alias("lo_"), F.max("doc_id").alias("hi_"), F.count(F.lit(1)).alias("n_"))
    stats = materialise(stats, "id-cuts")  # MOST_CUTS + 1 rows at most
    n = stats.agg(F.sum("n_")).first()[0] or 0
    width = F.greatest(F.ceil((F.col("hi_") - F.col("lo_") + 1) * F.lit(float(rows)) / F.col("n_")), F.lit(1))
    part = F.coalesce(F.floor((F.col("doc_id") - F.col("lo_")) / width).cast("long"), F.lit(-1).cast("long"))
    return keyed.join(F.broadcast(stats), "cut_").withColumn("part_", part).drop("lo_", "hi_", "n_"), n


def range_sizes(df: DataFrame, rows: int = 1024) -> list[int]:
    """Rows of each range: for tests and a look at the spread of ids."""
    return [r.n for r in in_ranges(df, rows)[0].groupBy("cut_", "part_").agg(F.count(F.lit(1)).alias("n")).collect()]


def with_next(df: DataFrame, columns: dict[str, str], rows: int = 1024, max_broadcast: int = 200_000) -> DataFrame:
    """Add, for ``{new: column}``, the column of the next row by ``doc_id`` (after
    the last: the first).  ``df`` has ``doc_id`` and ``text``; what follows from
    the text is better made after this than moved with it.

    Rows are dealt into ranges of about ``rows`` rows: stretches between sampled
    cuts of (``doc_id``, the text's head), whatever the ids' spread, nulls or
    repeats, and each of those into parts of equal id width.  The first row of
    each range is also sent to the range before it as a guest, so no window spans
    more than one range.  The ranges' heads are a narrow table of one row per range;
    it is broadcast if their number, which the count bounds, is at most
    ``max_broadcast``, and else joined by a shuffle."""
    dealt, n = in_ranges(df, rows)
    heads = dealt.select("cut_", "part_", "doc_id", "head_").groupBy("cut_", "part_").agg(F.min(F.struct("doc_id", "head_")).alias("first_"))
    line, cuts = Window.orderBy("cut_"), Window.partitionBy()  # of the cuts, MOST_CUTS + 1 at most
    last = heads.groupBy("cut_").agg(F.max("part_").alias("last_"))
    end = F.max(F.struct("cut_", "last_")).over(cuts)
    last = last.select(F.col("cut_").alias("at_"), F.coalesce(F.lag(F.struct("cut_", "last_")).over(line), end).alias("before_"))
    within = Window.partitionBy("cut_").orderBy("part_")
    heads = heads.join(F.broadcast(last), F.col("cut_") == F.col("at_")).withColumn("prior_", F.lag("part_").over(within))
    to = lambda own, far: F.when(F.col("prior_").isNotNull(), F.col(own)).otherwise(F.col(f"before_.{far}"))
    heads = heads.select(F.col("first_.doc_id").alias("f_id"), F.col("first_.head_").alias("f_head"), to("cut_", "cut_").alias("to_cut"), to("prior_", "last_").alias("to_part"))
    if n // rows + 2 * (MOST_CUTS + 1) <= max_broadcast:
        heads = F.broadcast(heads)
    guests = dealt.drop("cut_", "part_").join(heads, dealt.doc_id.eqNullSafe(heads.f_id) & dealt["head_"].eqNullSafe(heads.f_head))
    guests = guests.withColumnsRenamed({"to_cut": "cut_", "to_part": "part_"}).drop("f_id", "f_head")
    both = dealt.withColumn("guest_", F.lit(False)).unionByName(guests.withColumn("guest_", F.lit(True)))
    by = Window.partitionBy("cut_", "part_").orderBy("guest_", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return (both.select("*", *[F.lead(c).over(by).alias(n) for n, c in columns.items()])
            .where(~F.col("guest_")).drop("cut_", "part_", "guest_", "head_"))


def edited(text: Column, after: Column) -> Column:
    """The last floor(n/4) code points replaced by the first as many of ``after``."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(after, F.lit(1), cut))


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they
    (and the next document) look by their fingerprints."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(own, {"after": "text"}).withColumn("edit", edited(F.col("text"), F.col("after")))
    out = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"),
                      fingerprint("text").alias("print"), fingerprint("after").alias("next_print"), fingerprint("edit").alias("edit_print"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edit_print")).alias("edited_fingerprint"),
                      likeness("print", "edit_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"))
