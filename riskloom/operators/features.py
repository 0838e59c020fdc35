"""Label handling, code books, recodes, encoders and imputation.

Dictionaries are small fixed literals compiled into foldable ``map`` columns
(no join, no shuffle); data-dependent statistics (means, modes, encoder
domains) are aggregates — scalar subqueries or small grouped tables — never a
driver-side collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_literal(mapping: dict) -> Column:
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def codebook_lookup(c, codebook: dict, strict: bool = True) -> Column:
    """Code -> phrase.  Strict mode raises on an unknown (or NULL) code, as a
    dictionary lookup does; lenient mode returns NULL."""
    x = _c(c).cast("string")
    v = F.element_at(map_literal(codebook), x)
    if not strict:
        return v
    return F.when(v.isNull(), F.raise_error(F.concat(F.lit("unknown code: "), F.coalesce(x, F.lit("NULL"))))).otherwise(v)


def codebook_decode(df: DataFrame, columns: dict, strict: bool = True, suffix: str = "_text") -> DataFrame:
    """Decode several coded columns: ``{column: codebook}``."""
    for c, book in columns.items():
        df = df.withColumn(c + suffix, codebook_lookup(c, book, strict))
    return df


def recode(c, mapping: dict) -> Column:
    """Category -> group code; unmapped values become NULL."""
    return F.element_at(map_literal(mapping), _c(c).cast("string"))


def binarize_threshold(c, threshold) -> Column:
    """``<= t`` -> 0, ``> t`` -> 1, missing stays missing."""
    x = _c(c)
    return F.when(x <= F.lit(threshold), F.lit(0)).when(x > F.lit(threshold), F.lit(1))


def threshold_bucket(c, threshold) -> Column:
    """Group label ``'<= t'`` / ``'> t'``; NULL and NaN land in ``'> t'``."""
    x = _c(c)
    return F.when(x <= F.lit(threshold), F.lit(f"<= {threshold}")).otherwise(F.lit(f"> {threshold}"))


def label_encode(df: DataFrame, c: str, out: str, domain: Sequence | None = None) -> DataFrame:
    """Sorted distinct values -> 0..k-1 (binary string order).

    With a fixed ``domain`` the codes are a literal map (data independent);
    otherwise the domain is the distinct values of this table (a grouped
    aggregate), ranked over sampled cuts of the strings (no single-task window,
    any cardinality) and joined back — AQE broadcasts the code table when its
    measured size is small."""
    if domain is not None:
        return df.withColumn(out, recode(c, {v: i for i, v in enumerate(sorted(domain))}))
    from ..functions.ordering import global_rank
    codes = df.select(c).where(F.col(c).isNotNull()).distinct()
    codes = global_rank(codes, [c], out="_code").select(c, (F.col("_code") - 1).cast("int").alias(out))
    return df.join(codes, c, "left")


def answer_gold(label, positive: Sequence, choices: Sequence[str] = ("good", "bad")):
    """``(answer, choices, gold)``: positive labels -> choices[0], every other
    value (NULL included) -> choices[1]; gold = index of answer in choices."""
    x = _c(label)
    answer = F.when(x.isin(*positive), F.lit(choices[0])).otherwise(F.lit(choices[1]))
    ch = F.array(*[F.lit(c) for c in choices])
    gold = (F.array_position(ch, answer) - 1).cast("int")
    return answer, ch, gold


def filter_label_classes(df: DataFrame, c: str, classes: Sequence) -> DataFrame:
    """Keep the two label classes (NULL rejected)."""
    return df.where(F.col(c).isin(*classes))


def impute_clip(df: DataFrame, c: str, cap: float, low: float, out: str) -> DataFrame:
    """Cap values above ``cap``; replace values below ``low`` with the
    truncated mean of all capped values (a scalar subquery)."""
    x = F.col(c)
    capped = F.when(x > F.lit(cap), F.lit(cap).cast("double")).otherwise(x.cast("double"))
    t = df.withColumn("_capped", capped)
    mean_int = t.agg(F.avg("_capped")).scalar().cast("long")
    return t.withColumn(out, F.when(F.col("_capped") < F.lit(low), mean_int.cast("double")).otherwise(F.col("_capped"))).drop("_capped")


def impute_mode_mean(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (), suffix: str = "_imp") -> DataFrame:
    """NULL numeric -> column mean, NULL categorical -> most frequent value
    (ties -> smallest).  Both statistics are scalar subqueries."""
    for c in numeric:
        mean = df.agg(F.avg(c)).scalar()
        df = df.withColumn(c + suffix, F.coalesce(F.col(c).cast("double"), mean))
    for c in categorical:
        mode = (
            df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.desc("_n"), F.asc(c)).limit(1).select(c).scalar()
        )
        df = df.withColumn(c + suffix, F.coalesce(F.col(c), mode))
    return df
