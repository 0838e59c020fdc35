"""Group fairness metrics in one aggregate pass.

Rows whose protected value is in neither group are ignored.  An empty group
or a zero denominator gives NULL (not nan/inf).  Groups are few, so the
metrics are conditional sums over a partial aggregate — never a window
partitioned by the (possibly hot) group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs import FairnessSpec


def _is(c: Column, v) -> Column:
    return c == F.lit(v)


def base_rates(df: DataFrame, label: str, favorable, group: str) -> DataFrame:
    """P(label = favorable) per protected group value."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(_is(F.col(label), favorable), 1.0).otherwise(0.0)).alias("base_rate"),
    )


def _rate(cond: Column, given: Column) -> Column:
    num = F.count_if(cond & given)
    den = F.count_if(given)
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(num / den)


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b.isNull() | (b == 0), F.lit(None).cast("double")).otherwise(a / b)


def disparate_impact(df: DataFrame, label: str, spec: FairnessSpec) -> Column:
    """Aggregate column: base_rate(unprivileged) / base_rate(privileged)."""
    g = F.col(spec.protected_col)
    fav = _is(F.col(label), spec.favorable)
    return _safe_div(_rate(fav, _is(g, spec.unprivileged)), _rate(fav, _is(g, spec.privileged)))


def rate_columns(spec: FairnessSpec, truth: str, pred: str) -> list[Column]:
    """TPR / FPR per group (positive = favorable label) as aggregate columns."""
    g = F.col(spec.protected_col)
    t_pos = _is(F.col(truth), spec.favorable)
    p_pos = _is(F.col(pred), spec.favorable)
    cols = []
    for name, grp in (("u", spec.unprivileged), ("p", spec.privileged)):
        in_g = _is(g, grp)
        cols.append(_rate(p_pos, in_g & t_pos).alias(f"tpr_{name}"))
        cols.append(_rate(p_pos, in_g & ~t_pos).alias(f"fpr_{name}"))
    return cols


def fairness_metrics(df: DataFrame, spec: FairnessSpec, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """DI (truth and prediction), EOD, AOD in one aggregate."""
    agg = df.groupBy(*by).agg(
        disparate_impact(df, truth, spec).alias("di_truth"),
        disparate_impact(df, pred, spec).alias("di_pred"),
        *rate_columns(spec, truth, pred),
    )
    eod = F.col("tpr_u") - F.col("tpr_p")
    aod = ((F.col("fpr_u") - F.col("fpr_p")) + (F.col("tpr_u") - F.col("tpr_p"))) / 2
    return agg.select(*by, "di_truth", "di_pred", eod.alias("eod"), aod.alias("aod"))


def fairness_report(df: DataFrame, specs: Sequence[FairnessSpec], truth: str, pred: str) -> DataFrame:
    """Long report ``(metric, attribute, value)`` over several protected
    attributes: each row is exploded once to its ``(attribute, group)`` pairs, so
    the input is read once and one grouped aggregate serves all of them."""
    pairs = F.array(*[F.struct(
        F.lit(s.protected_col).alias("attribute"),
        F.when(_is(F.col(s.protected_col), s.unprivileged), F.lit("u")).when(_is(F.col(s.protected_col), s.privileged), F.lit("p")).alias("_g"),
        F.lit(str(s.favorable)).alias("_fav")) for s in specs])
    long = df.select(F.col(truth).alias("_t"), F.col(pred).alias("_p"), F.inline(pairs)).where(F.col("_g").isNotNull())
    fav_t = F.col("_t").cast("string") == F.col("_fav")
    fav_p = F.col("_p").cast("string") == F.col("_fav")

    def rate(cond, given):
        return F.when(F.count_if(given) == 0, F.lit(None).cast("double")).otherwise(F.count_if(cond & given) / F.count_if(given))

    u, p = F.col("_g") == "u", F.col("_g") == "p"
    agg = long.groupBy("attribute").agg(
        rate(fav_p, u).alias("sr_u"), rate(fav_p, p).alias("sr_p"),
        rate(fav_p, u & fav_t).alias("tpr_u"), rate(fav_p, p & fav_t).alias("tpr_p"),
        rate(fav_p, u & ~fav_t).alias("fpr_u"), rate(fav_p, p & ~fav_t).alias("fpr_p"),
    )
    di = _safe_div(F.col("sr_u"), F.col("sr_p"))
    eod = F.col("tpr_u") - F.col("tpr_p")
    aod = ((F.col("fpr_u") - F.col("fpr_p")) + (F.col("tpr_u") - F.col("tpr_p"))) / 2
    return agg.select(
        "attribute",
        F.explode(F.array(
            F.struct(F.lit("DI").alias("metric"), di.alias("value")),
            F.struct(F.lit("EOD").alias("metric"), eod.alias("value")),
            F.struct(F.lit("AOD").alias("metric"), aod.alias("value")),
        )).alias("m"),
    ).select("m.metric", "attribute", "m.value")
