"""Quality metrics and training-loss monitors as aggregates.

Every metric is a conditional sum inside one (partial, map-side combined)
aggregate; undefined ratios give 0 (F1, MCC, as the usual library convention)
or NULL (documented per function).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import range_cumsum


def confusion(truth: Column, pred: Column, positive) -> list[Column]:
    """tp, fp, fn, tn as BIGINT aggregate columns."""
    tp = F.count_if((truth == positive) & (pred == positive)).alias("tp")
    fp = F.count_if((truth != positive) & (pred == positive)).alias("fp")
    fn = F.count_if((truth == positive) & ((pred != positive) | pred.isNull())).alias("fn")
    tn = F.count_if((truth != positive) & ((pred != positive) | pred.isNull())).alias("tn")
    return [tp, fp, fn, tn]


def confusion_by(df: DataFrame, truth: str, pred: str, positive, by: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(truth), F.col(pred)
    return df.groupBy(*by).agg(*confusion(t, p, F.lit(positive)))


def f1_expr(tp="tp", fp="fp", fn="fn") -> Column:
    den = 2 * F.col(tp) + F.col(fp) + F.col(fn)
    return F.when(den == 0, F.lit(0.0)).otherwise(2.0 * F.col(tp) / den)


def mcc_expr(tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    tp_, fp_, fn_, tn_ = (F.col(x).cast("double") for x in (tp, fp, fn, tn))
    den = F.sqrt((tp_ + fp_) * (tp_ + fn_) * (tn_ + fp_) * (tn_ + fn_))
    return F.when(den == 0, F.lit(0.0)).otherwise((tp_ * tn_ - fp_ * fn_) / den)


def binary_metrics(df: DataFrame, truth: str, pred: str, positive, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, F1 (positive class), MCC, macro-F1 per group, from one pass."""
    c = confusion_by(df, truth, pred, positive, by)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    f1_neg = f1_expr("tn", "fn", "fp")
    return c.select(
        *by,
        n.alias("n"),
        F.when(n == 0, None).otherwise((F.col("tp") + F.col("tn")) / n).alias("accuracy"),
        f1_expr().alias("f1"),
        ((f1_expr() + f1_neg) / 2).alias("macro_f1"),
        mcc_expr().alias("mcc"),
    )


def cost_weighted_error(df: DataFrame, truth: str, pred: str, positive, fp_cost=5.0, fn_cost=1.0,
                        by: Sequence[str] = ()) -> DataFrame:
    """Asymmetric cost: predicting positive for a negative costs ``fp_cost``,
    the reverse ``fn_cost``."""
    c = confusion_by(df, truth, pred, positive, by)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    cost = F.col("fp") * F.lit(fp_cost) + F.col("fn") * F.lit(fn_cost)
    return c.select(*by, n.alias("n"), cost.alias("total_cost"),
                    F.when(n == 0, None).otherwise(cost / n).alias("mean_cost"))


def weighted_mean(df: DataFrame, metric: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """``sum(m*n)/sum(n)`` (NULL when the weights sum to 0)."""
    m, w = F.col(metric).cast("double"), F.col(weight).cast("double")
    return df.groupBy(*by).agg((F.sum(m * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("weighted_mean"))


def perplexity(df: DataFrame, loss: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean loss and ``exp(mean)`` (overflow gives Infinity, no error)."""
    return df.groupBy(*by).agg(F.avg(loss).alias("mean_loss"), F.exp(F.avg(loss)).alias("perplexity"))


def running_mean(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), out: str = "running_mean",
                 scale: int | None = None, digits: int = 6) -> DataFrame:
    """Incremental mean over an order (distributed prefix sums, one shuffle).

    With ``scale`` (the number of decimals the values carry) the sums are
    exact integers of ``10^-scale`` units and the mean is rounded half-up to
    ``digits`` decimals with integer division, so the result does not depend
    on the summation order (floating sums do, in the last bits)."""
    if scale is None:
        t = range_cumsum(df, {"_sum": F.col(value).cast("double"), "_cnt": F.lit(1).cast("long")}, order, by)
        return t.withColumn(out, F.col("_sum") / F.col("_cnt")).drop("_sum", "_cnt")
    units = F.round(F.col(value) * F.lit(10 ** scale)).cast("long")
    # a value with more decimals than declared is an error, never cut
    exact = F.col(value).isNull() | (units / F.lit(float(10 ** scale)) == F.col(value).cast("double"))
    units = F.when(exact, units).otherwise(F.raise_error(F.lit(f"running_mean: a value has more than {scale} decimals")).cast("long"))
    t = range_cumsum(df, {"_sum": units, "_cnt": F.lit(1).cast("long")}, order, by)
    mag = F.abs(F.col("_sum")) * F.lit(2 * 10 ** (digits - scale)) + F.col("_cnt")
    t = t.withColumn("_mag", mag).withColumn("_q", F.expr("_mag div (2 * _cnt)") * F.signum("_sum").cast("long"))
    return t.withColumn(out, F.col("_q") / F.lit(float(10 ** digits))).drop("_sum", "_cnt", "_mag", "_q")


def block_mean(df: DataFrame, value: str, epoch: str, step: str, every: int) -> DataFrame:
    """Mean of the values since the last report, reported when
    ``(step+1) % every == 0``; leftovers of an epoch carry into the next
    epoch's first block, the tail after the last report is not reported.

    block id = number of report flags strictly before the row (a distributed
    prefix sum); then a grouped mean of the blocks that end on a flag."""
    flag = ((F.col(step) + 1) % every == 0).cast("long")
    t = df.withColumn("_flag", flag)
    # one numeric order key (epoch, step) so the prefix sum can bucket on it
    t = t.withColumn("_order", F.col(epoch).cast("long") * F.lit(1 << 32) + F.col(step).cast("long"))
    t = range_cumsum(t, "_flag", ["_order"], out="_block", inclusive=False)
    g = t.groupBy("_block").agg(F.avg(value).alias("mean_loss"), F.count(F.lit(1)).alias("n"),
                                 F.max("_flag").alias("_closed"))
    return g.where(F.col("_closed") == 1).select(F.col("_block").alias("block_no"), "mean_loss", "n")


def topk(df: DataFrame, order: Sequence, k: int, by: Sequence[str] = (), out: str = "rnk") -> DataFrame:
    """Leaderboard: best ``k`` by metric (ties: earlier step first)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


# Metric registry: name -> function(truth Column, pred Column, positive) ->
# aggregate Column.  Callers pick metrics by name (the pluggable metric
# callback of a training loop becomes a named aggregate).
def _acc(t, p, pos):
    return F.avg(F.when(t == p, 1.0).otherwise(0.0))


def _f1(t, p, pos):
    tp = F.count_if((t == pos) & (p == pos))
    den = 2 * tp + F.count_if((t != pos) & (p == pos)) + F.count_if((t == pos) & ((p != pos) | p.isNull()))
    return F.when(den == 0, F.lit(0.0)).otherwise(2.0 * tp / den)


def _mcc(t, p, pos):
    tp = F.count_if((t == pos) & (p == pos)).cast("double")
    fp = F.count_if((t != pos) & (p == pos)).cast("double")
    fn = F.count_if((t == pos) & ((p != pos) | p.isNull())).cast("double")
    tn = F.count_if((t != pos) & ((p != pos) | p.isNull())).cast("double")
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den)


METRICS = {"accuracy": _acc, "f1": _f1, "mcc": _mcc}


def evaluate(df: DataFrame, truth: str, pred: str, positive, names=("accuracy", "f1", "mcc"),
             by: Sequence[str] = ()) -> DataFrame:
    """Compute registered metrics by name in one aggregate."""
    t, p, pos = F.col(truth), F.col(pred), F.lit(positive)
    return df.groupBy(*by).agg(*[METRICS[n](t, p, pos).alias(n) for n in names])


def average_precision(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    """Area under the precision-recall curve as average precision:
    ``sum_k (R_k - R_{k-1}) * P_k`` over score thresholds (ties grouped),
    highest score first.  Per-score counts are a partial aggregate; the
    cumulative counts a bucketed prefix sum, which also gives the number of
    positives.  Returns one row ``average_precision`` (NULL without positives)."""
    pos = F.col(label) == F.lit(positive)
    per_score = df.groupBy(F.col(score).alias("_s")).agg(
        F.count_if(pos).alias("_tp"), F.count_if(~pos).alias("_fp")).withColumn("_neg", -F.col("_s"))
    cum = range_cumsum(per_score, {"_ctp": F.col("_tp"), "_cfp": F.col("_fp")}, ["_neg"], total_out="_pos")
    term = F.col("_tp") / F.nullif("_pos", F.lit(0)) * F.col("_ctp") / (F.col("_ctp") + F.col("_cfp"))
    return cum.agg(F.sum(term).alias("average_precision"))
