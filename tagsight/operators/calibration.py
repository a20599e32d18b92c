"""Reliability of confidences and ranking quality of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S
from ..plans.lineage import durable
from ..plans.order import join_on, value_counts_below, value_ranks


def calibration_bins(
    preds: DataFrame,
    by: list[str],
    *,
    n_bins: int = 10,
    min_count: int = 1,
    raw: bool = False,
    dataset: Column | str | None = None,
) -> DataFrame:
    """Confidence against accuracy in right-closed bins; 0.0 belongs to the first bin."""
    conf = S.clip01(F.col("confidence").try_cast("double"))
    if raw:
        right = F.coalesce(F.col("pred_label") == F.col("true_label"), F.lit(False))
    else:
        right = L.labels_equal(F.col("true_label"), F.col("pred_label"), dataset)
    rows = preds.select(*by, conf.alias("c"), right.alias("ok")).filter("c IS NOT NULL AND NOT isnan(c)")
    slot = F.greatest(F.lit(1), F.least(F.lit(n_bins), F.ceil(F.round(F.col("c") * n_bins, 12)).cast("int")))
    return (
        rows.groupBy(*by, slot.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("c").alias("avg_conf"),
            F.avg(F.col("ok").cast("double")).alias("accuracy"),
        )
        .withColumn("abs_gap", F.abs(F.col("avg_conf") - F.col("accuracy")))
        .filter(F.col("n") >= min_count)
    )


def ece(preds: DataFrame, by: list[str], **kw) -> DataFrame:
    """Count-weighted mean gap over the bins."""
    return calibration_bins(preds, by, **kw).groupBy(*by).agg(
        (F.sum(F.col("n") * F.col("abs_gap")) / F.sum("n")).alias("ece")
    )


def roc_auc(df: DataFrame, by: list[str], *, score: str, truth: str) -> DataFrame:
    """Rank AUC from per-value counts (Mann-Whitney with ties at half)."""
    flag = F.col(truth).cast("boolean")
    vals = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(flag).alias("pos"), F.count_if(~flag).alias("neg")
    )
    ranked = value_counts_below(df, by=by, value=score)
    joined = join_on(ranked, vals, [*by, score])
    mean_rank = F.col("n_below") + (F.col("n_equal") + 1) / 2
    np_, nn = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    u = F.sum(F.col("pos") * mean_rank) - np_ * (np_ + 1) / 2
    return joined.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        (u / F.nullif(np_ * nn, F.lit(0.0))).alias("roc_auc"),
    )


def spearman(df: DataFrame, by: list[str], *, x: str, y: str, id_col: str) -> DataFrame:
    """Rank correlation with averaged ties."""
    src = df.select(*by, id_col, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(
        "x IS NOT NULL AND y IS NOT NULL"
    )
    rx = value_ranks(src, by=by, value="x", id_col=id_col).select(
        *by, id_col, "y", F.col("avg_rank").alias("rx")
    )
    rx = durable(rx)  # the second ranking reads it three times
    rxy = value_ranks(rx, by=by, value="y", id_col=id_col)
    return rxy.groupBy(*by).agg(F.corr("rx", "avg_rank").alias("spearman_r"))


def point_biserial(df: DataFrame, by: list[str], *, score: str, truth: str) -> DataFrame:
    """Pearson correlation of a score with a boolean."""
    return df.groupBy(*by).agg(
        F.corr(F.col(score).cast("double"), F.col(truth).cast("double")).alias("point_biserial")
    )
