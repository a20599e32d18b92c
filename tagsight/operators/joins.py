"""Joins between runs, id lists, pools and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from .metrics import with_cohort

SHARED = ("dataset_name", "text", "true_label", "meta_json")
PER_RUN = (
    "pred_label", "confidence", "reason", "in_tokens", "out_tokens", "is_confusing", "n_pred_labels",
    "pred_labels",
)


def run_overlap(preds: DataFrame, runs: list[str]) -> DataFrame:
    """Ids per run and how many of them the first run has too."""
    first = preds.filter(F.col("run_id") == runs[0]).select("sample_id", F.lit(True).alias("_in"))
    return (
        preds.filter(F.col("run_id").isin(runs))
        .select("run_id", "sample_id")
        .join(first, "sample_id", "left")
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("n_ids"), F.count("_in").alias("n_overlap"))
    )


def compare_runs_wide(preds: DataFrame, runs: list[str], how: str = "inner") -> DataFrame:
    """One row per sample, one column group per run, shared columns once.

    A single aggregate instead of n joins.  The result is empty when the runs
    belong to different datasets.
    """
    shared = [c for c in SHARED if c in preds.columns]
    per = [c for c in PER_RUN if c in preds.columns]
    src = preds.filter(F.col("run_id").isin(runs))
    cols = [
        F.max(F.when(F.col("run_id") == r, F.col(c))).alias(f"{c}__{r}") for r in runs for c in per
    ]
    wide = src.groupBy("sample_id").agg(
        *[F.min_by(c, "run_id").alias(c) for c in shared],
        F.count_distinct("run_id").alias("n_runs"),
        *cols,
    )
    if how == "inner":
        wide = wide.filter(F.col("n_runs") == len(runs))
    elif how != "outer":
        raise ValueError("how must be 'inner' or 'outer'")
    if "dataset_name" in shared:
        kinds = src.agg(F.count_distinct("dataset_name")).scalar()
        wide = wide.filter(kinds <= 1)
    return wide.drop("n_runs")


def paired(preds: DataFrame, a: str, b: str, *, dataset: Column | str | None = None) -> DataFrame:
    """Inner join of two runs on the sample with both outcomes."""
    keep = ["sample_id", "true_label", "pred_label"]
    ok = L.labels_equal(F.col("true_label"), F.col("pred_label"), dataset)
    left = preds.filter(F.col("run_id") == a).select(*keep, ok.alias("ok_a")).withColumnRenamed("pred_label", "pred_a")
    right = preds.filter(F.col("run_id") == b).select(
        "sample_id", F.col("pred_label").alias("pred_b"), ok.alias("ok_b")
    )
    return left.join(right, "sample_id")


def compare_two_runs(preds: DataFrame, a: str, b: str, *, dataset: Column | str | None = None) -> DataFrame:
    """Agreement, accuracies and flips of two runs."""
    both = paired(preds, a, b, dataset=dataset)
    same = F.coalesce(F.col("pred_a") == F.col("pred_b"), F.col("pred_a").isNull() & F.col("pred_b").isNull())
    acc_a, acc_b = F.avg(F.col("ok_a").cast("double")), F.avg(F.col("ok_b").cast("double"))
    lost, won = F.count_if(F.expr("ok_a AND NOT ok_b")), F.count_if(F.expr("NOT ok_a AND ok_b"))
    return both.agg(
        F.count(F.lit(1)).alias("n_overlap"),
        F.avg(same.cast("double")).alias("pred_agreement"),
        F.count_if(~same).alias("pred_disagree_n"),
        acc_a.alias("accuracy_a"),
        acc_b.alias("accuracy_b"),
        (acc_b - acc_a).alias("accuracy_delta"),
        lost.alias("a_correct_b_wrong"),
        won.alias("a_wrong_b_correct"),
        (lost + won).alias("flipped_n"),
    )


def paired_rows(preds: DataFrame, run: str, baseline: str) -> DataFrame:
    """One run next to its baseline, row by row."""
    return compare_runs_wide(preds, [baseline, run], "inner")


def pair_with_baseline(runs: DataFrame, baselines: DataFrame, *, preferred_bs: int = 10) -> DataFrame:
    """Each run with the baseline of its dataset, model, thinking level and tier.

    The baseline has the preferred batch size, otherwise the best macro F1.
    """
    key = ["dataset_name", "model_id", "thinking_level", "tier_size"]
    order = W.partitionBy(*key).orderBy(
        F.desc(F.coalesce(F.col("batch_size") == preferred_bs, F.lit(False))),
        F.desc_nulls_last("f1_macro"),
        "run_key",
    )
    best = (
        baselines.withColumn("_p", F.row_number().over(order))
        .filter("_p = 1")
        .select(
            *[F.col(k).alias(f"_{k}") for k in key],
            F.col("run_key").alias("baseline_key"),
            F.col("batch_size").alias("baseline_batch_size"),
            F.col("f1_macro").alias("baseline_f1"),
            F.col("accuracy").alias("baseline_accuracy"),
        )
    )
    cond = reduce(lambda a, b: a & b, [runs[k].eqNullSafe(best[f"_{k}"]) for k in key])
    return runs.join(best, cond, "left").select(
        *key,
        "run_key",
        "model_kind",
        F.col("f1_macro").alias("run_f1"),
        F.col("accuracy").alias("run_accuracy"),
        F.col("baseline_key").isNotNull().alias("matched"),
        "baseline_key",
        "baseline_batch_size",
        "baseline_f1",
        "baseline_accuracy",
        (F.col("f1_macro") - F.col("baseline_f1")).alias("delta_f1"),
        (F.col("accuracy") - F.col("baseline_accuracy")).alias("delta_accuracy"),
    )


def exclude_ids(df: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose id is not listed (left anti join)."""
    return df.join(ids.select(key), key, "left_anti")


def select_ids(df: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose id is listed (left semi join)."""
    return df.join(ids.select(key), key, "left_semi")


def select_in_order(df: DataFrame, ids: list[str] | DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows in the order of ``ids``, a list or a table (position, id); fails when one is missing."""
    wanted = ids
    if isinstance(ids, list):
        wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"position bigint, {key} string")
    missing = wanted.join(df.select(key), key, "left_anti").orderBy("position").limit(5).collect()
    if missing:
        raise KeyError(f"ids not found: {[r[key] for r in missing]}")
    return wanted.join(df, key).orderBy("position")


def edge_ids(edges: DataFrame) -> DataFrame:
    """Every anchor and contrast id of an edge table, once."""
    return edges.select(
        F.explode(F.array("anchor_sample_id", "contrast_sample_id")).alias("sample_id")
    ).distinct()


def operating_frame(pool: DataFrame, centroids: DataFrame, preds: DataFrame, edges: DataFrame) -> DataFrame:
    """Pool rows that are centroid, anchor or contrast; predictions only for centroids."""
    cent = centroids.select("sample_id").distinct().withColumn("_c", F.lit(True))
    ids = cent.select("sample_id").union(edge_ids(edges)).distinct()
    once = preds.groupBy("sample_id").agg(
        F.min(F.struct("pred_label", "correct")).alias("_p")
    )
    is_c = F.col("_c").isNotNull()
    return (
        select_ids(pool, ids)
        .join(cent, "sample_id", "left")
        .join(once, "sample_id", "left")
        .withColumn("pred_label", F.when(is_c, F.col("_p.pred_label")))
        .withColumn("correct", is_c & F.coalesce("_p.correct", F.lit(False)))
        .drop("_c", "_p")
    )


def labelled_frame(preds: DataFrame, edges: DataFrame, *, dataset_name: str) -> DataFrame:
    """Predictions plus contrast partners that have none; the prediction row wins."""
    extra = (
        edges.filter(F.length(L.strip(F.coalesce("contrast_text", F.lit("")))) > 0)
        .groupBy(F.col("contrast_sample_id").alias("sample_id"))
        .agg(F.min(F.struct("contrast_text", "contrast_true_label")).alias("e"))
        .select(
            "sample_id",
            F.lit(dataset_name).alias("dataset_name"),
            F.col("e.contrast_text").alias("text"),
            F.col("e.contrast_true_label").alias("true_label"),
            F.lit(None).cast("string").alias("pred_label"),
            F.lit(False).alias("correct"),
        )
    )
    keep = ["sample_id", "dataset_name", "text", "true_label", "pred_label", "correct"]
    base = preds.groupBy("sample_id").agg(F.min(F.struct(*keep[1:])).alias("b")).select("sample_id", "b.*")
    return base.unionByName(exclude_ids(extra, base))


def wide_votes(long: DataFrame, models: list[str], key: list[str]) -> DataFrame:
    """Distinct samples with one prediction column per model."""
    return long.groupBy(*key).agg(
        *[F.max(F.when(F.col("model") == m, F.col("pred_label"))).alias(m) for m in models]
    )


def align_runs_by_gold(long: DataFrame, *, reference: str, runs: list[str]) -> DataFrame:
    """Rows common to all runs, for runs whose gold equals the reference run's gold everywhere."""
    n = len(runs)
    src = long.filter(F.col("run_id").isin(runs))
    rows = src.groupBy("i").agg(
        F.count_distinct("run_id").alias("k"),
        *[F.max(F.when(F.col("run_id") == r, F.col("gold"))).alias(f"gold__{r}") for r in runs],
        *[F.max(F.when(F.col("run_id") == r, F.col("pred"))).alias(f"pred__{r}") for r in runs],
    ).filter(F.col("k") == n)
    ref = F.col(f"gold__{reference}")
    ok = rows.agg(
        F.array(
            *[F.coalesce(F.bool_and(F.coalesce(F.col(f"gold__{r}") == ref, F.lit(False))), F.lit(False)) for r in runs]
        )
    ).scalar()
    return rows.withColumn("_ok", ok).select(
        "i",
        ref.alias("gold"),
        *[F.when(F.col("_ok")[k], F.col(f"pred__{r}")).alias(f"pred__{r}") for k, r in enumerate(runs)],
        F.filter(
            F.array(*[F.when(F.col("_ok")[k], F.lit(r)) for k, r in enumerate(runs)]), lambda x: x.isNotNull()
        ).alias("aligned_runs"),
    )


def cohort_join(new: DataFrame, base: DataFrame, texts: DataFrame) -> DataFrame:
    """A run and its baseline on the sample, texts attached, cohort named."""
    pairs = new.select("sample_id", "true_label", F.col("pred_label").alias("new_pred")).join(
        base.select("sample_id", F.col("pred_label").alias("base_pred")), "sample_id"
    )
    ok = lambda c: F.coalesce(F.col(c) == F.col("true_label"), F.lit(False))
    return with_cohort(
        pairs.join(texts.select("sample_id", "text"), "sample_id", "left").withColumns(
            {"new_ok": ok("new_pred"), "base_ok": ok("base_pred")}
        )
    )


def attach_flags(result: DataFrame, flags: DataFrame, key: str = "sample_id") -> DataFrame:
    """Issue flags by row; rows without a flag get False."""
    names = [c for c in flags.columns if c != key]
    return result.join(flags, key, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in names if dict(flags.dtypes)[c] == "boolean"}
    )


def attach_predictions_to_batches(batches: DataFrame, preds: DataFrame) -> DataFrame:
    """Write predictions keyed by the running item number into the nested batch rows.

    Batches have a fixed size, so the lists stay short.
    """
    rows = batches.select("batch_id", F.inline("sentences"))
    joined = rows.join(preds.select("sample_id", "pred_label"), "sample_id", "left")
    return joined.groupBy("batch_id").agg(
        F.array_sort(
            F.collect_list(F.struct("position", "sample_id", "text", "gold", "pred_label"))
        ).alias("sentences")
    )


def group_context(df: DataFrame, key: str, order: str, *, text: str = "text", sep: str = " ") -> DataFrame:
    """The sentences of a group joined in order and mapped back to each row.

    The context of a group is one string by definition, so a group's text must fit into one; it is never cut.
    """
    ctx = df.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), sep
        ).alias("context")
    )
    return df.join(ctx, key)
