"""Whole evaluations composed from the operators: reports, leaderboards, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S
from ..operators import agreement as A
from ..operators import metrics as M
from ..operators.calibration import ece
from ..operators.ranking import leaderboard_sort, merge_leaderboard
from ..operators.votes import vote_metrics
from .order import join_on


def flatten_prediction(df: DataFrame, *, pred: str = "prediction") -> DataFrame:
    """Nested prediction to flat columns; fields kept in ``raw`` JSON are lifted out,
    committee members as one array instead of numbered columns."""
    raw = F.col(f"{pred}.raw")
    keep = [c for c in df.columns if c != pred]
    debate = {f"{s}_{k}": F.get_json_object(raw, f"$.{s}_{k}") for s in "ab" for k in ("label", "conf", "reasoning")}
    debate |= {k: v.try_cast("double") for k, v in debate.items() if k.endswith("_conf")}
    return df.select(
        *keep,
        F.col(f"{pred}.pred_label").alias("pred_label"),
        F.col(f"{pred}.confidence").alias("confidence"),
        F.col(f"{pred}.reason").alias("reason"),
        F.col(f"{pred}.probs").alias("probs"),
        F.col(f"{pred}.usage.in_tokens").alias("in_tokens"),
        F.col(f"{pred}.usage.out_tokens").alias("out_tokens"),
        F.get_json_object(raw, "$.is_confusing").try_cast("boolean").alias("is_confusing"),
        F.from_json(F.get_json_object(raw, "$.pred_labels"), "array<string>").alias("pred_labels"),
        F.get_json_object(raw, "$.n_pred_labels").try_cast("int").alias("n_pred_labels"),
        *[v.alias(k) for k, v in debate.items()],
        F.from_json(
            F.get_json_object(raw, "$.committee.members"), "array<struct<name:string,pred_label:string>>"
        ).alias("members"),
        F.get_json_object(raw, "$.committee.majority").alias("pred_label_majority"),
    )


def add_correct(preds: DataFrame, *, dataset: Column | str | None = None) -> DataFrame:
    """Clean prediction labels and one ``correct`` column for all runs."""
    confusing = F.col("is_confusing") if "is_confusing" in preds.columns else F.lit(False)
    return preds.withColumn("pred_label", L.norm_label(F.col("pred_label"))).withColumn(
        "correct", L.is_correct(F.col("true_label"), F.col("pred_label"), confusing, dataset)
    )


def evaluate(preds: DataFrame, by: list[str], *, dataset: Column | str | None = None) -> DataFrame:
    """One report row per run: scores, confusion statistics, probabilities and token usage."""
    perf = M.performance_excluding_confused(preds, by, dataset=dataset)
    out = join_on(perf, M.probs_summary(preds, by), by, "left")
    return join_on(out, M.usage_summary(preds, by), by, "left")


def report_struct(report: DataFrame, by: list[str]) -> DataFrame:
    """The nested layout of a report file."""
    return report.select(
        *by,
        F.struct("f1_macro", "accuracy", "f1_weighted").alias("metrics"),
        F.struct(
            F.struct(
                "n_total", "n_scored", "n_confusing", "confusing_rate", "n_zero_labels", "n_multi_labels"
            ).alias("confusion_stats"),
            F.struct("mean_max_prob", "mean_entropy", "mean_confidence").alias("probs"),
            F.struct("in_tokens_total", "out_tokens_total").alias("usage"),
        ).alias("extras"),
    )


def run_quality_board(preds: DataFrame, *, dataset: Column | str | None = None) -> DataFrame:
    """The flagship: runs ranked by macro F1 with coverage, calibration error and the share of
    a run's errors that fall on samples the runs dispute."""
    scored = add_correct(preds, dataset=dataset)
    perf = M.performance_excluding_confused(scored, ["run_id"], dataset=dataset)
    cal = ece(scored, ["run_id"], dataset=dataset)
    votes = vote_metrics(scored, ["sample_id"], dataset=dataset, order="run_id")
    errors = (
        scored.filter("NOT correct")
        .select("run_id", "sample_id")
        .join(votes.select("sample_id", "disagree_any", "entropy"), "sample_id")
        .groupBy("run_id")
        .agg(
            F.avg(F.col("disagree_any").cast("double")).alias("disputed_error_share"),
            F.avg("entropy").alias("mean_error_entropy"),
        )
    )
    board = perf.join(cal, "run_id", "left").join(errors, "run_id", "left").withColumn(
        "coverage", F.col("n_scored") / F.col("n_total")
    )
    return board.orderBy(F.desc_nulls_last("f1_macro"), F.desc_nulls_last("accuracy"), "run_id")


def leaderboard(rows: DataFrame) -> DataFrame:
    """Merged run rows in leaderboard order."""
    return leaderboard_sort(merge_leaderboard(rows))


def agreement_bundle(
    preds: DataFrame, runs: DataFrame, *, dataset: Column | str | None = None, max_runs: int = 25,
    reports: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Kappa, McNemar and per-class precision and recall for the best runs of every dataset and tier.

    ``runs`` has run_key, dataset_name, tier_size, f1_macro, has_predictions; ``preds``
    is keyed by ``run_id`` equal to run_key.  ``per_class`` has a row for every group, run, label and metric, with the last
    part of the run key as ``run``; it is taken from ``reports`` (run_id, label, precision, recall), by default the
    reports of the predictions.  All groups share one job a table.
    """
    groups = A.agreement_groups(runs, max_runs=max_runs)
    members = groups.select("group_key", F.col("run_key").alias("run_id"))
    keyed = preds.join(members, "run_id")
    pairs = A.pair_counts(keyed, by=["group_key"], runs=members, dataset=dataset, common="all")
    index = groups.groupBy("group_key", "dataset_name", "tier_size").agg(F.count(F.lit(1)).alias("n_runs"))
    if reports is None:
        reports = M.classification_report(keyed, ["run_id"], dataset=dataset)
    values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("precision", "recall")])
    per_class = (
        reports.filter(~F.col("label").isin(*M.SUMMARY_ROWS)).join(members, "run_id")
        .select(
            "group_key", "run_id", F.substring(F.substring_index("run_id", "/", -1), 1, 48).alias("run"), "label", F.inline(values)
        )
        .filter("value IS NOT NULL")
    )
    return {
        "index": index,
        "per_class": per_class,
        "kappa": A.kappa_from_pairs(pairs, ["group_key"]),
        "mcnemar": A.mcnemar_from_pairs(pairs, ["group_key"]),
    }


def add_throughput(runs: DataFrame) -> DataFrame:
    """Total tokens and seconds per row."""
    return runs.withColumns(
        {
            "tokens_total": F.coalesce("in_tokens_total", F.lit(0)) + F.coalesce("out_tokens_total", F.lit(0)),
            "seconds_per_row": F.col("infer_time_s") / F.nullif(F.col("n_samples"), F.lit(0)),
        }
    )


def tag_batch_size(runs: DataFrame, col: str = "run_key") -> DataFrame:
    """Batch size in the run name, and the name without it."""
    return runs.withColumns(
        {
            "batch_size_tag": F.regexp_extract(col, r"_bs(\d+)(?:_|$)", 1).try_cast("int"),
            "config_key": F.regexp_replace(col, r"_bs\d+(?=_|$)", ""),
        }
    )


def gold_pred_unified(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Gold and predicted label by field precedence, whether both are in the label domain,
    and correctness (NULL outside it)."""
    have = lambda names: [F.col(c).cast("string") for c in names if c in rows.columns]
    pick = lambda names: F.coalesce(*have(names)) if have(names) else F.lit(None).cast("string")
    gold = L.canonical(pick(["gold", "true"]), L.RCT_DATASET)
    pred = L.canonical(pick(["final_label", "pred_for_eval", "pred"]), L.RCT_DATASET)
    inside = F.coalesce(gold.isin(labels) & pred.isin(labels), F.lit(False))
    return rows.withColumns(
        {"gold_u": gold, "pred_u": pred, "in_eval": inside, "correct": F.when(inside, gold == pred)}
    )


# Confidence fields by precedence, their divisor and the name of the source.
CONFIDENCE_SOURCES = (
    ("raw_confidence", 100.0, "reported_model_confidence"),
    ("vc_avg", 100.0, "VCavg_semantic_entropy"),
    ("coverage_confidence", 1.0, "coverage_confidence_cove"),
    ("normalized_target_confidence", 1.0, "normalized_target_dinco"),
    ("confidence_rubric_scaled", 1.0, "confidence_rubric_scaled"),
    ("confidence_rubric", 4.0, "confidence_rubric_1_to_4"),
    ("softmax_max_prob", 1.0, "softmax_max_prob"),
    ("reliability_combined", 1.0, "reliability_combined"),
    ("top_two_probability", 1.0, "pass1_top2_probability"),
    ("critique_confidence", 100.0, "critique_confidence"),
    ("trace_confidence", 100.0, "mean_trace_conf_matching_pred"),
)


def confidence_unified(rows: DataFrame) -> DataFrame:
    """First usable confidence field scaled to [0, 1], with the name of its source."""
    options = []
    for name, scale, source in CONFIDENCE_SOURCES:
        if name not in rows.columns:
            continue
        value = F.col(name).try_cast("double")
        ok = value.isNotNull()
        if name == "confidence_rubric":
            ok = ok & value.between(1, 4)
        options.append(F.when(ok, F.struct(S.clip01(value / scale).alias("v"), F.lit(source).alias("s"))))
    best = F.coalesce(*options) if options else F.lit(None).cast("struct<v:double,s:string>")
    return rows.withColumns({"confidence_u": best["v"], "confidence_source": best["s"]})
