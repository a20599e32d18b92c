"""Scores of prediction tables.

Everything starts from confusion counts ``(by, true, pred) -> n``: one map-side
combined aggregate per table, after which only label-sized rows are handled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S
from ..plans.order import exact_quantiles, join_on

# Averages in report maps and answers that state nothing.
NOT_STATED = ("not stated", "not stated.", "unknown")
SUMMARY_ROWS = ("accuracy", "micro avg", "macro avg", "weighted avg")


def _ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 for an empty denominator."""
    return F.coalesce(num / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion_counts(
    preds: DataFrame,
    by: list[str],
    *,
    dataset: Column | str | None = None,
    null_policy: str = "drop",
    raw: bool = False,
) -> DataFrame:
    """``(by, true, pred, n)``.  ``null_policy``: 'drop' leaves NULL predictions out, 'wrong' keeps them as ''."""
    if null_policy not in ("drop", "wrong"):
        raise ValueError(f"unknown null_policy {null_policy!r}")
    gold, pred = F.col("true_label"), F.col("pred_label")
    src = preds.filter(pred.isNotNull()) if null_policy == "drop" else preds
    true_c = gold if raw else L.canonical(gold, dataset)
    pred_c = pred if raw else L.canonical_pred(pred, dataset)
    return (
        src.select(
            *by,
            F.coalesce(true_c, F.lit("")).alias("true"),
            F.coalesce(pred_c, F.lit("")).alias("pred"),
        )
        .groupBy(*by, "true", "pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def label_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """``(by, label, tp, fp, fn)`` over the union of true and predicted labels."""
    hit = F.col("true") == F.col("pred")
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("true").alias("label"),
            F.when(hit, n).otherwise(zero).alias("tp"),
            zero.alias("fp"),
            F.when(hit, zero).otherwise(n).alias("fn"),
        ),
        F.struct(
            F.col("pred").alias("label"),
            zero.alias("tp"),
            F.when(hit, zero).otherwise(n).alias("fp"),
            zero.alias("fn"),
        ),
    )
    return (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        .filter("tp + fp + fn > 0")
    )


def _with_prf(lab: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        lab.withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("support", tp + fn)
    )


def performance(
    preds: DataFrame,
    by: list[str],
    *,
    labels: list[str] | None = None,
    null_policy: str = "drop",
    dataset: Column | str | None = None,
    raw: bool = False,
) -> DataFrame:
    """A1, A3: rows scored, accuracy, macro F1 and support-weighted F1 per ``by``.

    Macro F1 averages over labels seen in truth or prediction, or over the fixed
    list ``labels``.
    """
    counts = confusion_counts(preds, by, dataset=dataset, null_policy=null_policy, raw=raw)
    lab = _with_prf(label_counts(counts, by))
    if labels is None:
        macro = F.avg("f1")
    else:
        macro = F.sum(F.when(F.col("label").isin(list(labels)), F.col("f1")).otherwise(0.0)) / len(
            labels
        )
    return lab.groupBy(*by).agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("n_scored"),
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.coalesce(macro, F.lit(0.0)).alias("f1_macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def classification_report(
    preds: DataFrame,
    by: list[str],
    *,
    exclude_confusing: bool = False,
    dataset: Column | str | None = None,
    null_policy: str = "drop",
) -> DataFrame:
    """A2: per-label precision, recall, F1, support, and the accuracy / macro / weighted rows."""
    src = not_confusing(preds) if exclude_confusing else preds
    counts = confusion_counts(src, by, dataset=dataset, null_policy=null_policy)
    lab = _with_prf(label_counts(counts, by))
    sup = F.sum("support")
    metrics = ("precision", "recall", "f1")
    totals = lab.groupBy(*by).agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"),
                *[_ratio(F.sum("tp"), sup).alias(m) for m in metrics],
                sup.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("label"),
                *[F.avg(m).alias(m) for m in metrics],
                sup.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("label"),
                *[_ratio(F.sum(F.col(m) * F.col("support")), sup).alias(m) for m in metrics],
                sup.alias("support"),
            ),
        ).alias("rows")
    )
    return lab.select(*by, "label", *metrics, "support").unionByName(
        totals.select(*by, F.inline("rows"))
    )


def not_confusing(preds: DataFrame) -> DataFrame:
    return preds.filter(~F.coalesce(F.col("is_confusing"), F.lit(False)))


def confusion_stats(preds: DataFrame, by: list[str]) -> DataFrame:
    """A4: totals, confusing rows and rate, rows with no label and with several labels."""
    n = F.count(F.lit(1))
    bad = F.count_if(F.coalesce(F.col("is_confusing"), F.lit(False)))
    return preds.groupBy(*by).agg(
        n.alias("n_total"),
        (n - bad).alias("n_unconfused"),
        bad.alias("n_confusing"),
        _ratio(bad, n).alias("confusing_rate"),
        F.count_if(F.col("n_pred_labels") == 0).alias("n_zero_labels"),
        F.count_if(F.col("n_pred_labels") > 1).alias("n_multi_labels"),
    )


def performance_excluding_confused(
    preds: DataFrame, by: list[str], *, dataset: Column | str | None = None
) -> DataFrame:
    """A5: A1 on rows that are not confusing and have a prediction, next to A4."""
    scored = performance(not_confusing(preds), by, dataset=dataset)
    stats = confusion_stats(preds, by)
    both = join_on(stats, scored, by, "left") if by else stats.withColumns(
        {c: scored.select(c).scalar() for c in ("n_scored", "accuracy", "f1_macro", "f1_weighted")}
    )
    return both.fillna(0.0, ["accuracy", "f1_macro", "f1_weighted"]).fillna(0, ["n_scored"])


def metric_audit(
    reports: DataFrame, preds: DataFrame, *, key: str = "run_id", dataset: Column | str | None = None
) -> DataFrame:
    """Stored metrics next to recomputed ones, with the differences."""
    fresh = performance_excluding_confused(preds, [key], dataset=dataset).select(
        key, F.col("accuracy").alias("accuracy_now"), F.col("f1_macro").alias("f1_macro_now"),
        "n_total", "n_confusing",
    )
    return reports.join(fresh, key, "left").withColumns(
        {
            "accuracy_delta": F.col("accuracy_now") - F.col("accuracy"),
            "f1_macro_delta": F.col("f1_macro_now") - F.col("f1_macro"),
        }
    )


def probs_summary(preds: DataFrame, by: list[str]) -> DataFrame:
    """Mean top probability and entropy; mean confidence where a group has no probabilities."""
    has_probs = "probs" in preds.columns
    probs = F.col("probs") if has_probs else F.lit(None).cast("map<string,double>")
    top = F.avg(S.probs_max(probs))
    conf = F.try_avg(F.col("confidence").try_cast("double"))
    return preds.groupBy(*by).agg(
        top.alias("mean_max_prob"),
        F.avg(S.probs_entropy(probs)).alias("mean_entropy"),
        F.when(top.isNull(), conf).alias("mean_confidence"),
    )


def usage_summary(preds: DataFrame, by: list[str]) -> DataFrame:
    """Token totals; text that is not a number is skipped, NULL when none was seen."""
    return preds.groupBy(*by).agg(
        *[
            F.sum(F.col(c).try_cast("bigint")).alias(f"{c}_total")
            for c in ("in_tokens", "out_tokens")
        ]
    )


def agreement_rate(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Share of equal labels among rows where both exist; 0 when there are none."""
    same = (F.col(a) == F.col(b)).cast("double")
    return df.groupBy(*(by or [])).agg(F.coalesce(F.avg(same), F.lit(0.0)).alias("agreement"))


def confusions(preds: DataFrame, k: int = 20, by: list[str] | None = None) -> DataFrame:
    """Most frequent (true, pred) pairs, NULL predictions included."""
    counts = preds.groupBy(*(by or []), F.col("true_label").alias("true"), F.col("pred_label").alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    order = [F.desc("n"), F.asc("true"), F.asc_nulls_last("pred")]
    if not by:
        return counts.orderBy(*order).limit(k)
    win = W.partitionBy(*by).orderBy(*order)
    return counts.withColumn("_rn", F.row_number().over(win)).filter(f"_rn <= {int(k)}").drop("_rn")


def most_confused(df: DataFrame, k: int = 10, *, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Most frequent off-diagonal pairs."""
    return (
        df.filter(F.col(true) != F.col(pred))
        .groupBy(F.col(true).alias("true"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "true", "pred")
        .limit(k)
    )


def with_cohort(pairs: DataFrame, *, new_ok: str = "new_ok", base_ok: str = "base_ok") -> DataFrame:
    """Outcome cohort of a run against its baseline."""
    new, base = F.col(new_ok), F.col(base_ok)
    return pairs.withColumn(
        "cohort",
        F.when(new & base, "both_correct")
        .when(new & ~base, "fixed")
        .when(~new & base, "regressions")
        .otherwise("stubborn_failures"),
    )


def cohorts(pairs: DataFrame) -> DataFrame:
    """Cohort sizes per true label with the two accuracies."""
    return (
        with_cohort(pairs)
        .groupBy("true_label")
        .agg(
            *[
                F.count_if(F.col("cohort") == c).alias(c)
                for c in ("both_correct", "fixed", "regressions", "stubborn_failures")
            ],
            F.avg(F.col("new_ok").cast("double")).alias("new_accuracy"),
            F.avg(F.col("base_ok").cast("double")).alias("base_accuracy"),
        )
    )


def describe_by(df: DataFrame, key: str, col: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per group."""
    basics = df.groupBy(key).agg(
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    quart = exact_quantiles(df, by=[key], value=col, probs={"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return join_on(basics, quart, [key], "left")


def adjusted_distance(
    preds: DataFrame, by: list[str], levels: dict[str, int] = L.SAFETY_LEVELS, penalty: int = 4
) -> DataFrame:
    """Mean ordinal distance; unknown labels cost ``penalty``."""
    gold = L.normalize_text_label(F.col("true_label"))
    pred = L.normalize_text_label(F.col("pred_label"))
    return preds.groupBy(*by).agg(
        F.coalesce(
            F.avg(S.level_distance(gold, pred, levels, penalty)), F.lit(float(penalty))
        ).alias("adjusted_distance")
    )


def summarize_parse_errors(preds: DataFrame, by: list[str], *, mark: str = "parse_error") -> DataFrame:
    """Scores without unparsed rows, and how many there were."""
    ok = preds.filter(~F.col("pred_label").eqNullSafe(mark))
    errors = preds.groupBy(*by).agg(F.count_if(F.col("pred_label") == mark).alias("parse_error_count"))
    return join_on(errors, performance(ok, by, null_policy="wrong"), by, "left").fillna(0.0)


def label_distribution(df: DataFrame, *, label: str = "true_label", labels: list[str] | None = None) -> DataFrame:
    """Count and share per label; zero-filled for a given list."""
    counts = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    if labels is not None:
        frame = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        counts = frame.join(counts, "label", "left").fillna(0, ["n"])
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", _ratio(F.col("n"), total))


def top_labels(df: DataFrame, k: int, *, label: str = "true_label") -> DataFrame:
    """The k most frequent labels, ties by name."""
    return (
        df.groupBy(F.col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label")
        .limit(k)
    )


def detection_metrics(
    df: DataFrame, by: list[str], *, flag: str = "is_flagged", truth: str = "is_corrupted"
) -> DataFrame:
    """Confusion of a detector's flags with the truth."""
    f, t = F.col(flag), F.col(truth)
    cells = df.groupBy(*by).agg(
        F.count_if(f & t).alias("tp"),
        F.count_if(f & ~t).alias("fp"),
        F.count_if(~f & t).alias("fn"),
        F.count_if(~f & ~t).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns(
        {
            "flagged_rows": tp + fp,
            "corrupted_rows": tp + fn,
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "flag_rate": _ratio(tp + fp, tp + fp + fn + tn),
        }
    )


def crosstab(df: DataFrame, a: str, b: str, b_values: list[str], a_values: list[str] | None = None) -> DataFrame:
    """Counts of ``a`` by the listed values of ``b``, zero-filled, rows for every listed ``a``."""
    table = df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(v) for v in b_values])
    if a_values is None:
        return table
    frame = df.sparkSession.createDataFrame([(x,) for x in a_values], f"{a} string")
    return frame.join(table, a, "left").fillna(0, b_values)


def corruption_summary(df: DataFrame) -> DataFrame:
    """Rows per true label and corruption kind ('' reads as clean)."""
    kind = F.coalesce(F.nullif(F.col("corruption_kind"), F.lit("")), F.lit("clean"))
    return df.groupBy("true_label", kind.alias("corruption_kind")).agg(F.count(F.lit(1)).alias("n"))


def two_stage_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Change rate between two passes and the quality of the second."""
    base = df.groupBy(*by).agg(
        F.avg((~F.col("pass1_label").eqNullSafe(F.col("pass2_label"))).cast("double")).alias("change_rate"),
        F.avg("confidence").alias("mean_confidence"),
    )
    perf = performance(
        df.withColumn("pred_label", F.col("pass2_label")), by, null_policy="wrong"
    ).select(*by, "accuracy", "f1_macro")
    return join_on(base, perf, by, "left")


def probe_metrics(items: DataFrame, by: list[str]) -> DataFrame:
    """Label-set predictions scored against one gold label."""
    labels, gold = F.col("pred_labels"), F.col("true_label")
    n = F.count(F.lit(1))
    kind = L.confusion_kind(labels)
    zero, multi = F.count_if(kind == "none"), F.count_if(kind == "multi")
    conf = F.count_if(F.size(labels) != 1)
    return items.groupBy(*by).agg(
        n.alias("n_items"),
        _ratio(F.count_if((F.size(labels) == 1) & (labels[0] == gold)), n).alias("top1_accuracy"),
        _ratio(F.count_if(F.array_contains(labels, gold)), n).alias("gold_in_set_rate"),
        conf.alias("n_confusing"),
        _ratio(conf, n).alias("confusion_rate"),
        zero.alias("n_pred_labels_zero"),
        multi.alias("n_pred_labels_multi"),
        F.count_if(kind == "single").alias("n_pred_labels_single"),
        _ratio(zero, n).alias("rate_pred_zero"),
        _ratio(multi, n).alias("rate_pred_multi"),
    )


def telemetry(calls: DataFrame, by: list[str]) -> DataFrame:
    """Call counters per run; thought tokens are NULL when there were none."""
    tok = {
        c: F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0)))
        for c in ("prompt_tokens", "candidate_tokens", "thought_tokens")
    }
    return calls.groupBy(*by).agg(
        F.round(F.sum(F.coalesce("elapsed_s", F.lit(0.0))), 4).alias("elapsed_s"),
        F.count(F.lit(1)).alias("n_calls"),
        tok["prompt_tokens"].alias("prompt_tokens"),
        tok["candidate_tokens"].alias("candidate_tokens"),
        F.nullif(tok["thought_tokens"], F.lit(0)).alias("thought_tokens"),
        F.when(
            tok["candidate_tokens"] != 0, tok["candidate_tokens"] - tok["thought_tokens"]
        ).alias("visible_tokens"),
    )


def label_accuracy(preds: DataFrame, labels: list[str]) -> DataFrame:
    """Accuracy overall (label NULL), per listed label (0 when absent) and mean per batch."""
    ok = F.col("correct").cast("double")
    per = preds.groupBy(F.col("true_label").alias("label")).agg(F.avg(ok).alias("accuracy"))
    frame = preds.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    per = frame.join(per, "label", "left").fillna(0.0).withColumn("level", F.lit("label"))
    whole = preds.agg(F.avg(ok).alias("accuracy")).select(
        F.lit(None).cast("string").alias("label"), "accuracy", F.lit("overall").alias("level")
    )
    out = per.unionByName(whole)
    if "batch_id" in preds.columns:
        batch = preds.groupBy("batch_id").agg(F.avg(ok).alias("a")).agg(F.avg("a").alias("accuracy"))
        out = out.unionByName(
            batch.select(
                F.lit(None).cast("string").alias("label"), "accuracy", F.lit("batch_mean").alias("level")
            )
        )
    return out


def batch_score(df: DataFrame, *, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Position-wise accuracy of a batch and a sentence about its errors."""
    n = F.size(gold)
    pairs = F.zip_with(gold, pred, lambda g, p: F.struct(g.alias("g"), p.alias("p")))
    tagged = F.transform(
        pairs,
        lambda x, i: F.when(
            ~x["g"].eqNullSafe(x["p"]),
            F.concat(F.lit("Pos "), (i + 1).cast("string"), F.lit(": expected "), x["g"],
                     F.lit(", got "), F.coalesce(x["p"], F.lit("None"))),
        ),
    )
    errors = F.filter(tagged, lambda x: x.isNotNull())
    good = n - F.size(errors)
    return df.withColumns(
        {
            "score": good / n.cast("double"),
            "feedback": F.when(F.size(errors) == 0, F.lit("Perfect batch.")).otherwise(
                F.concat(F.lit("Partial ("), good.cast("string"), F.lit("/"), n.cast("string"),
                         F.lit("). "), F.array_join(errors, "; "))
            ),
        }
    )


def per_class_pr_long(reports: DataFrame, *, report: str = "classification_report") -> DataFrame:
    """Report maps ``label -> struct(precision, recall, ...)`` as long rows, averages left out."""
    return (
        reports.select("run_id", F.explode(report).alias("label", "stats"))
        .filter(~F.col("label").isin(*SUMMARY_ROWS))
        .select(
            "run_id",
            "label",
            F.inline(
                F.array(
                    F.struct(F.lit("precision").alias("metric"), F.col("stats.precision").alias("value")),
                    F.struct(F.lit("recall").alias("metric"), F.col("stats.recall").alias("value")),
                )
            ),
        )
        .filter("value IS NOT NULL")
    )


def pivot_metric(runs: DataFrame, *, metric: str, models: list[str], row: str = "dataset_name", col: str = "model_id") -> DataFrame:
    """Dataset x model table of a metric (first value by run key)."""
    return runs.groupBy(row).agg(
        *[
            F.min_by(F.when(F.col(col) == m, F.col(metric)),
                     F.when((F.col(col) == m) & F.col(metric).isNotNull(), F.col("run_key"))).alias(m)
            for m in models
        ]
    )


def run_summary(long: DataFrame, by: list[str]) -> DataFrame:
    """Rows, rows in the label domain, accuracy over them, rows with confidence."""
    return long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("in_eval").alias("n_eval"),
        F.avg(F.when(F.col("in_eval"), F.col("correct").cast("double"))).alias("accuracy"),
        F.count("confidence").alias("n_confidence"),
    )


def not_stated_fraction(answers: DataFrame, by: list[str], *, answer: str = "answer") -> DataFrame:
    """Share of answers that state nothing (1 without answers); coverage confidence is the rest."""
    low = F.lower(L.strip(F.col(answer)))
    vague = low.isin(*NOT_STATED)
    return answers.groupBy(*by).agg(
        F.coalesce(F.avg(vague.cast("double")), F.lit(1.0)).alias("not_stated_fraction")
    ).withColumn("coverage_confidence", 1 - F.col("not_stated_fraction"))


def multilabel_metrics(df: DataFrame, labels: list[str], *, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Exact-set match, micro and macro F1 over the label list, mismatched rows."""
    lab = multilabel_report(df, labels, gold=gold, pred=pred)
    sums = lab.agg(
        _ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"),
        F.avg("f1").alias("macro_f1"),
    )
    low = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(x))))
    match = low(F.col(gold)) == low(F.col(pred))
    base = df.agg(
        F.avg(match.cast("double")).alias("exact_match_accuracy"),
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(~match).alias("n_mismatched"),
    )
    return base.withColumns({c: sums.select(c).scalar() for c in ("micro_f1", "macro_f1")})


def multilabel_report(df: DataFrame, labels: list[str], *, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Per-label counts and scores on the binarised labels, in one pass over the rows."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    cells = []
    for i, name in enumerate(labels):
        g, p = F.array_contains(low(F.col(gold)), name), F.array_contains(low(F.col(pred)), name)
        cells += [
            F.count_if(g & p).alias(f"tp{i}"),
            F.count_if(~g & p).alias(f"fp{i}"),
            F.count_if(g & ~p).alias(f"fn{i}"),
        ]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("label"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn")])
            for i, name in enumerate(labels)
        ]
    )
    return _with_prf(df.agg(*cells).select(F.inline(rows)))


def logprob_summary(resp: DataFrame, *, content: str = "content") -> DataFrame:
    """Token log-probability figures from ``array<struct<token,logprob>>``."""
    vals = F.filter(F.transform(content, lambda t: t["logprob"].cast("double")), lambda v: v.isNotNull())
    n = F.size(F.coalesce(vals, F.array().cast("array<double>")))
    return resp.withColumns(
        {
            "logprobs_available": n > 0,
            "mean_logprob": F.when(n > 0, S.array_sum(vals) / n),
            "min_logprob": F.array_min(vals),
            "max_logprob": F.array_max(vals),
        }
    )
