"""Votes of several runs, members or traces on the same item.

Votes are first counted per ``(item, label)`` with map-side combine, so an item
with very many votes never reaches a task as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.order import join_on
from .metrics import performance

TIE_POLICIES = (
    "lexicographic", "first_seen", "tie_marker", "confusing", "confidence", "arbitrary", "unanimous",
)


def vote_counts(
    votes: DataFrame, key: list[str], *, label: str = "label", confidence: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """``(key, label, n, conf, seen)``; the NULL label counts the missing votes."""
    conf = F.sum(F.coalesce(F.col(confidence).cast("double"), F.lit(0.0))) if confidence else F.lit(0.0)
    seen = F.min(order) if order else F.min(label)
    return votes.groupBy(*key, F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), conf.alias("conf"), seen.alias("seen")
    )


def majority_vote(
    votes: DataFrame,
    key: list[str],
    *,
    tie_policy: str = "lexicographic",
    label: str = "label",
    confidence: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """Plurality label per item under one of the tie policies.

    ``lexicographic`` and ``arbitrary`` take the smallest tied label, ``first_seen``
    the one whose first vote has the smallest ``order``, ``confidence`` the one
    with the largest summed confidence (to six digits: sums that differ by the order of
    their terms only are equal), ``tie_marker`` writes 'TIE',
    ``confusing`` ignores 'error' votes and writes 'confusing', ``unanimous``
    writes 'confusing' unless all usable votes agree.
    """
    if tie_policy not in TIE_POLICIES:
        raise ValueError(f"unknown tie_policy {tie_policy!r}")
    counts = vote_counts(votes, key, label=label, confidence=confidence, order=order)
    usable = F.col("label").isNotNull()
    if tie_policy in ("confusing", "unanimous"):
        usable = usable & (F.col("label") != "error")
    n, lab = F.col("n"), F.col("label")
    lead = {
        "first_seen": [F.col("seen")],
        "confidence": [-F.round("conf", 6)],
    }.get(tie_policy, [])
    best = F.min(F.when(usable, F.struct((-n).alias("n"), *lead, lab.alias("label"))))
    other = F.max(F.when(usable, F.struct(n.alias("n"), lab.alias("label"))))
    first = F.min(F.when(usable, F.struct((-n).alias("n"), lab.alias("label"))))
    out = counts.groupBy(*key).agg(
        best.alias("_best"),
        (first["label"] != other["label"]).alias("is_tie"),
        F.count(F.when(usable, lab)).alias("n_labels"),
        F.coalesce(F.sum(F.when(usable, n)), F.lit(0)).alias("n_votes"),
    )
    winner = F.col("_best.label")
    if tie_policy == "tie_marker":
        vote = F.when(F.col("is_tie"), "TIE").otherwise(winner)
    elif tie_policy == "confusing":
        vote = F.when(F.col("is_tie"), "confusing").otherwise(F.coalesce(winner, F.lit("error")))
    elif tie_policy == "unanimous":
        vote = F.when(F.col("n_labels") == 1, winner).otherwise("confusing")
    else:
        vote = winner
    top = -F.col("_best.n")
    return out.select(
        *key,
        vote.alias("vote"),
        F.coalesce(top / F.col("n_votes"), F.lit(0.0)).alias("vote_share"),
        F.coalesce("is_tie", F.lit(False)).alias("is_tie"),
        "n_labels",
        "n_votes",
    )


def vote_metrics(
    votes: DataFrame,
    key: list[str],
    *,
    label: str = "pred_label",
    order: str | None = None,
    dataset: Column | str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Size, spread and majority of each item's votes.

    Entropy is ``ln N - sum(n ln n)/N`` divided by the log of the number of
    distinct labels, so one aggregate over the counts is enough.  ``weight`` reads
    pre-counted votes.
    """
    canon = L.canonical_pred(F.col(label), dataset)
    w = F.col(weight) if weight else F.lit(1)
    src = votes.select(
        *key, canon.alias("label"), w.cast("bigint").alias("w"),
        (F.col(order) if order else canon).alias("o"),
    )
    counts = src.groupBy(*key, "label").agg(F.sum("w").alias("n"), F.min("o").alias("seen"))
    n, ok = F.col("n"), F.col("label").isNotNull()
    place = F.row_number().over(
        W.partitionBy(*key, ok).orderBy(F.desc("n"), "seen", "label")
    )
    total = F.sum(F.when(ok, n))
    kinds = F.count("label")
    entropy = F.log(total) - F.sum(F.when(ok, n * F.log(n))) / total
    flat = F.when(kinds > 1, entropy / F.log(kinds)).otherwise(0.0)
    top, second = F.max(F.when(ok & (F.col("p") == 1), n)), F.max(F.when(ok & (F.col("p") == 2), n))
    zero = F.lit(0.0)
    return (
        counts.withColumn("p", place)
        .groupBy(*key)
        .agg(
            F.sum("n").alias("n_models"),
            F.coalesce(total, F.lit(0)).alias("n_nonempty"),
            kinds.alias("n_unique"),
            F.coalesce(F.max(F.when(ok & (F.col("p") == 1), F.col("label"))), F.lit("")).alias("majority_label"),
            F.coalesce(top / total, zero).alias("majority_frac"),
            F.coalesce((top - F.coalesce(second, F.lit(0))) / total, zero).alias("vote_margin"),
            flat.alias("entropy"),
            (kinds >= 2).alias("disagree_any"),
        )
    )


def all_agree_rate(
    votes: DataFrame, key: list[str], *, by: list[str], label: str = "pred_label", n_models: int | None = None
) -> DataFrame:
    """Share of items with one distinct label; with ``n_models`` every model must have voted."""
    per = votes.groupBy(*dict.fromkeys([*by, *key])).agg(
        F.min(label).alias("lo"), F.max(label).alias("hi"), F.count(label).alias("n")
    )
    agree = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    if n_models is not None:
        agree = agree & (F.col("n") == n_models)
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg(agree.cast("double")).alias("all_agree_rate")
    )


def ensemble_confidence(votes: DataFrame, key: list[str]) -> DataFrame:
    """Plurality label without 'error' votes, mean confidence over all votes, disagreement."""
    usable = F.col("label").isNotNull() & (F.col("label") != "error")
    counts = votes.groupBy(*key, "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("nc")
    )
    best = F.min(F.when(usable, F.struct((-F.col("n")).alias("n"), F.col("label"))))
    kinds = F.count(F.when(usable, F.col("label")))
    return counts.groupBy(*key).agg(
        F.coalesce(best["label"], F.lit("error")).alias("pred"),
        F.when(kinds > 0, F.sum("c") / F.sum("nc")).otherwise(0.0).alias("avg_conf"),
        (kinds != 1).alias("disagreement"),
    )


def vcsc(traces: DataFrame, key: list[str], *, lam: float = 0.5) -> DataFrame:
    """Self-consistency, verbal confidence of the winning traces and their mix."""
    counts = traces.groupBy(*key, "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("confidence").alias("c"),
        F.sum(F.col("confidence") * F.col("confidence")).alias("cc"),
    ).withColumn("m", F.sum("n").over(W.partitionBy(*key)))
    good = F.col("label") != "error"
    n, m = F.col("n"), F.max("m")
    first = F.min(F.when(good, F.struct((-n).alias("n"), F.col("label"), F.col("c"))))
    last = F.max(F.when(good, F.struct(n.alias("n"), F.col("label"))))
    p = F.col("n") / F.col("m")
    mean = F.sum("c") / m
    rows = counts.groupBy(*key).agg(
        first.alias("f"),
        last.alias("l"),
        m.alias("m"),
        mean.alias("mean_conf"),
        F.sum(-p * F.log2(p + F.lit(1e-12))).alias("label_entropy"),
        F.when(m > 1, F.greatest(F.lit(0.0), F.sum("cc") / m - mean * mean)).otherwise(0.0).alias(
            "confidence_variance"
        ),
    )
    status = (
        F.when(F.col("f").isNull(), "all_error")
        .when(F.col("f.label") != F.col("l.label"), "confusing")
        .otherwise("ok")
    )
    ok = F.col("consensus_status") == "ok"
    return (
        rows.withColumn("consensus_status", status)
        .withColumn("sc", F.when(ok, -F.col("f.n") / F.col("m")).otherwise(0.0))
        .withColumn("vc_avg", F.when(ok, F.col("f.c") / -F.col("f.n")).otherwise(F.col("mean_conf")))
        .select(
            *key,
            "consensus_status",
            F.when(ok, F.col("f.label"))
            .when(F.col("consensus_status") == "all_error", "error")
            .otherwise("confusing")
            .alias("pred"),
            "sc",
            "vc_avg",
            (lam * F.col("sc") + (1 - lam) * F.col("vc_avg") / 100).alias("vcsc"),
            "label_entropy",
            "confidence_variance",
        )
    )


def dinco_resolve(claims: DataFrame, key: list[str], *, eps: float = 1e-6) -> DataFrame:
    """Decide between competing claims ``(claim_no, label, primary_label, score)`` of an item."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    label = F.lower(L.strip(F.col("label")))
    named = label.isNotNull() & ~label.isin("null", "none", "")
    src = claims.withColumn("s", score).withColumn(
        "place", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("s"), "claim_no"))
    )
    hit = label == F.lower(L.strip(F.col("primary_label")))
    target = F.coalesce(
        F.min(F.when(hit, F.struct("claim_no", "s"))), F.min(F.struct("claim_no", "s"))
    )["s"]
    first, second = F.col("place") == 1, F.col("place") == 2
    s1, s2 = F.max(F.when(first, F.col("s"))), F.max(F.when(second, F.col("s")))
    tie = F.coalesce((F.abs(s1 - s2) <= eps) & (s1 > 0), F.lit(False))
    best_label = F.max(F.when(first & named, label))
    mass = F.sum(F.greatest(F.lit(0.0), F.col("s"))) + F.lit(1e-12)
    return src.groupBy(*key).agg(
        F.when(tie, "confusing").otherwise(F.coalesce(best_label, F.lit("confusing"))).alias("pred"),
        (target / mass).alias("normalized_target_confidence"),
        mass.alias("total_score_mass"),
        F.max(F.when(first, F.col("claim_no"))).alias("best_claim_no"),
        tie.alias("tie"),
    )


def bool_matrix_label(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Per-label booleans to none / the one label / confusing."""
    yes = F.coalesce(F.col("verdict"), F.lit(False))
    n = F.count_if(yes)
    return verdicts.groupBy(*key).agg(
        F.when(n == 0, "none").when(n == 1, F.min(F.when(yes, F.col("label")))).otherwise("confusing").alias("pred_label"),
        n.alias("n_true"),
    )


def oracle_any_correct(votes: DataFrame, key: list[str], *, by: list[str] | None = None) -> DataFrame:
    """Share of items on which at least one member is right."""
    per = votes.groupBy(*dict.fromkeys([*(by or []), *key])).agg(
        F.bool_or(F.coalesce("correct", F.lit(False))).alias("any_correct")
    )
    return per.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if("any_correct").alias("n_any_correct"),
        F.avg(F.col("any_correct").cast("double")).alias("oracle_accuracy"),
    )


def per_model_metrics(long: DataFrame, models: list[str]) -> DataFrame:
    """Per dataset and model coverage, accuracy and F1, with the majority vote as one more model."""
    key = ["dataset_name", "sample_id"]
    counts = long.groupBy(*key, F.col("pred_label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.max("true_label").alias("true_label")
    )
    first = F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("label"))))
    last = F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label")))
    items = counts.groupBy(*key).agg(
        F.max("true_label").alias("true_label"),
        F.count("label").alias("kinds"),
        F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).alias("n"),
        F.when(first["label"] == last["label"], first["label"]).alias("vote"),
    )
    whole = items.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(((F.col("kinds") == 1) & (F.col("n") == len(models))).cast("double")).alias("all_agree_rate"),
        F.avg(F.coalesce(F.col("vote") == F.col("true_label"), F.lit(False)).cast("double")).alias(
            "major_vote_accuracy"
        ),
    )
    rows = long.select("dataset_name", "model", "true_label", "pred_label").unionByName(
        items.select(
            "dataset_name", F.lit("major_vote").alias("model"), "true_label", F.col("vote").alias("pred_label")
        )
    )
    perf = performance(rows, ["dataset_name", "model"], raw=True)
    return perf.join(whole, "dataset_name").select(
        "dataset_name",
        "model",
        "n_samples",
        (F.col("n_scored") / F.col("n_samples")).alias("coverage"),
        "accuracy",
        "f1_macro",
        "f1_weighted",
        "all_agree_rate",
        "major_vote_accuracy",
    )


def repeat_run_summary(runs: DataFrame, key: list[str]) -> DataFrame:
    """Vote of repeated runs (ties by summed confidence), mean confidence, agreement of all runs."""
    vote = majority_vote(runs, key, tie_policy="confidence", confidence="confidence")
    conf = runs.groupBy(*key).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("decision_confidence"))
    return join_on(vote, conf, key).select(
        *key, "vote", "vote_share", "decision_confidence", (F.col("n_labels") == 1).alias("all_runs_agree")
    )


def avg_probs(runs: DataFrame, key: list[str]) -> DataFrame:
    """Mean probability per label over repeated runs."""
    return (
        runs.select(*key, F.explode("probs").alias("label", "prob"))
        .groupBy(*key, "label")
        .agg(F.avg("prob").alias("prob"))
    )


def probs_from_votes(votes: DataFrame, key: list[str], labels: list[str], *, label: str = "label") -> DataFrame:
    """Vote shares over the label list as a map; uniform when no vote is usable."""
    cells = [F.count_if(F.col(label) == x) for x in labels]
    total = F.count_if(F.col(label).isin(list(labels)))
    entries = [
        v
        for x, c in zip(labels, cells)
        for v in (F.lit(x), F.when(total > 0, c / total).otherwise(F.lit(1.0 / len(labels))))
    ]
    return votes.groupBy(*key).agg(F.create_map(*entries).alias("probs"))


def unanimous(df: DataFrame, col: str) -> DataFrame:
    """P25: flag and label of non-empty annotation arrays whose normalised values are all equal."""
    norm = F.transform(col, lambda x: L.normalize_text_label(x))
    return df.withColumns(
        {
            "is_unanimous": F.coalesce(F.size(F.array_distinct(norm)) == 1, F.lit(False)),
            "unanimous_label": F.when(F.size(norm) > 0, norm[0]),
        }
    )


def semantic_entropy(
    answers: DataFrame, edges: DataFrame, *, threshold: float = 0.5
) -> DataFrame:
    """Cluster the answers of a question by entailment both ways; entropy of the cluster sizes.

    ``answers(question_id, answer_id)``, ``edges(question_id, src, dst, score)``.
    """
    from .graph import connected_components

    strong = edges.filter((F.col("score") >= threshold) & (F.col("src") != F.col("dst")))
    back = strong.select("question_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = strong.select("question_id", "src", "dst").join(back, ["question_id", "src", "dst"], "left_semi")
    comp = connected_components(
        answers.select("question_id", "answer_id"), both, group=["question_id"], node="answer_id",
    )
    sizes = comp.groupBy("question_id", "component").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    nats = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
    out = sizes.groupBy("question_id").agg(
        total.alias("n_answers"), F.count(F.lit(1)).alias("n_clusters"),
        F.when(F.abs(nats) < 1e-12, 0.0).otherwise(nats).alias("entropy_nats"),
    )
    return out.withColumn("entropy_bits", F.col("entropy_nats") / F.log(F.lit(2.0)))
