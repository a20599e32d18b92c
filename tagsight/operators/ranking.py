"""Ranks, quintiles, robust scores, flags and ordered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import durable
from ..plans.order import exact_quantiles, join_on, value_ranks
from .calibration import roc_auc, spearman
from .metrics import detection_metrics


def dense_rank_in_cluster(df: DataFrame, *, by: list[str], distance: str, id_col: str) -> DataFrame:
    """Dense rank of the distance inside each cluster; rank 1 represents it.

    Ranks run over the distinct distances of a cluster, so copies do not pile up in one task.
    """
    vals = df.select(*by, distance).distinct()
    ranks = value_ranks(vals, by=by, value=distance, id_col=distance).select(
        *by, distance, F.col("row_rank").alias("dense_rank")
    )
    return join_on(df, ranks, [*by, distance]).withColumn("is_representative", F.col("dense_rank") == 1)


def row_rank(df: DataFrame, *, by: list[str], score: str, id_col: str) -> DataFrame:
    """Unique ascending rank of a score (ties by md5 of the id)."""
    return value_ranks(df, by=by, value=score, id_col=id_col).drop("avg_rank", "n_group")


def pick_one_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key; only one row per key and task is shuffled."""
    win = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(win)).filter("_rn = 1").drop("_rn")


def quintiles(df: DataFrame, *, by: list[str], score: str, id_col: str, q: int = 5) -> DataFrame:
    """Equal-frequency bins of the unique rank, and the groups Q1 / Q234 / Q5."""
    ranked = value_ranks(df, by=by, value=score, id_col=id_col)
    steps = q * (F.col("row_rank") - 1) / F.nullif(F.col("n_group") - 1, F.lit(0))
    bin_ = F.when(F.col("row_rank").isNotNull(), F.greatest(F.lit(1), F.coalesce(F.ceil(steps), F.lit(1))).cast("int"))
    group = F.when(F.col("quantile") == 1, "Q1").when(F.col("quantile") == q, f"Q{q}").when(
        F.col("quantile").isNotNull(), "Q" + "".join(str(i) for i in range(2, q))
    )
    return ranked.withColumn("quantile", bin_).withColumn("quantile_group", group).drop(
        "avg_rank", "n_group", "row_rank"
    )


def average_rank(df: DataFrame, *, by: list[str], score: str, id_col: str) -> DataFrame:
    """Rank with ties averaged."""
    return value_ranks(df, by=by, value=score, id_col=id_col).drop("row_rank", "n_group")


def robust_z(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(x - median) / (1.4826 MAD)``; a zero MAD falls back to the deviation, then to 1.

    The columns are stacked so that one job finds all medians and a second one all
    deviations; only those figures reach the driver.
    """
    def stacked(expr) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), expr(c).cast("double").alias("v")) for c in cols])
        return df.select(F.inline(pairs))

    def medians(rows: DataFrame) -> dict[str, float]:
        found = exact_quantiles(rows, by=["c"], value="v", probs={"m": 0.5})
        return {r["c"]: r["m"] for r in found.collect()}

    med = medians(stacked(F.col))
    mad = medians(stacked(lambda c: F.abs(F.col(c) - F.lit(med.get(c)))))
    flat = [c for c in cols if not mad.get(c)]
    std = df.agg(*[F.stddev_pop(c).alias(c) for c in flat]).first().asDict() if flat else {}
    scale = {c: 1.4826 * mad[c] if mad.get(c) else (std.get(c) or 1.0) for c in cols}
    return df.withColumns({f"{c}_z": (F.col(c) - F.lit(med.get(c))) / F.lit(scale[c]) for c in cols})


#: tokens whose priors are sent to every task
COMMON = 1000


def token_prior(corpus: DataFrame, *, text: str = "text") -> DataFrame:
    """Relative frequency of every token of the corpus."""
    toks = corpus.select(F.explode(F.split(text, r"\s+")).alias("token")).filter("token <> ''")
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prior", F.col("n") / counts.agg(F.sum("n")).scalar())


def prior_stats(docs: DataFrame, priors: DataFrame, *, id_col: str = "sample_id", text: str = "text") -> DataFrame:
    """Mean and deviation of the token priors of each text (0 without tokens).

    The ``COMMON`` likeliest tokens go to every task, where a text's occurrences of them fold into one row of sums before
    anything is shuffled. Of the others, repeated tokens of a text are counted before the join, in which the rows of sums
    take no part: they are dealt by text. Squared deviations are summed around the mean of the common and of the other
    tokens, so that equal priors deviate by 0 however many there are.
    """
    toks = docs.select(id_col, F.explode(F.split(text, r"\s+")).alias("token")).filter("token <> ''")
    common = priors.orderBy(F.desc("prior"), "token").limit(COMMON).select("token", F.col("prior").alias("common"))
    found = (
        toks.join(F.broadcast(common), "token", "left")
        .groupBy(id_col, F.when(F.col("common").isNull(), F.col("token")).alias("token"))
        .agg(F.count(F.lit(1)).alias("k"), F.sum("common").alias("s1"), F.var_pop("common").alias("v"))
        .withColumn("seat", F.when(F.col("token").isNotNull(), F.lit(0).cast("bigint")).otherwise(1 + F.pmod(F.xxhash64(id_col), F.lit(1 << 20))))
        .withColumn("token", F.coalesce("token", F.lit("")))
    )
    others = priors.select("token", "prior", F.lit(0).cast("bigint").alias("seat"))
    p, rare = F.coalesce("prior", F.lit(0.0)), F.col("s1").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    parts = (
        found.join(others, ["token", "seat"], "left")
        .groupBy(id_col)
        .agg(
            F.sum("k").alias("token_count"),
            F.coalesce(F.sum(F.when(rare, F.col("k"))), F.lit(0)).alias("_k"),
            total("s1").alias("_c1"),
            total(F.col("k") * F.col("v")).alias("_c2"),
            total(F.when(rare, F.col("k") * p)).alias("_r1"),
            total(F.when(rare, F.col("k") * p * p)).alias("_r2"),
        )
    )
    n, k = F.col("token_count"), F.col("_k")
    own = F.when(k > 0, F.greatest(F.lit(0.0), F.col("_r2") - F.col("_r1") * F.col("_r1") / k)).otherwise(0.0)
    gap = F.when((k > 0) & (k < n), F.col("_c1") / (n - k) - F.col("_r1") / k).otherwise(0.0)
    per = parts.select(
        id_col,
        "token_count",
        ((F.col("_c1") + F.col("_r1")) / n).alias("prior_mu"),
        F.sqrt((F.col("_c2") + own + gap * gap * k * ((n - k) / n)) / n).alias("prior_sigma"),
    )
    return docs.select(id_col).join(per, id_col, "left").fillna(0)


def prior_score(docs: DataFrame, priors: DataFrame, *, id_col: str = "sample_id", text: str = "text", keep_empty: bool = True) -> DataFrame:
    """Norm of the robust scores of mean and deviation of the token priors, with its quintile.

    Texts without tokens count as 0 in both, or have no part (``keep_empty`` false).
    """
    stats = prior_stats(docs, priors, id_col=id_col, text=text)
    stats = durable(stats if keep_empty else stats.filter("token_count > 0"))  # read by three passes
    z = robust_z(stats, ["prior_mu", "prior_sigma"])
    scored = z.withColumn("prior_score", F.sqrt(F.col("prior_mu_z") ** 2 + F.col("prior_sigma_z") ** 2))
    return quintiles(scored, by=[], score="prior_score", id_col=id_col)


def quantile_flag(df: DataFrame, *, score: str, q: float = 0.9, by: list[str] | None = None, out: str = "is_flagged") -> DataFrame:
    """Rows at or above the exact q-quantile."""
    by = by or []
    cut = exact_quantiles(df, by=by, value=score, probs={"_cut": q})
    joined = join_on(df, cut, by, "left") if by else df.withColumn("_cut", cut.scalar())
    return joined.withColumn(out, F.coalesce(F.col(score) >= F.col("_cut"), F.lit(False))).drop("_cut")


def tail_flags(df: DataFrame, *, truth: str = "is_corrupted") -> DataFrame:
    """Detection quality of the low, high and either tail of a quintiled score."""
    low, high = F.col("quantile") == 1, F.col("quantile") == 5
    rows = df.select(
        F.col(truth).alias("is_corrupted"),
        F.inline(
            F.array(
                F.struct(F.lit("low_tail_Q1").alias("strategy"), low.alias("is_flagged")),
                F.struct(F.lit("high_tail_Q5").alias("strategy"), high.alias("is_flagged")),
                F.struct(F.lit("either_tail_Q1_or_Q5").alias("strategy"), (low | high).alias("is_flagged")),
            )
        ),
    )
    return detection_metrics(rows, ["strategy"])


def quantile_summary(df: DataFrame, by: list[str], *, score: str, truth: str = "is_corrupted", level: str = "quantile") -> DataFrame:
    """Size, rate, mean and median of a score per quintile or quintile group."""
    key = [*by, level]
    df = durable(df.select(*key, score, truth))  # read for the means, the bucket edges and the medians
    base = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(truth).cast("double")).alias("mislabeled_rate"),
        F.avg(score).alias("mean_score"),
    )
    return join_on(base, exact_quantiles(df, by=key, value=score, probs={"median_score": 0.5}), key, "left")


def consensus_counts(df: DataFrame, *, n_methods: int, groups: list[str], id_col: str = "sample_id", truth: str = "is_corrupted") -> DataFrame:
    """How many methods put a row in each group; per count the rows and their mislabelled rate."""
    per = df.groupBy(id_col).agg(
        F.bool_or(truth).alias("t"),
        *[F.count_if(F.col("quantile_group") == g).alias(g) for g in groups],
    )
    rows = per.select(
        F.col("t"), F.inline(F.array(*[F.struct(F.lit(g).alias("quantile_group"), F.col(g).alias("n_methods")) for g in groups]))
    )
    counts = rows.groupBy("quantile_group", "n_methods").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.col("t").cast("double")).alias("mislabeled_rate"),
        F.count_if("t").alias("mislabeled_samples"),
    )
    frame = df.sparkSession.createDataFrame(
        [(g, k) for g in groups for k in range(n_methods + 1)], "quantile_group string, n_methods bigint"
    )
    return frame.join(counts, ["quantile_group", "n_methods"], "left").fillna(0, ["samples", "mislabeled_samples"])


def pairwise_jaccard(flags: DataFrame, methods: list[str], *, by: list[str] | None = None, id_col: str = "sample_id") -> DataFrame:
    """Overlap of the flagged rows of every method pair.

    A row's methods form one short array that is exploded once; counters per other
    method replace row pairs.
    """
    by = by or []
    per = flags.filter(F.col("method").isin(methods)).groupBy(*by, id_col).agg(
        F.array(*[F.bool_or(F.col("method") == m) for m in methods]).alias("on")
    )
    each = per.select(*by, "on", F.posexplode("on").alias("i", "hit")).filter("hit")
    cells = each.groupBy(*by, "i").agg(
        F.array(*[F.count_if(F.col("on")[j]) for j in range(len(methods))]).alias("c")
    )
    names = F.array(*[F.lit(m) for m in methods])
    inter = cells.select(*by, "i", F.posexplode("c").alias("j", "both"))
    size = inter.filter("i = j").select(*by, F.col("i").alias("k"), F.col("both").alias("size"))
    a = size.select(*by, F.col("k").alias("i"), F.col("size").alias("na"))
    b = size.select(*by, F.col("k").alias("j"), F.col("size").alias("nb"))
    out = inter.join(a, [*by, "i"]).join(b, [*by, "j"])
    return out.select(
        *by,
        names[F.col("i")].alias("method_a"),
        names[F.col("j")].alias("method_b"),
        F.col("both").alias("n_both"),
        (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"),
    )


def jaccard_summary(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, smallest and largest overlap off the diagonal."""
    return pairs.filter("method_a <> method_b").groupBy(*(by or [])).agg(
        F.avg("jaccard").alias("mean_jaccard"), F.min("jaccard").alias("min_jaccard"), F.max("jaccard").alias("max_jaccard")
    )


def method_summary(df: DataFrame, *, score: str = "score", truth: str = "is_corrupted", id_col: str = "sample_id") -> DataFrame:
    """Per method AUC, rank correlation, class means, rates per group and quality of the top quintile."""
    by = ["method"]
    df = durable(df)  # read by four aggregations
    t = F.col(truth)
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(t, F.col(score))).alias("mean_score_corrupted"),
        F.avg(F.when(~t, F.col(score))).alias("mean_score_clean"),
        *[
            F.avg(F.when(F.col("quantile_group") == g, t.cast("double"))).alias(f"{g.lower()}_mislabeled_rate")
            for g in ("Q1", "Q234", "Q5")
        ],
    )
    top = detection_metrics(df.withColumn("is_flagged", F.col("quantile") == 5), by, truth=truth).select(
        *by, F.col("precision").alias("q5_precision"), F.col("recall").alias("q5_recall"),
        F.col("f1").alias("q5_f1"), F.col("flag_rate").alias("q5_flag_rate"),
    )
    auc = roc_auc(df, by, score=score, truth=truth).select(*by, "roc_auc")
    rho = spearman(df, by, x=score, y=truth, id_col=id_col)
    return base.join(top, by).join(auc, by, "left").join(rho, by, "left")


def top_rows(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    out = df.orderBy(*order)
    return out if n is None else out.limit(n)


def ambiguous_rows(votes: DataFrame, n: int = 50) -> DataFrame:
    """Highest entropy, then smallest margin."""
    return top_rows(votes, n, F.desc("entropy"), F.asc("vote_margin"), F.asc("sample_id"))


def clear_rows(votes: DataFrame, n: int = 50) -> DataFrame:
    """Lowest entropy, then largest margin."""
    return top_rows(votes, n, F.asc("entropy"), F.desc("vote_margin"), F.asc("sample_id"))


def majority_mismatch(votes: DataFrame, gold: DataFrame) -> DataFrame:
    """Samples whose majority differs from the gold label, weakest majority first."""
    bad = votes.join(gold.select("sample_id", "true_label"), "sample_id").filter(
        "majority_label <> '' AND majority_label <> lower(trim(true_label))"
    )
    return bad.orderBy("majority_frac", F.desc("entropy"), "sample_id")


def wrong_rows(preds: DataFrame, votes: DataFrame, run: str) -> DataFrame:
    """T4: one run's errors, most ambiguous first."""
    bad = preds.filter((F.col("run_id") == run) & ~F.col("correct"))
    return bad.join(votes.select("sample_id", "entropy", "vote_margin"), "sample_id", "left").orderBy(
        F.desc("entropy"), "vote_margin", "sample_id"
    )


def flips(preds: DataFrame, votes: DataFrame, a: str, b: str) -> DataFrame:
    """T4: samples the first run gets right and the second wrong."""
    sides = preds.filter(F.col("run_id").isin(a, b)).groupBy("sample_id").agg(
        F.max("true_label").alias("true_label"),
        F.max(F.when(F.col("run_id") == a, F.col("pred_label"))).alias("pred_a"),
        F.max(F.when(F.col("run_id") == b, F.col("pred_label"))).alias("pred_b"),
        F.bool_or(F.when(F.col("run_id") == a, F.col("correct"))).alias("ok_a"),
        F.bool_or(F.when(F.col("run_id") == b, F.col("correct"))).alias("ok_b"),
    )
    return (
        sides.filter("ok_a AND NOT ok_b")
        .drop("ok_a", "ok_b")
        .join(votes.select("sample_id", "entropy", "vote_margin"), "sample_id", "left")
        .orderBy("sample_id")
    )


def slice_summary(preds: DataFrame, votes: DataFrame) -> DataFrame:
    """Per run and outcome the rows, mean entropy, mean margin and share of disputed samples."""
    return (
        preds.select("run_id", "sample_id", "correct")
        .join(votes.select("sample_id", "entropy", "vote_margin", "disagree_any"), "sample_id")
        .groupBy("run_id", F.when(F.col("correct"), "correct").otherwise("incorrect").alias("slice"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg("entropy").alias("mean_entropy"),
            F.avg("vote_margin").alias("mean_vote_margin"),
            F.avg(F.col("disagree_any").cast("double")).alias("p_disagree_any"),
        )
    )


def leaderboard_sort(runs: DataFrame) -> DataFrame:
    """Macro F1, accuracy, time saved, key; all descending, NULLs last."""
    return runs.orderBy(*[F.desc_nulls_last(c) for c in ("f1_macro", "accuracy", "saved_utc", "run_key")])


def top_bottom_runs(runs: DataFrame, metric: str = "f1_macro", n: int = 15) -> DataFrame:
    """Best and worst runs by a metric; runs with predictions are preferred when there are any."""
    some = runs.agg(F.coalesce(F.bool_or(F.col("has_predictions") & F.col(metric).isNotNull()), F.lit(False))).scalar()
    pool = runs.filter(F.col(metric).isNotNull() & (F.col("has_predictions") | ~some))
    best = pool.orderBy(F.desc(metric), "run_key").limit(n).withColumn("side", F.lit("top"))
    worst = pool.orderBy(F.asc(metric), "run_key").limit(n).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def rank_by_label_quality(df: DataFrame, *, probs: str = "probs", observed: str = "observed_label") -> DataFrame:
    """Probability of the observed label and the suggested label, worst first."""
    return self_confidence(df, probs=probs, observed=observed).orderBy("self_confidence", "sample_id")


def self_confidence(df: DataFrame, *, probs: str = "probs", observed: str = "observed_label") -> DataFrame:
    """Probability of the observed label; also the most probable label (ties by name)."""
    ranked = F.array_sort(
        F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("label")))
    )
    return df.withColumns(
        {
            "self_confidence": F.try_element_at(F.col(probs), F.col(observed)),
            "suggested_label": ranked[0]["label"],
            "suggested_prob": -ranked[0]["p"],
        }
    )


def top_issue_rows(issues: DataFrame, n: int = 8) -> DataFrame:
    """Rows with the largest score per issue type."""
    win = W.partitionBy("issue_type").orderBy(F.desc_nulls_last("score"), "sample_id")
    return issues.withColumn("place", F.row_number().over(win)).filter(F.col("place") <= n)


def select_scored_examples(df: DataFrame, *, min_score: float = 2, floor: int = 5, fallback: int = 10, id_col: str = "sample_id") -> DataFrame:
    """Examples at or above a score; the best ``fallback`` ones when fewer than ``floor`` reach it."""
    order = [F.desc_nulls_last("score"), F.asc(id_col)]
    enough = df.agg(F.count_if(F.col("score") >= min_score) >= floor).scalar()
    good = df.filter((F.col("score") >= min_score) & enough)
    best = df.orderBy(*order).limit(fallback).filter(~enough)
    return good.unionByName(best).orderBy(*order)


def dedupe_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Deterministic first row of each key."""
    return pick_one_per_key(df, key, order)


def union_runs(*frames: DataFrame) -> DataFrame:
    """Stack run tables whose columns differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# Row formats that win over other layouts of the same run.
HARNESS_FORMATS = ("harness_report", "metrics_json", "metadata_only")


def merge_leaderboard(rows: DataFrame, *, order: str = "source_order") -> DataFrame:
    """One row per run key; harness formats first, then the higher F1, then the earlier source."""
    first = F.coalesce(F.col("format").isin(*HARNESS_FORMATS), F.lit(False))
    return pick_one_per_key(
        rows.filter("run_key IS NOT NULL AND run_key <> ''"),
        ["run_key"],
        [F.desc(first), F.desc_nulls_last("f1_macro"), F.asc(order)],
    )


def label_union(*frames: DataFrame, expected: list[str] | None = None, label: str = "true_label") -> DataFrame:
    """Distinct labels over splits; expected order first, the rest by name."""
    out = frames[0].select(label)
    for f in frames[1:]:
        out = out.union(f.select(label))
    known = F.array_position(F.array(*[F.lit(x) for x in (expected or [""])]), F.col(label))
    return (
        out.distinct()
        .withColumn("_p", F.when(known > 0, known).otherwise(1 << 30))
        .orderBy("_p", label)
        .drop("_p")
    )


def method_overlap(flags: DataFrame, a: str, b: str, *, id_col: str = "sample_id") -> DataFrame:
    """Rows flagged by both, only the first, only the second detector."""
    per = flags.filter(F.col("method").isin(a, b)).groupBy(id_col).agg(
        F.bool_or(F.col("method") == a).alias("a"), F.bool_or(F.col("method") == b).alias("b")
    )
    return per.agg(
        F.count_if(F.expr("a AND b")).alias("n_both"),
        F.count_if(F.expr("a AND NOT b")).alias("n_only_a"),
        F.count_if(F.expr("b AND NOT a")).alias("n_only_b"),
    )


def seed_plus_selected(seed: DataFrame, *selected: DataFrame) -> DataFrame:
    """Training union of the seed rows and the accepted ones, origin kept."""
    out = seed.withColumn("origin", F.lit("seed"))
    for i, s in enumerate(selected, 1):
        out = out.unionByName(s.withColumn("origin", F.lit(f"selected_{i}")), allowMissingColumns=True)
    return out
