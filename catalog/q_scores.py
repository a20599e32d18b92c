"""Metric, vote, agreement, calibration and join queries: A1-A59, J1-J18, T5-T7."""

from pyspark.sql import functions as F

from tagsight.functions import scores as S
from tagsight.operators import agreement as A
from tagsight.operators import batches as B
from tagsight.operators import calibration as C
from tagsight.operators import joins as J
from tagsight.operators import metrics as M
from tagsight.operators import ranking as R
from tagsight.operators import votes as V
from tagsight.plans import evaluate as E
from tagsight.sources.runs import aggregate_reports

from .base import (
    FLAGS, LANGS, NOISY, PREDS, RUNS, SAMPLES, SCORED, VOTES, flags, noisy, preds, query, rank_cte, rounded,
    samples, table, votes, wide_preds_sql, with_,
)


def scored(spark, sf, *more):
    return E.add_correct(preds(spark, sf, *more))


def f1_ctes(src: str, by: str = "run_id", name: str = "perf") -> str:
    """Accuracy and F1 figures of a relation with true_label and non-NULL pred_label."""
    return f"""{name}_c AS (SELECT {by}, true_label AS t, pred_label AS p, count(*) AS n FROM {src} GROUP BY ALL),
{name}_l AS (SELECT {by}, l AS label, sum(CASE WHEN t = p AND t = l THEN n ELSE 0 END)::BIGINT AS tp,
   sum(CASE WHEN p = l AND t <> l THEN n ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN t = l AND p <> l THEN n ELSE 0 END)::BIGINT AS fn
   FROM {name}_c, (SELECT unnest(list_sort(list_distinct(list_concat((SELECT list(DISTINCT t) FROM {name}_c), (SELECT list(DISTINCT p) FROM {name}_c))))) AS l)
   GROUP BY ALL HAVING tp + fp + fn > 0),
{name}_f AS (SELECT *, tp + fn AS support, COALESCE(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, COALESCE(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
   2.0 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM {name}_l),
{name} AS (SELECT {by}, sum(support)::BIGINT AS n_scored, sum(tp) / sum(support)::DOUBLE AS accuracy, avg(f1) AS f1_macro,
   sum(f1 * support) / sum(support)::DOUBLE AS f1_weighted FROM {name}_f GROUP BY ALL)"""


PERF_COLS = "n_scored, ROUND(accuracy, 9) AS accuracy, ROUND(f1_macro, 9) AS f1_macro, ROUND(f1_weighted, 9) AS f1_weighted"
SEEN = "seen AS (SELECT * FROM preds WHERE pred_label IS NOT NULL)"
CLEAR = "clear AS (SELECT * FROM preds WHERE pred_label IS NOT NULL AND NOT is_confusing)"
STATS = """stats AS (SELECT run_id, count(*) AS n_total, count(*) FILTER (NOT is_confusing) AS n_unconfused, count(*) FILTER (is_confusing) AS n_confusing,
  count(*) FILTER (is_confusing)::DOUBLE / count(*) AS confusing_rate, count(*) FILTER (n_pred_labels = 0) AS n_zero_labels,
  count(*) FILTER (n_pred_labels > 1) AS n_multi_labels FROM preds GROUP BY 1)"""


@query("a1_performance", with_(PREDS, SEEN, f1_ctes("seen"), body=f"SELECT run_id, {PERF_COLS} FROM perf"))
def _(spark, sf):
    return rounded(M.performance(preds(spark, sf), ["run_id"]))


@query("a1_performance_null_is_wrong", with_(PREDS, "filled AS (SELECT run_id, true_label, COALESCE(pred_label, '') AS pred_label FROM preds)",
                                            f1_ctes("filled"), body=f"SELECT run_id, {PERF_COLS} FROM perf"))
def _(spark, sf):
    return rounded(M.performance(preds(spark, sf), ["run_id"], null_policy="wrong"))


@query("a2_classification_report", with_(PREDS, SEEN, f1_ctes("seen"), body="""
  SELECT run_id, label, ROUND(precision, 9) AS precision, ROUND(recall, 9) AS recall, ROUND(f1, 9) AS f1, support FROM perf_f
  UNION ALL SELECT run_id, 'accuracy', ROUND(sum(tp) / sum(support)::DOUBLE, 9), ROUND(sum(tp) / sum(support)::DOUBLE, 9), ROUND(sum(tp) / sum(support)::DOUBLE, 9), sum(support)::BIGINT FROM perf_f GROUP BY 1
  UNION ALL SELECT run_id, 'macro avg', ROUND(avg(precision), 9), ROUND(avg(recall), 9), ROUND(avg(f1), 9), sum(support)::BIGINT FROM perf_f GROUP BY 1
  UNION ALL SELECT run_id, 'weighted avg', ROUND(sum(precision * support) / sum(support), 9), ROUND(sum(recall * support) / sum(support), 9), ROUND(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM perf_f GROUP BY 1"""))
def _(spark, sf):
    return rounded(M.classification_report(preds(spark, sf), ["run_id"]))


@query("a3_macro_f1_fixed_labels", with_(PREDS, SEEN, f1_ctes("seen"), body="""SELECT run_id, ROUND(sum(CASE WHEN label IN ('de','en','xx') THEN f1 ELSE 0 END) / 3, 9) AS f1_macro,
  ROUND(sum(f1 * support) / sum(support), 9) AS f1_weighted FROM perf_f GROUP BY 1"""))
def _(spark, sf):
    return rounded(M.performance(preds(spark, sf), ["run_id"], labels=["de", "en", "xx"]).select("run_id", "f1_macro", "f1_weighted"))


@query("a4_confusion_stats", with_(PREDS, STATS, body="SELECT * REPLACE (ROUND(confusing_rate, 9) AS confusing_rate) FROM stats"))
def _(spark, sf):
    return rounded(M.confusion_stats(preds(spark, sf), ["run_id"]))


@query("a5_performance_excluding_confused", with_(PREDS, CLEAR, STATS, f1_ctes("clear"), body=f"""SELECT run_id, n_total, n_unconfused, n_confusing,
  ROUND(confusing_rate, 9) AS confusing_rate, n_zero_labels, n_multi_labels, {PERF_COLS} FROM stats JOIN perf USING (run_id)"""))
def _(spark, sf):
    return rounded(M.performance_excluding_confused(preds(spark, sf), ["run_id"]))


@query("a6_metric_audit", with_(PREDS, CLEAR, STATS, f1_ctes("clear"), body="""SELECT run_id, 0.5::DOUBLE AS accuracy, 0.25::DOUBLE AS f1_macro, ROUND(perf.accuracy, 9) AS accuracy_now,
  ROUND(perf.f1_macro, 9) AS f1_macro_now, n_total, n_confusing, ROUND(perf.accuracy - 0.5, 9) AS accuracy_delta, ROUND(perf.f1_macro - 0.25, 9) AS f1_macro_delta FROM perf JOIN stats USING (run_id)"""))
def _(spark, sf):
    p = preds(spark, sf)
    stored = p.select("run_id").distinct().select("run_id", F.lit(0.5).alias("accuracy"), F.lit(0.25).alias("f1_macro"))
    return rounded(M.metric_audit(stored, p))


@query("a7_probs_summary", with_(PREDS, body="""SELECT run_id, ROUND(avg(greatest(confidence, 1 - confidence)), 9) AS mean_max_prob,
  ROUND(avg(-(confidence * ln(confidence + 1e-12)) - (1 - confidence) * ln(1 - confidence + 1e-12)), 9) AS mean_entropy, NULL::DOUBLE AS mean_confidence FROM preds WHERE run_id <> 'run_4' GROUP BY 1
  UNION ALL SELECT run_id, NULL, NULL, ROUND(avg(confidence), 9) FROM preds WHERE run_id = 'run_4' GROUP BY 1"""))
def _(spark, sf):
    both = F.create_map(F.lit("yes"), F.col("confidence"), F.lit("no"), 1 - F.col("confidence"))
    return rounded(M.probs_summary(preds(spark, sf).withColumn("probs", F.when(F.col("r") < 4, both)), ["run_id"]))


@query("a8_usage_summary", with_(PREDS, body="""SELECT run_id, sum(CASE WHEN doc_id % 8 = 0 THEN NULL ELSE in_tokens END)::BIGINT AS in_tokens_total,
  CASE WHEN run_id = 'run_0' THEN NULL ELSE sum(out_tokens)::BIGINT END AS out_tokens_total FROM preds GROUP BY 1"""))
def _(spark, sf):
    src = preds(spark, sf).withColumns({
        "in_tokens": F.when(F.col("doc_id") % 8 == 0, "n/a").otherwise(F.col("in_tokens").cast("string")),
        "out_tokens": F.when(F.col("r") > 0, F.col("out_tokens")),
    })
    return M.usage_summary(src, ["run_id"])


@query("a9_agreement_rate", with_(PREDS, wide_preds_sql(), body="SELECT ROUND(avg((run_0 = run_1)::INTEGER), 9) AS agreement FROM wide"))
def _(spark, sf):
    wide = J.wide_votes(preds(spark, sf).withColumnRenamed("run_id", "model"), RUNS, ["sample_id"])
    return rounded(M.agreement_rate(wide, "run_0", "run_1"))


PAIRS = """pairs AS (SELECT a.run_id AS run_a, b.run_id AS run_b, a.sample_id, a.pred_label AS pa, b.pred_label AS pb, a.true_label
  FROM preds a JOIN preds b ON a.sample_id = b.sample_id WHERE a.pred_label IS NOT NULL AND b.pred_label IS NOT NULL)"""
COMMON = """common AS (SELECT sample_id FROM preds GROUP BY 1 HAVING count(pred_label) = 5)"""


@query("a10_agreement_matrix", with_(PREDS, PAIRS, body="""SELECT run_a, run_b, count(*) AS n_comparable, ROUND(CASE WHEN run_a = run_b THEN 1.0 ELSE avg((pa = pb)::INTEGER) END, 9)::DOUBLE AS agreement FROM pairs GROUP BY 1, 2"""))
def _(spark, sf):
    return rounded(A.agreement_matrix(preds(spark, sf)))


@query("a11_disagreement_matrix", with_(PREDS, PAIRS, body="""SELECT run_a, run_b, ROUND(CASE WHEN run_a = run_b THEN 0.0 ELSE 1 - avg((pa = pb)::INTEGER) END, 9)::DOUBLE AS disagreement FROM pairs GROUP BY 1, 2"""))
def _(spark, sf):
    return rounded(A.disagreement_matrix(preds(spark, sf)))


KAPPA = """m AS (SELECT run_a, run_b, count(*) AS n_common, avg((pa = pb)::INTEGER) AS observed FROM sel GROUP BY 1, 2),
  ma AS (SELECT run_a, run_b, pa AS l, count(*) AS na FROM sel GROUP BY 1, 2, 3), mb AS (SELECT run_a, run_b, pb AS l, count(*) AS nb FROM sel GROUP BY 1, 2, 3),
  e AS (SELECT run_a, run_b, sum(na * nb)::DOUBLE AS s FROM ma JOIN mb USING (run_a, run_b, l) GROUP BY 1, 2)"""
KAPPA_BODY = """SELECT run_a, run_b, n_common, ROUND(observed, 9) AS observed, ROUND(s / (n_common * n_common), 9) AS expected,
  ROUND((observed - s / (n_common * n_common)) / (1 - s / (n_common * n_common)), 9) AS kappa FROM m JOIN e USING (run_a, run_b)"""


@query("a12_cohen_kappa", with_(PREDS, PAIRS, COMMON, "sel AS (SELECT * FROM pairs SEMI JOIN common USING (sample_id) WHERE run_a < run_b)", KAPPA, body=KAPPA_BODY))
def _(spark, sf):
    return rounded(A.cohen_kappa(preds(spark, sf)))


@query("a12_cohen_kappa_pairwise", with_(PREDS, PAIRS, "sel AS (SELECT * FROM pairs WHERE run_a < run_b)", KAPPA, body=KAPPA_BODY))
def _(spark, sf):
    return rounded(A.cohen_kappa(preds(spark, sf), common="pair"))


# the tail sum of the binomial, by a list of log terms
MCNEMAR_P = """CASE WHEN a_only = b_only THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
  lambda i: exp(lgamma(a_only + b_only + 1.0) - lgamma(i + 1.0) - lgamma(a_only + b_only - i + 1.0) - (a_only + b_only) * ln(2.0))))) END"""


@query("a13_mcnemar", with_(PREDS, PAIRS, COMMON, """t AS (SELECT run_a, run_b, count(*) FILTER (pa = true_label AND pb = true_label) AS both_correct,
  count(*) FILTER (pa = true_label AND pb <> true_label) AS a_only, count(*) FILTER (pa <> true_label AND pb = true_label) AS b_only,
  count(*) FILTER (pa <> true_label AND pb <> true_label) AS both_wrong FROM pairs SEMI JOIN common USING (sample_id) WHERE run_a < run_b GROUP BY 1, 2)""",
  body=f"SELECT *, a_only + b_only AS disagreements, ROUND(ROUND({MCNEMAR_P}, 12), 7)::DOUBLE AS p_value, 'exact' AS p_method FROM t"))
def _(spark, sf):
    return rounded(rounded(A.mcnemar(preds(spark, sf)), 12), 7)


def vote_sql(order: str, usable: str = "label IS NOT NULL") -> str:
    return f"""n AS (SELECT item_id, label, count(*) AS n, sum(confidence) AS conf, min(seq) AS seen FROM votes WHERE {usable} GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, {order}) AS k, rank() OVER (PARTITION BY item_id ORDER BY n DESC) AS rk,
    sum(n) OVER (PARTITION BY item_id) AS tot FROM n),
  w AS (SELECT item_id, max(CASE WHEN k = 1 THEN label END) AS top, count(*) FILTER (rk = 1) > 1 AS is_tie,
    max(CASE WHEN k = 1 THEN n::DOUBLE / tot END) AS share, count(*) AS n_labels, max(tot)::BIGINT AS n_votes FROM o GROUP BY 1)"""


def _vote_query(name, policy, sql_order, expr, **kw):
    sql = with_(VOTES, vote_sql(sql_order), body=f"SELECT item_id, {expr} AS vote, ROUND(share, 9) AS vote_share, is_tie, n_labels, n_votes FROM w")

    @query(name, sql)
    def _(spark, sf):
        return rounded(V.majority_vote(votes(spark, sf), ["item_id"], tie_policy=policy, **kw))


_vote_query("a14_majority_vote_lexicographic", "lexicographic", "label", "top")
_vote_query("a14_majority_vote_first_seen", "first_seen", "seen, label", "top", order="seq")
_vote_query("a14_majority_vote_tie_marker", "tie_marker", "label", "CASE WHEN is_tie THEN 'TIE' ELSE top END")
_vote_query("a14_majority_vote_confidence", "confidence", "ROUND(conf, 6) DESC, label", "top", confidence="confidence")
_vote_query("a14_majority_vote_arbitrary", "arbitrary", "label", "top")


@query("a14_majority_vote_confusing", with_(VOTES, vote_sql("label", "label <> 'error'"), body="""SELECT i.item_id, CASE WHEN w.item_id IS NULL THEN 'error' WHEN is_tie THEN 'confusing' ELSE top END AS vote,
  ROUND(COALESCE(share, 0), 9) AS vote_share, COALESCE(is_tie, FALSE) AS is_tie, COALESCE(n_labels, 0) AS n_labels, COALESCE(n_votes, 0) AS n_votes
  FROM (SELECT DISTINCT item_id FROM votes) i LEFT JOIN w USING (item_id)"""))
def _(spark, sf):
    return rounded(V.majority_vote(votes(spark, sf), ["item_id"], tie_policy="confusing"))


@query("a14_majority_vote_unanimous", with_(VOTES, vote_sql("label", "label <> 'error'"), body="""SELECT i.item_id, CASE WHEN n_labels = 1 THEN top ELSE 'confusing' END AS vote,
  ROUND(COALESCE(share, 0), 9) AS vote_share, COALESCE(is_tie, FALSE) AS is_tie, COALESCE(n_labels, 0) AS n_labels, COALESCE(n_votes, 0) AS n_votes
  FROM (SELECT DISTINCT item_id FROM votes) i LEFT JOIN w USING (item_id)"""))
def _(spark, sf):
    return rounded(V.majority_vote(votes(spark, sf), ["item_id"], tie_policy="unanimous"))


def vote_metric_ctes(src: str, key: str, label: str, order: str) -> str:
    return f"""vn AS (SELECT {key}, {label} AS label, count(*) AS n, min({order}) AS seen FROM {src} GROUP BY 1, 2),
  vo AS (SELECT *, row_number() OVER (PARTITION BY {key}, label IS NULL ORDER BY n DESC, seen, label) AS k FROM vn),
  va AS (SELECT {key}, sum(n)::BIGINT AS n_models, COALESCE(sum(n) FILTER (label IS NOT NULL), 0)::BIGINT AS n_nonempty, count(label) AS n_unique,
    COALESCE(max(CASE WHEN label IS NOT NULL AND k = 1 THEN label END), '') AS majority_label, max(CASE WHEN label IS NOT NULL AND k = 1 THEN n END) AS n1,
    COALESCE(max(CASE WHEN label IS NOT NULL AND k = 2 THEN n END), 0) AS n2, sum(n * ln(n)) FILTER (label IS NOT NULL) AS nln FROM vo GROUP BY 1),
  vm AS (SELECT {key}, n_models, n_nonempty, n_unique, majority_label, COALESCE(n1 / n_nonempty::DOUBLE, 0) AS majority_frac,
    COALESCE((n1 - n2) / n_nonempty::DOUBLE, 0) AS vote_margin, CASE WHEN n_unique > 1 THEN (ln(n_nonempty) - nln / n_nonempty) / ln(n_unique) ELSE 0 END AS entropy,
    n_unique >= 2 AS disagree_any FROM va)"""


VM_COLS = "n_models, n_nonempty, n_unique, majority_label, ROUND(majority_frac, 9) AS majority_frac, ROUND(vote_margin, 9) AS vote_margin, ROUND(entropy, 9)::DOUBLE AS entropy, disagree_any"
VMETRICS = vote_metric_ctes("preds", "sample_id", "pred_label", "run_id")


@query("a15_vote_metrics", with_(PREDS, VMETRICS, body=f"SELECT sample_id, {VM_COLS} FROM vm"))
def _(spark, sf):
    return rounded(V.vote_metrics(preds(spark, sf), ["sample_id"], order="run_id"))


@query("a15_vote_metrics_events", with_(VOTES, vote_metric_ctes("votes", "item_id", "label", "label"), body=f"SELECT item_id, {VM_COLS} FROM vm"))
def _(spark, sf):
    return rounded(V.vote_metrics(votes(spark, sf), ["item_id"], label="label"))


@query("a16_all_agree_rate", with_(PREDS, body="""SELECT dataset_name, count(*) AS n_items, ROUND(avg(ok::INTEGER), 9) AS all_agree_rate FROM (
  SELECT dataset_name, sample_id, count(DISTINCT pred_label) = 1 AND count(pred_label) = 5 AS ok FROM preds GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, sf):
    return rounded(V.all_agree_rate(preds(spark, sf), ["sample_id"], by=["dataset_name"], n_models=5))


@query("a17_ensemble_confidence", with_(VOTES, """n AS (SELECT item_id, label, count(*) AS n FROM votes WHERE label <> 'error' GROUP BY 1, 2),
  w AS (SELECT item_id, arg_min(label, (-n, label)) AS pred, count(*) AS kinds FROM n GROUP BY 1)""", body="""SELECT v.item_id, COALESCE(max(pred), 'error') AS pred,
  ROUND(CASE WHEN max(kinds) > 0 THEN avg(confidence) ELSE 0 END, 9) AS avg_conf, COALESCE(max(kinds), 0) <> 1 AS disagreement FROM votes v LEFT JOIN w USING (item_id) GROUP BY 1"""))
def _(spark, sf):
    return rounded(V.ensemble_confidence(votes(spark, sf), ["item_id"]))


@query("a18_vcsc", with_(VOTES, """t AS (SELECT item_id, label, confidence * 100 AS c FROM votes), n AS (SELECT item_id, label, count(*) AS n, sum(c) AS c FROM t GROUP BY 1, 2),
  tot AS (SELECT item_id, count(*) AS m, avg(c) AS mean_c, var_pop(c) AS v FROM t GROUP BY 1),
  g AS (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY n DESC) AS rk FROM n WHERE label <> 'error'),
  w AS (SELECT item_id, count(*) AS ties, min(label) AS label, min(n) AS n, min(c) AS c FROM g WHERE rk = 1 GROUP BY 1),
  ent AS (SELECT item_id, sum(-(n::DOUBLE / m) * log2(n::DOUBLE / m + 1e-12)) AS h FROM n JOIN tot USING (item_id) GROUP BY 1),
  r AS (SELECT tot.item_id, CASE WHEN w.item_id IS NULL THEN 'all_error' WHEN ties > 1 THEN 'confusing' ELSE 'ok' END AS consensus_status, w.*, m, mean_c, v, h
    FROM tot LEFT JOIN w USING (item_id) JOIN ent USING (item_id))""", body="""SELECT item_id, consensus_status, CASE consensus_status WHEN 'ok' THEN label WHEN 'all_error' THEN 'error' ELSE 'confusing' END AS pred,
  ROUND(CASE WHEN consensus_status = 'ok' THEN n::DOUBLE / m ELSE 0 END, 9) AS sc, ROUND(CASE WHEN consensus_status = 'ok' THEN c / n ELSE mean_c END, 9) AS vc_avg,
  ROUND(0.5 * CASE WHEN consensus_status = 'ok' THEN n::DOUBLE / m ELSE 0 END + 0.5 * CASE WHEN consensus_status = 'ok' THEN c / n ELSE mean_c END / 100, 9) AS vcsc,
  ROUND(h, 9) AS label_entropy, ROUND(CASE WHEN m > 1 THEN v ELSE 0 END, 6) AS confidence_variance FROM r"""))
def _(spark, sf):
    out = V.vcsc(votes(spark, sf).withColumn("confidence", F.col("confidence") * 100), ["item_id"])
    return rounded(out.withColumn("confidence_variance", F.round("confidence_variance", 6)))


CLAIMS = """claims AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS claim_no,
  CASE WHEN l_linenumber = 3 THEN 'null' ELSE 'flag_' || l_returnflag END AS label, 'FLAG_A' AS primary_label, l_discount * 10 AS score FROM lineitem)"""


def claims(spark, sf):
    from pyspark.sql import Window as W

    no = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", no.cast("bigint").alias("claim_no"),
        F.when(F.col("l_linenumber") == 3, "null").otherwise(F.concat(F.lit("flag_"), "l_returnflag")).alias("label"),
        F.lit("FLAG_A").alias("primary_label"), (F.col("l_discount") * 10).alias("score"),
    )


@query("a19_dinco_resolve", with_(CLAIMS, """c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, claim_no) AS k FROM claims),
  a AS (SELECT l_orderkey, sum(greatest(0, score)) + 1e-12 AS mass, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2,
    max(CASE WHEN k = 1 AND label <> 'null' THEN lower(label) END) AS best, max(CASE WHEN k = 1 THEN claim_no END) AS best_claim_no,
    COALESCE(arg_min(score, claim_no) FILTER (lower(label) = lower(primary_label)), arg_min(score, claim_no)) AS target FROM c GROUP BY 1),
  b AS (SELECT *, COALESCE(abs(s1 - s2) <= 1e-6 AND s1 > 0, FALSE) AS tie FROM a)""", body="""SELECT l_orderkey, CASE WHEN tie THEN 'confusing' ELSE COALESCE(best, 'confusing') END AS pred,
  ROUND(target / mass, 9) AS normalized_target_confidence, ROUND(mass, 9) AS total_score_mass, best_claim_no, tie FROM b"""))
def _(spark, sf):
    return rounded(V.dinco_resolve(claims(spark, sf), ["l_orderkey"]))


@query("a20_bool_matrix_label", """SELECT l_orderkey, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN l ELSE 'confusing' END AS pred_label, n AS n_true FROM (
  SELECT l_orderkey, count(*) FILTER (l_discount >= 0.08) AS n, min(l_returnflag || l_linenumber) FILTER (l_discount >= 0.08) AS l FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    v = table(spark, sf, "lineitem").select(
        "l_orderkey", F.concat("l_returnflag", "l_linenumber").alias("label"), (F.col("l_discount") >= 0.08).alias("verdict")
    )
    return V.bool_matrix_label(v, ["l_orderkey"])


@query("a21_oracle_any_correct", with_(PREDS, SCORED, body="""SELECT dataset_name, count(*) AS n_items, count(*) FILTER (ok) AS n_any_correct, ROUND(avg(ok::INTEGER), 9) AS oracle_accuracy FROM (
  SELECT dataset_name, sample_id, bool_or(correct) AS ok FROM scored GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, sf):
    return rounded(V.oracle_any_correct(scored(spark, sf), ["sample_id"], by=["dataset_name"]))


@query("a22_per_model_metrics", with_(PREDS, """ds AS (SELECT source AS dataset_name, run_id AS model, sample_id, true_label, pred_label FROM preds)""",
  "n AS (SELECT dataset_name, sample_id, pred_label AS label, count(*) AS n, max(true_label) AS true_label FROM ds GROUP BY 1, 2, 3)",
  """k AS (SELECT *, rank() OVER (PARTITION BY dataset_name, sample_id ORDER BY n DESC) AS rk FROM n WHERE label IS NOT NULL)""",
  """mv AS (SELECT dataset_name, sample_id, CASE WHEN count(*) = 1 THEN max(label) END AS vote FROM k WHERE rk = 1 GROUP BY 1, 2)""",
  """items AS (SELECT ds.dataset_name, ds.sample_id, max(true_label) AS true_label, count(DISTINCT pred_label) AS kinds, count(pred_label) AS c, max(vote) AS vote
    FROM ds LEFT JOIN mv ON ds.dataset_name = mv.dataset_name AND ds.sample_id = mv.sample_id GROUP BY 1, 2)""",
  """whole AS (SELECT dataset_name, count(*) AS n_samples, avg((kinds = 1 AND c = 5)::INTEGER) AS all_agree_rate, avg(COALESCE(vote = true_label, FALSE)::INTEGER) AS major_vote_accuracy FROM items GROUP BY 1)""",
  """rws AS (SELECT dataset_name, model, true_label, pred_label FROM ds WHERE pred_label IS NOT NULL UNION ALL SELECT dataset_name, 'major_vote', true_label, vote FROM items WHERE vote IS NOT NULL)""",
  f1_ctes("rws", "dataset_name, model"), body="""SELECT dataset_name, model, n_samples, ROUND(n_scored::DOUBLE / n_samples, 9) AS coverage, ROUND(accuracy, 9) AS accuracy, ROUND(f1_macro, 9) AS f1_macro,
  ROUND(f1_weighted, 9) AS f1_weighted, ROUND(all_agree_rate, 9) AS all_agree_rate, ROUND(major_vote_accuracy, 9) AS major_vote_accuracy FROM perf JOIN whole USING (dataset_name)"""))
def _(spark, sf):
    long = preds(spark, sf, "source").drop("dataset_name").withColumnsRenamed({"source": "dataset_name", "run_id": "model"})
    return rounded(V.per_model_metrics(long, RUNS))


BINS = """bins AS (SELECT run_id, greatest(1, ceil(ROUND(confidence * 10, 12)))::INTEGER AS bin, count(*) AS n, avg(confidence) AS avg_conf,
  avg(COALESCE(pred_label = true_label, FALSE)::INTEGER) AS accuracy FROM preds GROUP BY 1, 2)"""


@query("a23_calibration_bins", with_(PREDS, BINS, body="""SELECT run_id, bin, n, ROUND(avg_conf, 9) AS avg_conf, ROUND(accuracy, 9) AS accuracy, ROUND(abs(avg_conf - accuracy), 9) AS abs_gap FROM bins"""))
def _(spark, sf):
    return rounded(C.calibration_bins(preds(spark, sf), ["run_id"]))


@query("a24_ece", with_(PREDS, BINS, body="SELECT run_id, ROUND(sum(n * abs(avg_conf - accuracy)) / sum(n), 9) AS ece FROM bins GROUP BY 1"))
def _(spark, sf):
    return rounded(C.ece(preds(spark, sf), ["run_id"]))


@query("a25_confusions", with_(PREDS, body="SELECT true_label AS true, pred_label AS pred, count(*) AS n FROM preds WHERE run_id = 'run_0' GROUP BY 1, 2 ORDER BY n DESC, true_label, pred_label NULLS LAST LIMIT 10"))
def _(spark, sf):
    return M.confusions(preds(spark, sf).filter("run_id = 'run_0'"), 10)


@query("a26_most_confused", with_(PREDS, body="SELECT true_label AS true, pred_label AS pred, count(*) AS n FROM preds WHERE true_label <> pred_label GROUP BY 1, 2 ORDER BY n DESC, true_label, pred_label LIMIT 5"))
def _(spark, sf):
    return M.most_confused(preds(spark, sf), 5)


COHORT = """coh AS (SELECT sample_id, true_label, run_4 AS new_pred, run_0 AS base_pred, COALESCE(run_4 = true_label, FALSE) AS n, COALESCE(run_0 = true_label, FALSE) AS b FROM wide)"""


@query("a27_cohorts", with_(PREDS, wide_preds_sql(), COHORT, body="""SELECT true_label, count(*) FILTER (n AND b) AS both_correct, count(*) FILTER (n AND NOT b) AS fixed,
  count(*) FILTER (NOT n AND b) AS regressions, count(*) FILTER (NOT n AND NOT b) AS stubborn_failures, ROUND(avg(n::INTEGER), 9) AS new_accuracy, ROUND(avg(b::INTEGER), 9) AS base_accuracy FROM coh GROUP BY 1"""))
def _(spark, sf):
    p = preds(spark, sf)
    pairs = J.cohort_join(p.filter("run_id = 'run_4'"), p.filter("run_id = 'run_0'"), samples(spark, sf))
    return rounded(M.cohorts(pairs))


@query("a28_slice_summary", with_(PREDS, SCORED, VMETRICS, body="""SELECT run_id, CASE WHEN correct THEN 'correct' ELSE 'incorrect' END AS slice, count(*) AS n_rows, ROUND(avg(entropy), 9) AS mean_entropy,
  ROUND(avg(vote_margin), 9) AS mean_vote_margin, ROUND(avg(disagree_any::INTEGER), 9) AS p_disagree_any FROM scored JOIN vm USING (sample_id) GROUP BY 1, 2"""))
def _(spark, sf):
    s = scored(spark, sf)
    return rounded(R.slice_summary(s, V.vote_metrics(s, ["sample_id"], order="run_id")))


@query("a29_describe_by", """SELECT source, count(n_chars) AS count, ROUND(avg(n_chars), 9) AS mean, ROUND(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, max(n_chars) AS max,
  ROUND(quantile_cont(n_chars, 0.25), 9) AS q25, ROUND(quantile_cont(n_chars, 0.5), 9) AS q50, ROUND(quantile_cont(n_chars, 0.75), 9) AS q75 FROM documents GROUP BY 1""")
def _(spark, sf):
    return rounded(M.describe_by(table(spark, sf, "documents"), "source", "n_chars").withColumn("std", F.round("std", 6)))


LEVELS = {"1-urgent": 0, "2-high": 1, "3-medium": 2, "4-not_specified": 3, "5-low": 4}


@query("a30_adjusted_distance", """SELECT o_orderstatus AS run_id, ROUND(avg(CASE WHEN o_orderkey % 13 = 0 THEN 4 ELSE abs(((l + o_orderkey % 3) % 5) - l) END), 9) AS adjusted_distance
  FROM (SELECT *, left(o_orderpriority, 1)::INTEGER - 1 AS l FROM orders) GROUP BY 1""")
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in LEVELS])
    level = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    pred = F.when(F.col("o_orderkey") % 13 == 0, "mystery").otherwise(names[((level + F.col("o_orderkey") % 3) % 5).cast("int")])
    src = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("run_id"), F.col("o_orderpriority").alias("true_label"), pred.alias("pred_label")
    )
    return rounded(M.adjusted_distance(src, ["run_id"], LEVELS))


@query("a31_summarize_parse_errors", with_(PREDS, "pe AS (SELECT run_id, true_label, COALESCE(pred_label, 'parse_error') AS pred_label FROM preds)", "ok AS (SELECT * FROM pe WHERE pred_label <> 'parse_error')",
  f1_ctes("ok"), body=f"SELECT run_id, count(*) FILTER (pred_label = 'parse_error') AS parse_error_count, any_value(n_scored) AS n_scored, ROUND(any_value(accuracy), 9) AS accuracy, ROUND(any_value(f1_macro), 9) AS f1_macro, ROUND(any_value(f1_weighted), 9) AS f1_weighted FROM pe JOIN perf USING (run_id) GROUP BY 1"))
def _(spark, sf):
    src = preds(spark, sf).withColumn("pred_label", F.coalesce("pred_label", F.lit("parse_error")))
    return rounded(M.summarize_parse_errors(src, ["run_id"]))


@query("a32_label_distribution", """SELECT l.label, count(d.lang) AS n, ROUND(count(d.lang) / (SELECT count(*) FROM documents)::DOUBLE, 9) AS share
  FROM (SELECT unnest(['de','en','es','fr','it']) AS label) l LEFT JOIN documents d ON d.lang = l.label GROUP BY 1""")
def _(spark, sf):
    return rounded(M.label_distribution(samples(spark, sf), labels=[*LANGS, "it"]))


@query("a33_top_labels", "SELECT source AS label, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, label LIMIT 5")
def _(spark, sf):
    return M.top_labels(table(spark, sf, "documents"), 5, label="source")


def detection_sql(src: str, by: str) -> str:
    return f"""SELECT {by}, tp, fp, fn, tn, tp + fp AS flagged_rows, tp + fn AS corrupted_rows, ROUND(COALESCE(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision,
  ROUND(COALESCE(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall, ROUND(COALESCE(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1,
  ROUND((tp + fp) / (tp + fp + fn + tn)::DOUBLE, 9) AS flag_rate FROM (SELECT {by}, count(*) FILTER (is_flagged AND is_corrupted) AS tp, count(*) FILTER (is_flagged AND NOT is_corrupted) AS fp,
  count(*) FILTER (NOT is_flagged AND is_corrupted) AS fn, count(*) FILTER (NOT is_flagged AND NOT is_corrupted) AS tn FROM {src} GROUP BY {by})"""


@query("a34_detection_metrics", with_(NOISY, FLAGS, body=detection_sql("flags", "method")))
def _(spark, sf):
    return rounded(M.detection_metrics(flags(spark, sf), ["method"]))


@query("a35_crosstab", with_(NOISY, FLAGS, body="""SELECT CASE WHEN is_corrupted THEN 'corrupted' ELSE 'not_corrupted' END AS actual, count(*) FILTER (NOT is_flagged) AS not_flagged,
  count(*) FILTER (is_flagged) AS flagged FROM flags WHERE method = 'm1' GROUP BY 1"""))
def _(spark, sf):
    f = flags(spark, sf).filter("method = 'm1'").select(
        F.when(F.col("is_corrupted"), "corrupted").otherwise("not_corrupted").alias("actual"),
        F.when(F.col("is_flagged"), "flagged").otherwise("not_flagged").alias("predicted"),
    )
    return M.crosstab(f, "actual", "predicted", ["not_flagged", "flagged"], ["not_corrupted", "corrupted"])


@query("a36_corruption_summary", with_(NOISY, body="SELECT true_label::VARCHAR AS true_label, CASE WHEN is_corrupted THEN 'flip' ELSE 'clean' END AS corruption_kind, count(*) AS n FROM noisy GROUP BY 1, 2"))
def _(spark, sf):
    return M.corruption_summary(noisy(spark, sf).select(
        F.col("true_label").cast("string").alias("true_label"), F.when(F.col("is_corrupted"), "flip").otherwise("").alias("corruption_kind")
    ))


@query("a43_two_stage_metrics", with_(PREDS, """two AS (SELECT source, sample_id, max(true_label) AS true_label, max(CASE WHEN r = 0 THEN pred_label END) AS p1, COALESCE(max(CASE WHEN r = 4 THEN pred_label END), '') AS pred_label,
  max(CASE WHEN r = 4 THEN confidence END) AS confidence FROM preds GROUP BY 1, 2)""", f1_ctes("two", "source"), """chg AS (SELECT source, ROUND(avg((p1 IS DISTINCT FROM nullif(pred_label, ''))::INTEGER), 9) AS change_rate, ROUND(avg(confidence), 9) AS mean_confidence FROM two GROUP BY 1)""",
  body="SELECT source, change_rate, mean_confidence, ROUND(accuracy, 9) AS accuracy, ROUND(f1_macro, 9) AS f1_macro FROM perf JOIN chg USING (source)"))
def _(spark, sf):
    two = preds(spark, sf, "source").groupBy("source", "sample_id").agg(
        F.max("true_label").alias("true_label"), F.max(F.when(F.col("r") == 0, F.col("pred_label"))).alias("pass1_label"),
        F.max(F.when(F.col("r") == 4, F.col("pred_label"))).alias("pass2_label"), F.max(F.when(F.col("r") == 4, F.col("confidence"))).alias("confidence"),
    )
    return rounded(M.two_stage_metrics(two, ["source"]))


@query("a44_repeat_run_summary", with_(PREDS, """n AS (SELECT sample_id, pred_label AS label, count(*) AS n, sum(confidence) AS c FROM preds WHERE pred_label IS NOT NULL GROUP BY 1, 2)""",
  """w AS (SELECT sample_id, arg_min(label, (-n, -ROUND(c, 6), label)) AS vote, max(n) / sum(n)::DOUBLE AS share, count(*) AS k FROM n GROUP BY 1)""",
  body="""SELECT p.sample_id, max(vote) AS vote, ROUND(COALESCE(max(share), 0), 9) AS vote_share, ROUND(avg(confidence), 9) AS decision_confidence, COALESCE(max(k), 0) = 1 AS all_runs_agree
  FROM preds p LEFT JOIN w USING (sample_id) GROUP BY 1"""))
def _(spark, sf):
    runs = preds(spark, sf).withColumnRenamed("pred_label", "label")
    return rounded(V.repeat_run_summary(runs, ["sample_id"]))


@query("a45_avg_probs", with_(PREDS, body="""SELECT sample_id, label, ROUND(avg(CASE WHEN pred_label IS NULL THEN 0.25 WHEN pred_label = label THEN confidence ELSE (1 - confidence) / 3.0 END), 9) AS prob
  FROM preds, (SELECT unnest(['de','en','es','fr']) AS label) GROUP BY 1, 2"""))
def _(spark, sf):
    p = preds(spark, sf).withColumn("probs", S.probs_from_confidence(F.col("pred_label"), F.col("confidence"), LANGS))
    return rounded(V.avg_probs(p, ["sample_id"]))


def label_sets(spark, sf):
    """Predicted label sets: none, the prediction, or prediction and next language."""
    p = preds(spark, sf)
    some = F.when(F.col("n_pred_labels") == 0, F.array().cast("array<string>")).when(
        F.col("n_pred_labels") == 1, F.array("pred_label")
    ).otherwise(F.array(F.col("pred_label"), F.lit("it")))
    return p.withColumn("pred_labels", F.filter(some, lambda x: x.isNotNull()))


SETS = """sets AS (SELECT *, list_filter(CASE n_pred_labels WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [pred_label] ELSE [pred_label, 'it'] END, lambda x: x IS NOT NULL) AS pred_labels FROM preds)"""


@query("a46_probe_metrics", with_(PREDS, SETS, body="""SELECT run_id, count(*) AS n_items, ROUND(count(*) FILTER (len(pred_labels) = 1 AND pred_labels[1] = true_label) / count(*)::DOUBLE, 9) AS top1_accuracy,
  ROUND(count(*) FILTER (list_contains(pred_labels, true_label)) / count(*)::DOUBLE, 9) AS gold_in_set_rate, count(*) FILTER (len(pred_labels) <> 1) AS n_confusing,
  ROUND(count(*) FILTER (len(pred_labels) <> 1) / count(*)::DOUBLE, 9) AS confusion_rate, count(*) FILTER (len(pred_labels) = 0) AS n_pred_labels_zero,
  count(*) FILTER (len(pred_labels) > 1) AS n_pred_labels_multi, count(*) FILTER (len(pred_labels) = 1) AS n_pred_labels_single,
  ROUND(count(*) FILTER (len(pred_labels) = 0) / count(*)::DOUBLE, 9) AS rate_pred_zero, ROUND(count(*) FILTER (len(pred_labels) > 1) / count(*)::DOUBLE, 9) AS rate_pred_multi FROM sets GROUP BY 1"""))
def _(spark, sf):
    return rounded(M.probe_metrics(label_sets(spark, sf), ["run_id"]))


@query("a47_telemetry", with_(PREDS, body="""SELECT run_id, ROUND(sum(h / 100.0), 4) AS elapsed_s, count(*) AS n_calls, sum(in_tokens)::BIGINT AS prompt_tokens, sum(out_tokens)::BIGINT AS candidate_tokens,
  nullif(sum(CASE WHEN run_id = 'run_0' THEN 0 ELSE h % 3 END)::BIGINT, 0) AS thought_tokens, (sum(out_tokens) - sum(CASE WHEN run_id = 'run_0' THEN 0 ELSE h % 3 END))::BIGINT AS visible_tokens FROM preds GROUP BY 1"""))
def _(spark, sf):
    calls = preds(spark, sf).select(
        "run_id", (F.col("h") / 100.0).alias("elapsed_s"), F.col("in_tokens").alias("prompt_tokens"),
        F.col("out_tokens").alias("candidate_tokens"), F.when(F.col("r") > 0, F.col("h") % 3).alias("thought_tokens"),
    )
    return M.telemetry(calls, ["run_id"])


@query("a48_batch_log", with_(PREDS, SCORED, "p0 AS (SELECT * FROM scored WHERE run_id = 'run_0')", rank_cte("p0", ""), body="""SELECT (rk - 1) // 10 AS batch_id, count(*) AS batch_size,
  string_agg(sample_id, ',' ORDER BY rk) AS sample_ids, string_agg(true_label, ',' ORDER BY rk) AS gold_labels, string_agg(COALESCE(pred_label, ''), ',' ORDER BY rk) AS pred_labels,
  count(*) FILTER (correct) AS correct_count, ROUND(avg(correct::INTEGER), 9) AS batch_accuracy, sum(in_tokens)::BIGINT AS prompt_tokens, sum(out_tokens)::BIGINT AS output_tokens, max(h / 100.0)::DOUBLE AS elapsed_s FROM ranked GROUP BY 1"""))
def _(spark, sf):
    p0 = scored(spark, sf).filter("run_id = 'run_0'").withColumn("elapsed_s", F.col("h") / 100.0)
    log = B.batch_log(B.fixed_batches(p0, 10, seed=42))
    return rounded(log.withColumns({c: F.array_join(c, ",") for c in ("sample_ids", "gold_labels", "pred_labels")}))


@query("a49_label_accuracy", with_(PREDS, SCORED, "p0 AS (SELECT *, doc_id // 10 AS batch_id FROM scored WHERE run_id = 'run_0')", body="""
  SELECT l.label, ROUND(COALESCE(avg(correct::INTEGER), 0), 9) AS accuracy, 'label' AS level FROM (SELECT unnest(['de','en','es','fr','it']) AS label) l LEFT JOIN p0 ON p0.true_label = l.label GROUP BY 1
  UNION ALL SELECT NULL, ROUND(avg(correct::INTEGER), 9), 'overall' FROM p0
  UNION ALL SELECT NULL, ROUND(avg(a), 9), 'batch_mean' FROM (SELECT avg(correct::INTEGER) AS a FROM p0 GROUP BY batch_id)"""))
def _(spark, sf):
    p0 = scored(spark, sf).filter("run_id = 'run_0'").withColumn("batch_id", F.floor(F.col("doc_id") / 10))
    return rounded(M.label_accuracy(p0, [*LANGS, "it"]))


ARRAYS = """arr AS (SELECT sample_id, list(true_label ORDER BY run_id) AS gold, list(pred_label ORDER BY run_id) AS pred FROM preds GROUP BY 1)"""


def run_arrays(spark, sf):
    s = F.array_sort(F.collect_list(F.struct("run_id", "true_label", "pred_label")))
    return preds(spark, sf).groupBy("sample_id").agg(s.alias("s")).select(
        "sample_id", F.transform("s", lambda x: x["true_label"]).alias("gold"), F.transform("s", lambda x: x["pred_label"]).alias("pred")
    )


@query("a50_batch_score", with_(PREDS, ARRAYS, """e AS (SELECT sample_id, gold, pred, list_filter(list_transform(range(1, 6), lambda i: CASE WHEN gold[i] IS DISTINCT FROM pred[i]
  THEN 'Pos ' || i || ': expected ' || gold[i] || ', got ' || COALESCE(pred[i], 'None') END), lambda x: x IS NOT NULL) AS errs FROM arr)""", body="""SELECT sample_id, ROUND((5 - len(errs)) / 5.0, 9)::DOUBLE AS score,
  CASE WHEN len(errs) = 0 THEN 'Perfect batch.' ELSE 'Partial (' || (5 - len(errs)) || '/5). ' || array_to_string(errs, '; ') END AS feedback FROM e"""))
def _(spark, sf):
    return rounded(M.batch_score(run_arrays(spark, sf)).select("sample_id", "score", "feedback"))


def report_docs(spark, sf):
    """A report and a config body per run, made from the predictions."""
    rep = E.report_struct(E.evaluate(preds(spark, sf), ["run_id"]), ["run_id"])
    report = F.to_json(F.struct(F.lit("documents").alias("dataset_name"), F.lit(200).alias("tier_size"), "metrics", "extras"))
    config = F.to_json(F.struct(F.struct(F.lit("toy").alias("kind"), F.struct(F.col("run_id").alias("model_id"), F.lit(10).alias("batch_size")).alias("params")).alias("model")))
    return rep.select(F.col("run_id").alias("run_dir"), report.alias("report"), config.alias("config"))


@query("a51_aggregate_reports", with_(PREDS, CLEAR, STATS, f1_ctes("clear"), body="""SELECT run_id AS run_dir, 'documents' AS dataset_name, NULL::VARCHAR AS predictor_name, ROUND(f1_macro, 9) AS f1_macro, ROUND(accuracy, 9) AS accuracy,
  NULL::DOUBLE AS infer_time_s, NULL::DOUBLE AS train_time_s, ROUND(confusing_rate, 9) AS confusing_rate, 200::BIGINT AS tier_size, (SELECT sum(in_tokens)::BIGINT FROM preds p WHERE p.run_id = perf.run_id) AS in_tokens_total,
  (SELECT sum(out_tokens)::BIGINT FROM preds p WHERE p.run_id = perf.run_id) AS out_tokens_total, n_total, n_scored, n_confusing, n_zero_labels, n_multi_labels, TRUE AS has_confusion_stats,
  'toy' AS model_kind, run_id AS model_id, NULL::VARCHAR AS prompt_id, '10' AS batch_size, NULL::VARCHAR AS max_concurrency, NULL::VARCHAR AS temperature, NULL::VARCHAR AS max_tokens, NULL::VARCHAR AS retries FROM perf JOIN stats USING (run_id)"""))
def _(spark, sf):
    return rounded(aggregate_reports(report_docs(spark, sf)))


@query("a52_per_class_pr_long", with_(PREDS, SEEN, f1_ctes("seen"), body="""SELECT run_id, label, 'precision' AS metric, ROUND(precision, 9) AS value FROM perf_f UNION ALL SELECT run_id, label, 'recall', ROUND(recall, 9) FROM perf_f"""))
def _(spark, sf):
    rep = M.classification_report(preds(spark, sf), ["run_id"]).groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.struct("precision", "recall", "support")))).alias("classification_report")
    )
    return rounded(M.per_class_pr_long(rep))


@query("a53_pivot_metric", with_(PREDS, "s AS (SELECT source AS dataset_name, run_id, avg(COALESCE(pred_label = true_label, FALSE)::INTEGER) AS v FROM preds GROUP BY 1, 2)",
  body="SELECT dataset_name, " + ", ".join(f"ROUND(max(CASE WHEN run_id = '{r}' THEN v END), 9) AS {r}" for r in RUNS) + " FROM s GROUP BY 1"))
def _(spark, sf):
    ok = F.coalesce(F.col("pred_label") == F.col("true_label"), F.lit(False)).cast("double")
    runs = preds(spark, sf, "source").groupBy(F.col("source").alias("dataset_name"), F.col("run_id").alias("model_id")).agg(F.avg(ok).alias("v"))
    return rounded(M.pivot_metric(runs.withColumn("run_key", F.concat("dataset_name", "model_id")), metric="v", models=RUNS))


@query("a54_run_summary", with_(PREDS, body="""SELECT run_id, count(*) AS n_rows, count(*) FILTER (pred_label IN ('de','en','fr')) AS n_eval,
  ROUND(avg((pred_label = true_label)::INTEGER) FILTER (pred_label IN ('de','en','fr')), 9) AS accuracy, count(confidence) AS n_confidence FROM preds GROUP BY 1"""))
def _(spark, sf):
    inside = F.coalesce(F.col("pred_label").isin("de", "en", "fr"), F.lit(False))
    long = preds(spark, sf).withColumns({"in_eval": inside, "correct": F.when(inside, F.col("pred_label") == F.col("true_label"))})
    return rounded(M.run_summary(long, ["run_id"]))


@query("a55_not_stated_fraction", with_(VOTES, body="""SELECT item_id, ROUND(COALESCE(avg((label = 'error')::INTEGER), 1), 9) AS not_stated_fraction, ROUND(1 - COALESCE(avg((label = 'error')::INTEGER), 1), 9) AS coverage_confidence FROM votes GROUP BY 1"""))
def _(spark, sf):
    a = votes(spark, sf).withColumn("answer", F.when(F.col("label") == "error", " Not stated. ").otherwise(F.col("label")))
    return rounded(M.not_stated_fraction(a, ["item_id"]))


def answer_edges(spark, sf):
    """Answers are the turns of a conversation; same role and neighbouring turns entail each other."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("answer_id"), "role")
    step = c.select("question_id", F.col("answer_id").alias("src"), F.explode(F.array(F.col("answer_id") - 2, F.col("answer_id") + 2)).alias("dst"), "role")
    other = c.select("question_id", F.col("answer_id").alias("dst"), F.col("role").alias("role2"))
    edges = step.join(other, ["question_id", "dst"]).filter("role = role2").select(
        "question_id", "src", "dst", F.when((F.least("src", "dst") % 3 == 0) & (F.col("src") < F.col("dst")), 0.2).otherwise(0.9).alias("score")
    )
    return c, edges


@query("a56_semantic_entropy", """WITH RECURSIVE c AS (SELECT conv_id AS q, turn AS a, role FROM conversations),
  e AS (SELECT x.q, x.a AS s, y.a AS d FROM c x JOIN c y ON x.q = y.q AND abs(x.a - y.a) = 2 AND x.role = y.role AND least(x.a, y.a) % 3 <> 0),
  reach AS (SELECT q, a AS s, a AS d FROM c UNION SELECT r.q, r.s, e.d FROM reach r JOIN e ON r.q = e.q AND r.d = e.s),
  comp AS (SELECT q, s, min(d) AS k FROM reach GROUP BY 1, 2), sz AS (SELECT q, k, count(*) AS n FROM comp GROUP BY 1, 2),
  h AS (SELECT q, sum(n)::BIGINT AS t, count(*) AS m, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS nats FROM sz GROUP BY 1)
  SELECT q AS question_id, t AS n_answers, m AS n_clusters, ROUND(CASE WHEN abs(nats) < 1e-12 THEN 0 ELSE nats END, 9)::DOUBLE AS entropy_nats, ROUND(CASE WHEN abs(nats) < 1e-12 THEN 0 ELSE nats / ln(2) END, 9)::DOUBLE AS entropy_bits FROM h""")
def _(spark, sf):
    answers, edges = answer_edges(spark, sf)
    return rounded(V.semantic_entropy(answers, edges, threshold=0.5))


ML = """ml AS (SELECT sample_id, list_distinct(list(true_label)) AS gold, list_filter(list_distinct(list(pred_label)), lambda x: x IS NOT NULL) AS pred FROM preds GROUP BY 1)"""
ML_CELLS = """cells AS (SELECT l.label, count(*) FILTER (list_contains(gold, l.label) AND list_contains(pred, l.label)) AS tp, count(*) FILTER (NOT list_contains(gold, l.label) AND list_contains(pred, l.label)) AS fp,
  count(*) FILTER (list_contains(gold, l.label) AND NOT list_contains(pred, l.label)) AS fn FROM ml, (SELECT unnest(['de','en','es','fr']) AS label) l GROUP BY 1)"""


def multilabel(spark, sf):
    return preds(spark, sf).groupBy("sample_id").agg(F.collect_set("true_label").alias("gold"), F.collect_set("pred_label").alias("pred"))


@query("a58_multilabel_metrics", with_(PREDS, ML, ML_CELLS, body="""SELECT (SELECT ROUND(avg((list_sort(gold) = list_sort(pred))::INTEGER), 9) FROM ml) AS exact_match_accuracy, (SELECT count(*) FROM ml) AS n_texts,
  (SELECT count(*) FROM ml WHERE list_sort(gold) <> list_sort(pred)) AS n_mismatched, ROUND(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 9) AS micro_f1, ROUND(avg(2 * tp / (2 * tp + fp + fn)::DOUBLE), 9) AS macro_f1 FROM cells"""))
def _(spark, sf):
    return rounded(M.multilabel_metrics(multilabel(spark, sf), LANGS))


@query("a58_multilabel_report", with_(PREDS, ML, ML_CELLS, body="""SELECT label, tp, fp, fn, ROUND(tp / (tp + fp)::DOUBLE, 9) AS precision, ROUND(tp / (tp + fn)::DOUBLE, 9) AS recall, ROUND(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1, tp + fn AS support FROM cells"""))
def _(spark, sf):
    return rounded(M.multilabel_report(multilabel(spark, sf), LANGS))


@query("a59_logprob_summary", """SELECT l_orderkey, count(v) > 0 AS logprobs_available, ROUND(avg(v), 9) AS mean_logprob, ROUND(min(v), 9) AS min_logprob, ROUND(max(v), 9) AS max_logprob FROM (
  SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE -l_discount END AS v FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    tok = F.struct("l_linenumber", F.when(F.col("l_returnflag") != "R", -F.col("l_discount")).alias("logprob"))
    resp = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(tok)).alias("content"))
    return rounded(M.logprob_summary(resp).drop("content"))


# joins -----------------------------------------------------------------------------------------

def _wide_cols(col):
    return ", ".join(f"max(CASE WHEN run_id = '{r}' THEN {col} END) AS {col}__{r}" for r in ("run_0", "run_2"))


@query("j1_compare_runs_wide", with_(PREDS, body=f"""SELECT sample_id, max(dataset_name) AS dataset_name, max(true_label) AS true_label, {_wide_cols('pred_label')}, {_wide_cols('confidence')}, {_wide_cols('in_tokens')},
  {_wide_cols('out_tokens')}, {_wide_cols('is_confusing')}, {_wide_cols('n_pred_labels')} FROM preds WHERE run_id IN ('run_0', 'run_2') AND NOT (run_id = 'run_2' AND pred_label IS NULL) GROUP BY 1 HAVING count(DISTINCT run_id) = 2"""))
def _(spark, sf):
    p = preds(spark, sf).filter("NOT (r = 2 AND pred_label IS NULL)")
    return J.compare_runs_wide(p, ["run_0", "run_2"])


@query("j1_run_overlap", with_(PREDS, """p AS (SELECT * FROM preds WHERE run_id IN ('run_0', 'run_2') AND NOT (run_id = 'run_2' AND pred_label IS NULL))""", body="""SELECT p.run_id, count(*) AS n_ids, count(a.sample_id) AS n_overlap
  FROM p LEFT JOIN (SELECT sample_id FROM p WHERE run_id = 'run_0') a USING (sample_id) GROUP BY 1"""))
def _(spark, sf):
    return J.run_overlap(preds(spark, sf).filter("NOT (r = 2 AND pred_label IS NULL)"), ["run_0", "run_2"])


TWO = "two AS (SELECT *, COALESCE(run_0 = true_label, FALSE) AS a, COALESCE(run_3 = true_label, FALSE) AS b, run_0 IS NOT DISTINCT FROM run_3 AS same FROM wide)"


@query("j2_compare_two_runs", with_(PREDS, wide_preds_sql(), TWO, body="""SELECT count(*) AS n_overlap, ROUND(avg(same::INTEGER), 9) AS pred_agreement, count(*) FILTER (NOT same) AS pred_disagree_n, ROUND(avg(a::INTEGER), 9) AS accuracy_a,
  ROUND(avg(b::INTEGER), 9) AS accuracy_b, ROUND(avg(b::INTEGER) - avg(a::INTEGER), 9) AS accuracy_delta, count(*) FILTER (a AND NOT b) AS a_correct_b_wrong, count(*) FILTER (b AND NOT a) AS a_wrong_b_correct, count(*) FILTER (a <> b) AS flipped_n FROM two"""))
def _(spark, sf):
    return rounded(J.compare_two_runs(preds(spark, sf), "run_0", "run_3"))


@query("j3_paired_rows", with_(PREDS, wide_preds_sql(), wide_preds_sql("confidence").replace("wide AS", "widec AS"), body="SELECT sample_id, wide.true_label, wide.run_0 AS pred_label__run_0, wide.run_4 AS pred_label__run_4, widec.run_0 AS confidence__run_0, widec.run_4 AS confidence__run_4 FROM wide JOIN widec USING (sample_id)"))
def _(spark, sf):
    cols = ["sample_id", "true_label", *[f"{c}__{r}" for c in ("pred_label", "confidence") for r in ("run_0", "run_4")]]
    return J.paired_rows(preds(spark, sf), "run_4", "run_0").select(*cols)


def runs_table(spark, sf):
    """One run per source and run number, scored by its accuracy."""
    ok = F.coalesce(F.col("pred_label") == F.col("true_label"), F.lit(False)).cast("double")
    return preds(spark, sf, "source").groupBy("source", "r").agg(F.avg(ok).alias("accuracy"), F.count("*").alias("n_samples")).select(
        F.concat("source", F.lit("/run_"), "r").alias("run_key"), F.col("source").alias("dataset_name"),
        F.concat(F.lit("m"), F.col("r") % 2).alias("model_id"), F.when(F.col("r") % 2 == 0, "low").alias("thinking_level"),
        F.lit(200).cast("bigint").alias("tier_size"), (5 * F.col("r")).cast("bigint").alias("batch_size"),
        F.concat(F.lit("kind_"), F.col("r") % 2).alias("model_kind"), "accuracy", (F.col("accuracy") / 2).alias("f1_macro"),
        (F.col("r") != 3).alias("has_predictions"), "n_samples", F.concat(F.lit("2026010"), "r").alias("saved_utc"), "r",
    )


RUNS_SQL = """runs AS (SELECT source || '/run_' || r AS run_key, source AS dataset_name, 'm' || (r % 2) AS model_id, CASE WHEN r % 2 = 0 THEN 'low' END AS thinking_level, 200::BIGINT AS tier_size,
  (5 * r)::BIGINT AS batch_size, 'kind_' || (r % 2) AS model_kind, avg(COALESCE(pred_label = true_label, FALSE)::INTEGER) AS accuracy, avg(COALESCE(pred_label = true_label, FALSE)::INTEGER) / 2 AS f1_macro,
  r <> 3 AS has_predictions, count(*) AS n_samples, '2026010' || r AS saved_utc, r FROM preds GROUP BY source, r)"""


@query("j4_pair_with_baseline", with_(PREDS, RUNS_SQL, """b AS (SELECT *, row_number() OVER (PARTITION BY dataset_name, model_id, thinking_level, tier_size ORDER BY (batch_size = 10) DESC, f1_macro DESC, run_key) AS k FROM runs WHERE r IN (0, 1, 2))""",
  body="""SELECT a.dataset_name, a.model_id, a.thinking_level, a.tier_size, a.run_key, a.model_kind, ROUND(a.f1_macro, 9) AS run_f1, ROUND(a.accuracy, 9) AS run_accuracy, b.run_key IS NOT NULL AS matched, b.run_key AS baseline_key,
  b.batch_size AS baseline_batch_size, ROUND(b.f1_macro, 9) AS baseline_f1, ROUND(b.accuracy, 9) AS baseline_accuracy, ROUND(a.f1_macro - b.f1_macro, 9) AS delta_f1, ROUND(a.accuracy - b.accuracy, 9) AS delta_accuracy
  FROM runs a LEFT JOIN b ON a.dataset_name = b.dataset_name AND a.model_id = b.model_id AND a.thinking_level IS NOT DISTINCT FROM b.thinking_level AND a.tier_size = b.tier_size AND b.k = 1 WHERE a.r IN (3, 4)"""))
def _(spark, sf):
    runs = runs_table(spark, sf)
    return rounded(J.pair_with_baseline(runs.filter("r IN (3, 4)"), runs.filter("r IN (0, 1, 2)")))


@query("j5_exclude_ids", with_(SAMPLES, body="SELECT sample_id, true_label FROM samples WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def _(spark, sf):
    ids = table(spark, sf, "labels").select(F.concat(F.lit("train_"), "doc_id").alias("sample_id"))
    return J.exclude_ids(samples(spark, sf), ids).select("sample_id", "true_label")


@query("j6_select_ids", with_(SAMPLES, body="SELECT sample_id, true_label FROM samples WHERE doc_id IN (SELECT doc_id FROM labels)"))
def _(spark, sf):
    ids = table(spark, sf, "labels").select(F.concat(F.lit("train_"), "doc_id").alias("sample_id"))
    return J.select_ids(samples(spark, sf), ids).select("sample_id", "true_label")


@query("j7_select_in_order", with_(SAMPLES, body="SELECT (SELECT max(doc_id) FROM labels) - doc_id AS position, sample_id, true_label FROM samples WHERE doc_id IN (SELECT doc_id FROM labels)"))
def _(spark, sf):
    labels = table(spark, sf, "labels")
    order = labels.select(
        (labels.agg(F.max("doc_id")).scalar() - F.col("doc_id")).alias("position"), F.concat(F.lit("train_"), "doc_id").alias("sample_id")
    )
    return J.select_in_order(samples(spark, sf), order).select("position", "sample_id", "true_label")


def doc_edges(spark, sf):
    """Edges from every wrong prediction of the first run to the next document."""
    s = samples(spark, sf, "doc_id").select("doc_id", F.col("sample_id").alias("contrast_sample_id"), F.col("text").alias("contrast_text"), F.col("true_label").alias("contrast_true_label"))
    wrong = scored(spark, sf).filter("run_id = 'run_0' AND NOT correct").select(F.col("sample_id").alias("anchor_sample_id"), F.col("true_label").alias("anchor_true_label"), (F.col("doc_id") + 1).alias("doc_id"))
    return wrong.join(s, "doc_id").filter("anchor_true_label <> contrast_true_label").drop("doc_id")


EDGES = """edges AS (SELECT p.sample_id AS anchor_sample_id, p.true_label AS anchor_true_label, s.sample_id AS contrast_sample_id, s.text AS contrast_text, s.true_label AS contrast_true_label
  FROM scored p JOIN samples s ON s.doc_id = p.doc_id + 1 WHERE p.run_id = 'run_0' AND NOT p.correct AND p.true_label <> s.true_label)"""


@query("j8_operating_frame", with_(SAMPLES, PREDS, SCORED, EDGES, """ids AS (SELECT sample_id FROM samples WHERE sample_id IN (SELECT min(sample_id) FROM samples GROUP BY source) UNION SELECT anchor_sample_id FROM edges UNION SELECT contrast_sample_id FROM edges)""",
  body="""SELECT s.sample_id, s.true_label, CASE WHEN c.sample_id IS NOT NULL THEN p.pred_label END AS pred_label, c.sample_id IS NOT NULL AND COALESCE(p.correct, FALSE) AS correct
  FROM samples s SEMI JOIN ids USING (sample_id) LEFT JOIN (SELECT * FROM scored WHERE run_id = 'run_1') p USING (sample_id) LEFT JOIN (SELECT min(sample_id) AS sample_id FROM samples GROUP BY source) c USING (sample_id)"""))
def _(spark, sf):
    s = samples(spark, sf, "source")
    p = scored(spark, sf).filter("run_id = 'run_1'")
    first = s.groupBy("source").agg(F.min("sample_id").alias("sample_id"))
    return J.operating_frame(s, first, p, doc_edges(spark, sf)).select("sample_id", "true_label", "pred_label", "correct")


@query("j9_labelled_frame", with_(SAMPLES, PREDS, SCORED, EDGES, "p AS (SELECT * FROM scored WHERE run_id = 'run_0' AND NOT is_confusing)", body="""SELECT sample_id, true_label, pred_label, correct FROM p
  UNION ALL SELECT DISTINCT contrast_sample_id, contrast_true_label, NULL, FALSE FROM edges WHERE contrast_sample_id NOT IN (SELECT sample_id FROM p)"""))
def _(spark, sf):
    p = scored(spark, sf).filter("run_id = 'run_0' AND NOT is_confusing").join(samples(spark, sf).select("sample_id", "text"), "sample_id")
    return J.labelled_frame(p, doc_edges(spark, sf), dataset_name="documents").select("sample_id", "true_label", "pred_label", "correct")


@query("j13_wide_votes", with_(PREDS, wide_preds_sql(), body="SELECT sample_id, true_label, " + ", ".join(RUNS) + " FROM wide"))
def _(spark, sf):
    return J.wide_votes(preds(spark, sf).withColumnRenamed("run_id", "model"), RUNS, ["sample_id", "true_label"])


@query("j14_align_runs_by_gold", with_(PREDS, wide_preds_sql(), body="""SELECT sample_id AS i, true_label AS gold, run_0 AS pred__run_0, run_1 AS pred__run_1, NULL::VARCHAR AS pred__run_2, 'run_0,run_1' AS aligned_runs FROM wide"""))
def _(spark, sf):
    gold = F.when((F.col("r") == 2) & (F.col("doc_id") % 50 == 0), "other").otherwise(F.col("true_label"))
    long = preds(spark, sf).select("run_id", F.col("sample_id").alias("i"), gold.alias("gold"), F.col("pred_label").alias("pred"))
    out = J.align_runs_by_gold(long, reference="run_0", runs=["run_0", "run_1", "run_2"])
    return out.withColumn("aligned_runs", F.array_join("aligned_runs", ","))


@query("j15_cohort_join", with_(PREDS, SAMPLES, wide_preds_sql(), COHORT, body="""SELECT coh.sample_id, coh.true_label, new_pred, base_pred, text, CASE WHEN n AND b THEN 'both_correct' WHEN n THEN 'fixed' WHEN b THEN 'regressions' ELSE 'stubborn_failures' END AS cohort
  FROM coh JOIN samples USING (sample_id)"""))
def _(spark, sf):
    p = preds(spark, sf)
    return J.cohort_join(p.filter("run_id = 'run_4'"), p.filter("run_id = 'run_0'"), samples(spark, sf)).drop("new_ok", "base_ok")


@query("j16_attach_flags", with_(SAMPLES, body="SELECT sample_id, COALESCE(toxic = 1, FALSE) AS is_toxic FROM samples LEFT JOIN labels USING (doc_id)"))
def _(spark, sf):
    f = table(spark, sf, "labels").select(F.concat(F.lit("train_"), "doc_id").alias("sample_id"), (F.col("toxic") == 1).alias("is_toxic"))
    return J.attach_flags(samples(spark, sf).select("sample_id"), f)


@query("j17_attach_predictions_to_batches", with_(SAMPLES, rank_cte("samples", ""), PREDS, body="""SELECT (rk - 1) // 8 AS batch_id, string_agg(r.sample_id || ':' || COALESCE(p.pred_label, '-'), ',' ORDER BY rk) AS filled
  FROM ranked r LEFT JOIN (SELECT sample_id, pred_label FROM preds WHERE run_id = 'run_1') p USING (sample_id) GROUP BY 1"""))
def _(spark, sf):
    man = B.batch_manifest(B.fixed_batches(samples(spark, sf), 8, seed=42), split="train")
    out = J.attach_predictions_to_batches(man, preds(spark, sf).filter("run_id = 'run_1'"))
    text = F.transform("sentences", lambda s: F.concat(s["sample_id"], F.lit(":"), F.coalesce(s["pred_label"], F.lit("-"))))
    return out.select("batch_id", F.array_join(text, ",").alias("filled"))


@query("j18_group_context", """SELECT conv_id, turn, c.context FROM conversations JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS context FROM conversations GROUP BY 1) c USING (conv_id)""")
def _(spark, sf):
    return J.group_context(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "context")


# disagreement reports -----------------------------------------------------------------------------

@query("t5_disagreements", with_(PREDS, body="SELECT sample_id, count(DISTINCT pred_label) AS n_distinct FROM preds GROUP BY 1 HAVING count(DISTINCT pred_label) >= 2"))
def _(spark, sf):
    return A.disagreements(preds(spark, sf))


@query("t6_multiwise_diff", with_(PREDS, body="SELECT sample_id, count(DISTINCT pred_label) AS n_distinct FROM preds WHERE run_id IN ('run_1', 'run_3') GROUP BY 1 HAVING count(DISTINCT pred_label) >= 2"))
def _(spark, sf):
    return A.disagreements(preds(spark, sf), runs=["run_1", "run_3"], raw=True)


@query("t7_distinct_preds_report", with_(PREDS, body="SELECT sample_id, max(true_label) AS gold, count(DISTINCT pred_label) AS n_distinct, string_agg(DISTINCT pred_label, '|' ORDER BY pred_label) AS preds FROM preds GROUP BY 1 HAVING count(DISTINCT pred_label) > 1"))
def _(spark, sf):
    return A.distinct_preds_report(preds(spark, sf))


@query("f29_agreement_groups", with_(PREDS, RUNS_SQL, "k AS (SELECT *, row_number() OVER (PARTITION BY dataset_name, tier_size ORDER BY f1_macro DESC, run_key) AS place FROM runs WHERE has_predictions)",
  body="SELECT run_key, dataset_name || '__tier200' AS group_key, place::INTEGER AS place, 3::BIGINT AS n_runs FROM k WHERE place <= 3"))
def _(spark, sf):
    return A.agreement_groups(runs_table(spark, sf), max_runs=3).select("run_key", "group_key", "place", "n_runs")
