"""Row-level queries: P1-P42."""

from pyspark.sql import functions as F

from tagsight import schema as SC
from tagsight.functions import labels as L
from tagsight.functions import scores as S
from tagsight.functions import text as X
from tagsight.operators import batches as B
from tagsight.operators import responses as R
from tagsight.operators import rows as O
from tagsight.operators import votes as V
from tagsight.plans import evaluate as E

from .base import (
    LANGS, PREDS, SAMPLES, SCORED, VOTES, preds, query, rounded, samples, table, votes, with_,
)

MIXED = """mixed AS (SELECT sample_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN ' nan '
  WHEN doc_id % 5 = 0 THEN (doc_id % 6)::VARCHAR || '.0' WHEN doc_id % 3 = 0 THEN (doc_id % 6)::VARCHAR
  ELSE upper(true_label) || '  ' END AS raw, doc_id FROM samples)"""
RCT_CASE = """CASE {0} WHEN '0' THEN 'background' WHEN '1' THEN 'objective' WHEN '2' THEN 'methods'
  WHEN '3' THEN 'results' WHEN '4' THEN 'conclusions' ELSE {0} END"""


def mixed(spark, sf):
    d = F.col("doc_id")
    raw = (
        F.when(d % 7 == 0, " nan ").when(d % 5 == 0, F.concat((d % 6).cast("string"), F.lit(".0")))
        .when(d % 3 == 0, (d % 6).cast("string")).otherwise(F.concat(F.upper("true_label"), F.lit("  ")))
    )
    return samples(spark, sf, "doc_id").select("sample_id", "doc_id", F.when(d % 11 != 0, raw).alias("raw"))


@query("p1_validate_samples", with_(SAMPLES, body="SELECT dataset_name, count(*) AS n FROM samples GROUP BY 1"))
def _(spark, sf):
    return SC.validate_samples(samples(spark, sf)).groupBy("dataset_name").agg(F.count("*").alias("n"))


@query("p2_assert_unique", "SELECT text, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    SC.assert_unique(docs, "doc_id")
    return SC.duplicate_keys(docs, "text")


@query("p3_to_processed", """SELECT lang || '_' || doc_id AS sample_id, 'documents' AS dataset_name, text, source AS true_label,
  '{"source":"documents","orig_split":"' || lang || '","orig_row":' || doc_id || ',"label_col":"source"}' AS meta_json FROM documents""")
def _(spark, sf):
    return SC.to_processed(
        table(spark, sf, "documents"), dataset_name="documents", split=F.col("lang"), row=F.col("doc_id"),
        text_col="text", label_col="source", source_id="documents",
    )


@query("p4_pick_column", "SELECT doc_id, text AS picked, source AS mixed FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    col = SC.pick_column(docs, ["sentence", "text", "content"])
    return docs.select("doc_id", F.col(col).alias("picked"), SC.coalesce_columns(docs, ["category", "source"], "mixed"))


@query("p5_map_label_ids", """SELECT vec_id, CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two'
  ELSE label::VARCHAR END AS true_label FROM embeddings""")
def _(spark, sf):
    return O.map_label_ids(table(spark, sf, "embeddings"), ["zero", "one", "two"], col="label").select("vec_id", "true_label")


@query("p6_binarize_label", "SELECT event_id, CASE WHEN value >= 20.0 THEN 'high' ELSE 'low' END AS true_label FROM events")
def _(spark, sf):
    return O.binarize_label(
        table(spark, sf, "events"), col="value", positive="high", negative="low", threshold=20.0
    ).select("event_id", "true_label")


@query("p7_norm_label", with_(SAMPLES, MIXED, body="""SELECT sample_id, CASE WHEN lower(trim(raw)) IN ('nan','none','?','') THEN NULL
  ELSE regexp_replace(trim(raw), '^(-*[0-9]+)\\.0$', '\\1') END AS label FROM mixed"""))
def _(spark, sf):
    return mixed(spark, sf).select("sample_id", L.norm_label(F.col("raw")).alias("label"))


@query("p8_canonical_label", with_(SAMPLES, body="""SELECT sample_id, CASE true_label WHEN 'en' THEN 'english' WHEN 'de' THEN 'german'
  ELSE true_label END AS canonical FROM samples"""))
def _(spark, sf):
    aliases = spark.createDataFrame(
        [("documents", "EN ", "english"), ("documents", "de", "german"), ("other", "fr", "french")],
        "dataset_name string, raw string, canonical string",
    )
    return O.canonical_label(samples(spark, sf), aliases).select("sample_id", "canonical")


@query("p9_label_from_id_or_name", with_(SAMPLES, MIXED, body=f"""SELECT sample_id, {RCT_CASE.format('t')} AS name FROM (
  SELECT sample_id, CASE WHEN lower(trim(raw)) = 'nan' THEN NULL ELSE lower(regexp_replace(trim(raw), '\\.0$', '')) END AS t FROM mixed)"""))
def _(spark, sf):
    return mixed(spark, sf).select("sample_id", L.label_from_id_or_name(F.col("raw")).alias("name"))


@query("p10_normalize_text_label", """SELECT o_orderkey, lower(replace(o_orderpriority, ' ', '_')) AS dunder,
  trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS words,
  regexp_replace(lower(trim(o_orderpriority)), '[\\s_-]+', '_', 'g') AS snake FROM orders""")
def _(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        L.normalize_text_label(F.concat(F.lit(" __"), p, F.lit("__"))).alias("dunder"),
        L.normalize_text_label(p, "words").alias("words"),
        L.normalize_text_label(p, "snake").alias("snake"),
    )


@query("p11_match_allowed", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS label FROM documents""")
def _(spark, sf):
    d = F.col("doc_id")
    raw = F.when(d % 7 == 0, "xx").when(d % 5 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("lang"))
    allowed = F.array(*[F.lit(x) for x in LANGS])
    return table(spark, sf, "documents").select("doc_id", L.match_allowed(raw, allowed).alias("label"))


@query("p12_match_allowed_fuzzy", """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'de' ELSE lang END AS label,
  CASE doc_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'substring' WHEN 2 THEN 'substring' ELSE 'fallback' END AS match_kind FROM documents""")
def _(spark, sf):
    k = F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.upper("lang")).when(k == 1, F.concat(F.lit("1 "), F.col("lang"), F.lit(" 1")))
        .when(k == 2, F.concat(F.lit('{"c": "'), F.col("lang"), F.lit('"}'))).otherwise("?")
    )
    return table(spark, sf, "documents").select("doc_id", R.match_allowed_fuzzy(raw, LANGS).alias("m")).select("doc_id", "m.*")


@query("p13_labels_equal", with_(PREDS, body="SELECT sample_id, run_id, COALESCE(pred_label = true_label, FALSE) AS equal FROM preds"))
def _(spark, sf):
    return preds(spark, sf).select(
        "sample_id", "run_id", L.labels_equal(F.col("true_label"), F.upper("pred_label")).alias("equal")
    )


@query("p14_add_correct", with_(PREDS, SCORED, body="SELECT sample_id, run_id, correct FROM scored"))
def _(spark, sf):
    return E.add_correct(preds(spark, sf)).select("sample_id", "run_id", "correct")


@query("p15_add_correct_per_run", with_(PREDS, SCORED, body="SELECT run_id, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM scored GROUP BY 1"))
def _(spark, sf):
    return E.add_correct(preds(spark, sf)).groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("n_correct")
    )


@query("p16_flatten_prediction", with_(PREDS, body="""SELECT sample_id, run_id, pred_label, confidence, in_tokens, out_tokens, is_confusing,
  n_pred_labels, pred_label AS a_label, confidence AS a_conf, 'm1:' || COALESCE(pred_label, '-') || ',m2:' || true_label AS members,
  true_label AS pred_label_majority FROM preds"""))
def _(spark, sf):
    member = lambda name, col: F.struct(F.lit(name).alias("name"), F.col(col).alias("pred_label"))
    raw = F.to_json(F.struct(
        "is_confusing", "n_pred_labels", F.col("pred_label").alias("a_label"), F.col("confidence").alias("a_conf"),
        F.struct(F.array(member("m1", "pred_label"), member("m2", "true_label")).alias("members"),
                 F.col("true_label").alias("majority")).alias("committee"),
    ))
    nested = preds(spark, sf).select("sample_id", "run_id", F.struct(
        "pred_label", "confidence", F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("map<string,double>").alias("probs"), F.struct("in_tokens", "out_tokens").alias("usage"), raw.alias("raw"),
    ).alias("prediction"))
    text = F.array_join(F.transform("members", lambda m: F.concat(m["name"], F.lit(":"), F.coalesce(m["pred_label"], F.lit("-")))), ",")
    return E.flatten_prediction(nested).select(
        "sample_id", "run_id", "pred_label", "confidence", "in_tokens", "out_tokens", "is_confusing", "n_pred_labels",
        "a_label", "a_conf", text.alias("members"), "pred_label_majority",
    )


@query("p17_confidence_from_probs", with_(PREDS, body="""SELECT sample_id, run_id, CASE WHEN doc_id % 2 = 0 THEN confidence
  WHEN pred_label IS NULL THEN NULL WHEN pred_label = 'en' THEN 0.75 WHEN pred_label = 'de' THEN 0.25 END AS conf FROM preds"""))
def _(spark, sf):
    given = F.when(F.col("doc_id") % 2 == 0, F.col("confidence"))
    return preds(spark, sf).select(
        "sample_id", "run_id",
        S.confidence_from_probs(given, F.lit('{"en": 0.75, "de": 0.25}'), F.col("pred_label")).alias("conf"),
    )


@query("p18_mask_disallowed", with_(PREDS, body="""SELECT sample_id, run_id, CASE WHEN pred_label IN ('de','en') THEN pred_label END AS pred_label,
  CASE WHEN pred_label IN ('de','en') THEN GREATEST(0.0, confidence) ELSE GREATEST(confidence, 1 - confidence) END AS confidence FROM preds"""))
def _(spark, sf):
    probs = F.create_map(F.coalesce("pred_label", F.lit("none")), F.col("confidence"), F.lit("rest"), 1 - F.col("confidence"))
    return preds(spark, sf).select(
        "sample_id", "run_id", S.mask_disallowed(F.col("pred_label"), probs, ["de", "en"]).alias("m")
    ).select("sample_id", "run_id", "m.*")


@query("p19_collapse_labels", """WITH s AS (SELECT o_orderkey, lower(replace(o_orderpriority, ' ', '_')) AS p FROM orders)
  SELECT o_orderkey, CASE WHEN p IN ('1-urgent', '2-high') THEN 'top' WHEN p = '3-medium' THEN 'mid' ELSE p END AS true_label FROM s""")
def _(spark, sf):
    src = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("true_label"))
    return O.collapse_labels(src, {"1-urgent": "top", "2-high": "top", "3-medium": "mid"}, cols=("true_label",))


@query("p20_filter_labels", with_(SAMPLES, body="SELECT sample_id, true_label FROM samples WHERE true_label IN ('de', 'fr')"))
def _(spark, sf):
    return O.filter_labels(samples(spark, sf), ["de", "fr"]).select("sample_id", "true_label")


@query("p21_filter_clean_text", r"""SELECT page_id, url FROM (SELECT page_id, url, url || ' page ' || page_id || ' @' || page_id AS t FROM pages)
  WHERE length(trim(t)) >= 15 AND len(regexp_extract_all(t, '(?i)(?:https?://\S+|www\.\S+|@\w+)'))::DOUBLE
    / len(regexp_extract_all(t, '\S+')) <= 0.5""")
def _(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", "url", F.concat("url", F.lit(" page "), "page_id", F.lit(" @"), "page_id").alias("t")
    )
    return O.filter_clean_text(pages, text="t").select("page_id", "url")


@query("p22_filter_mean_std_length", """WITH s AS (SELECT doc_id, source, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS k FROM documents),
  m AS (SELECT avg(k) AS a, stddev_pop(k) AS d FROM s)
  SELECT doc_id, source FROM s, m WHERE k >= a - 0.5*d AND k <= a + 0.5*d""")
def _(spark, sf):
    return O.filter_mean_std_length(table(spark, sf, "documents"), ["text"], 0.5).select("doc_id", "source")


@query("p22_filter_mean_std_length_arrays", """WITH s AS (SELECT conv_id, list(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS ks FROM conversations GROUP BY 1),
  m AS (SELECT avg(k) AS a, stddev_pop(k) AS d FROM (SELECT unnest(ks) AS k FROM s) WHERE k > 0)
  SELECT conv_id, len(ks) AS n FROM s, m WHERE len(list_filter(ks, lambda k: k < a - d OR k > a + d)) = 0""")
def _(spark, sf):
    convs = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("texts"))
    return O.filter_mean_std_length(convs, ["texts"], 1.0).select("conv_id", F.size("texts").cast("bigint").alias("n"))


@query("p23_clean_text", r"""SELECT doc_id, regexp_replace(lower(text), '(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|(\w+:\/\/\S+)', ' ', 'g') AS tweet,
  regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g') AS news FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.clean_text(F.col("text")).alias("tweet"), X.clean_text(F.col("text"), "news").alias("news")
    )


@query("p24_drop_blank", """SELECT doc_id, trim(t) AS t FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '   ' ELSE '  ' || source || ' ' END AS t FROM documents)
  WHERE length(trim(t)) > 0""")
def _(spark, sf):
    t = F.when(F.col("doc_id") % 9 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("source"), F.lit(" ")))
    return O.drop_blank(table(spark, sf, "documents").select("doc_id", t.alias("t")), text="t")


@query("p25_unanimous", """SELECT conv_id, count(DISTINCT role) = 1 AS is_unanimous, arg_min(role, turn) AS unanimous_label FROM conversations GROUP BY 1""")
def _(spark, sf):
    convs = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]).alias("annotations")
    )
    return V.unanimous(convs, "annotations").drop("annotations")


@query("p26_route_by_keywords", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'kill|murder|suicide|bomb|rape|pedo|weapon|shoot') THEN 2
  WHEN length(text) > 260 OR regexp_matches(lower(text), 'hate|racist|slur|abuse|threat|assault|violent') THEN 1 ELSE 0 END AS expert FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.route_expert(F.col("text"), 3).alias("expert"))


@query("p27_split_call_usage", """SELECT l_orderkey, l_linenumber, t // n + CASE WHEN pos < t % n THEN 1 ELSE 0 END AS tokens FROM (
  SELECT l_orderkey, l_linenumber, 100 + l_orderkey % 13 AS t, count(*) OVER (PARTITION BY l_orderkey) AS n,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem)""")
def _(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey")
    src = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (100 + F.col("l_orderkey") % 13).alias("t"), F.count("*").over(w).alias("n"),
        (F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).alias("pos"),
    )
    return src.select("l_orderkey", "l_linenumber", S.call_share(F.col("t"), F.col("pos"), F.col("n")).alias("tokens"))


@query("p28_softmax_reliability", """WITH s AS (SELECT doc_id, [least(1.0, (doc_id % 5) / 4.0), least(1.0, (doc_id % 7) / 5.0), 0.0]::DOUBLE[] AS v FROM documents),
  e AS (SELECT doc_id, list_transform(v, lambda x: exp(x - list_max(v))) AS ex FROM s),
  p AS (SELECT doc_id, list_reverse_sort(list_transform(ex, lambda x: x / list_sum(ex))) AS p FROM e),
  h AS (SELECT doc_id, p, list_sum(list_transform(p, lambda x: -x * log2(x))) AS ent FROM p)
  SELECT doc_id, round(ent, 4) AS label_entropy_bits, round(greatest(0, least(1, 1 - ent / log2(3))), 4) AS label_entropy_normalized,
    round(p[1], 4) AS softmax_max_prob, round(p[1] - p[2], 4) AS softmax_margin_top1_top2,
    round(0.5 * p[1] + 0.5 * greatest(0, least(1, 1 - ent / log2(3))), 4) AS reliability_combined FROM h""")
def _(spark, sf):
    scores = F.create_map(
        F.lit("a"), (F.col("doc_id") % 5) / 4.0, F.lit("b"), (F.col("doc_id") % 7) / 5.0
    )
    return table(spark, sf, "documents").select("doc_id", S.softmax_reliability(scores, ["a", "b", "c"]).alias("r")).select("doc_id", "r.*")


@query("p29_probs_from_label_confidence", with_(PREDS, body="""SELECT sample_id, run_id, label, CASE WHEN pred_label IS NULL THEN 0.25
  WHEN pred_label = label THEN confidence ELSE (1 - confidence) / 3.0 END AS prob FROM preds, (SELECT unnest(['de','en','es','fr']) AS label)"""))
def _(spark, sf):
    probs = S.probs_from_confidence(F.col("pred_label"), F.col("confidence"), LANGS)
    return rounded(preds(spark, sf).select("sample_id", "run_id", F.explode(probs).alias("label", "prob")))


@query("p30_probs_from_votes", with_(VOTES, body="""SELECT item_id, label, ROUND(CASE WHEN t = 0 THEN 1.0/3 ELSE n::DOUBLE / t END, 9) AS prob FROM (
  SELECT item_id, l.label, count(*) FILTER (votes.label = l.label) AS n, count(*) FILTER (votes.label IN ('click','view','error')) AS t
  FROM votes, (SELECT unnest(['click','view','error']) AS label) l GROUP BY 1, 2)"""))
def _(spark, sf):
    out = V.probs_from_votes(votes(spark, sf), ["item_id"], ["click", "view", "error"])
    return rounded(out.select("item_id", F.explode("probs").alias("label", "prob")))


@query("p31_confidence_unified", with_(PREDS, body="""SELECT sample_id, run_id, ROUND(CASE doc_id % 4 WHEN 0 THEN least(1.0, h / 100.0)
  WHEN 1 THEN confidence WHEN 2 THEN (1 + h % 4) / 4.0 END, 9) AS confidence_u,
  CASE doc_id % 4 WHEN 0 THEN 'VCavg_semantic_entropy' WHEN 1 THEN 'coverage_confidence_cove' WHEN 2 THEN 'confidence_rubric_1_to_4' END AS confidence_source FROM preds"""))
def _(spark, sf):
    k = F.col("doc_id") % 4
    src = preds(spark, sf).withColumns({
        "vc_avg": F.when(k == 0, F.col("h")), "coverage_confidence": F.when(k == 1, F.col("confidence")),
        "confidence_rubric": F.when(k == 2, 1 + F.col("h") % 4).when(k == 3, 9),
    })
    return rounded(E.confidence_unified(src).select("sample_id", "run_id", "confidence_u", "confidence_source"))


@query("p32_gold_pred_unified", f"""WITH s AS (SELECT doc_id, (doc_id % 5)::VARCHAR AS gold, CASE WHEN doc_id % 3 = 0 THEN 'Method'
  WHEN doc_id % 4 = 0 THEN 'confusing' ELSE (doc_id % 5)::VARCHAR END AS pred FROM documents),
  u AS (SELECT doc_id, {RCT_CASE.format('gold')} AS gold_u, CASE WHEN pred = 'Method' THEN 'methods' ELSE {RCT_CASE.format('pred')} END AS pred_u FROM s)
  SELECT doc_id, gold_u, pred_u, pred_u <> 'confusing' AS in_eval, CASE WHEN pred_u <> 'confusing' THEN gold_u = pred_u END AS correct FROM u""")
def _(spark, sf):
    d = F.col("doc_id")
    five = (d % 5).cast("string")
    src = table(spark, sf, "documents").select(
        "doc_id", five.alias("gold"), F.when(d % 3 == 0, "Method").alias("final_label"),
        F.when(d % 4 == 0, "confusing").alias("pred_for_eval"), five.alias("pred"),
    )
    return E.gold_pred_unified(src, list(L.RCT_LABELS)).select("doc_id", "gold_u", "pred_u", "in_eval", "correct")


@query("p33_rubric_to_label", with_(PREDS, body="""SELECT sample_id, run_id, CASE WHEN r4 = 1 THEN 'abstain' WHEN pred_label IN ('de','en','es') THEN pred_label
  ELSE 'error' END AS pred_label, r4 AS rubric, round(r4 / 4.0, 4)::DOUBLE AS rubric_scaled FROM (SELECT *, CASE WHEN h % 5 = 0 THEN 2 ELSE h % 5 END::INTEGER AS r4 FROM preds)"""))
def _(spark, sf):
    rubric = F.when(F.col("h") % 5 != 0, F.col("h") % 5)
    return preds(spark, sf).select(
        "sample_id", "run_id", L.rubric_label(F.col("pred_label"), rubric, ["de", "en", "es"]).alias("r")
    ).select("sample_id", "run_id", "r.*")


@query("p34_confidence_category", with_(PREDS, SCORED, body="""SELECT run_id, CASE WHEN correct THEN 'correct_' ELSE 'wrong_' END ||
  CASE WHEN confidence > 0 AND confidence <= 0.5 THEN 'low' WHEN confidence > 0.5 AND confidence <= 0.7 THEN 'medium'
  WHEN confidence > 0.7 THEN 'high' ELSE 'nan' END AS category, count(*) AS n FROM scored GROUP BY 1, 2"""))
def _(spark, sf):
    cat = S.confidence_category(F.col("confidence"), F.col("correct"))
    return E.add_correct(preds(spark, sf)).groupBy("run_id", cat.alias("category")).agg(F.count("*").alias("n"))


@query("p35_confusion_kind", """SELECT conv_id, CASE WHEN n = 1 THEN 'single' ELSE 'multi' END AS kind FROM (
  SELECT conv_id, count(DISTINCT role) AS n FROM conversations GROUP BY 1)""")
def _(spark, sf):
    sets = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return sets.select("conv_id", L.confusion_kind(F.col("r")).alias("kind"))


@query("p36_debate_confusion", with_(PREDS, """d AS (SELECT sample_id, max(CASE WHEN r = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 'error' ELSE pred_label END END) AS a,
  max(CASE WHEN r = 4 THEN pred_label END) AS b FROM preds GROUP BY 1)""", body="""SELECT sample_id, a IS NULL OR b IS NULL OR a = 'error' OR a <> b AS confusing,
  COALESCE(a <> 'error', TRUE) AND (a IS NULL OR b IS NULL OR a <> b) AS confusing_older FROM d"""))
def _(spark, sf):
    p = preds(spark, sf)
    d = p.groupBy("sample_id").agg(
        F.max(F.when(F.col("r") == 0, F.when(F.col("doc_id") % 10 == 0, "error").otherwise(F.col("pred_label")))).alias("a"),
        F.max(F.when(F.col("r") == 4, F.col("pred_label"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return d.select(
        "sample_id", L.debate_confusing(a, b).alias("confusing"),
        L.debate_confusing(a, b, errors_confuse=False).alias("confusing_older"),
    )


@query("p37_confident_but_wrong", with_(PREDS, SCORED, body="SELECT sample_id, run_id, confidence >= 0.67 AND NOT correct AS bad FROM scored"))
def _(spark, sf):
    return E.add_correct(preds(spark, sf)).select(
        "sample_id", "run_id", S.confident_but_wrong(F.col("confidence"), F.col("correct")).alias("bad")
    )


@query("p38_parse_sample_id", with_(SAMPLES, body="""SELECT 'train_' || (doc_id * 2) AS sample_id, 'train' AS split, doc_id * 2 AS idx,
  EXISTS (SELECT 1 FROM documents d2 WHERE d2.doc_id = s.doc_id * 2) AS found FROM samples s"""))
def _(spark, sf):
    wanted = table(spark, sf, "documents").select(F.concat(F.lit("train_"), F.col("doc_id") * 2).alias("sample_id"))
    return O.lookup_by_ids(samples(spark, sf), wanted).select("sample_id", "split", "idx", "found")


@query("p39_tag_batch_size", """SELECT DISTINCT 'gem_' || source || '_bs' || (doc_id % 10) || '_test' AS run_key, (doc_id % 10)::INTEGER AS batch_size_tag,
  'gem_' || source || '_test' AS config_key FROM documents""")
def _(spark, sf):
    runs = table(spark, sf, "documents").select(
        F.concat(F.lit("gem_"), "source", F.lit("_bs"), F.col("doc_id") % 10, F.lit("_test")).alias("run_key")
    ).distinct()
    return E.tag_batch_size(runs)


@query("p40_add_throughput", with_(PREDS, body="""SELECT run_id, sum(in_tokens)::BIGINT + sum(out_tokens)::BIGINT AS tokens_total,
  ROUND(12.5 / count(*), 9) AS seconds_per_row FROM preds GROUP BY 1"""))
def _(spark, sf):
    runs = preds(spark, sf).groupBy("run_id").agg(
        F.sum("in_tokens").alias("in_tokens_total"), F.sum("out_tokens").alias("out_tokens_total"),
        F.count("*").alias("n_samples"), F.lit(12.5).alias("infer_time_s"),
    )
    return rounded(E.add_throughput(runs).select("run_id", "tokens_total", "seconds_per_row"))


@query("p41_parse_label_list", """SELECT doc_id, CASE WHEN lang = 'es' THEN 'de' ELSE lang || ',de' END AS labels FROM documents""")
def _(spark, sf):
    raw = F.concat(F.upper("lang"), F.lit(" , xx, De "))
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(L.parse_label_list(raw, ["de", "en", "fr"]), ",").alias("labels")
    )


@query("p42_flatten_batches", """SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1)::INTEGER AS position,
  l_returnflag AS true_label, l_linestatus AS pred_label FROM lineitem""")
def _(spark, sf):
    s = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus")))
    b = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(s.alias("s")).select(
        "l_orderkey", F.transform("s", lambda x: x["l_returnflag"]).alias("gold"),
        F.transform("s", lambda x: x["l_linestatus"]).alias("pred"),
    )
    return B.flatten_batches(b)
