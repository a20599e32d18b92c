"""Neighbour, mining, response, model and whole-evaluation queries: J10-J12, F21-F28, N11-N16, M1-M17, M19."""

from pyspark.sql import functions as F

from tagsight.operators import batches as B
from tagsight.operators import jobs as JB
from tagsight.operators import mining as G
from tagsight.operators import models as MD
from tagsight.operators import neighbours as K
from tagsight.operators import quality as Q
from tagsight.operators import responses as R
from tagsight.plans import evaluate as E

from .base import LANGS, PREDS, SAMPLES, SCORED, SEED, VECTORS, preds, query, rank_cte, responses, rounded, samples, table, vectors, with_
from .q_scores import CLEAR, EDGES, MCNEMAR_P, PERF_COLS, STATS, VMETRICS, doc_edges, f1_ctes, runs_table, scored

COS = "round(list_cosine_similarity(a.embedding, b.embedding), 12)"
NEAR = """near AS (SELECT a.sample_id AS q, b.sample_id AS p, a.true_label AS ql, b.true_label AS pl, {cos} AS s FROM vectors a, vectors b WHERE {cond})"""


@query("j10_nearest_other_class", with_(VECTORS, NEAR.format(cos=COS, cond="a.true_label <> b.true_label"), "best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS k FROM near)",
  body="SELECT q AS anchor_sample_id, p AS contrast_sample_id, ql AS anchor_true_label, pl AS contrast_true_label, ROUND(s, 9) AS cosine_similarity FROM best WHERE k = 1"))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(K.nearest_other_class(v, v).drop("anchor_text", "contrast_text"))


@query("j11_topk_similar", with_(VECTORS, NEAR.format(cos=COS, cond="a.sample_id <> b.sample_id"), "best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS k FROM near)",
  body="SELECT q AS q_id, p AS p_id, ROUND(s, 9) AS score, k::INTEGER AS place FROM best WHERE k <= 3"))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(K.topk_similar(v, v, k=3, exclude_self=True))


@query("j12_topk_similar_per_label", with_(VECTORS, "ask AS (SELECT sample_id, embedding, unnest([true_label, ((true_label::INTEGER + 1) % 10)::VARCHAR]) AS want FROM vectors)",
  f"near AS (SELECT a.sample_id AS q, a.want, b.sample_id AS p, {COS} AS s FROM ask a JOIN vectors b ON b.true_label = a.want)", "k1 AS (SELECT *, row_number() OVER (PARTITION BY q, want ORDER BY s DESC, p::VARCHAR) AS k FROM near)",
  "k2 AS (SELECT *, ((p * 31) % 17)::DOUBLE AS rr, row_number() OVER (PARTITION BY q, want ORDER BY (p * 31) % 17 DESC, p::VARCHAR) AS m FROM k1 WHERE k <= 5)",
  body="SELECT q::VARCHAR AS query_id, want AS candidate_label, p::VARCHAR AS pool_id, ROUND(s, 9) AS score, rr AS rerank_score, m::INTEGER AS place FROM k2 WHERE m <= 2"))
def _(spark, sf):
    v = vectors(spark, sf)
    following = ((F.col("true_label").cast("int") + 1) % 10).cast("string")
    asked = v.withColumn("candidate_labels", F.array("true_label", following))
    pool = v.withColumn("rr", (F.col("sample_id") * 31 % 17).cast("double"))
    return rounded(K.topk_similar_per_label(asked, pool, k=5, m=2, rerank="rr"))


@query("m13_knn_classify", with_(VECTORS, NEAR.format(cos=COS, cond="a.sample_id <> b.sample_id"), "best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS k FROM near)",
  "v AS (SELECT q, pl, count(*) AS n FROM best WHERE k <= 5 GROUP BY 1, 2)", body="SELECT q AS sample_id, arg_min(pl, (-n, pl)) AS pred_label, ROUND(max(n) / 5.0, 9)::DOUBLE AS confidence FROM v GROUP BY 1"))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(K.knn_classify(v, v, k=5, exclude_self=True))


CENT = """dims AS (SELECT sample_id, true_label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM vectors), ctr AS (SELECT true_label, i, avg(v) AS m FROM dims GROUP BY 1, 2),
  cd AS (SELECT sample_id, true_label, sqrt(sum((v - m) ** 2)) AS distance FROM dims JOIN ctr USING (true_label, i) GROUP BY 1, 2)"""


@query("f22_class_centroid_representatives", with_(VECTORS, CENT, "k AS (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY distance, sample_id) AS place FROM cd)", body="SELECT sample_id, true_label, ROUND(distance, 8) AS distance, place::INTEGER AS place FROM k WHERE place <= 3"))
def _(spark, sf):
    return rounded(G.class_centroid_representatives(vectors(spark, sf), 3).drop("embedding"), 8)


@query("n11_centroid_distance_flag", with_(VECTORS, CENT, body="SELECT sample_id, true_label, ROUND(distance, 8) AS distance, distance >= (SELECT quantile_cont(distance, 0.9) FROM cd) AS is_flagged FROM cd"))
def _(spark, sf):
    return rounded(Q.centroid_distance_flag(vectors(spark, sf)).drop("embedding"), 8)


@query("n12_outliers", with_(VECTORS, NEAR.format(cos=COS, cond="a.sample_id <> b.sample_id"), "best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS k FROM near)", "o AS (SELECT q AS sample_id, 1 - avg(s) AS d FROM best WHERE k <= 10 GROUP BY 1)",
  body="SELECT sample_id, ROUND(d, 9) AS outlier_score, d >= (SELECT quantile_cont(d, 0.9) FROM o) AS is_outlier FROM o"))
def _(spark, sf):
    return rounded(Q.outliers(vectors(spark, sf)))


@query("n13_near_duplicates", "WITH RECURSIVE " + ", ".join([VECTORS, NEAR.format(cos=COS, cond="a.sample_id <> b.sample_id"), "best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS k FROM near)",
  "l AS (SELECT q, p FROM best WHERE k <= 10 AND s >= 0.8 UNION SELECT p, q FROM best WHERE k <= 10 AND s >= 0.8)", "reach AS (SELECT sample_id AS a, sample_id AS b FROM vectors UNION SELECT reach.a, l.p FROM reach JOIN l ON l.q = reach.b)",
  "comp AS (SELECT a AS sample_id, min(b) AS set_id FROM reach GROUP BY 1)"]) + " SELECT sample_id, set_id, count(*) OVER (PARTITION BY set_id) AS set_size, count(*) OVER (PARTITION BY set_id) > 1 AS is_near_duplicate FROM comp")
def _(spark, sf):
    return Q.near_duplicates(vectors(spark, sf), threshold=0.8)


@query("n16_non_iid", with_(VECTORS, NEAR.format(cos=COS, cond="a.sample_id <> b.sample_id"), "best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS k FROM near)", "n AS (SELECT count(*) AS n FROM vectors)",
  "h AS (SELECT least(100, ceil(abs(q - p) * 100 / n::DOUBLE)) AS bin, count(*) AS c FROM best, n WHERE k <= 10 GROUP BY 1)", "g AS (SELECT c, abs(sum(c) OVER (ORDER BY bin) / (sum(c) OVER ())::DOUBLE - (1 - (1 - bin / 100.0) ** 2)) AS gap FROM h)",
  body="SELECT sum(c)::BIGINT AS n_pairs, ROUND(max(gap), 9) AS ks_statistic, ROUND(max(gap) * sqrt(sum(c)), 9) AS ks_scaled FROM g"))
def _(spark, sf):
    return rounded(Q.non_iid(vectors(spark, sf).withColumn("position", F.col("sample_id"))))


@query("f21_cluster_representatives")
def _(spark, sf):
    return rounded(G.cluster_representatives(vectors(spark, sf), 3, seed=SEED).drop("embedding"))


@query("f21_cluster_facts", with_(VECTORS, body="SELECT true_label, count(*) AS n_rows, 0::BIGINT AS n_nearer_elsewhere, 0::BIGINT AS n_nearer_than_representative FROM vectors GROUP BY 1"))
def _(spark, sf):
    """Checks on every row: its centre is the nearest of its label, and no row is nearer to a centre than the representative."""
    v = vectors(spark, sf)
    centres = G.label_centres(v, 3, seed=SEED)
    table_ = spark.createDataFrame([(x, j, c.tolist()) for x, m in centres.items() for j, c in enumerate(m)], "true_label string, j int, c array<double>")
    clustered = G.label_clusters(v, 3, seed=SEED)
    best = G.representatives(clustered).select("true_label", "cluster_id", F.col("distance").alias("least"))
    apart = clustered.join(table_, "true_label").withColumn("d", F.sqrt(Q.squared_distance("embedding", "c"))).groupBy("true_label", "sample_id", "cluster_id", "distance").agg(
        F.min("d").alias("d")
    )
    return apart.join(best, ["true_label", "cluster_id"], "left").groupBy("true_label").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("distance") > F.col("d") + 1e-9).alias("n_nearer_elsewhere"),
        F.count_if(F.col("least").isNull() | (F.col("distance") < F.col("least"))).alias("n_nearer_than_representative"),
    )


@query("f21_first_row_per_label", with_(VECTORS, body="SELECT min(sample_id) AS sample_id, true_label FROM vectors GROUP BY 2"))
def _(spark, sf):
    return G.cluster_representatives(vectors(spark, sf), 1, seed=SEED).select("sample_id", "true_label")


@query("f23_expand_pool")
def _(spark, sf):
    labels = [str(i) for i in range(10)]
    _, pool = G.expand_pool(vectors(spark, sf), 2, 100, labels=labels, seed=SEED)
    return pool.select("sample_id", "true_label")


@query("f24_pair_table", "WITH " + ", ".join([SAMPLES, PREDS, SCORED]) + """, edges AS (SELECT p.sample_id AS anchor_sample_id, p.true_label AS anchor_true_label, s.sample_id AS contrast_sample_id FROM scored p JOIN samples s ON s.doc_id = p.doc_id + 1
  WHERE p.run_id = 'run_0' AND NOT p.correct AND p.true_label <> s.true_label) SELECT anchor_sample_id || '|' || contrast_sample_id AS pair_id, anchor_sample_id, contrast_sample_id, anchor_true_label FROM edges""")
def _(spark, sf):
    return G.pair_table(doc_edges(spark, sf))


EDGE_CTES = [SAMPLES, PREDS, SCORED, EDGES]
PAIR = "pt AS (SELECT anchor_sample_id || '|' || contrast_sample_id AS pair_id, anchor_sample_id, contrast_sample_id, anchor_true_label FROM edges)"


def pair_draw(src: str, n: int, seed: int, name: str) -> list[str]:
    """Even quota per anchor label in md5 order, then a random refill."""
    base, rest = divmod(n, 4)
    quota = ", ".join(f"('{x}', {base + (i < rest)})" for i, x in enumerate(LANGS))
    return [
        rank_cte(src, "anchor_true_label", seed, f"{name}r", "pair_id"),
        f"{name}b AS (SELECT {name}r.* EXCLUDE (rk) FROM {name}r JOIN (VALUES {quota}) AS q(l, quota) ON l = anchor_true_label WHERE rk <= quota)",
        f"{name}o AS (SELECT * FROM {src} WHERE pair_id NOT IN (SELECT pair_id FROM {name}b))", rank_cte(f"{name}o", "", f"{seed}-rest", f"{name}f", "pair_id"),
        f"{name} AS (SELECT * FROM {name}b UNION ALL SELECT * EXCLUDE (rk) FROM {name}f WHERE rk <= {n} - (SELECT count(*) FROM {name}b))",
    ]


@query("f25_sample_pairs", with_(*EDGE_CTES, PAIR, *pair_draw("pt", 10, SEED, "one"), "used AS (SELECT anchor_sample_id AS s FROM one UNION SELECT contrast_sample_id FROM one)",
  "free AS (SELECT * FROM pt WHERE pair_id NOT IN (SELECT pair_id FROM one) AND anchor_sample_id NOT IN (SELECT s FROM used) AND contrast_sample_id NOT IN (SELECT s FROM used))",
  *pair_draw("free", 8, SEED + 1, "two"), body="SELECT * FROM two"))
def _(spark, sf):
    pairs = G.pair_table(doc_edges(spark, sf))
    first = G.sample_pairs(pairs, 10, labels=LANGS, seed=SEED)
    return G.sample_pairs(pairs, 8, labels=LANGS, seed=SEED + 1, exclude_pairs=first, exclude_samples=G.pair_rows(first))


def first_run(spark, sf):
    return scored(spark, sf).filter("run_id = 'run_0'").join(samples(spark, sf).select("sample_id", "text"), "sample_id").select(
        "sample_id", "dataset_name", "text", "true_label", "pred_label", "correct"
    )


EVEN20 = "(VALUES ('de', 5), ('en', 5), ('es', 5), ('fr', 5)) AS q(l, quota)"
HOLDOUT = [
    "ends AS (SELECT anchor_sample_id AS s FROM edges UNION SELECT contrast_sample_id FROM edges)", "fr AS (SELECT * FROM scored WHERE run_id = 'run_0')", "hp AS (SELECT * FROM fr WHERE sample_id IN (SELECT s FROM ends))", rank_cte("hp", "true_label", SEED, "hr"),
    f"hard AS (SELECT sample_id, true_label, pred_label, correct, 'contrastive' AS val_bucket FROM hr JOIN {EVEN20} ON l = true_label WHERE rk <= quota)", "ep AS (SELECT * FROM fr WHERE correct AND sample_id NOT IN (SELECT sample_id FROM hard))",
    rank_cte("ep", "true_label", SEED + 1, "er"), f"val AS (SELECT * FROM hard UNION ALL SELECT sample_id, true_label, pred_label, correct, 'easy' FROM er JOIN {EVEN20} ON l = true_label WHERE rk <= quota)",
]


@query("f26_val_holdout", with_(*EDGE_CTES, *HOLDOUT, body="SELECT * FROM val"))
def _(spark, sf):
    return G.val_holdout(first_run(spark, sf), doc_edges(spark, sf), 40, frac=0.5, labels=LANGS, seed=SEED).drop("text", "dataset_name")


@query("f27_train_from_contrastive", with_(*EDGE_CTES, *HOLDOUT, body="SELECT sample_id, true_label, pred_label, correct, 'train_contrastive' AS selection_role FROM fr WHERE sample_id IN (SELECT s FROM ends) AND sample_id NOT IN (SELECT sample_id FROM val)"))
def _(spark, sf):
    p, e = first_run(spark, sf), doc_edges(spark, sf)
    val = G.val_holdout(p, e, 40, frac=0.5, labels=LANGS, seed=SEED)
    return G.train_from_contrastive(p, e, val).drop("text", "dataset_name")


@query("f28_optimizer_train_val")
def _(spark, sf):
    train, val = G.optimizer_train_val(first_run(spark, sf), doc_edges(spark, sf), labels=LANGS, dataset_name="documents")
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val"))).drop("text")


# prompts and responses -----------------------------------------------------------------------------

RESP_LABEL = "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END"


@query("m1_render_prompts", with_(SAMPLES, rank_cte("samples", ""), body="""SELECT (rk - 1) // 8 AS batch_id, count(*) AS n_items, string_agg(sample_id, ',' ORDER BY rk) AS ids, string_agg(text, chr(10) ORDER BY rk) AS texts, TRUE AS has_labels FROM ranked GROUP BY 1"""))
def _(spark, sf):
    b = B.fixed_batches(samples(spark, sf), 8, seed=SEED)
    p = R.render_prompts(b, LANGS, extra="sample_id")
    items = F.from_json(
        F.get_json_object(F.regexp_replace("user_text", r"^[\s\S]*?Items:\n", ""), "$.items"), "array<struct<id:string,text:string,sample_id:string>>"
    )
    return p.withColumn("items", items).select(
        "batch_id", "n_items", F.array_join(F.transform("items", lambda x: x["sample_id"]), ",").alias("ids"),
        F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("texts"), F.contains("user_text", F.lit('["de", "en", "es", "fr"]')).alias("has_labels"),
    )


def by_length(texts):
    """A deterministic predictor: the label follows from the text length."""
    names = ["de", "en", "es", "fr"]
    return [{"label": names[len(t) % 4], "confidence": len(t) % 10 / 10.0} for t in texts]


def shifted(texts, first=None):
    names = ["de", "en", "es", "fr"]
    return [names[len(t) // 2 % 4] if f == "de" else f for t, f in zip(texts, first)]


LEN_LABEL = "['de','en','es','fr'][length(text) % 4 + 1]"


@query("m2_batch_predict", with_(SAMPLES, rank_cte("samples", ""), body=f"SELECT sample_id, (rk - 1) // 8 AS batch_id, ((rk - 1) % 8)::INTEGER AS position, {LEN_LABEL} AS pred_label, ROUND((length(text) % 10) / 10.0, 9)::DOUBLE AS confidence FROM ranked"))
def _(spark, sf):
    out = JB.batch_predict(B.fixed_batches(samples(spark, sf), 8, seed=SEED), by_length)
    return rounded(out.select("sample_id", "batch_id", "position", "pred_label", "confidence"))


@query("m3_parse_label_responses", f"SELECT doc_id, 'ok' AS parse_status, doc_id::VARCHAR AS item_id, {RESP_LABEL} AS pred_label FROM documents")
def _(spark, sf):
    return R.parse_label_responses(responses(spark, sf), LANGS, keep=["doc_id"])


@query("m4_parse_multilabel_responses", f"""SELECT doc_id, 'ok' AS parse_status, doc_id::VARCHAR AS item_id, CASE WHEN doc_id % 7 = 0 THEN 'none' ELSE 'single' END AS confusion_kind, doc_id % 7 = 0 AS is_confusing, {RESP_LABEL} AS pred_label,
  COALESCE({RESP_LABEL}, '') AS pred_labels FROM documents""")
def _(spark, sf):
    raw = F.concat(F.lit("<thought>maybe [1, 2]</thought>\nsome [draft] Final Answer: "), "raw_text")
    out = R.parse_multilabel_responses(responses(spark, sf).withColumn("raw_text", raw), LANGS, keep=["doc_id"])
    return out.select("doc_id", "parse_status", "item_id", "confusion_kind", "is_confusing", "pred_label", F.array_join("pred_labels", ",").alias("pred_labels"))


@query("m5_parse_debate_responses", """SELECT doc_id, 'ok' AS parse_status, doc_id::VARCHAR AS item_id, lang AS pred_label, least(1.0, (doc_id % 30) / 20.0)::DOUBLE AS confidence, 'because ' || source AS reasoning FROM documents""")
def _(spark, sf):
    body = F.concat(
        F.lit('[{"id": '), F.col("doc_id").cast("string"), F.lit(', "label": " '), F.upper("lang"), F.lit('", "confidence": '),
        ((F.col("doc_id") % 30) / 20.0).cast("string"), F.lit(', "reason": " because '), "source", F.lit(' "}]'),
    )
    src = table(spark, sf, "documents").select("doc_id", body.alias("raw_text"))
    return R.parse_debate_responses(src, LANGS, keep=["doc_id"])


@query("m6_parse_label_array", """SELECT doc_id, p::INTEGER AS position, CASE WHEN doc_id % 6 = 0 THEN 'error' WHEN p = 0 THEN lang WHEN p = 1 THEN 'de' ELSE 'error' END AS pred_label FROM documents, (SELECT unnest([0, 1, 2, 3]) AS p)""")
def _(spark, sf):
    raw = F.when(F.col("doc_id") % 6 == 0, "no list here").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("['"), F.upper("lang"), F.lit("', 'de', 'xx']"))).otherwise(
        F.concat(F.lit('Labels: ["'), F.col("lang"), F.lit('", "DE", "xx"]'))
    )
    return R.parse_label_array(table(spark, sf, "documents").select("doc_id", raw.alias("raw_text")), LANGS, n=4, keep=["doc_id"])


@query("m7_two_pass_predict", with_(SAMPLES, f"t AS (SELECT sample_id, {LEN_LABEL} AS a, CASE WHEN {LEN_LABEL} = 'de' THEN ['de','en','es','fr'][(length(text) // 2) % 4 + 1] ELSE {LEN_LABEL} END AS b FROM samples)",
  body="SELECT sample_id, a AS a_label, b AS b_label, a <> b AS is_confusing, CASE WHEN a = b THEN b END AS pred_label FROM t"))
def _(spark, sf):
    out = JB.two_pass_predict(B.fixed_batches(samples(spark, sf), 8, seed=SEED), by_length, shifted)
    return out.select("sample_id", "a_label", "b_label", "is_confusing", "pred_label")


@query("m8_committee_predict", with_(SAMPLES, f"v AS (SELECT sample_id, {LEN_LABEL} AS l FROM samples UNION ALL SELECT sample_id, 'fr' FROM samples UNION ALL SELECT sample_id, 'en' FROM samples)", "n AS (SELECT sample_id, l, count(*) AS n FROM v GROUP BY 1, 2)",
  body="SELECT sample_id, arg_min(l, (-n, l)) AS pred_label, ROUND(max(n) / 3.0, 9)::DOUBLE AS confidence FROM n GROUP BY 1"))
def _(spark, sf):
    members = {"length": by_length, "always_fr": lambda t: ["fr"] * len(t), "always_en": lambda t: ["en"] * len(t)}
    out = JB.committee_predict(B.fixed_batches(samples(spark, sf), 8, seed=SEED), members)
    return rounded(out.select("sample_id", "pred_label", "confidence"))


# models --------------------------------------------------------------------------------------------

def text_split(spark, sf):
    from tagsight.operators.sampling import train_test_split

    s = samples(spark, sf)
    parts = train_test_split(s, 60, seed=SEED)
    return parts.filter("split = 'train'"), parts.filter("split = 'test'")


@query("m9_tfidf_logreg")
def _(spark, sf):
    train, test = text_split(spark, sf)
    return MD.tfidf_logreg(train, test).select("sample_id", "true_label", "pred_label", "confidence")


@query("m10_tfidf_svm")
def _(spark, sf):
    train, test = text_split(spark, sf)
    return MD.tfidf_svm(train, test)


@query("m11_tfidf_boost")
def _(spark, sf):
    train, test = text_split(spark, sf)
    return MD.tfidf_boost(train, test)


def vector_split(spark, sf):
    v = vectors(spark, sf)
    test = F.substring(F.md5(F.col("sample_id").cast("string")), 1, 1) < "4"
    return v.filter(~test), v.filter(test)


@query("m12_embed_reduce_head")
def _(spark, sf):
    train, test = vector_split(spark, sf)
    return MD.embed_reduce_head(train, test, head="logreg").select("sample_id", "true_label", "pred_label", "confidence")


@query("m12_embed_reduce_knn")
def _(spark, sf):
    train, test = vector_split(spark, sf)
    return MD.embed_reduce_head(train, test, head="knn")


@query("m14_embed")
def _(spark, sf):
    out = MD.embed(samples(spark, sf))
    return out.select("sample_id", "embedding")


@query("m15_pseudo_label")
def _(spark, sf):
    train, test = vector_split(spark, sf)
    is_seed = F.substring(F.md5(F.concat(F.lit("seed"), F.col("sample_id").cast("string"))), 1, 1) < "5"
    return rounded(MD.pseudo_label(train.filter(is_seed), train.filter(~is_seed), test))


@query("m16_out_of_fold_probs", with_(SAMPLES, body="""SELECT sample_id, true_label, (('0x' || substr(md5('42|' || sample_id), 1, 8))::BIGINT % 5)::INTEGER AS fold, (SELECT count(DISTINCT true_label) FROM samples)::INTEGER AS n_probs,
  1.0::DOUBLE AS probs_sum, TRUE AS best_is_predicted FROM samples"""))
def _(spark, sf):
    out = MD.out_of_fold_probs(samples(spark, sf), seed=SEED)
    best = F.try_element_at("probs", "pred_label") == F.array_max(F.map_values("probs"))
    total = F.round(F.aggregate(F.map_values("probs"), F.lit(0.0), lambda a, p: a + p), 6)
    return out.select("sample_id", "true_label", "fold", F.size("probs").alias("n_probs"), total.alias("probs_sum"), best.alias("best_is_predicted"))


# whole evaluations ---------------------------------------------------------------------------------

@query("m17_evaluate", with_(PREDS, CLEAR, STATS, f1_ctes("clear"), body=f"""SELECT run_id, n_total, n_unconfused, n_confusing, ROUND(confusing_rate, 9) AS confusing_rate, n_zero_labels, n_multi_labels, {PERF_COLS},
  NULL::DOUBLE AS mean_max_prob, NULL::DOUBLE AS mean_entropy, (SELECT ROUND(avg(confidence), 9) FROM preds p WHERE p.run_id = stats.run_id) AS mean_confidence,
  (SELECT sum(in_tokens)::BIGINT FROM preds p WHERE p.run_id = stats.run_id) AS in_tokens_total, (SELECT sum(out_tokens)::BIGINT FROM preds p WHERE p.run_id = stats.run_id) AS out_tokens_total FROM stats JOIN perf USING (run_id)"""))
def _(spark, sf):
    return rounded(E.evaluate(preds(spark, sf), ["run_id"]))


BOARD = with_(PREDS, SCORED, CLEAR, STATS, f1_ctes("clear"), VMETRICS, """bins AS (SELECT run_id, greatest(1, ceil(ROUND(confidence * 10, 12))) AS bin, count(*) AS n, avg(confidence) AS c, avg(COALESCE(pred_label = true_label, FALSE)::INTEGER) AS a FROM preds GROUP BY 1, 2)""",
  "cal AS (SELECT run_id, sum(n * abs(c - a)) / sum(n) AS ece FROM bins GROUP BY 1)", "err AS (SELECT run_id, avg(disagree_any::INTEGER) AS disputed_error_share, avg(entropy) AS mean_error_entropy FROM scored JOIN vm USING (sample_id) WHERE NOT correct GROUP BY 1)",
  body=f"""SELECT run_id, n_total, n_unconfused, n_confusing, ROUND(confusing_rate, 9) AS confusing_rate, n_zero_labels, n_multi_labels, {PERF_COLS}, ROUND(ece, 9) AS ece, ROUND(disputed_error_share, 9) AS disputed_error_share,
  ROUND(mean_error_entropy, 9) AS mean_error_entropy, ROUND(n_scored / n_total::DOUBLE, 9) AS coverage FROM stats JOIN perf USING (run_id) JOIN cal USING (run_id) JOIN err USING (run_id)""")


@query("run_quality_board", BOARD)
def _(spark, sf):
    return rounded(E.run_quality_board(preds(spark, sf)))


GROUPED = """gp AS (SELECT source || '__tier200' AS group_key, source || '/' || run_id AS rid, sample_id, true_label, pred_label FROM preds WHERE run_id <> 'run_3'),
  ok AS (SELECT group_key, sample_id FROM gp GROUP BY 1, 2 HAVING count(pred_label) = 4),
  sel AS (SELECT a.group_key, a.rid AS run_a, b.rid AS run_b, a.pred_label AS pa, b.pred_label AS pb, a.true_label FROM gp a JOIN gp b ON a.group_key = b.group_key AND a.sample_id = b.sample_id AND a.rid < b.rid JOIN ok ON ok.group_key = a.group_key AND ok.sample_id = a.sample_id)"""


def bundle(spark, sf):
    keyed = preds(spark, sf, "source").withColumn("run_id", F.concat("source", F.lit("/"), "run_id"))
    return E.agreement_bundle(keyed, runs_table(spark, sf))


@query("m19_agreement_bundle_mcnemar", with_(PREDS, GROUPED, """t AS (SELECT group_key, run_a, run_b, count(*) FILTER (pa = true_label AND pb = true_label) AS both_correct, count(*) FILTER (pa = true_label AND pb <> true_label) AS a_only,
  count(*) FILTER (pa <> true_label AND pb = true_label) AS b_only, count(*) FILTER (pa <> true_label AND pb <> true_label) AS both_wrong FROM sel GROUP BY 1, 2, 3)""", body=f"SELECT *, a_only + b_only AS disagreements, ROUND(ROUND({MCNEMAR_P}, 12), 7)::DOUBLE AS p_value, 'exact' AS p_method FROM t"))
def _(spark, sf):
    return rounded(rounded(bundle(spark, sf)["mcnemar"], 12), 7)


@query("m19_agreement_bundle_kappa", with_(PREDS, GROUPED, "m AS (SELECT group_key, run_a, run_b, count(*) AS n_common, avg((pa = pb)::INTEGER) AS observed FROM sel GROUP BY 1, 2, 3)",
  "ma AS (SELECT group_key, run_a, run_b, pa AS l, count(*) AS na FROM sel GROUP BY ALL)", "mb AS (SELECT group_key, run_a, run_b, pb AS l, count(*) AS nb FROM sel GROUP BY ALL)",
  "e AS (SELECT group_key, run_a, run_b, sum(na * nb)::DOUBLE AS s FROM ma JOIN mb USING (group_key, run_a, run_b, l) GROUP BY 1, 2, 3)", body="""SELECT group_key, run_a, run_b, n_common, ROUND(observed, 9) AS observed, ROUND(COALESCE(s, 0) / (n_common * n_common), 9) AS expected,
  ROUND((observed - COALESCE(s, 0) / (n_common * n_common)) / nullif(1 - COALESCE(s, 0) / (n_common * n_common), 0), 9) AS kappa FROM m LEFT JOIN e USING (group_key, run_a, run_b)"""))
def _(spark, sf):
    return rounded(bundle(spark, sf)["kappa"])


@query("m19_agreement_bundle_per_class", with_(PREDS, """gp AS (SELECT source || '__tier200' AS group_key, source || '/' || run_id AS run_id, true_label, pred_label FROM preds WHERE run_id <> 'run_3' AND pred_label IS NOT NULL)""",
  f1_ctes("gp", "group_key, run_id"), body="""SELECT group_key, run_id, split_part(run_id, '/', 2) AS run, label, 'precision' AS metric, ROUND(precision, 9) AS value FROM perf_f UNION ALL SELECT group_key, run_id, split_part(run_id, '/', 2), label, 'recall', ROUND(recall, 9) FROM perf_f"""))
def _(spark, sf):
    return rounded(bundle(spark, sf)["per_class"])


@query("m19_agreement_bundle_index", with_(PREDS, body="SELECT source || '__tier200' AS group_key, source AS dataset_name, 200::BIGINT AS tier_size, count(DISTINCT run_id) AS n_runs FROM preds WHERE run_id <> 'run_3' GROUP BY source"))
def _(spark, sf):
    return bundle(spark, sf)["index"]
