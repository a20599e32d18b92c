"""File queries: S1-S20, F13, M18.  Everything is first written from the given tables, then read back."""

from pyspark.sql import functions as F

from tagsight.operators import agreement as A
from tagsight.operators import joins as J
from tagsight.operators import votes as V
from tagsight.plans import evaluate as E
from tagsight.plans.lineage import scratch_path
from tagsight.sources import predictions as PR
from tagsight.sources import runs as RN
from tagsight.sources import tiers as TR

from .base import PREDS, RUNS, SAMPLES, SEED, preds, query, rank_cte, rounded, samples, table, wide_preds_sql, with_
from .q_ranks import take_quota_ctes
from .q_scores import RUNS_SQL, report_docs, runs_table

# digest of a table `chosen`: of the digests of its md5 buckets, as the operator states it
BUCKETS = "buckets AS (SELECT substr(md5(sample_id), 1, 4) AS b, sha256(string_agg(sample_id, chr(10) ORDER BY sample_id)) AS d, count(*) AS n FROM chosen GROUP BY 1)"
DIGEST = "sha256(string_agg(d, chr(10) ORDER BY b))"


def stored_tier(spark, sf, n=150):
    from tagsight.operators.sampling import stratified_take

    root = scratch_path(spark, "tiers")
    part = stratified_take(samples(spark, sf), n, seed=SEED)
    TR.write_tier(part, root, dataset="documents", split="test", tier=n, seed=SEED, builder="catalog", origin={"kind": "table"})
    return root


@query("s1_read_tier", with_(SAMPLES, take_quota_ctes(150), rank_cte("samples"), body="SELECT sample_id, dataset_name, text, true_label FROM ranked JOIN quo USING (true_label) WHERE rk <= quota"))
def _(spark, sf):
    return TR.read_tier(spark, stored_tier(spark, sf), "documents", "test", 150)


@query("s2_read_artifact", with_(SAMPLES, body="SELECT sample_id, dataset_name, text, true_label FROM samples"))
def _(spark, sf):
    root = scratch_path(spark, "artifact")
    TR.write_artifact(samples(spark, sf), root, dataset="documents", split="pool", artifact="full", seed=SEED, builder="catalog", origin={"kind": "table"})
    return TR.read_artifact(spark, root, "documents", "pool", "full")


@query("s3_write_tier", with_(SAMPLES, take_quota_ctes(150), rank_cte("samples"), "chosen AS (SELECT sample_id FROM ranked JOIN quo USING (true_label) WHERE rk <= quota)", BUCKETS,
  body=f"""SELECT 'documents' AS dataset_name, 'test' AS split_name, 'tier_150' AS artifact, 150::BIGINT AS tier_size_requested, sum(n)::BIGINT AS tier_size_actual,
  42::BIGINT AS seed, 'catalog' AS builder, {DIGEST} AS sample_id_sha256 FROM buckets"""))
def _(spark, sf):
    return TR.read_manifest(spark, stored_tier(spark, sf), "documents", "test", "tier_150").drop("created_at", "origin")


@query("s4_id_digest", with_(SAMPLES, "chosen AS (SELECT sample_id FROM samples)", BUCKETS, body=f"SELECT {DIGEST} AS digest, sum(n)::BIGINT AS n_rows FROM buckets"))
def _(spark, sf):
    return TR.id_digest(samples(spark, sf))


@query("s5_card", with_(SAMPLES, body="SELECT 'documents' AS dataset_name, 'all documents' AS description, string_agg(DISTINCT true_label, ',' ORDER BY true_label) AS labels, count(*) AS sample_count FROM samples"))
def _(spark, sf):
    root = scratch_path(spark, "card")
    TR.write_card(TR.make_card(samples(spark, sf), dataset="documents", description="all documents", origin={"kind": "table"}), root, "documents")
    return TR.read_card(spark, root, "documents").select("dataset_name", "description", F.array_join("labels", ",").alias("labels"), "sample_count")


@query("s6_read_jsonl_dialogues", """SELECT trim(text) AS context, role AS safety_label, conv_id AS dialogue_id, turn AS response_id, 'a_b,' || role AS annotations, (SELECT count(*) FROM conversations WHERE length(trim(text)) > 0) AS n_indexed
  FROM conversations WHERE length(trim(text)) > 0""")
def _(spark, sf):
    path = scratch_path(spark, "dialogues")
    table(spark, sf, "conversations").select(
        F.concat(F.lit("  "), "text").alias("context"), F.concat(F.lit(" __"), F.upper("role"), F.lit("__")).alias("safety_label"),
        F.array(F.lit("A b"), F.col("role")).alias("safety_annotations"), F.col("conv_id").alias("dialogue_id"), F.col("turn").alias("response_id"),
    ).write.json(path)
    d = PR.read_jsonl_dialogues(spark, path, all_features=True)
    indexed = d.agg(F.count_distinct("source_index")).scalar()
    return d.select(
        "context", "safety_label", "dialogue_id", "response_id", F.array_join("safety_annotations", ",").alias("annotations"), indexed.alias("n_indexed")
    )


@query("s7_read_predictions", with_(PREDS, body="""SELECT run_id AS run, sample_id, true_label, pred_label, CASE WHEN run_id = 'run_4' THEN NULL ELSE confidence::VARCHAR END AS confidence FROM preds"""))
def _(spark, sf):
    root = scratch_path(spark, "predictions")
    p = preds(spark, sf)
    csv = {"header": True, "quote": '"', "escape": '"'}
    p.filter("r < 2").select("run_id", "sample_id", "true_label", "pred_label", "confidence").write.partitionBy("run_id").csv(f"{root}/a", **csv)
    p.filter("r IN (2, 3)").select("run_id", F.col("sample_id").alias("id"), "confidence", F.col("true_label").alias("gold"), F.col("pred_label").alias("pred")).write.partitionBy("run_id").csv(f"{root}/b", **csv)
    p.filter("r = 4").groupBy("run_id").agg(
        F.to_json(F.struct(F.collect_list(F.struct(F.col("sample_id").alias("id"), "true_label", F.col("pred_label").alias("pred"))).alias("predictions"))).alias("value")
    ).write.partitionBy("run_id").text(f"{root}/c")
    out = PR.read_predictions(spark, [f"{root}/a/*/*.csv", f"{root}/b/*/*.csv"], [f"{root}/c/*/*.txt"])
    return out.select(F.regexp_extract("run_dir", r"run_id=(\w+)$", 1).alias("run"), "sample_id", "true_label", "pred_label", "confidence")


@query("s8_read_predictions_legacy", with_(PREDS, body="SELECT sample_id, true_label, pred_label, 'documents' AS dataset_name FROM preds WHERE run_id = 'run_1'"))
def _(spark, sf):
    path = scratch_path(spark, "legacy")
    preds(spark, sf).select(
        F.col("sample_id").alias("source_index"), F.col("true_label").alias("true"), F.col("pred_label").alias("pred"), F.col("run_id").alias("model")
    ).write.csv(path, header=True)
    return PR.read_predictions_legacy(spark, path, dataset="documents", model="run_1").select("sample_id", "true_label", "pred_label", "dataset_name")


# run trees -----------------------------------------------------------------------------------------

STAMP = "20260501_12000"


def run_tree(spark, sf, root=None):
    """A results folder: one run per source and run number, with report, config and predictions marker.

    Run 3 has a metrics file instead of a report, run 4 only a manifest.
    """
    root = root or scratch_path(spark, "results")
    r = F.col("r")
    score = F.struct(F.col("f1_macro"), "accuracy")
    report = F.to_json(F.struct("dataset_name", "tier_size", score.alias("metrics"), F.struct((F.col("n_samples") / 8.0).alias("infer_time_s")).alias("extras"), F.col("saved_utc").alias("created_at")))
    flat = F.to_json(F.struct("dataset_name", "n_samples", F.col("f1_macro").alias("macro_f1"), "accuracy"))
    config = F.to_json(F.struct(F.col("run_key").alias("name"), F.struct(F.col("model_kind").alias("kind"), F.struct("model_id", "thinking_level", "batch_size").alias("params")).alias("model")))
    manifest = F.to_json(F.struct(F.concat(F.lit("slug_"), "dataset_name").alias("experiment_slug")))
    files = F.filter(
        F.array(
            F.when(r < 3, F.struct(F.lit("report.json").alias("file"), report.alias("value"))),
            F.when(r == 3, F.struct(F.lit("metrics.json").alias("file"), flat.alias("value"))),
            F.when(r < 4, F.struct(F.lit("config.resolved.json").alias("file"), config.alias("value"))),
            F.when(r < 2, F.struct(F.lit("predictions.csv").alias("file"), F.concat(F.lit("sample_id,pred_label"), F.repeat(F.lit("\ns,\"a\nb\""), F.col("n_samples").cast("int"))).alias("value"))),
            F.struct(F.lit("run_manifest.json").alias("file"), manifest.alias("value")),
        ),
        lambda x: x.isNotNull(),
    )
    runs_table(spark, sf).select(
        F.lit("evaluate").alias("series"), F.concat(F.lit(STAMP), "r").alias("campaign"), F.concat("dataset_name", F.lit("_run")).alias("leaf"), F.inline(files)
    ).repartition(8).write.mode("append").partitionBy("series", "campaign", "leaf", "file").text(root)
    # a suite folder above the runs: it plans them, so it is not a run itself
    runs_table(spark, sf).select(
        F.lit("evaluate").alias("series"), F.concat(F.lit(STAMP), "r").alias("campaign"),
    ).distinct().select("*", F.inline(F.array(
        F.struct(F.lit("summary.json").alias("file"), F.lit('{"planned": [1], "results": []}').alias("value")),
        F.struct(F.lit("run_manifest.json").alias("file"), F.lit("{}").alias("value")),
    ))).repartition(8).write.mode("append").partitionBy("series", "campaign", "file").text(root)
    return root


TREE = """tree AS (SELECT *, 'evaluate/20260501_12000' || r || '/' || dataset_name || '_run' AS run_dir FROM runs)"""


@query("s9_discover_runs", with_(PREDS, RUNS_SQL, TREE, body="""SELECT run_dir, 'evaluate' AS series, '20260501_12000' || r AS campaign, dataset_name || '_run' AS suite, dataset_name || '_run' AS run_leaf,
  CASE WHEN r < 2 THEN 'predictions.csv,report.json,run_manifest.json' WHEN r = 2 THEN 'report.json,run_manifest.json' WHEN r = 3 THEN 'metrics.json,run_manifest.json' ELSE 'run_manifest.json' END AS markers FROM tree
  UNION ALL SELECT 'evaluate/20260501_120004', 'evaluate', '20260501_120004', NULL, '20260501_120004', 'run_manifest.json,summary.json'"""))
def _(spark, sf):
    return RN.discover_runs(spark, run_tree(spark, sf)).withColumn("markers", F.array_join("markers", ","))


@query("s10_discover_experiments", with_(PREDS, RUNS_SQL, TREE, body="SELECT run_dir FROM tree WHERE r < 3"))
def _(spark, sf):
    return RN.discover_experiments(spark, run_tree(spark, sf))


@query("s11_load_table", with_(PREDS, RUNS_SQL, TREE, body="""SELECT run_dir, TRUE AS ok, r < 2 AS has_predictions, TRUE AS has_report, TRUE AS has_config, CASE WHEN r < 2 THEN n_samples END::BIGINT AS n_rows_predictions, 0::INTEGER AS n_missing, (CASE WHEN r < 2 THEN 0 ELSE 1 END)::INTEGER AS n_warnings, 0::INTEGER AS n_errors FROM tree WHERE r < 3"""))
def _(spark, sf):
    return RN.load_table(spark, run_tree(spark, sf)).drop("warnings", "errors")


RECORDS = """rec AS (SELECT run_dir AS run_key, run_dir, 'evaluate' AS series, '20260501_12000' || r AS campaign, dataset_name || '_run' AS suite, dataset_name || '_run' AS run_leaf, 'slug_' || dataset_name AS experiment_slug,
  CASE WHEN r < 4 THEN dataset_name END AS dataset_name, CASE WHEN r < 3 THEN 200 WHEN r = 3 THEN n_samples END AS tier_size, CASE WHEN r = 3 THEN n_samples END AS n_samples, CASE WHEN r < 4 THEN model_kind END AS model_kind,
  CASE WHEN r < 4 THEN model_id END AS model_id, CASE WHEN r < 4 THEN thinking_level END AS thinking_level, CASE WHEN r < 4 THEN batch_size END AS batch_size, CASE WHEN r < 3 THEN 'full' WHEN r = 3 THEN 'preliminary' ELSE 'started' END AS phase,
  CASE WHEN r < 4 THEN ROUND(accuracy, 9) END AS accuracy, CASE WHEN r < 4 THEN ROUND(f1_macro, 9) END AS f1_macro, CASE WHEN r < 3 THEN ROUND(n_samples / 8.0, 9)::DOUBLE END AS infer_time_s, r < 2 AS has_predictions,
  CASE WHEN r < 2 THEN 'csv' ELSE 'none' END AS predictions_source, CASE WHEN r < 3 THEN saved_utc END AS saved_utc, CASE WHEN r < 3 THEN 'harness_report' WHEN r = 3 THEN 'metrics_json' ELSE 'manifest_only' END AS format FROM tree)"""
REC_COLS = ["run_key", "run_dir", "series", "campaign", "suite", "run_leaf", "experiment_slug", "dataset_name", "tier_size", "n_samples", "model_kind", "model_id",
            "thinking_level", "batch_size", "phase", "accuracy", "f1_macro", "infer_time_s", "has_predictions", "predictions_source", "saved_utc", "format"]


# the suite folder above the fourth runs holds a manifest and no result below it, so it counts as started
STARTED = {
    "run_key": "'evaluate/20260501_120004'", "run_dir": "'evaluate/20260501_120004'", "series": "'evaluate'", "campaign": "'20260501_120004'",
    "run_leaf": "'20260501_120004'", "phase": "'started'", "has_predictions": "FALSE", "predictions_source": "'none'", "format": "'manifest_only'",
}


@query("s12_read_run_records", with_(PREDS, RUNS_SQL, TREE, RECORDS, body=f"""SELECT {', '.join(REC_COLS)} FROM rec
  UNION ALL SELECT {', '.join(STARTED.get(c, 'NULL') for c in REC_COLS)}"""))
def _(spark, sf):
    return rounded(RN.read_run_records(spark, run_tree(spark, sf)).select(*REC_COLS))


def legacy_tree(spark, sf, root=None):
    """All five flat layouts, made from the runs."""
    root = root or scratch_path(spark, "flat")
    runs = runs_table(spark, sf)
    one = lambda df, *parts: df.repartition(8).write.mode("append").partitionBy(*parts, "file").text(root)
    item = F.struct(
        F.col("dataset_name").alias("dataset"), F.lit("ML").alias("model_family"), F.concat("model_id", F.lit("_svm")).alias("model"), F.lit(100).alias("train_n"),
        F.col("n_samples").alias("test_n"), "accuracy", F.col("f1_macro").alias("macro_f1"), F.lit(2.0).alias("infer_seconds"),
    )
    one(runs.filter("r = 0").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("value")).select(
        F.lit("mvp4_results").alias("series"), F.lit("mvp4_final_results.json").alias("file"), "value"), "series")
    one(runs.filter("r = 0").select(
        F.lit("mvp4_results").alias("series"), F.concat(F.lit("preds_"), "dataset_name", F.lit("_"), "model_id", F.lit("_n100.csv")).alias("file"), F.lit("text,true,pred").alias("value")), "series")
    stamp = F.concat(F.lit("20260601_"), F.lpad((F.row_number().over(_by_key())).cast("string"), 6, "0"))
    v1 = runs.filter("r = 1").select("*", stamp.alias("stamp"))
    body = F.to_json(F.struct(
        F.col("dataset_name").alias("workflow"), F.struct("accuracy", F.col("f1_macro").alias("macro_f1")).alias("metrics"), F.struct(F.col("n_samples").alias("test")).alias("sample_sizes"),
        F.struct(F.col("model_id").alias("regular")).alias("models"), F.struct(F.lit(5.5).alias("total"), F.lit(1.5).alias("inference")).alias("timing_seconds"),
    ))
    one(v1.select(F.lit("mvp_v1").alias("series"), F.concat(F.lit("mvp_"), "dataset_name", F.lit("_summary_"), "stamp", F.lit(".json")).alias("file"), body.alias("value")), "series")
    one(v1.filter("model_kind = 'kind_1'").select(F.lit("mvp_v1").alias("series"), F.concat(F.lit("mvp_"), "dataset_name", F.lit("_preds_"), "stamp", F.lit(".csv")).alias("file"), F.lit("a,b").alias("value")), "series")
    v3 = runs.filter("r = 2").select("*", stamp.alias("stamp"))
    body3 = F.to_json(F.struct(F.struct("accuracy", F.col("f1_macro").alias("macro_f1")).alias("metrics"), F.struct(F.col("model_id").alias("prediction_model"), "batch_size").alias("extra")))
    one(v3.select(F.lit("prosocial_v3").alias("series"), F.concat(F.lit("exp_"), "dataset_name", F.lit("_summary_"), "stamp", F.lit(".json")).alias("file"), body3.alias("value")), "series")
    hf = runs.filter("r = 3").select(F.concat_ws(",", "dataset_name", "model_id", "n_samples", "accuracy", "f1_macro").alias("value"))
    lines = hf.agg(F.array_join(F.concat(F.array(F.lit("dataset,model,n_samples,accuracy,macro_f1")), F.array_sort(F.collect_list("value")), F.array(F.lit("x,major_vote,1,1,1"))), "\n").alias("value"))
    hf_file = lambda df, name: one(df.select(F.lit("hf_llms_comparison").alias("series"), F.lit(name).alias("file"), "value"), "series")
    hf_file(lines, "metrics_20260602_090000.csv")
    hf_file(lines.select(F.lit("{}").alias("value")), "summary_20260602_090000.json")
    hyp = lambda i, f, v: F.struct(F.lit(i).alias("id"), F.struct(v.alias(f), F.col("n_samples").alias("n")).alias("details"))
    h = F.concat(F.lit('{"hypotheses": ['), F.concat_ws(",", F.to_json(hyp("H1", "full_accuracy", F.col("f1_macro"))), F.to_json(hyp("H4_x", "report_accuracy", F.col("accuracy"))), F.to_json(hyp("H5", "full_accuracy", F.lit(0.0)))), F.lit("]}"))
    v5 = runs.filter("r = 4").select("*", stamp.alias("stamp"))
    one(v5.select(F.lit("debug_accuracy").alias("series"), F.col("stamp").alias("leaf"), F.lit("results.json").alias("file"), h.alias("value")), "series", "leaf")
    return root


def _by_key():
    from pyspark.sql import Window as W

    return W.orderBy("run_key")


FLAT = """st AS (SELECT *, '20260601_' || lpad((row_number() OVER (PARTITION BY r ORDER BY run_key))::VARCHAR, 6, '0') AS stamp FROM runs),
  flat AS (SELECT 'mvp4_results/' || dataset_name || '/' || model_id || '_svm/train100' AS run_key, 'mvp4_final_results' AS format, accuracy, f1_macro, TRUE AS has_predictions, n_samples AS tier_size, 2.0::DOUBLE AS duration_seconds, 'f1_macro' AS f1_source FROM st WHERE r = 0
  UNION ALL SELECT 'mvp_v1/' || dataset_name || '/' || stamp, 'mvp_v1_summary', accuracy, f1_macro, TRUE, n_samples, 5.5, 'f1_macro' FROM st WHERE r = 1
  UNION ALL SELECT 'prosocial_v3/exp_' || dataset_name || '/' || stamp, 'prosocial_v3_summary', accuracy, f1_macro, FALSE, 25, NULL, 'f1_macro' FROM st WHERE r = 2
  UNION ALL SELECT 'hf_llms_comparison/20260602_090000/' || dataset_name || '/' || model_id, 'hf_llms_metrics_csv', accuracy, f1_macro, FALSE, n_samples, NULL, 'f1_macro' FROM st WHERE r = 3
  UNION ALL SELECT 'debug_accuracy/' || stamp, 'debug_accuracy_results', accuracy, accuracy, FALSE, n_samples, NULL, 'accuracy' FROM st WHERE r = 4)"""
FLAT_COLS = ["run_key", "format", "accuracy", "f1_macro", "has_predictions", "tier_size", "duration_seconds", "f1_source"]


@query("s13_read_legacy_records", with_(PREDS, RUNS_SQL, FLAT, body="SELECT run_key, format, ROUND(accuracy, 9) AS accuracy, ROUND(f1_macro, 9) AS f1_macro, has_predictions, tier_size, duration_seconds, f1_source FROM flat"))
def _(spark, sf):
    return rounded(RN.read_legacy_records(spark, legacy_tree(spark, sf)).select(*FLAT_COLS))


@query("s14_pair_preds_for_summary", """SELECT DISTINCT source AS dir, 'mvp_' || lang || '_summary_20260101_000000.json' AS name, 'mvp_' || lang AS prefix, '20260101_000000' AS stamp,
  CASE lang WHEN 'de' THEN 'mvp_de_preds_x_20260101_000000.csv' WHEN 'en' THEN 'mvp_en_preds_20260101_000000.csv' WHEN 'fr' THEN 'mvp_pred_20260101_000000.csv' ELSE NULL END AS csv FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("lang", F.lit("")).alias("lang"), "source").distinct()
    summaries = d.select(F.col("source").alias("dir"), F.concat(F.lit("mvp_"), "lang", F.lit("_summary_20260101_000000.json")).alias("name"))
    csv = (
        F.when(F.col("lang") == "de", F.array(F.lit("mvp_de_preds_x_20260101_000000.csv"), F.lit("mvp_de_preds_20260101_000000.csv")))
        .when(F.col("lang") == "en", F.array(F.lit("mvp_en_preds_20260101_000000.csv")))
        .when(F.col("lang") == "fr", F.array(F.lit("mvp_fr_notes_20260101_000000.csv"), F.lit("mvp_pred_20260101_000000.csv")))
        .otherwise(F.array(F.lit("other_20260101_000000.csv")))
    )
    own = d.select("source", "lang", F.explode(csv).alias("csv"))
    # each language looks into its own folder
    s = summaries.withColumn("dir", F.concat_ws("/", "dir", F.regexp_extract("name", r"mvp_(\w\w)_", 1)))
    c = own.select(F.concat_ws("/", "source", "lang").alias("dir"), F.col("csv").alias("name"))
    return RN.pair_preds_for_summary(s, c).withColumn("dir", F.substring_index("dir", "/", 1))


@query("s15_read_tier_rows_summary", with_(PREDS, "s AS (SELECT source, r, avg(COALESCE(pred_label = true_label, FALSE)::INTEGER) AS a, count(*) AS n FROM preds GROUP BY 1, 2)", body="""SELECT 'reasoning_spectrum/' || source || '/tier_' || r || '_t' || r AS run_key, source AS campaign, 'pubmed' AS dataset_name,
  ROUND(a, 9) AS accuracy, ROUND(a / 2, 9) AS f1_macro, n AS tier_size, 'gold_in_set_rate' AS f1_source FROM s"""))
def _(spark, sf):
    root = scratch_path(spark, "spectrum")
    item = F.struct(F.col("r").alias("tier"), F.concat(F.lit("t"), "r").alias("name"), "model_id", F.col("accuracy").alias("top1_accuracy"), F.col("f1_macro").alias("gold_in_set_rate"))
    runs_table(spark, sf).groupBy("dataset_name").agg(F.array_sort(F.collect_list(item)).alias("tiers"), F.first("n_samples").alias("n_items")).select(
        F.lit("reasoning_spectrum").alias("series"), F.col("dataset_name").alias("leaf"), F.lit("summary.json").alias("file"),
        F.to_json(F.struct(F.lit("pubmed_probe").alias("suite"), "n_items", "tiers")).alias("value"),
    ).repartition(8).write.partitionBy("series", "leaf", "file").text(root)
    out = RN.read_tier_rows_summary(spark, root)
    return rounded(out.select("run_key", "campaign", "dataset_name", "accuracy", "f1_macro", "tier_size", "f1_source"))


@query("s16_read_latest", with_(PREDS, RUNS_SQL, body="SELECT dataset_name AS slug, max('20260501_12000' || r) AS stamp, dataset_name || '/' || max('20260501_12000' || r) || '/full_predictions.json' AS path FROM runs GROUP BY 1"))
def _(spark, sf):
    root = scratch_path(spark, "latest")
    runs_table(spark, sf).select(
        F.col("dataset_name").alias("slug"), F.concat(F.lit(STAMP), "r").alias("stamp"), F.lit("full_predictions.json").alias("file"), F.lit("[]").alias("value")
    ).repartition(8).write.partitionBy("slug", "stamp", "file").text(root)
    return RN.read_latest(spark, root)


@query("s17_write_predictions", with_(PREDS, body="SELECT sample_id, run_id, true_label, pred_label, confidence::VARCHAR AS confidence, sample_id || '/' || run_id AS json_row FROM preds"))
def _(spark, sf):
    path = scratch_path(spark, "sink")
    PR.write_predictions(preds(spark, sf).select("sample_id", "run_id", "true_label", "pred_label", "confidence"), path)
    lines = spark.read.json(f"{path}/full_predictions.json").select("sample_id", "run_id", F.concat_ws("/", "sample_id", "run_id").alias("json_row"))
    return spark.read.csv(f"{path}/predictions.csv", header=True).join(lines, ["sample_id", "run_id"])


@query("s18_write_report", with_(PREDS, "s AS (SELECT run_id, count(*) AS n_total, sum(in_tokens)::BIGINT AS t FROM preds GROUP BY 1)", body="SELECT run_id, n_total, t AS in_tokens_total FROM s"))
def _(spark, sf):
    path = scratch_path(spark, "reports")
    PR.write_report(E.report_struct(E.evaluate(preds(spark, sf), ["run_id"]), ["run_id"]), path)
    return spark.read.json(path).select("run_id", F.col("extras.confusion_stats.n_total").alias("n_total"), F.col("extras.usage.in_tokens_total").alias("in_tokens_total"))


@query("s19_write_analysis_bundle", with_(PREDS, body="""SELECT 'loaded_table' AS file, count(*) AS n_rows FROM preds UNION ALL SELECT 'aggregated_reports', 5 UNION ALL SELECT 'comparison', count(DISTINCT sample_id) FROM preds
  UNION ALL SELECT 'disagreements', count(*) FROM (SELECT 1 FROM preds GROUP BY sample_id HAVING count(DISTINCT pred_label) > 1) UNION ALL SELECT 'agreement_matrix', 25"""))
def _(spark, sf):
    path, p = scratch_path(spark, "bundle"), preds(spark, sf)
    PR.write_analysis_bundle(
        path, table=p, reports=RN.aggregate_reports(report_docs(spark, sf)), comparison=J.compare_runs_wide(p, RUNS),
        disagreements=A.disagreements(p), agreement=A.agreement_matrix(p),
    )
    return spark.read.json(f"{path}/manifest.json").select("file", "n_rows")


@query("s20_write_long_wide_metrics", with_(PREDS, body="SELECT dataset_name, run_id AS model, count(*) AS n_rows, count(*) FILTER (pred_label IS NULL) AS n_failed FROM preds GROUP BY 1, 2"))
def _(spark, sf):
    path = scratch_path(spark, "longwide")
    long = preds(spark, sf).withColumnRenamed("run_id", "model")
    PR.write_long_wide_metrics(path, long=long, wide=J.wide_votes(long, RUNS, ["dataset_name", "sample_id"]), metrics=V.per_model_metrics(long, RUNS))
    return spark.read.json(f"{path}/summary.json").select("dataset_name", "model", "n_rows", "n_failed")


@query("s19_bundle_rows", with_(PREDS, body="""SELECT sample_id, run_id, true_label, pred_label, confidence, (SELECT count(DISTINCT d.pred_label) FROM preds d WHERE d.sample_id = p.sample_id) > 1 AS disagreed FROM preds p"""))
def _(spark, sf):
    """The written table, with the samples of the written disagreements marked."""
    path, p = scratch_path(spark, "bundle"), preds(spark, sf)
    PR.write_analysis_bundle(path, table=p, reports=RN.aggregate_reports(report_docs(spark, sf)), disagreements=A.disagreements(p))
    back = lambda name: spark.read.csv(f"{path}/{name}.csv", header=True, multiLine=True, quote='"', escape='"')
    marked = back("disagreements").select("sample_id", F.lit(True).alias("hit"))
    return back("loaded_table").join(marked, "sample_id", "left").select(
        "sample_id", "run_id", "true_label", "pred_label", F.col("confidence").cast("double").alias("confidence"), F.coalesce("hit", F.lit(False)).alias("disagreed")
    )


@query("s20_written_rows", with_(PREDS, wide_preds_sql(), body=f"""SELECT p.sample_id, p.run_id AS model, p.true_label, p.pred_label, p.pred_label AS json_label, p.pred_label IS NULL AS failed,
  concat_ws(',', {', '.join(f"COALESCE(w.{r}, '-')" for r in RUNS)}) AS votes FROM preds p JOIN wide w USING (sample_id)"""))
def _(spark, sf):
    """Every long row as CSV and JSON hold it, whether it is among the errors, and its row of the wide table."""
    path = scratch_path(spark, "longwide")
    long = preds(spark, sf).withColumnRenamed("run_id", "model")
    PR.write_long_wide_metrics(path, long=long, wide=J.wide_votes(long, RUNS, ["dataset_name", "sample_id"]), metrics=V.per_model_metrics(long, RUNS))
    back = lambda name: spark.read.csv(f"{path}/{name}.csv", header=True, multiLine=True, quote='"', escape='"')
    key = ["sample_id", "model"]
    errors = back("errors").select(*key, F.lit(True).alias("hit"))
    lines = spark.read.json(f"{path}/predictions_long.jsonl").select(*key, F.col("pred_label").alias("json_label"))
    wide = back("predictions_wide")
    votes = wide.select("sample_id", F.concat_ws(",", *[F.coalesce(r, F.lit("-")) for r in RUNS]).alias("votes"))
    return back("predictions_long").join(lines, key).join(errors, key, "left").join(votes, "sample_id").select(
        *key, "true_label", "pred_label", "json_label", F.coalesce("hit", F.lit(False)).alias("failed"), "votes"
    )


@query("f13_build_dataset", with_("tops AS (SELECT source AS label FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)", "kept AS (SELECT * FROM documents WHERE source IN (SELECT label FROM tops))", body="""
  SELECT 'train_seed/tier_10' AS part, 10::BIGINT AS n UNION ALL SELECT 'train_seed/tier_20', 20 UNION ALL SELECT 'train_pool_remaining/full', count(*) - 30 FROM kept UNION ALL SELECT 'test/tier_20', 20 UNION ALL SELECT 'card', 2 * count(*) FROM kept"""))
def _(spark, sf):
    root, docs = scratch_path(spark, "dataset"), table(spark, sf, "documents")
    TR.build_dataset(
        docs, docs, root, dataset="documents", text_col="text", label_col="source", row_col="doc_id", seed=SEED, train_tiers=[20, 10], test_tiers=[20],
        origin={"id": "documents"}, top_k=5,
    )
    rows = None
    for split, artifact in (("train_seed", "tier_10"), ("train_seed", "tier_20"), ("train_pool_remaining", "full"), ("test", "tier_20")):
        m = TR.read_manifest(spark, root, "documents", split, artifact).select(F.lit(f"{split}/{artifact}").alias("part"), F.col("tier_size_actual").alias("n"))
        rows = m if rows is None else rows.unionByName(m)
    return rows.unionByName(TR.read_card(spark, root, "documents").select(F.lit("card").alias("part"), F.col("sample_count").alias("n")))


@query("f13_built_rows", """WITH tops AS (SELECT source AS label FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
  SELECT doc_id, source AS true_label, text, 1::BIGINT AS n_places FROM documents WHERE source IN (SELECT label FROM tops)""")
def _(spark, sf):
    """Every row of the kept labels as the written training parts hold it, and in how many of them."""
    root, docs = scratch_path(spark, "dataset"), table(spark, sf, "documents")
    TR.build_dataset(
        docs, docs, root, dataset="documents", text_col="text", label_col="source", row_col="doc_id", seed=SEED, train_tiers=[20, 10], test_tiers=[20],
        origin={"id": "documents"}, top_k=5,
    )
    parts = [TR.read_tier(spark, root, "documents", "train_seed", n) for n in (10, 20)] + [TR.read_artifact(spark, root, "documents", "train_pool_remaining", "full")]
    rows = None
    for part in parts:
        part = part.select(F.regexp_extract("sample_id", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "true_label", "text")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("doc_id", "true_label", "text").agg(F.count("*").alias("n_places"))


@query("m18_leaderboard", with_(PREDS, RUNS_SQL, TREE, RECORDS, FLAT, body="""SELECT run_key, format, ROUND(accuracy, 9) AS accuracy, ROUND(f1_macro, 9) AS f1_macro, has_predictions FROM flat UNION ALL SELECT run_key, format, accuracy, f1_macro, has_predictions FROM rec
  UNION ALL SELECT 'evaluate/20260501_120004', 'manifest_only', NULL, NULL, FALSE"""))
def _(spark, sf):
    root = legacy_tree(spark, sf, run_tree(spark, sf))  # one results folder with every layout
    return rounded(RN.leaderboard(spark, root).select("run_key", "format", "accuracy", "f1_macro", "has_predictions"))
