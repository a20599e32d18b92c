"""Run trees, flat layouts, prediction files and tiers written to a temporary folder."""

import csv
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagsight.plans import evaluate as E
from tagsight.sources import predictions as PR
from tagsight.sources import runs as RN
from tagsight.sources import tiers as TR


def put(path, obj):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj, indent=1))


def table(path, head, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([head, *lines])


def harness_run(base, dataset="irony", f1=0.9):
    table(base / "predictions.csv", ["sample_id", "dataset_name", "text", "true_label", "pred_label"], ["s1", dataset, 'hi, "you"\nthere', "a", "a"])
    put(base / "report.json", {"dataset_name": dataset, "tier_size": 10, "metrics": {"f1_macro": f1, "accuracy": f1}})
    put(base / "config.resolved.json", {"name": base.name, "model": {"kind": "toy", "params": {"model_id": "m1", "thinking_level": "low", "batch_size": 5}}})


def test_one_leaderboard_row(spark, tmp_path):
    harness_run(tmp_path / "evaluate" / "20260501_120000" / "exp_a")
    got = RN.leaderboard(spark, str(tmp_path)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["run_key"], r["series"], r["campaign"], r["f1_macro"], r["has_predictions"]) == ("evaluate/20260501_120000/exp_a", "evaluate", "20260501_120000", 0.9, True)
    assert (r["tier_size"], r["model_id"], r["batch_size"], r["format"], r["phase"]) == (10, "m1", 5, "harness_report", "full")


def test_folders_with_equal_signs_stay_apart(spark, tmp_path):
    for name in ("lr=1", "bs=1"):
        harness_run(tmp_path / "evaluate" / name)
    assert {r["run_dir"] for r in RN.discover_runs(spark, str(tmp_path)).collect()} == {"evaluate/lr=1", "evaluate/bs=1"}


def test_zero_f1_survives(spark, tmp_path):
    harness_run(tmp_path / "evaluate" / "20260501_120000" / "exp_a", f1=0.0)
    assert RN.read_run_records(spark, str(tmp_path)).first()["f1_macro"] == 0.0


def test_suite_parent_is_left_out(spark, tmp_path):
    top = tmp_path / "prompt" / "20260502_100000"
    harness_run(top / "probe" / "child")
    put(top / "summary.json", {"planned": [{"x": 1}], "results": []})
    put(top / "run_manifest.json", {})
    put(tmp_path / "prompt" / "20260503_100000" / "run_manifest.json", {"experiment_slug": "started"})
    got = {r["run_dir"]: r for r in RN.discover_runs(spark, str(tmp_path)).collect()}
    assert set(got) == {"prompt/20260502_100000/probe/child", "prompt/20260503_100000"}
    assert got["prompt/20260502_100000/probe/child"]["suite"] == "probe"
    started = RN.read_run_records(spark, str(tmp_path)).filter("phase = 'started'").first()
    assert started["experiment_slug"] == "started" and started["f1_macro"] is None


def test_broken_json_and_fallbacks(spark, tmp_path):
    put(tmp_path / "s" / "r1" / "report.json", "{not json")
    put(tmp_path / "s" / "r1" / "metrics.json", {"dataset_name": "d", "n_samples": 7, "macro_f1": 0.25, "accuracy": 0.5})
    put(tmp_path / "s" / "r2" / "full_metadata.json", {"duration_seconds": 3, "saved_utc": "z", "metrics": {}})
    put(tmp_path / "s" / "r2" / "full_classification_report.json", {"macro avg": {"f1-score": 0.75}, "accuracy": 0.8})
    put(tmp_path / "s" / "r2" / "full_predictions.json", [])
    put(tmp_path / "s" / "r2" / "full_predictions_skipped.txt", "x")
    got = {r["run_key"]: r for r in RN.read_run_records(spark, str(tmp_path)).collect()}
    assert (got["s/r1"]["f1_macro"], got["s/r1"]["n_samples"], got["s/r1"]["format"]) == (0.25, 7, "metrics_json")
    assert (got["s/r2"]["f1_macro"], got["s/r2"]["accuracy"], got["s/r2"]["predictions_source"], got["s/r2"]["format"]) == (0.75, 0.8, "skipped", "metadata_only")
    status = {r["run_dir"]: r for r in RN.load_table(spark, str(tmp_path)).collect()}
    assert status["s/r1"]["n_errors"] == 1 and not status["s/r1"]["ok"]
    assert status["s/r2"]["n_missing"] == 2 and status["s/r2"]["ok"]


def test_rows_of_prediction_files_are_counted(spark, tmp_path):
    for r in ("a", "b", "c", "d", "e"):
        harness_run(tmp_path / r)
    for r in ("b", "c", "d", "e"):
        (tmp_path / r / "predictions.csv").unlink()
    table(tmp_path / "a" / "predictions.csv", ["id", "text"], ["1", "two\nlines"], ["2", 'a "b"'])
    put(tmp_path / "a" / "full_predictions.json", [{}] * 9)
    put(tmp_path / "b" / "full_predictions.json", [{"id": 1}, {"id": 2}, {"id": 3}])
    put(tmp_path / "c" / "full_predictions.json", {"predictions": [{"id": 1}]})
    table(tmp_path / "d" / "predictions.csv", ["id", "text"])
    got = {r["run_dir"]: r["n_rows_predictions"] for r in RN.load_table(spark, str(tmp_path)).collect()}
    assert got == {"a": 2, "b": 3, "c": 1, "d": 0, "e": None}


def test_result_rows_meet_their_files(spark, tmp_path):
    item = lambda d, m, n, f="ML": {"dataset": d, "model_family": f, "model": m, "train_n": n, "accuracy": 0.5, "macro_f1": 0.5}
    put(tmp_path / "mvp4_results" / "mvp4_final_results.json", [
        item("ag_news", "svm_tfidf", 100), item("ag_news", "svm_tfidf", 200), item("ag_news", "knn", 100), item("news", "svm", None),
        item("trec", "gpt_x", 5, "LLM"), item("", "svm", None), item("ag_news", "svm_tfidf", 100),
    ])
    for stem in ("agnews_svm_n100", "trec_gpt_zero"):
        table(tmp_path / "mvp4_results" / f"preds_{stem}.csv", ["text"], ["a"])
    got = RN.read_result_list(spark, str(tmp_path)).select("dataset_name", "model_id", "run_leaf", "has_predictions").collect()
    assert len(got) == 7
    assert {(r[0], r[1], r[2]) for r in got if r[3]} == {("ag_news", "svm_tfidf", "svm_tfidf_train100"), ("news", "svm", None), ("trec", "gpt_x", "gpt_x_train5")}


def test_first_match_stops_descent(spark, tmp_path):
    harness_run(tmp_path / "a")
    harness_run(tmp_path / "a" / "inner")
    harness_run(tmp_path / "b" / "c" / "d" / "e" / "f" / "too_deep")
    assert rows(RN.discover_experiments(spark, str(tmp_path), max_depth=5)) == [("a",)]


def test_flat_layouts(spark, tmp_path):
    put(tmp_path / "mvp4_results" / "mvp4_final_results.json", [{"dataset": "ag_news", "model_family": "ML", "model": "svm_tfidf", "train_n": 100, "test_n": 50, "accuracy": 0.6, "macro_f1": 0.55}])
    table(tmp_path / "mvp4_results" / "preds_ag_news_svm_n100.csv", ["text", "true", "pred"], ["a", "Sports", "Sports"])
    hf = tmp_path / "hf_llms_comparison"
    put(hf / "summary_20260425_120000.json", {})
    table(hf / "metrics_20260425_120000.csv", ["dataset", "model", "n_samples", "accuracy", "macro_f1"], ["ag_news", "llama, 8b", 10, 0.8, 0.75], ["ag_news", "major_vote", 10, 1, 1])
    table(hf / "predictions_long_20260425_120000.csv", ["dataset", "sample_id", "true_label", "pred_label", "model"], ["ag_news", "s1", "x", "x", "llama, 8b"])
    put(tmp_path / "debug_accuracy" / "20260517_084623" / "results.json", {"hypotheses": [{"id": "H1", "details": {"full_accuracy": 0.5, "n": 20}}, {"id": "H4_a", "details": {"report_accuracy": 0.7}}, {"id": "H9", "details": {"full_accuracy": 0.1}}]})
    got = {r["run_key"]: r for r in RN.leaderboard(spark, str(tmp_path)).collect()}
    assert set(got) == {"mvp4_results/ag_news/svm_tfidf/train100", "hf_llms_comparison/20260425_120000/ag_news/llama, 8b", "debug_accuracy/20260517_084623"}
    assert all(got[k]["has_predictions"] for k in got if not k.startswith("debug"))
    debug = got["debug_accuracy/20260517_084623"]
    assert (debug["accuracy"], debug["n_samples"], debug["f1_source"]) == (0.7, 20, "accuracy")


def test_prediction_files(spark, tmp_path):
    harness_run(tmp_path / "r1")
    table(tmp_path / "r2" / "predictions.csv", ["pred", "id", "gold"], ["x", "9", "y"])
    put(tmp_path / "r3" / "full_predictions.json", {"predictions": [{"source_index": 4, "true": "u", "pred": None}]})
    put(tmp_path / "r4" / "full_predictions.json", [{"sample_id": "big", "pred_label": "x" * 500}])
    csvs = [str(tmp_path / r / "predictions.csv") for r in ("r1", "r2")]
    jsons = [str(tmp_path / r / "full_predictions.json") for r in ("r3", "r4")]
    got = PR.read_predictions(spark, csvs, jsons)
    short = got.select(F.substring_index("run_dir", "/", -1).alias("r"), "sample_id", "true_label", "pred_label")
    assert rows(short) == [("r1", "s1", "a", "a"), ("r2", "9", "y", "x"), ("r3", "4", "u", None), ("r4", "big", None, "x" * 500)]
    assert got.filter("sample_id = 's1'").first()["text"] == 'hi, "you"\nthere'


@pytest.mark.parametrize("size", ["97", "128m"])
def test_prediction_files_are_read_in_splits(spark, tmp_path, size):
    texts = ['plain', 'two\nlines', 'a "quoted" word', 'br}ace [{ "', 'back\\slash \\" }', "", "x" * 300, 'end\r\nof line', "{}", "ünï }\n{"]
    items = [{"id": i, "true": "t", "pred": None if i % 7 == 0 else f"p{i}", "text": texts[i % len(texts)], "meta_json": {"a": [{"b": i}, "}"]}} for i in range(60)]
    table(tmp_path / "c" / "predictions.csv", ["id", "true", "pred", "text"], *[[x["id"], "t", x["pred"] or "", x["text"]] for x in items])
    table(tmp_path / "plain" / "predictions.csv", ["id", "true", "pred"], *[[i, "t", "p"] for i in range(60)])
    put(tmp_path / "flat" / "full_predictions.json", items)
    put(tmp_path / "wide" / "full_predictions.json", json.dumps(items, indent=3) + "\n")
    put(tmp_path / "wrap" / "full_predictions.json", {"predictions": items, "extra": {"x": {"y": {}}, "z": [{"id": 900}]}})
    put(tmp_path / "last" / "full_predictions.json", {"extra": {"id": 900}, "predictions": items})
    put(tmp_path / "cut" / "full_predictions.json", json.dumps(items)[:-40])
    put(tmp_path / "empty" / "full_predictions.json", [])
    jsons = [str(tmp_path / r / "full_predictions.json") for r in ("flat", "wide", "wrap", "last", "cut", "empty")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = PR.read_predictions(spark, [str(tmp_path / r / "predictions.csv") for r in ("c", "plain")], jsons)
        out = got.select(F.substring_index("run_dir", "/", -1).alias("r"), "sample_id", "true_label", "pred_label", "text").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by = {}
    for r in out:
        by.setdefault(r["r"], []).append(tuple(r)[1:])
    want = sorted((str(x["id"]), "t", x["pred"], x["text"]) for x in items)
    for name in ("flat", "wide", "wrap", "last"):
        assert sorted(by[name]) == want, name
    assert sorted((a, b, c or None, d or "") for a, b, c, d in by["c"]) == want
    assert sorted(r[0] for r in by["plain"]) == sorted(str(i) for i in range(60))
    assert set(by) == {"c", "plain", "flat", "wide", "wrap", "last"}


def test_source_index_counts_rows(spark, tmp_path):
    lines = [{"context": f" c{i} " if i != 3 else "  ", "safety_label": "__Needs Caution__", "safety_annotations": ["A b"]} for i in range(50)]
    put(tmp_path / "d.jsonl", "\n".join(json.dumps(x) for x in lines))
    got = PR.read_jsonl_dialogues(spark, str(tmp_path / "d.jsonl"), all_features=True).orderBy("source_index").collect()
    assert [r["source_index"] for r in got] == [i for i in range(50) if i != 3]
    assert got[4]["context"] == "c5" and got[0]["safety_label"] == "needs_caution" and got[0]["safety_annotations"] == ["a_b"]


def test_source_index_follows_file_names(spark, tmp_path):
    for name, n in (("c", 3), ("a", 700), ("b", 1)):
        put(tmp_path / "many" / f"{name}.jsonl", "\n".join(json.dumps({"context": f"{name}{i}", "safety_label": "x"}) for i in range(n)))
    got = {r["context"]: r["source_index"] for r in PR.read_jsonl_dialogues(spark, str(tmp_path / "many")).collect()}
    assert (got["a0"], got["a699"], got["b0"], got["c0"], got["c2"]) == (0, 699, 700, 701, 703)


@pytest.mark.parametrize("n", [1, 1200])
def test_predictions_get_json_lines_at_any_size(spark, tmp_path, n):
    df = spark.range(n).selectExpr("cast(id as string) AS sample_id", "'a' AS pred_label", "map('a', 0.5D) AS probs")
    PR.write_predictions(df, str(tmp_path / "p"))
    back = spark.read.json(str(tmp_path / "p" / "full_predictions.json"))
    assert back.count() == n and rows(back.limit(1).select("probs.a")) == [(0.5,)]


def test_tiers_round_trip(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([(f"s{i}", "d", "t", "ab"[i % 2]) for i in range(20)], "sample_id string, dataset_name string, text string, true_label string")
    kw = {"dataset": "d", "split": "test", "seed": 1, "builder": "b", "origin": {"k": "v"}}
    TR.write_tier(df, str(tmp_path), tier=20, **kw)
    assert rows(TR.read_tier(spark, str(tmp_path), "d", "test", 20)) == rows(df)
    m = TR.read_manifest(spark, str(tmp_path), "d", "test", "tier_20").first()
    buckets: dict[str, list[str]] = {}
    for i in sorted(f"s{i}" for i in range(20)):
        buckets.setdefault(hashlib.md5(i.encode()).hexdigest()[:4], []).append(i)
    parts = [hashlib.sha256("\n".join(v).encode()).hexdigest() for _, v in sorted(buckets.items())]
    assert m["sample_id_sha256"] == hashlib.sha256("\n".join(parts).encode()).hexdigest()
    with pytest.raises(FileNotFoundError):
        TR.read_tier(spark, str(tmp_path), "d", "test", 99)
    with pytest.raises(ValueError):
        TR.write_tier(df.union(df), str(tmp_path), tier=40, **kw)


def test_report_row_is_complete(spark):
    df = spark.createDataFrame([("r", "a", "a", False, 1, 3, 4, 0.5)], "run_id string, true_label string, pred_label string, is_confusing boolean, n_pred_labels int, in_tokens int, out_tokens int, confidence double")
    r = E.report_struct(E.evaluate(df, ["run_id"]), ["run_id"]).first()
    assert r["metrics"]["accuracy"] == 1.0 and r["extras"]["usage"]["out_tokens_total"] == 4
