"""Run folders: discovery, run records, flat result layouts and the leaderboard.

Small JSON files are read as whole texts in one scan per question; their fields
are taken by explicit paths, so no schema is inferred from file contents.
"""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import union_runs
from ..plans.evaluate import leaderboard as ordered_board
from ..schema import RUN_COLUMNS, run_row

# File names that mark a run, name formats and a row format.
SCORING = ("report.json", "full_metadata.json", "metrics.json", "val_eval_macro_f1.json")
EXTRA = ("run_manifest.json", "full_classification_report.json", "preliminary_metadata.json")
FILES = ("predictions.csv", "full_predictions.json", "summary.json")
STAMP = r"\d{8}_\d{6}"
VAL_FORMAT = "gepa_val_eval"
SKIPPED = "full_predictions_skipped.txt"
CONFIGS = ("config.resolved.json", "config.json")
CSV_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
SUMMARY_NAME = r"^(.+)_summary_(\d{8}_\d{6})\.json$"


def _listing(df: DataFrame, path: Column, root: str, globs: tuple[str, ...], *keep: str) -> DataFrame:
    """Add (rel, dir, name) and keep the files whose name matches one of the globs.

    A folder that Spark wrote counts as a file, by the name in its ``file=`` column:
    ``a/leaf=x/file=report.json/part-0`` is ``a/x/report.json``.  Other paths stay as they are, also where a
    folder is called ``lr=1``.
    """
    below = F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    whole = F.regexp_replace(below, r"/part-[^/]*$", "")
    by_columns = F.regexp_like(below, F.lit(r"(^|/)file=[^/]*/part-[^/]*$"))
    rel = F.when(by_columns, F.regexp_replace(whole, r"(^|/)[A-Za-z_]+=", "$1")).otherwise(whole)
    named = df.select(rel.alias("rel"), *keep).withColumns(
        {"dir": F.regexp_replace("rel", r"/?[^/]*$", ""), "name": F.substring_index("rel", "/", -1)}
    )
    pattern = "^(?:" + "|".join(fnmatch.translate(g) for g in globs) + ")"
    return named.filter(F.regexp_like("name", F.lit(pattern)))


def _file_filter(globs: tuple[str, ...]) -> str:
    return "{" + ",".join([*globs, "part-*"]) + "}"


def list_files(spark: SparkSession, root: str, *globs: str) -> DataFrame:
    """(rel, dir, name, length) of the files below ``root``; contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _file_filter(globs))
        .load(root)
    )
    return _listing(files, F.col("path"), root, globs, "length").distinct()


def read_texts(spark: SparkSession, root: str, *globs: str) -> DataFrame:
    """(rel, dir, name, body) of small text files below ``root``."""
    texts = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", _file_filter(globs))
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("_path"), F.col("value").alias("body"))
    )
    return _listing(texts, F.col("_path"), root, globs, "body").filter("length(body) > 0")


def in_series(files: DataFrame, series: str) -> DataFrame:
    """Files of one first-level folder, with paths relative to it."""
    prefix = f"{series}/"
    cut = lambda c: F.when(F.col(c) == series, "").otherwise(F.substring(c, len(prefix) + 1, 1 << 20))
    return files.filter(F.startswith("rel", F.lit(prefix))).withColumns({"rel": cut("rel"), "dir": cut("dir")})


def ancestors(path: Column) -> Column:
    """All proper parent folders of a relative path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(
        n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ).otherwise(F.array().cast("array<string>"))


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per run folder with its place in the tree and its marker files.

    A folder whose summary plans a suite is left out when a scored run lies below
    it: scored folders name their ancestors, so this is an equi join.
    """
    markers = SCORING + EXTRA + FILES
    found = list_files(spark, root, *markers)
    dirs = found.groupBy("dir").agg(F.array_sort(F.collect_set("name")).alias("markers"))
    has = lambda names: F.arrays_overlap("markers", F.array(*[F.lit(n) for n in names]))
    runs = dirs.filter(has(SCORING) | has(("run_manifest.json",))).filter(
        ~F.substring_index("dir", "/", -1).isin("configs", "__pycache__")
    )
    below = runs.filter(has(SCORING)).select(F.explode(ancestors(F.col("dir"))).alias("dir")).distinct()
    body = F.col("body")
    suites = read_texts(spark, root, "summary.json").filter(
        F.coalesce(F.startswith(F.get_json_object(body, "$.planned"), F.lit("[")), F.lit(False))
        | F.coalesce(F.startswith(F.get_json_object(body, "$.results"), F.lit("[")), F.lit(False))
    ).select("dir")
    parents = suites.join(below, "dir", "left_semi")
    parts = F.split("dir", "/")
    second = F.try_element_at(parts, F.lit(2))
    stamped = F.coalesce(F.regexp_like(second, F.lit(f"^{STAMP}$")), F.lit(False))
    last = F.try_element_at(parts, F.lit(-1))
    return runs.join(parents, "dir", "left_anti").select(
        F.col("dir").alias("run_dir"),
        parts[0].alias("series"),
        F.when(stamped, second)
        .when((F.size(parts) >= 2) & F.regexp_like(last, F.lit(f"^{STAMP}$")), last)
        .alias("campaign"),
        F.when(stamped, F.try_element_at(parts, F.lit(3))).alias("suite"),
        last.alias("run_leaf"),
        "markers",
    )


def discover_experiments(spark: SparkSession, root: str, *, max_depth: int = 5) -> DataFrame:
    """Experiment folders at most ``max_depth`` below the root; the first match on a path wins."""
    wanted = ("predictions.csv", "full_predictions.json", "report.json", "full_metadata.json", SKIPPED)
    dirs = list_files(spark, root, *wanted).groupBy("dir").agg(F.collect_set("name").alias("names"))
    has = lambda n: F.array_contains("names", n)
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    hits = dirs.filter(
        has("predictions.csv") | (has("full_predictions.json") & ~has(SKIPPED)) | has("report.json") | has("full_metadata.json")
    ).filter(depth <= max_depth).select("dir")
    up = hits.select("dir", F.explode(ancestors(F.col("dir"))).alias("up"))
    covered = up.join(hits.select(F.col("dir").alias("up")), "up", "left_semi").select("dir").distinct()
    return hits.join(covered, "dir", "left_anti").select(F.col("dir").alias("run_dir"))


def run_documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per folder with the bodies of its JSON files (NULL where absent or not an object)."""
    names = SCORING + EXTRA + CONFIGS
    texts = read_texts(spark, root, *names)
    good = F.when(F.startswith(F.ltrim("body"), F.lit("{")) & F.get_json_object("body", "$").isNotNull(), F.col("body"))
    return texts.groupBy("dir").agg(*[F.max(F.when(F.col("name") == n, good)).alias(_key(n)) for n in names])


def _key(name: str) -> str:
    return name.rsplit(".json", 1)[0].replace(".", "_")


def _j(doc: str, path: str, kind: str = "string") -> Column:
    value = F.get_json_object(F.col(doc), f"$.{path}")
    return value if kind == "string" else value.try_cast(kind)


def read_run_records(spark: SparkSession, root: str) -> DataFrame:
    """The 24-column row of every run folder.

    Scores come from the first present of report, metrics, validation scores and
    metadata; a classification report fills a missing macro F1.
    """
    docs = run_documents(spark, root)
    runs = discover_runs(spark, root).join(docs.withColumnRenamed("dir", "run_dir"), "run_dir", "left")
    skipped = list_files(spark, root, SKIPPED).select(F.col("dir").alias("run_dir"), F.lit(True).alias("skipped"))
    runs = runs.join(skipped, "run_dir", "left").withColumns(
        {
            "meta": F.coalesce("full_metadata", "preliminary_metadata"),
            "cfg": F.coalesce("config_resolved", "config", F.get_json_object("run_manifest", "$.config")),
            "scores": F.coalesce("metrics", "val_eval_macro_f1"),
        }
    )
    has = lambda c: F.col(c).isNotNull()
    fmt = (
        F.when(has("report"), "harness_report")
        .when(has("metrics"), "metrics_json")
        .when(has("val_eval_macro_f1"), VAL_FORMAT)
        .when(has("meta"), "metadata_only")
        .otherwise("manifest_only")
    )
    runs = runs.withColumn("fmt", fmt)
    is_ = lambda name: F.col("fmt") == name

    def score(kind: str) -> Column:
        names = ("f1_macro", "macro_f1") if kind == "f1_macro" else (kind,)
        first = lambda doc, base: F.coalesce(*[_j(doc, f"{base}{n}", "double") for n in names])
        picked = (
            F.when(is_("harness_report"), first("report", "metrics."))
            .when(is_("metrics_json"), first("metrics", ""))
            .when(is_(VAL_FORMAT), first("val_eval_macro_f1", ""))
            .when(is_("metadata_only"), first("meta", "metrics."))
        )
        fallback = (
            F.get_json_object("full_classification_report", "$['macro avg']['f1-score']")
            if kind == "f1_macro"
            else F.get_json_object("full_classification_report", "$.accuracy")
        ).try_cast("double")
        return F.coalesce(picked, fallback)

    tier = F.coalesce(
        F.when(is_("harness_report"), _j("report", "tier_size", "double")),
        F.when(is_("metrics_json"), _j("metrics", "n_samples", "double")),
        F.when(is_(VAL_FORMAT), _j("val_eval_macro_f1", "n_samples", "double")),
        F.nullif(F.regexp_extract(_j("cfg", "test_data"), r"tier_(\d+)", 1), F.lit("")).try_cast("double"),
    ).cast("bigint")
    dataset = F.when(is_("harness_report"), _j("report", "dataset_name")).when(
        is_("metrics_json"), _j("metrics", "dataset_name")
    )
    n_samples = F.coalesce(
        _j("scores", "n_samples", "double"),
        _j("report", "extras.confusion_stats.n_total", "double"),
        _j("report", "extras.confusion_stats.n_scored", "double"),
    ).cast("bigint")
    source = (
        F.when(F.array_contains("markers", "predictions.csv"), "csv")
        .when(F.array_contains("markers", "full_predictions.json") & has("skipped"), "skipped")
        .when(F.array_contains("markers", "full_predictions.json"), "json")
        .otherwise("none")
    )
    phase = (
        F.when(is_("manifest_only"), "started").when(has("full_metadata") | has("report"), "full").otherwise("preliminary")
    )
    slug = F.coalesce(_j("run_manifest", "experiment_slug"), _j("run_manifest", "experiment"), _j("cfg", "name"))
    usable = runs.filter(has("report") | has("run_manifest") | has("scores") | has("meta"))
    return run_row(
        usable,
        run_key=F.col("run_dir"), run_dir=F.col("run_dir"), series=F.col("series"), campaign=F.col("campaign"),
        suite=F.col("suite"), run_leaf=F.col("run_leaf"), experiment_slug=slug,
        predictor_name=_j("report", "predictor_name"), dataset_name=dataset, tier_size=tier, n_samples=n_samples,
        model_kind=_j("cfg", "model.kind"), model_id=_j("cfg", "model.params.model_id"),
        thinking_level=_j("cfg", "model.params.thinking_level"),
        batch_size=_j("cfg", "model.params.batch_size", "double").cast("bigint"), phase=phase,
        accuracy=score("accuracy"), f1_macro=score("f1_macro"),
        duration_seconds=_j("meta", "duration_seconds", "double"),
        infer_time_s=F.coalesce(_j("report", "extras.infer_time_s", "double"), _j("meta", "extras.infer_time_s", "double")),
        has_predictions=source.isin("csv", "json"), predictions_source=source,
        saved_utc=F.when(has("meta"), _j("meta", "saved_utc")).otherwise(_j("report", "created_at")),
        format=F.col("fmt"), f1_source=F.lit("f1_macro"),
    )


def prediction_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the prediction file of every folder; NULL where a JSON file is neither a list nor holds one."""
    name = "predictions.csv"
    scan = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", _file_filter((name,)))
        .csv(root, schema="c string", header=True, multiLine=True, quote='"', escape='"')
        .groupBy(F.col("_metadata.file_path").alias("_path"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # a file without rows is in the listing only
    tables = list_files(spark, root, name).select("dir").distinct().join(
        _listing(scan, F.col("_path"), root, (name,), "n").groupBy("dir").agg(F.sum("n").alias("n")), "dir", "left"
    )
    body = F.col("body")
    items = F.when(F.startswith(F.ltrim(body), F.lit("[")), F.json_array_length(body)).otherwise(
        F.json_array_length(F.get_json_object(body, "$.predictions"))
    )
    lists = read_texts(spark, root, "full_predictions.json").select("dir", items.cast("bigint").alias("m"))
    return tables.join(lists, "dir", "full").select(
        F.col("dir").alias("run_dir"),
        F.coalesce("n", "m", F.when(F.col("m").isNull(), F.lit(0))).cast("bigint").alias("n_rows_predictions"),
    )


def load_table(spark: SparkSession, root: str, preds: DataFrame | None = None) -> DataFrame:
    """Load status of every experiment folder: what is there, row counts, warnings and errors.

    Rows are those of ``preds`` where given, else those of the folder's prediction files (CSV before JSON).
    """
    found = discover_experiments(spark, root)
    texts = read_texts(spark, root, "report.json", "config.resolved.json")
    valid = F.get_json_object("body", "$").isNotNull() & F.startswith(F.ltrim("body"), F.lit("{"))
    state = texts.groupBy(F.col("dir").alias("run_dir")).agg(
        *[
            F.bool_or(F.when(F.col("name") == n, F.coalesce(valid, F.lit(False)))).alias(c)
            for n, c in (("report.json", "report_ok"), ("config.resolved.json", "config_ok"))
        ]
    )
    files = list_files(spark, root, "predictions.csv", "full_predictions.json").groupBy(
        F.col("dir").alias("run_dir")
    ).agg(F.lit(True).alias("pred_file"))
    out = found.join(state, "run_dir", "left").join(files, "run_dir", "left")
    if preds is not None:
        rows = preds.groupBy(F.regexp_replace("run_dir", "^.*?" + re.escape(root.rstrip("/")) + "/", "").alias("run_dir")).agg(F.count(F.lit(1)).alias("n_rows_predictions"))
        out = out.join(rows, "run_dir", "left")
    else:
        out = out.join(prediction_counts(spark, root), "run_dir", "left")
    keep = lambda *cols: F.filter(F.array(*cols), lambda x: x.isNotNull())
    text = lambda cond, msg: F.when(cond, F.concat(F.lit(msg), F.col("run_dir")))
    warnings = keep(
        text(F.col("pred_file").isNull(), "No predictions: "),
        text(F.col("report_ok").isNull(), "Missing report.json: "),
        text(F.col("config_ok").isNull(), "Missing config.resolved.json: "),
    )
    errors = keep(
        text(F.col("report_ok") == F.lit(False), "Failed to parse report.json: "),
        text(F.col("config_ok") == F.lit(False), "Failed to parse config.resolved.json: "),
    )
    return out.select(
        "run_dir",
        (F.size(errors) == 0).alias("ok"),
        F.col("pred_file").isNotNull().alias("has_predictions"),
        F.coalesce("report_ok", F.lit(False)).alias("has_report"),
        F.coalesce("config_ok", F.lit(False)).alias("has_config"),
        "n_rows_predictions",
        F.size(F.filter(warnings, lambda w: F.startswith(w, F.lit("Missing ")))).alias("n_missing"),
        F.size(warnings).alias("n_warnings"),
        F.size(errors).alias("n_errors"),
        warnings.alias("warnings"),
        errors.alias("errors"),
    )


def aggregate_reports(docs: DataFrame, *, key: str = "run_dir", report: str = "report", config: str = "config") -> DataFrame:
    """One wide row per run from its report and config bodies."""
    text = {"dataset_name": "dataset_name", "predictor_name": "predictor_name"}
    numbers = {
        "f1_macro": "metrics.f1_macro", "accuracy": "metrics.accuracy", "infer_time_s": "extras.infer_time_s",
        "train_time_s": "extras.train_time_s", "confusing_rate": "extras.confusion_stats.confusing_rate",
    }
    whole = {
        "tier_size": "tier_size", "in_tokens_total": "extras.usage.in_tokens_total",
        "out_tokens_total": "extras.usage.out_tokens_total",
        **{c: f"extras.confusion_stats.{c}" for c in ("n_total", "n_scored", "n_confusing", "n_zero_labels", "n_multi_labels")},
    }
    params = ("model_id", "prompt_id", "batch_size", "max_concurrency", "temperature", "max_tokens", "retries")
    return docs.select(
        key,
        *[_j(report, p).alias(c) for c, p in text.items()],
        *[_j(report, p, "double").alias(c) for c, p in numbers.items()],
        *[_j(report, p, "double").cast("bigint").alias(c) for c, p in whole.items()],
        F.get_json_object(report, "$.extras.confusion_stats").isNotNull().alias("has_confusion_stats"),
        _j(config, "model.kind").alias("model_kind"),
        *[_j(config, f"model.params.{p}").alias(p) for p in params],
    )


def read_tier_rows_summary(spark: SparkSession, root: str, *, series: str = "reasoning_spectrum") -> DataFrame:
    """The ``tiers`` list of every summary as run rows; the score is a set hit rate, so named."""
    tier = "struct<tier:string,name:string,model_id:string,top1_accuracy:double,gold_in_set_rate:double,elapsed_s:double>"
    body = in_series(read_texts(spark, root, "summary.json"), series).withColumn(
        "tiers", F.from_json(F.get_json_object("body", "$.tiers"), f"array<{tier}>")
    )
    rows = body.select("dir", "body", F.inline("tiers"))
    suite = F.coalesce(_j("body", "suite"), F.col("dir"))
    leaf = F.concat(F.lit("tier_"), F.col("tier"), F.lit("_"), F.col("name"))
    rel = F.concat(F.lit(f"{series}/"), F.col("dir"))
    n = _j("body", "n_items", "double").cast("bigint")
    return run_row(
        rows,
        run_key=F.concat(rel, F.lit("/"), leaf), run_dir=rel, series=F.lit(series), campaign=F.col("dir"), suite=suite,
        run_leaf=leaf, experiment_slug=F.lit(series), predictor_name=F.concat(F.lit(f"{series}:"), F.col("name")),
        dataset_name=F.substring_index(suite, "_", 1), tier_size=n, model_id=F.col("model_id"),
        model_kind=F.lit("reasoning_spectrum_tier"), batch_size=_j("body", "batch_size", "double").cast("bigint"),
        phase=F.lit("tier"), accuracy=F.col("top1_accuracy"), f1_macro=F.col("gold_in_set_rate"),
        duration_seconds=F.col("elapsed_s"), infer_time_s=F.col("elapsed_s"), has_predictions=F.lit(False),
        predictions_source=F.lit("none"), format=F.lit("reasoning_spectrum_summary"), f1_source=F.lit("gold_in_set_rate"),
    )


def read_latest(spark: SparkSession, root: str, *, marker: str = "full_predictions.json") -> DataFrame:
    """Newest run per slug by the name of its folder ``{slug}/{stamp}``."""
    files = list_files(spark, root, marker).select(
        F.substring_index("dir", "/", 1).alias("slug"), F.substring_index("dir", "/", -1).alias("stamp"), "rel"
    )
    return files.groupBy("slug").agg(F.max_by("rel", "stamp").alias("path"), F.max("stamp").alias("stamp"))


def pair_preds_for_summary(summaries: DataFrame, csvs: DataFrame) -> DataFrame:
    """Predictions file of every summary in the same folder with the same stamp.

    Names are matched from the strictest pattern to the loosest; ``(dir, name)`` on both sides.
    """
    s = summaries.select(
        "dir", "name", F.regexp_extract("name", SUMMARY_NAME, 1).alias("prefix"), F.regexp_extract("name", SUMMARY_NAME, 2).alias("stamp")
    ).filter("stamp <> ''")
    c = csvs.select("dir", F.col("name").alias("csv"), F.regexp_extract("name", f"({STAMP})", 1).alias("stamp"))
    both = s.join(c, ["dir", "stamp"])
    has = lambda pre, post: F.startswith(F.col("csv"), F.concat(F.col("prefix"), F.lit(pre))) & F.endswith(
        F.col("csv"), F.concat(F.lit(post), F.col("stamp"), F.lit(".csv"))
    )
    exact = F.col("csv") == F.concat("prefix", F.lit("_preds_"), "stamp", F.lit(".csv"))
    pred = F.contains(F.lower("csv"), F.lit("pred"))
    rank = (
        F.when(has("_preds_", "_") & ~exact, 1)
        .when(exact, 2)
        .when(F.startswith(F.col("csv"), F.col("prefix")) & pred, 3)
        .when(pred & F.contains(F.col("csv"), F.substring_index("prefix", "_", 1)), 4)
    )
    best = F.min(F.struct("rank", "csv"))
    hit = both.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("dir", "name").agg(best["csv"].alias("csv"))
    return s.select("dir", "name", "prefix", "stamp").join(hit, ["dir", "name"], "left")


def _legacy(rows: DataFrame, **cols: Column) -> DataFrame:
    has = cols.get("has_predictions", F.lit(False))
    base = {
        "phase": F.lit("final"),
        "has_predictions": has,
        "predictions_source": F.when(has, "legacy_csv").otherwise("none"),
        "f1_source": F.lit("f1_macro"),
    }
    return run_row(rows, **(base | cols))


def read_result_list(spark: SparkSession, root: str, series: str = "mvp4_results") -> DataFrame:
    """S13, first layout: a JSON list of results next to ``preds_*.csv`` files."""
    item = (
        "struct<dataset:string,model_family:string,model:string,train_n:double,test_n:double,accuracy:double,"
        "macro_f1:double,fit_seconds:double,infer_seconds:double>"
    )
    rows = in_series(read_texts(spark, root, "mvp4_final_results.json"), series).select(F.inline(F.from_json("body", f"array<{item}>")))
    stems = in_series(list_files(spark, root, "preds_*.csv"), series).select(
        F.regexp_replace(F.regexp_replace("name", r"\.csv$", ""), "^preds_", "").alias("stem")
    )
    flat = lambda c: F.replace(c, F.lit("_"), F.lit(""))
    n = F.col("train_n").cast("bigint").cast("string")
    rows = rows.withColumn("_key", F.to_json(F.struct("dataset", "model", "train_n", "model_family")))
    asked = rows.select("_key", "dataset", "model", "train_n", "model_family", flat(F.col("dataset")).alias("part")).distinct()
    # every part of a stem that is as long as some data set's name, so that names meet stems by equality
    lengths = asked.filter("part <> ''").agg(F.collect_set(F.length("part"))).scalar()
    parts = (
        stems.distinct()
        .select("stem", flat(F.col("stem")).alias("_flat"), F.explode(lengths).alias("_n"))
        .filter(F.length("_flat") >= F.col("_n"))
        .select("stem", F.explode(F.transform(F.sequence(F.lit(1), F.length("_flat") - F.col("_n") + 1), lambda i: F.substr("_flat", i, F.col("_n")))).alias("part"))
        .distinct()
    )
    stem = F.col("stem")
    hits = asked.join(parts, "part").filter(
        (F.contains(stem, F.substring_index("model", "_", 1)) | F.contains(stem, F.col("model")))
        & (F.col("train_n").isNull() | F.contains(stem, F.concat(F.lit("n"), n)) | (F.col("model_family") == "LLM"))
    ).select("_key", F.lit(True).alias("hit")).distinct()
    rows = rows.join(hits, "_key", "left")
    spent = F.coalesce("fit_seconds", F.lit(0.0)) + F.coalesce("infer_seconds", F.lit(0.0))
    return _legacy(
        rows,
        run_key=F.concat_ws("/", F.lit(series), "dataset", "model", F.concat(F.lit("train"), n)),
        run_dir=F.concat_ws("/", F.lit(series), "dataset"), series=F.lit(series), suite=F.col("dataset"),
        run_leaf=F.concat(F.col("model"), F.lit("_train"), n), experiment_slug=F.lit("mvp4"),
        predictor_name=F.col("model"), dataset_name=F.col("dataset"), tier_size=F.col("test_n"), n_samples=F.col("test_n"),
        model_kind=F.coalesce("model_family", F.lit("ML")), model_id=F.col("model"), accuracy=F.col("accuracy"),
        f1_macro=F.col("macro_f1"), duration_seconds=F.nullif(spent, F.lit(0.0)), infer_time_s=F.col("infer_seconds"),
        has_predictions=F.coalesce("hit", F.lit(False)), format=F.lit("mvp4_final_results"),
    )


def read_summaries(spark: SparkSession, root: str, series: str) -> DataFrame:
    """S13, second and third layout: ``*_summary_<stamp>.json`` files with paired predictions."""
    first = series == "mvp_v1"
    files = in_series(read_texts(spark, root, "mvp_*_summary_*.json" if first else "exp_*_summary_*.json"), series)
    pairs = pair_preds_for_summary(files, in_series(list_files(spark, root, "*.csv"), series)).select("dir", "name", "prefix", "stamp", "csv")
    rows = files.join(pairs, ["dir", "name"], "left")
    stem = F.regexp_replace("name", r"\.json$", "")
    short = F.regexp_replace("prefix", "^mvp_", "") if first else F.col("prefix")
    flow = F.coalesce(_j("body", "workflow"), short, stem)
    stamp = F.coalesce("stamp", stem if first else F.lit(""))
    folder = F.concat_ws("/", F.lit(series), flow) if first else F.concat_ws("/", F.lit(series), F.nullif("dir", F.lit("")))
    key = F.concat_ws("/", F.lit(series), flow, stamp) if first else F.concat_ws("/", folder, flow, stamp)
    sizes = ("sample_sizes.test_eval", "sample_sizes.test", "sample_sizes.test_subset_25")
    n = F.coalesce(*[_j("body", p, "double") for p in sizes]) if first else F.lit(25.0)
    model = F.coalesce(_j("body", "model"), _j("body", "models.regular"), _j("body", "models.smart")) if first else _j(
        "body", "extra.prediction_model"
    )
    total = _j("body", "timing_seconds.total", "double") if first else _j("body", "extra.timing_seconds.inference", "double")
    infer = _j("body", "timing_seconds.inference", "double") if first else total
    return _legacy(
        rows,
        run_key=key, run_dir=folder, series=F.lit(series), campaign=stamp, suite=flow, run_leaf=stem,
        experiment_slug=flow, predictor_name=flow, dataset_name=F.lit("prosocial_dialogue"), tier_size=n, n_samples=n,
        model_kind=F.lit("legacy_mvp" if first else series), model_id=model,
        batch_size=F.lit(None) if first else _j("body", "extra.batch_size", "double"),
        accuracy=_j("body", "metrics.accuracy", "double"), f1_macro=_j("body", "metrics.macro_f1", "double"),
        duration_seconds=total, infer_time_s=infer, has_predictions=F.col("csv").isNotNull(),
        format=F.lit(f"{series}_summary"),
    )


def read_metrics_csv(spark: SparkSession, root: str, series: str = "hf_llms_comparison") -> DataFrame:
    """S13, fourth layout: ``metrics_<stamp>.csv`` with one row per dataset and model; the vote row is dropped."""
    stamp_of = lambda c: F.regexp_extract(c, f"({STAMP})", 1)
    files = in_series(list_files(spark, root, "summary_*.json", "predictions_long_*.csv"), series)
    have = files.groupBy(stamp_of("name").alias("stamp")).agg(
        F.bool_or(F.startswith("name", F.lit("summary_"))).alias("has_summary"),
        F.bool_or(F.startswith("name", F.lit("predictions_long_"))).alias("has_preds"),
    )
    cells = lambda line: F.transform(F.split(line, CSV_COMMA), lambda x: F.trim(x, F.lit('"')))
    scan = (
        in_series(read_texts(spark, root, "metrics_*.csv"), series)
        .select(stamp_of("name").alias("stamp"), F.filter(F.split("body", r"\r?\n"), lambda x: x != "").alias("lines"))
        .select("stamp", cells(F.col("lines")[0]).alias("head"), F.explode(F.slice("lines", 2, 1 << 30)).alias("line"))
        .select("stamp", F.map_from_arrays("head", F.slice(cells(F.col("line")), F.lit(1), F.size("head"))).alias("m"))
    )
    field = lambda c: F.try_element_at("m", F.lit(c))
    num = lambda c: field(c).try_cast("double")
    rows = (
        scan.join(have.filter("has_summary"), "stamp")
        .withColumns({"dataset": field("dataset"), "model": field("model")})
        .filter("dataset <> '' AND model <> '' AND model <> 'major_vote'")
    )
    return _legacy(
        rows,
        run_key=F.concat_ws("/", F.lit(series), "stamp", "dataset", "model"), run_dir=F.concat_ws("/", F.lit(series), "stamp"),
        series=F.lit(series), campaign=F.col("stamp"), suite=F.col("dataset"), run_leaf=F.col("model"),
        experiment_slug=F.lit(series), predictor_name=F.col("model"), dataset_name=F.col("dataset"),
        tier_size=num("n_samples"), n_samples=num("n_samples"), model_kind=F.lit("hf_openrouter"), model_id=F.col("model"),
        batch_size=num("batch_size"), accuracy=num("accuracy"), f1_macro=num("macro_f1"), has_predictions=F.col("has_preds"),
        predictions_source=F.when(F.col("has_preds"), "legacy_long_csv").otherwise("none"), format=F.lit("hf_llms_metrics_csv"),
    )


def read_hypotheses(spark: SparkSession, root: str, series: str = "debug_accuracy") -> DataFrame:
    """S13, fifth layout: hypothesis lists; the last accuracy seen counts, up to hypothesis H4.

    The file stores an accuracy as macro F1, which ``f1_source`` says.
    """
    keys = ("full_accuracy", "report_accuracy", "accuracy_raw_string", "accuracy_canonical_names")
    hyp = "struct<id:string,details:struct<" + ",".join(f"{k}:double" for k in keys) + ",n:double>>"
    body = in_series(read_texts(spark, root, "results.json"), series).filter(F.regexp_like("dir", F.lit(f"^{STAMP}$")))
    live = in_series(list_files(spark, root, "live_*.csv"), series).groupBy("dir").agg(F.lit(True).alias("live"))
    listed = F.from_json(F.get_json_object("body", "$.hypotheses"), f"array<{hyp}>")
    start = F.struct(
        F.lit(None).cast("double").alias("acc"), F.lit(None).cast("double").alias("n"), F.lit(False).alias("stop")
    )

    def step(s: Column, h: Column) -> Column:
        last = F.coalesce(*[h["details"][k] for k in reversed(keys)], s["acc"])
        done = last.isNotNull() & F.startswith(h["id"], F.lit("H4"))
        return F.when(s["stop"], s).otherwise(
            F.struct(
                last.alias("acc"), F.coalesce(h["details"]["n"], s["n"]).alias("n"),
                F.coalesce(done, F.lit(False)).alias("stop"),
            )
        )

    rows = body.join(live, "dir", "left").withColumn("r", F.aggregate(F.coalesce(listed, F.array().cast(f"array<{hyp}>")), start, step))
    key = F.concat_ws("/", F.lit(series), "dir")
    return _legacy(
        rows,
        run_key=key, run_dir=key, series=F.lit(series), campaign=F.col("dir"), run_leaf=F.col("dir"),
        experiment_slug=F.lit(series), predictor_name=F.lit("debug_ablation"), dataset_name=F.lit("pubmed_20k_rct"),
        tier_size=F.coalesce("r.n", F.lit(200.0)), n_samples=F.col("r.n"), model_kind=F.lit("debug"), phase=F.lit("analysis"),
        accuracy=F.col("r.acc"), f1_macro=F.col("r.acc"), has_predictions=F.col("live").isNotNull(),
        saved_utc=_j("body", "created_at"), format=F.lit("debug_accuracy_results"), f1_source=F.lit("accuracy"),
    )


# Folder names of the flat layouts.
LEGACY = {
    "mvp4_results": read_result_list,
    "mvp_v1": lambda spark, root: read_summaries(spark, root, "mvp_v1"),
    "prosocial_v3": lambda spark, root: read_summaries(spark, root, "prosocial_v3"),
    "hf_llms_comparison": read_metrics_csv,
    "debug_accuracy": read_hypotheses,
}


def series_in(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Those of the first-level folder names below the results root that hold any result file."""
    files = list_files(spark, root, "*.json", "*.csv")
    top = files.select(F.substring_index("rel", "/", 1).alias("s")).filter(F.col("s").isin(names)).distinct()
    return sorted(r["s"] for r in top.collect())


def read_legacy_records(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all flat layouts that exist below the root."""
    present = series_in(spark, root, list(LEGACY))
    parts = [reader(spark, root) for name, reader in LEGACY.items() if name in present]
    if not parts:
        return run_row(spark.range(0), f1_source=F.lit("f1_macro"))
    return union_runs(*parts)


def leaderboard(spark: SparkSession, root: str) -> DataFrame:
    """Run folders, flat layouts and tier summaries merged and ordered."""
    parts = [read_run_records(spark, root), read_legacy_records(spark, root)]
    if series_in(spark, root, ["reasoning_spectrum"]):
        parts.append(read_tier_rows_summary(spark, root))
    rows = union_runs(*[p.withColumn("source_order", F.lit(i)) for i, p in enumerate(parts)])
    return ordered_board(rows).select(*[c for c, _ in RUN_COLUMNS], "f1_source")
