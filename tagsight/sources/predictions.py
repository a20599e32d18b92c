"""Prediction files, dialogues and their sinks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.lineage import collect_small
from ..schema import coalesce_columns
from .records import csv_records, json_records

ALIASES = {
    "sample_id": ["sample_id", "id", "source_index"],
    "true_label": ["true_label", "gold", "true"],
    "pred_label": ["pred_label", "pred"],
}
PRED_FIELDS = (
    "sample_id", "id", "source_index", "dataset_name", "text", "true_label", "gold", "true", "pred_label", "pred",
    "confidence", "reason", "in_tokens", "out_tokens", "is_confusing", "n_pred_labels", "probs", "meta_json", "correct",
)
DIALOGUE = (
    "context string, response string, safety_label string, safety_annotations array<string>, "
    "safety_annotation_reasons array<string>, dialogue_id bigint, response_id bigint, source string"
)


def with_source_index(scan: DataFrame, out: str = "source_index") -> DataFrame:
    """Number the rows of a file scan from 0, by file path and place in the file, however the scan was split.

    Only one count per split is aggregated; the scan itself is not shuffled.
    """
    tagged = scan.withColumns(
        {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
    )
    sizes = tagged.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1))
    offs = sizes.select("_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_off"))
    return (
        tagged.join(offs, ["_file", "_block"])
        .withColumn(out, (F.col("_off") + F.col("_at")).cast("bigint"))
        .drop("_file", "_block", "_at", "_off")
    )


def read_jsonl_dialogues(spark: SparkSession, path: str, *, all_features: bool = False) -> DataFrame:
    """JSON-lines dialogues with a source index, trimmed context and normalised labels."""
    df = with_source_index(spark.read.schema(DIALOGUE).json(path))
    trimmed = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast("array<string>"))
    out = df.withColumns(
        {
            "context": L.strip(F.coalesce("context", F.lit(""))),
            "safety_label": L.normalize_text_label(F.col("safety_label")),
            "safety_annotations": trimmed("safety_annotations", lambda x: F.replace(F.lower(L.strip(x)), F.lit(" "), F.lit("_"))),
            "safety_annotation_reasons": trimmed("safety_annotation_reasons", L.strip),
        }
    ).filter("context <> ''")
    first = ["source_index", "context", "response", "safety_label", "dialogue_id", "response_id", "source"]
    rest = ["safety_annotations", "safety_annotation_reasons"] if all_features else []
    return out.select(*first, *rest)


def harmonise(df: DataFrame) -> DataFrame:
    """Rename alias columns of a prediction table and make the id a string."""
    other = [c for c in df.columns if all(c not in names for names in ALIASES.values())]
    return df.select(
        *[coalesce_columns(df, names, out) for out, names in ALIASES.items()], *other
    )


def _csv_files(spark: SparkSession, paths: list[str]) -> list[Row]:
    """Header line of every file, and whether a record may go over several lines, in one job."""
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("f"), "value", F.monotonically_increasing_id().alias("i"),
        F.col("_metadata.file_block_start").alias("b"), (odd % 2 == 1).alias("odd"),
    )
    return collect_small(
        lines.groupBy("f").agg(
            F.min_by(F.when(F.col("b") == 0, F.col("value")), F.when(F.col("b") == 0, F.col("i"))).alias("header"),
            F.bool_or("odd").alias("spans"),
            F.min_by(F.when(F.col("b") == 0, F.col("odd")), F.when(F.col("b") == 0, F.col("i"))).alias("header_spans"),
        )
    )


def _split_csv(spark: SparkSession, paths: list[str], header: str) -> DataFrame:
    """CSV files with line breaks in quoted fields, still read by many tasks."""
    names = next(csv.reader([header]))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = csv_records(spark, paths).select(
        F.from_csv("text", schema, {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r"), run_dir_of(F.col("f")).alias("run_dir")
    )
    return rows.select("r.*", "run_dir")


def run_dir_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"/[^/]*$", "")


def read_predictions(
    spark: SparkSession, csv_paths: list[str] = (), json_paths: list[str] = ()
) -> DataFrame:
    """Prediction files of many runs as one long table with ``run_dir``.

    CSV files are scanned once per distinct header.  JSON files hold an array or ``{"predictions": [...]}``.
    A large file is read by many tasks, also where quoted fields hold line breaks and where a JSON list has no line
    breaks at all.  Only a CSV file whose header goes over several lines or repeats a name, and a JSON object that does
    not begin with ``predictions``, are read by one task each.
    """
    parts: list[DataFrame] = []
    if csv_paths:
        groups: dict[tuple[str, str], list[str]] = {}
        for r in _csv_files(spark, list(csv_paths)):
            names = next(csv.reader([r["header"]]), [])
            whole = r["header_spans"] or not names or "" in names or len({n.lower() for n in names}) < len(names)
            how = "lines" if not r["spans"] else "whole" if whole else "split"
            groups.setdefault((how, r["header"]), []).append(r["f"])
        for (how, header), paths in groups.items():
            if how == "split":
                parts.append(harmonise(_split_csv(spark, paths, header)))
            else:
                scan = spark.read.csv(paths, header=True, multiLine=how == "whole", quote='"', escape='"')
                parts.append(harmonise(scan.withColumn("run_dir", run_dir_of(F.col("_metadata.file_path")))))
    if json_paths:
        row = "struct<" + ",".join(f"{c}:string" for c in PRED_FIELDS) + ">"
        listed, others = json_records(spark, list(json_paths))
        listed = listed.select(run_dir_of(F.col("f")).alias("run_dir"), F.from_json("text", row).alias("r"))
        parts.append(harmonise(listed.select("run_dir", "r.*")))
        if others:
            body = spark.read.text(others, wholetext=True).select("value", run_dir_of(F.col("_metadata.file_path")).alias("run_dir"))
            rows = F.from_json("value", f"struct<predictions:array<{row}>>")["predictions"]
            parts.append(harmonise(body.select("run_dir", F.inline(rows))))
    if not parts:
        raise ValueError("no prediction files")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_predictions_legacy(
    spark: SparkSession, path: str, *, dataset: str | None = None, model: str | None = None
) -> DataFrame:
    """A flat CSV shared by many models; row position as id when the file has none."""
    scan = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if not set(ALIASES["sample_id"]) & set(scan.columns):
        scan = with_source_index(scan)
    if model is not None and "model" in scan.columns:
        scan = scan.filter(F.col("model") == model)
    out = harmonise(scan)
    if dataset is not None and "dataset_name" not in out.columns:
        out = out.withColumn("dataset_name", F.lit(dataset))
    return out


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions as parquet, CSV and JSON lines."""
    flat = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    nested = [F.to_json(c).alias(c) for c, t in df.dtypes if c not in flat]
    df.write.mode("overwrite").parquet(f"{path}/predictions.parquet")
    stored = df.sparkSession.read.parquet(f"{path}/predictions.parquet")
    stored.select(*flat, *nested).write.mode("overwrite").csv(
        f"{path}/predictions.csv", header=True, quote='"', escape='"'
    )
    stored.write.mode("overwrite").json(f"{path}/full_predictions.json")


def write_report(reports: DataFrame, path: str) -> None:
    """Nested reports of many runs, one JSON folder per run."""
    reports.write.mode("overwrite").partitionBy("run_id").json(path)


def write_analysis_bundle(
    path: str, *, table: DataFrame, reports: DataFrame, comparison: DataFrame | None = None,
    disagreements: DataFrame | None = None, agreement: DataFrame | None = None,
) -> list[str]:
    """The tables of an analysis as CSV with a manifest of their row counts."""
    spark = table.sparkSession
    given = {
        "loaded_table": table, "aggregated_reports": reports, "comparison": comparison,
        "disagreements": disagreements, "agreement_matrix": agreement,
    }
    names = [k for k, v in given.items() if v is not None]
    for name in names:
        given[name].write.mode("overwrite").csv(f"{path}/{name}.csv", header=True, quote='"', escape='"')
    counts = None
    for name in names:
        row = spark.read.csv(f"{path}/{name}.csv", header=True, multiLine=True, quote='"', escape='"').agg(
            F.count(F.lit(1)).alias("n_rows")
        ).select(F.lit(name).alias("file"), "n_rows")
        counts = row if counts is None else counts.unionByName(row)
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")
    return names


def write_long_wide_metrics(path: str, *, long: DataFrame, wide: DataFrame, metrics: DataFrame) -> None:
    """Long rows as CSV and JSON lines, the wide table, metrics, failed rows and a summary."""
    csv = {"header": True, "quote": '"', "escape": '"'}
    long.write.mode("overwrite").csv(f"{path}/predictions_long.csv", **csv)
    long.write.mode("overwrite").json(f"{path}/predictions_long.jsonl")
    wide.write.mode("overwrite").csv(f"{path}/predictions_wide.csv", **csv)
    metrics.write.mode("overwrite").csv(f"{path}/metrics.csv", **csv)
    long.filter("pred_label IS NULL").write.mode("overwrite").csv(f"{path}/errors.csv", **csv)
    long.groupBy("dataset_name", "model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("pred_label").isNull()).alias("n_failed")
    ).coalesce(1).write.mode("overwrite").json(f"{path}/summary.json")
