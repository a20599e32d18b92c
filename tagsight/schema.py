"""Table layouts and the checks made before a table is used or written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED_COLUMNS = ("sample_id", "dataset_name", "text", "true_label")
OPTIONAL_COLUMNS = ("meta_json",)

SAMPLES = T.StructType(
    [T.StructField(name, T.StringType()) for name in REQUIRED_COLUMNS + OPTIONAL_COLUMNS]
)

CARD = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("origin", T.MapType(T.StringType(), T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("sample_count", T.LongType()),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("pred_label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("probs", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "usage",
            T.StructType(
                [T.StructField("in_tokens", T.LongType()), T.StructField("out_tokens", T.LongType())]
            ),
        ),
        T.StructField("raw", T.StringType()),
    ]
)

RUN_COLUMNS = (
    ("run_key", "string"),
    ("series", "string"),
    ("campaign", "string"),
    ("suite", "string"),
    ("run_leaf", "string"),
    ("experiment_slug", "string"),
    ("predictor_name", "string"),
    ("dataset_name", "string"),
    ("tier_size", "bigint"),
    ("n_samples", "bigint"),
    ("model_kind", "string"),
    ("model_id", "string"),
    ("thinking_level", "string"),
    ("batch_size", "bigint"),
    ("phase", "string"),
    ("accuracy", "double"),
    ("f1_macro", "double"),
    ("duration_seconds", "double"),
    ("infer_time_s", "double"),
    ("has_predictions", "boolean"),
    ("predictions_source", "string"),
    ("saved_utc", "string"),
    ("run_dir", "string"),
    ("format", "string"),
)


def run_row(df: DataFrame, **values: Column) -> DataFrame:
    """Project ``df`` to the 24-column run row; columns not given are NULL."""
    return df.select(
        *[
            values.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in RUN_COLUMNS
        ],
        *[col.alias(name) for name, col in values.items() if name not in dict(RUN_COLUMNS)],
    )


def validate_samples(df: DataFrame) -> DataFrame:
    """Fail when a required sample column is absent (schema only, no job)."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Raise when ``key`` repeats.  The count is combined map-side, one row is fetched."""
    bad = duplicate_keys(df, key).limit(1).collect()
    if bad:
        raise ValueError(f"duplicate {key}: {bad[0][0]!r} occurs {bad[0][1]} times")
    return df


def ensure_string_labels(df: DataFrame, label: str = "true_label") -> DataFrame:
    return df.withColumn(label, F.col(label).cast("string"))


def to_processed(
    df: DataFrame,
    *,
    dataset_name: str,
    split: Column,
    row: Column,
    text_col: str,
    label_col: str,
    source_id: str,
    config: str | None = None,
) -> DataFrame:
    """Any labelled source to the sample layout; id is ``{split}_{row}``, lineage kept as JSON."""
    return df.select(
        F.concat_ws("_", split, row.cast("string")).alias("sample_id"),
        F.lit(dataset_name).alias("dataset_name"),
        F.col(text_col).cast("string").alias("text"),
        F.col(label_col).cast("string").alias("true_label"),
        F.to_json(
            F.struct(
                F.lit(source_id).alias("source"),
                F.lit(config).cast("string").alias("config"),
                split.alias("orig_split"),
                row.cast("bigint").alias("orig_row"),
                F.lit(label_col).alias("label_col"),
            )
        ).alias("meta_json"),
    )


def pick_column(df: DataFrame, candidates: list[str]) -> str:
    """First candidate present in the table; falls back to the first string column."""
    for name in candidates:
        if name in df.columns:
            return name
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        raise ValueError(f"no column for {candidates} in {df.columns}")
    return strings[0]


def coalesce_columns(df: DataFrame, candidates: list[str], alias: str) -> Column:
    """P4 for mixed tables: first non-NULL value among the candidates that exist."""
    present = [F.col(c).cast("string") for c in candidates if c in df.columns]
    return (F.coalesce(*present) if present else F.lit(None).cast("string")).alias(alias)


def stable_sort(df: DataFrame, *extra: str, key: str = "sample_id") -> DataFrame:
    """Deterministic output order."""
    return df.orderBy(*extra, key)
