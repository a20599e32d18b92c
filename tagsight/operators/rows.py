"""Row filters and projections that need more than one expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..functions import text as X
from ..functions.labels import literal_map, strip


def map_label_ids(df: DataFrame, names: list[str], *, col: str = "label_id", out: str = "true_label") -> DataFrame:
    """P5: integer label to its name; ids outside the list keep their text."""
    table = literal_map({i: n for i, n in enumerate(names)})
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(col).cast("int")), F.col(col).cast("string")))


def binarize_label(df: DataFrame, *, col: str, positive: str, negative: str, threshold: float = 0.5, out: str = "true_label") -> DataFrame:
    """P6."""
    return df.withColumn(out, F.when(F.col(col) >= threshold, positive).otherwise(negative))


def canonical_label(df: DataFrame, aliases: DataFrame, *, dataset_col: str = "dataset_name", label_col: str = "true_label", out: str = "canonical") -> DataFrame:
    """P8 with an alias table ``(dataset_name, raw, canonical)``; other labels are lower-cased and trimmed.

    The table is small; Spark broadcasts it when its size allows.
    """
    low = F.lower(strip(F.col(label_col)))
    table = aliases.select(
        F.col("dataset_name").alias("_d"), F.lower(strip(F.col("raw"))).alias("_raw"), F.col("canonical").alias("_canon")
    )
    return (
        df.withColumn("_low", low)
        .join(table, (F.col(dataset_col) == F.col("_d")) & (F.col("_low") == F.col("_raw")), "left")
        .withColumn(out, F.coalesce("_canon", "_low"))
        .drop("_low", "_d", "_raw", "_canon")
    )


def collapse_labels(df: DataFrame, mapping: dict[str, str] = L.SAFETY_TO_THREE, *, cols: tuple[str, ...] = ("true_label", "pred_label")) -> DataFrame:
    """Merge label levels; labels outside the mapping stay."""
    table = literal_map(mapping)
    norm = lambda c: L.normalize_text_label(F.col(c))
    return df.withColumns({c: F.coalesce(F.try_element_at(table, norm(c)), norm(c)) for c in cols})


def filter_labels(df: DataFrame, keep: list[str], *, label: str = "true_label") -> DataFrame:
    """P20."""
    return df.filter(F.col(label).isin(list(keep)))


def filter_clean_text(df: DataFrame, *, text: str = "text", min_len: int = 15, max_noise: float = 0.5) -> DataFrame:
    """P21."""
    return df.filter(X.is_clean(F.col(text), min_len=min_len, max_noise=max_noise))


def drop_blank(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Trimmed text, blank rows out."""
    return df.withColumn(text, strip(F.col(text))).filter(F.length(text) > 0)


def filter_mean_std_length(df: DataFrame, cols: list[str], n: float = 1.0) -> DataFrame:
    """Rows whose text length lies within ``n`` population deviations of the mean in every column.

    In an array column every item counts, and an empty array fails.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = df
    for c in cols:
        if isinstance(kinds[c], T.ArrayType):
            items = df.select(F.explode(c).alias("t")).select(F.length(strip(F.col("t"))).alias("k")).filter("k > 0")
        else:
            items = df.select(F.length(strip(F.coalesce(F.col(c), F.lit("")))).alias("k"))
        span = items.agg(F.struct(F.avg("k").alias("m"), F.stddev_pop("k").alias("s"))).scalar()
        lo, hi = span["m"] - n * span["s"], span["m"] + n * span["s"]
        out = out.withColumns({"_lo": lo, "_hi": hi})
        if isinstance(kinds[c], T.ArrayType):
            size = F.transform(c, lambda t: F.length(strip(t)))
            ok = (F.size(c) > 0) & F.forall(size, lambda k: (k >= F.col("_lo")) & (k <= F.col("_hi")))
        else:
            size = F.length(strip(F.coalesce(F.col(c), F.lit(""))))
            ok = (size >= F.col("_lo")) & (size <= F.col("_hi"))
        # no items at all leaves the column unfiltered
        out = out.filter(F.coalesce(ok, F.col("_lo").isNull())).drop("_lo", "_hi")
    return out


def parse_sample_id(df: DataFrame, *, col: str = "sample_id") -> DataFrame:
    """``split_idx`` to split and index."""
    return df.withColumns(
        {
            "split": F.nullif(F.regexp_extract(col, r"^(.+)_(\d+)$", 1), F.lit("")),
            "idx": F.regexp_extract(col, r"^(.+)_(\d+)$", 2).try_cast("bigint"),
        }
    )


def lookup_by_ids(df: DataFrame, ids: DataFrame, *, key: str = "sample_id") -> DataFrame:
    """One row per wanted id with ``found``; ids that do not parse or are out of range are not found."""
    parsed = parse_sample_id(ids.select(key), col=key)
    hits = df.withColumn("_f", F.lit(True))
    return parsed.join(hits, key, "left").withColumn(
        "found", F.coalesce("_f", F.lit(False)) & F.col("idx").isNotNull()
    ).drop("_f")
