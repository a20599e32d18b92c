"""Dataset tiers, artifacts, manifests and cards on disk.

``{root}/{dataset}/{split}/{artifact}/samples.parquet`` with ``manifest.json`` next
to it; a tier of n rows is the artifact ``tier_{n}``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators.metrics import top_labels
from ..operators.sampling import build_seed_vault, test_pool
from ..schema import CARD, assert_unique, to_processed, validate_samples


def artifact_dir(root: str, dataset: str, split: str, artifact: str) -> str:
    return f"{root.rstrip('/')}/{dataset}/{split}/{artifact}"


def read_artifact(spark: SparkSession, root: str, dataset: str, split: str, artifact: str) -> DataFrame:
    """Samples of an artifact; fails when it is missing or lacks a required column."""
    path = f"{artifact_dir(root, dataset, split, artifact)}/samples.parquet"
    try:
        df = spark.read.parquet(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"no samples at {path}") from exc
    return validate_samples(df)


def read_tier(spark: SparkSession, root: str, dataset: str, split: str, tier: int) -> DataFrame:
    """Samples of a tier."""
    return read_artifact(spark, root, dataset, split, f"tier_{int(tier)}")


def id_digest(df: DataFrame, *, key: str = "sample_id") -> DataFrame:
    """sha256 over the table's ids, as one row (digest, n_rows), independent of the order of rows.

    Ids fall into buckets by the first four digits of their md5; a bucket's digest covers its ids, one per line in
    order, and the digest covers those of the buckets in order.  It means the same at every size, and no task lists
    more than one of 65,536 parts of the ids.
    """
    per = df.groupBy(F.substring(F.md5(F.col(key).cast("string")), 1, 4).alias("b")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n"), 256).alias("d"),
        F.count(F.lit(1)).alias("n"),
    )
    buckets = F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda s: s["d"])
    return per.agg(F.sha2(F.array_join(buckets, "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def manifest(
    df: DataFrame, *, dataset: str, split: str, artifact: str, seed: int, builder: str,
    origin: dict[str, str], requested: int | None = None, extra: dict[str, str] | None = None,
) -> DataFrame:
    """The one-row manifest of an artifact."""
    return id_digest(df).select(
        F.lit(dataset).alias("dataset_name"),
        F.lit(split).alias("split_name"),
        F.lit(artifact).alias("artifact"),
        F.lit(requested).cast("bigint").alias("tier_size_requested"),
        F.col("n_rows").alias("tier_size_actual"),
        F.lit(int(seed)).cast("bigint").alias("seed"),
        F.lit(builder).alias("builder"),
        L.literal_map({k: str(v) for k, v in (origin or {"kind": "table"}).items()}).alias("origin"),
        F.col("digest").alias("sample_id_sha256"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        *[F.lit(str(v)).alias(k) for k, v in (extra or {}).items()],
    )


def write_artifact(
    df: DataFrame, root: str, *, dataset: str, split: str, artifact: str, seed: int, builder: str,
    origin: dict[str, str], requested: int | None = None, extra: dict[str, str] | None = None,
) -> str:
    """S3: check, write parquet, then describe what was written in the manifest."""
    assert_unique(validate_samples(df))
    out = artifact_dir(root, dataset, split, artifact)
    df.write.mode("overwrite").parquet(f"{out}/samples.parquet")
    stored = df.sparkSession.read.parquet(f"{out}/samples.parquet")
    row = manifest(
        stored, dataset=dataset, split=split, artifact=artifact, seed=seed, builder=builder, origin=origin,
        requested=requested, extra=extra,
    )
    row.coalesce(1).write.mode("overwrite").json(f"{out}/manifest.json")
    return out


def write_tier(df: DataFrame, root: str, *, dataset: str, split: str, tier: int, **kw) -> str:
    """S3 for tiers."""
    return write_artifact(df, root, dataset=dataset, split=split, artifact=f"tier_{int(tier)}", requested=int(tier), **kw)


def read_manifest(spark: SparkSession, root: str, dataset: str, split: str, artifact: str) -> DataFrame:
    """S5."""
    try:
        return spark.read.option("multiLine", True).json(f"{artifact_dir(root, dataset, split, artifact)}/manifest.json")
    except AnalysisException as exc:
        raise FileNotFoundError(f"no manifest for {dataset}/{split}/{artifact}") from exc


def make_card(df: DataFrame, *, dataset: str, description: str, origin: dict[str, str]) -> DataFrame:
    """Dataset card: sorted labels and row count."""
    per = validate_samples(df).groupBy("true_label").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.lit(dataset).alias("dataset_name"),
        F.lit(description).alias("description"),
        L.literal_map({k: str(v) for k, v in origin.items()}).alias("origin"),
        F.array_sort(F.collect_set("true_label")).alias("labels"),
        F.sum("n").alias("sample_count"),
    )


def write_card(card: DataFrame, root: str, dataset: str) -> str:
    """S5."""
    path = f"{root.rstrip('/')}/{dataset}/dataset_card.json"
    card.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_card(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """S5."""
    path = f"{root.rstrip('/')}/{dataset}/dataset_card.json"
    try:
        return spark.read.schema(CARD).option("multiLine", True).json(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"no card at {path}") from exc


def build_dataset(
    train: DataFrame, test: DataFrame, root: str, *, dataset: str, text_col: str, label_col: str, row_col: str,
    seed: int, train_tiers: list[int], test_tiers: list[int], origin: dict[str, str], description: str = "",
    top_k: int | None = None, test_frac: float = 1.0, prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, str]:
    """normalise both splits, keep the top labels, write card, tiers, remaining pool and manifests."""
    def processed(df: DataFrame, split: str) -> DataFrame:
        df = prepare(df) if prepare else df
        return to_processed(
            df, dataset_name=dataset, split=F.lit(split), row=F.col(row_col), text_col=text_col,
            label_col=label_col, source_id=origin.get("id", dataset),
        )

    tr, te = processed(train, "train"), processed(test, "test")
    if top_k is not None:
        keep = top_labels(tr, top_k).select(F.col("label").alias("true_label"))
        tr, te = (x.join(keep, "true_label", "left_semi") for x in (tr, te))
    card = make_card(tr.unionByName(te), dataset=dataset, description=description, origin=origin)
    write_card(card, root, dataset)
    pool = test_pool(te, test_frac, seed=seed)
    tiers, tests, status = build_seed_vault(tr, pool, seed=seed, train_tiers=train_tiers, test_tiers=test_tiers)
    kw = {"dataset": dataset, "seed": seed, "builder": "build_dataset", "origin": origin}
    for n in sorted(set(train_tiers)):
        part = tiers.filter(F.col("tier") == n).drop("tier")
        write_tier(part, root, split="train_seed", tier=n, extra={"status": status[f"train_seed_{n}"]}, **kw)
    write_artifact(tiers.filter("tier IS NULL").drop("tier"), root, split="train_pool_remaining", artifact="full", **kw)
    for n in test_tiers:
        part = tests.filter(F.col("tier") == n).drop("tier")
        write_tier(part, root, split="test", tier=n, extra={"status": status[f"test_{n}"]}, **kw)
    return status
