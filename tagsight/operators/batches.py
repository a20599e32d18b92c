"""Batches of items for model calls, and what comes back per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.lineage import small_table
from ..plans.order import md5_rank
from .sampling import label_sizes


def fixed_batches(df: DataFrame, size: int, *, seed: int, id_col: str = "sample_id") -> DataFrame:
    """consecutive chunks of the md5 order; ``position`` starts at 0, the last batch may be short."""
    idx = F.col("_r") - 1
    return (
        md5_rank(df, by=[], seed=seed, id_col=id_col, out="_r")
        .withColumn("batch_id", F.floor(idx / size).cast("bigint"))
        .withColumn("position", (idx % size).cast("int"))
        .drop("_r")
    )


def batch_shape(left: dict[str, int], size: int) -> dict[str, int]:
    """Rows of each label in the next batch: one per label and turn, labels in order."""
    take = dict.fromkeys(left, 0)
    room = min(size, sum(left.values()))
    while room:
        live = [k for k in left if take[k] < left[k]]
        turns = min(room // len(live), min(left[k] - take[k] for k in live))
        for k in live if turns else live[:room]:
            take[k] += max(turns, 1)
            room -= max(turns, 1)
    return {k: n for k, n in take.items() if n}


def batch_spans(
    sizes: dict[str, int], size: int, drop_incomplete: bool
) -> dict[str, list[tuple[int, int, int, int]]]:
    """Per label ``(first rank, last rank, rows per batch, first batch)``.

    Batches keep one shape until a label runs out, so there are about as many
    spans as labels, whatever the number of rows.
    """
    left, done, batch = dict(sizes), dict.fromkeys(sizes, 0), 0
    out: dict[str, list] = {k: [] for k in sizes}
    while any(left.values()):
        shape = batch_shape({k: v for k, v in left.items() if v}, size)
        if sum(shape.values()) < size and drop_incomplete:
            break
        repeat = min(left[k] // n for k, n in shape.items())
        for k, n in shape.items():
            out[k].append((done[k], done[k] + n * repeat, n, batch))
            done[k] += n * repeat
            left[k] -= n * repeat
        batch += repeat
    return out


def label_balanced_batches(
    df: DataFrame, size: int, *, seed: int, drop_incomplete: bool = True, label: str = "true_label",
    id_col: str = "sample_id",
) -> DataFrame:
    """batches that cycle through the labels; batch numbers are shuffled.

    The shape of every batch follows from the label counts, so a row finds its
    batch from its rank inside the label and the label's few spans.
    """
    sizes = dict(sorted(label_sizes(df, label).items()))
    plan = batch_spans(sizes, size, drop_incomplete)
    n_batches = max((b + (hi - lo) // w for spans in plan.values() for lo, hi, w, b in spans), default=0)
    table = small_table(
        df.sparkSession, list(plan.items()),
        f"`{label}` string, spans array<struct<lo:bigint,hi:bigint,width:bigint,batch:bigint>>",
    )
    ranked = md5_rank(df, by=[label], seed=seed, id_col=id_col, out="_r").join(table, label)
    mine = F.try_element_at(
        F.filter("spans", lambda s: (F.col("_r") > s["lo"]) & (F.col("_r") <= s["hi"])), F.lit(1)
    )
    placed = ranked.withColumn("_s", mine).filter("_s IS NOT NULL").withColumn(
        "_slot", F.col("_r") - 1 - F.col("_s.lo")
    )
    named = placed.select(
        *df.columns,
        (F.col("_s.batch") + F.floor(F.col("_slot") / F.col("_s.width"))).cast("bigint").alias("raw_batch"),
        (F.col("_slot") % F.col("_s.width")).alias("_turn"),
    )
    numbers = df.sparkSession.range(n_batches).withColumnRenamed("id", "raw_batch")
    renumber = md5_rank(numbers, by=[], seed=seed, id_col="raw_batch", out="_b").select(
        "raw_batch", (F.col("_b") - 1).alias("batch_id")
    )
    place = W.partitionBy("batch_id").orderBy("_turn", label)
    return (
        named.join(renumber, "raw_batch")
        .withColumn("position", (F.row_number().over(place) - 1).cast("int"))
        .drop("_turn", "raw_batch")
    )


def batch_manifest(
    batches: DataFrame, *, split: str, label: str = "true_label", dataset: str | None = None
) -> DataFrame:
    """one row per batch with numbered text, target labels, ids and sentences.

    A batch has a fixed number of rows, so its lists are bounded.
    """
    gold = L.canonical(F.col(label), dataset)
    rows = batches.groupBy("batch_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (F.col("position") + 1).alias("position"), "sample_id", "text", gold.alias("gold")
                )
            )
        ).alias("sentences")
    )
    s = F.col("sentences")
    line = lambda x: F.concat(x["position"].cast("string"), F.lit(". "), x["text"])
    return rows.select(
        F.lit(split).alias("split"),
        "batch_id",
        F.array_join(F.transform(s, line), "\n").alias("input_texts_numbered"),
        F.transform(s, lambda x: x["gold"]).alias("target_labels"),
        F.transform(s, lambda x: x["sample_id"]).alias("sample_ids"),
        "sentences",
    )


def flatten_batches(df: DataFrame, *, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Aligned per-batch arrays to one row per item; unequal lengths stop the job."""
    keep = [c for c in df.columns if c not in (gold, pred)]
    checked = F.when(
        F.size(gold) == F.size(pred), F.arrays_zip(F.col(gold).alias("gold"), F.col(pred).alias("pred"))
    ).otherwise(F.raise_error(F.lit("gold and predicted arrays differ in length")))
    return df.select(*keep, F.posexplode(checked).alias("position", "_z")).select(
        *keep, "position", F.col("_z.gold").alias("true_label"), F.col("_z.pred").alias("pred_label")
    )


def batch_log(preds: DataFrame) -> DataFrame:
    """Per batch the ids, labels, accuracy, tokens and the longest call."""
    ok = F.coalesce("correct", F.lit(False))
    rows = preds.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "sample_id", "true_label", "pred_label"))).alias("r"),
        F.count(F.lit(1)).alias("batch_size"),
        F.count_if(ok).alias("correct_count"),
        F.avg(ok.cast("double")).alias("batch_accuracy"),
        F.sum(F.coalesce("in_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("out_tokens", F.lit(0))).alias("output_tokens"),
        F.max("elapsed_s").alias("elapsed_s"),
    )
    return rows.select(
        "batch_id",
        "batch_size",
        F.transform("r", lambda x: x["sample_id"]).alias("sample_ids"),
        F.transform("r", lambda x: x["true_label"]).alias("gold_labels"),
        F.transform("r", lambda x: F.coalesce(x["pred_label"], F.lit(""))).alias("pred_labels"),
        "correct_count",
        "batch_accuracy",
        "prompt_tokens",
        "output_tokens",
        "elapsed_s",
    )
