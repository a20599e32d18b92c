"""Rows without those that a stage drops, and numbers for rows whose ids are missing or repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable

#: keys (some 16 bytes each) that are sent to every task; more meet the rows in a shuffle join
SENT_IDS = 4_000_000


def mark(text_col: str = "text") -> Column:
    """Tells rows of one id apart by their texts; NULL counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, keys: list[Column], sent_ids: int = SENT_IDS) -> DataFrame:
    """The rows of docs whose keys are not in `gone` (one column for each key), with all their columns. NULLs are equal.

    The keys that go are counted: up to `sent_ids` go to every task, so that no text moves; beyond that both sides are
    shuffled. The rows are the same.
    """
    names = [f"dropped {n}" for n in range(len(keys))]
    gone = durable(gone.toDF(*names).distinct())
    side = F.broadcast(gone) if gone.count() <= sent_ids else gone
    return docs.join(side, reduce(Column.__and__, [k.eqNullSafe(gone[n]) for k, n in zip(keys, names, strict=True)]), "left_anti")


def row_numbers(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(docs, None) where every row has an id of its own; else rows (id, text) under numbers, and the ids behind them.

    Numbers rise with the id, then with the hash of the text; NULL ids are behind all others. Rows that repeat an id and
    a text share a number.
    """
    odd = docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull())
    if odd.isEmpty():
        return docs, None
    keyed = docs.select(F.col(id_col).alias("id"), mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    kinds = keyed.select("id", "mark").distinct().repartitionByRange(F.col("id").asc_nulls_last(), "mark")
    kinds = durable(kinds.sortWithinPartitions(F.col("id").asc_nulls_last(), "mark").withColumn("number", F.monotonically_increasing_id()))
    rows = keyed.join(kinds, keyed["id"].eqNullSafe(kinds["id"]) & (keyed["mark"] == kinds["mark"]))
    return rows.select(F.col("number").alias(id_col), F.col("text").alias(text_col)), kinds.select("number", F.col("id").alias("named"))


def renamed(found: DataFrame, kinds: DataFrame | None, id_col: str) -> DataFrame:
    """Rows of `row_numbers` under their ids again."""
    if kinds is None:
        return found
    kinds = kinds.withColumnRenamed("number", id_col)
    return found.join(kinds, id_col).select(*[F.col("named").alias(c) if c == id_col else c for c in found.columns])
