"""Exact duplicates: local winners, then salted groups, then one global group per content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable

from .drops import mark, without

#: The white space that equality ignores, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
_ID = "CAST(1e19 AS DECIMAL(38,0))"
_UNIT = "CAST(1e20 AS DECIMAL(38,0))"


def normalised(text: Column) -> Column:
    """The text without white space; NULL counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """Every row with the row that stays of its group: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are the same without white space. The longest original text (code points)
    stays, then the smallest id; a NULL id loses against every other.

    Each stage groups by digest and content, so two texts that share a digest never merge: the map side keeps one
    winner per task, the salted groups one per salt, the last stage one per content. A group that holds a third of
    all rows arrives as one row per task and salt. The rows then meet their winner by digest alone, except where a
    digest has several contents; those meet it by content too.

    NULL texts are empty texts and equal to texts of blanks only; very long texts are taken whole. Rows that repeat an
    id and a text share one result. Columns beside id and text are not read, an empty table gives an empty result.
    """
    found = _with_winners(docs, id_col, text_col, salts, digest)
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _with_winners(docs: DataFrame, id_col: str, text_col: str, salts: int = 16, digest=sha256, *more: Column) -> DataFrame:
    """Every row (id, `more`) with keep_id, group_size and text_sha256."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    base = base.select("id", F.length("raw").alias("points"), normalised(F.col("raw")).alias("content"), *more)
    base = base.withColumn("digest", digest(F.col("content")))
    # one number that orders by length, then by falling id: a fixed-width buffer keeps the hash aggregate
    rank = F.expr(f"CAST(points AS DECIMAL(38,0)) * {_UNIT} + COALESCE({_ID} - CAST(id AS DECIMAL(38,0)), 0)").cast("decimal(38,0)")
    local = base.select(
        "digest", "content", rank.alias("rank"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")
    )
    salted = local.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    merged = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
    place = F.expr(f"rank % {_UNIT}")
    merged = merged.select(
        "digest", "content", F.when(place > 0, F.expr(f"CAST({_ID} - rank % {_UNIT} AS BIGINT)")).alias("keep_id"), F.col("n").alias("group_size")
    )
    winners = durable(merged.drop("content"))
    kept = [c for c in base.columns if c not in ("content", "digest")]
    rows = base.select(*kept, "digest", F.sha2("content", 256).alias("text_sha256"))
    shared = winners.groupBy("digest").count().where("count > 1").select("digest")
    if shared.isEmpty():
        return rows.join(winners, "digest")
    shared = durable(shared)
    by_content = base.join(shared, "digest", "left_semi").join(merged, ["digest", "content"])
    return rows.join(shared, "digest", "left_anti").join(winners, "digest").unionByName(
        by_content.select("digest", *kept, F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns.

    Rows are told apart by id and text, so an id that stands for several texts loses none that has no copy, and rows
    without an id are treated as others. Of rows of one id the longest text stays, then the smallest hash; of rows that
    are alike in both, one. NULL and empty texts are one group. An empty table stays empty.
    """
    groups = durable(_with_winners(docs, id_col, text_col, 16, sha256, mark("raw").alias("mark")).select("id", "mark", "points", "keep_id", "text_sha256"))
    wins = groups.where(F.col("id").eqNullSafe(F.col("keep_id")))
    gone = groups.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "mark")
    several = durable(wins.groupBy("text_sha256").agg(F.count("*").alias("n"), F.max(F.struct("points", "mark")).alias("first")).where("n > 1"))
    key = [F.col(id_col).cast("long"), mark(text_col)]
    if several.isEmpty():
        return without(docs, gone, key)
    behind = wins.join(several, "text_sha256").where("mark != first.mark").select("id", "mark")
    left = without(docs, gone.unionByName(behind), key)
    twice = wins.join(several, "text_sha256").where("mark = first.mark").groupBy("id", "mark").count().where("count > 1").select("id", "mark")
    alike = left.withColumn("dropped mark", mark(text_col))
    pair = durable(twice.toDF("twice id", "twice mark"))
    same = alike[id_col].cast("long").eqNullSafe(pair["twice id"]) & (alike["dropped mark"] == pair["twice mark"])
    one = alike.join(pair, same, "left_semi").dropDuplicates([id_col, "dropped mark"])
    return alike.join(pair, same, "left_anti").unionByName(one).drop("dropped mark")
