"""Agreement between any number of runs in one job.

The runs of a sample become fixed-position arrays of at most ``RUN_BLOCK`` runs (mergeable
aggregates).  Every pair of such blocks is taken once a sample, each position of the
first is exploded, and per ``(run, label)`` one counter is kept for every run of the
second: the code has one size whatever the number of runs, no pairs of rows are ever
emitted, and only counters are shuffled after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S
from ..plans.lineage import MAX_DRIVER_ROWS, durable, small_table

#: runs whose counters are kept side by side
RUN_BLOCK = 16


def run_positions(preds: DataFrame, by: list[str], runs: DataFrame | None = None) -> DataFrame:
    """Dense position of every run inside its group, by run id."""
    src = runs if runs is not None else preds
    ids = src.select(*by, "run_id").distinct()
    win = W.partitionBy(*by)
    return ids.withColumn("pos", F.row_number().over(win.orderBy("run_id")) - 1).withColumn(
        "n_runs", F.count(F.lit(1)).over(win)
    )


def pair_counts(
    preds: DataFrame,
    *,
    by: list[str] | None = None,
    runs: DataFrame | None = None,
    dataset: Column | str | None = None,
    common: str = "all",
) -> DataFrame:
    """Counters for every ordered pair of runs and every label of the first run.

    Columns: ``by, run_a, run_b, label, both, agree, both_ok, a_only, b_only, both_wrong``.
    ``common='all'`` uses samples predicted by all runs of the group, ``'pair'``
    those predicted by the two runs.
    """
    by = list(by or [])
    found = run_positions(preds, by, runs)
    head = found.limit(MAX_DRIVER_ROWS + 1).collect()
    if not head:
        raise ValueError("no runs")
    if len(head) <= MAX_DRIVER_ROWS:
        pos, most = small_table(preds.sparkSession, head, found.schema), max(r["n_runs"] for r in head)
    else:
        pos = durable(found)
        most = pos.agg(F.max("n_runs")).scalar()
    width = min(most, RUN_BLOCK)
    lab = L.canonical_pred(F.col("pred_label"), dataset)
    ok = L.canonical(F.col("true_label"), dataset) == lab
    src = preds.join(pos, [*by, "run_id"]).select(
        *by, "sample_id", (F.col("pos") % width).alias("slot"), F.floor(F.col("pos") / width).cast("int").alias("block"),
        "n_runs", lab.alias("label"), F.coalesce(ok, F.lit(False)).alias("ok"),
    )
    item = [*by, "sample_id", "n_runs"]
    arrays = [
        F.array(*[F.max(F.when(F.col("slot") == i, F.col(c))) for i in range(width)]).alias(out)
        for c, out in (("label", "p"), ("ok", "ok"))
    ]

    def filled(p: Column) -> Column:
        return F.size(F.filter(p, lambda x: x.isNotNull()))

    if most <= width:
        wide = src.groupBy(*item).agg(*arrays)
        if common == "all":
            wide = wide.filter(filled(F.col("p")) == F.col("n_runs"))
        each = wide.select(
            *by, F.lit(0).alias("block"), F.lit(0).alias("block_b"), "ok", F.col("p").alias("p_b"), F.col("ok").alias("ok_b"),
            F.posexplode("p").alias("slot", "label"),
        )
    else:
        blocks = src.groupBy(*item, "block").agg(*arrays)
        wide = blocks.groupBy(*item).agg(F.collect_list(F.struct("block", "p", "ok")).alias("blocks"))
        if common == "all":
            known = F.aggregate("blocks", F.lit(0), lambda n, b: n + filled(b["p"]))
            wide = wide.filter(known == F.col("n_runs"))
        pairs = wide.select(*by, "blocks", F.explode("blocks").alias("a")).select(*by, "a", F.explode("blocks").alias("b"))
        each = pairs.select(
            *by, "a.block", F.col("b.block").alias("block_b"), "a.ok", F.col("b.p").alias("p_b"), F.col("b.ok").alias("ok_b"),
            F.posexplode("a.p").alias("slot", "label"),
        )
    each = each.filter("label IS NOT NULL")
    mine = F.col("ok")[F.col("slot")]
    cells = []
    for j in range(width):
        there = F.col("p_b")[j].isNotNull()
        other = F.col("ok_b")[j]
        cells.append(
            F.struct(
                F.count_if(there).alias("both"),
                F.count_if(F.col("p_b")[j] == F.col("label")).alias("agree"),
                F.count_if(there & mine & other).alias("both_ok"),
                F.count_if(there & mine & ~other).alias("a_only"),
                F.count_if(there & ~mine & other).alias("b_only"),
                F.count_if(there & ~mine & ~other).alias("both_wrong"),
            )
        )
    flat = (
        each.groupBy(*by, "block", "block_b", "slot", "label")
        .agg(F.array(*cells).alias("cells"))
        .select(*by, "block", "block_b", "slot", "label", F.posexplode("cells").alias("slot_b", "c"))
        .select(
            *by, (F.col("block") * width + F.col("slot")).alias("i"), (F.col("block_b") * width + F.col("slot_b")).alias("j"),
            "label", "c.*",
        )
    )
    names = pos.select(*by, "run_id", "pos")
    a = names.select(*by, F.col("run_id").alias("run_a"), F.col("pos").alias("i"))
    b = names.select(*by, F.col("run_id").alias("run_b"), F.col("pos").alias("j"))
    return flat.join(a, [*by, "i"]).join(b, [*by, "j"]).drop("i", "j")


def agreement_matrix(
    preds: DataFrame, *, by: list[str] | None = None, dataset: Column | str | None = None
) -> DataFrame:
    """A10: agreement share of every ordered pair; 1 on the diagonal, 0 when nothing is comparable."""
    by = list(by or [])
    pairs = pair_counts(preds, by=by, dataset=dataset, common="pair")
    share = F.sum("agree") / F.nullif(F.sum("both").cast("double"), F.lit(0.0))
    return pairs.groupBy(*by, "run_a", "run_b").agg(
        F.sum("both").alias("n_comparable"),
        F.when(F.col("run_a") == F.col("run_b"), 1.0)
        .otherwise(F.coalesce(share, F.lit(0.0)))
        .alias("agreement"),
    )


def disagreement_matrix(preds: DataFrame, **kw) -> DataFrame:
    """Share of differing rows per pair."""
    return agreement_matrix(preds, **kw).select(
        *(kw.get("by") or []), "run_a", "run_b", (1 - F.col("agreement")).alias("disagreement")
    )


def kappa_from_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """A12 from :func:`pair_counts`."""
    back = pairs.select(
        *by, F.col("run_a").alias("run_b"), F.col("run_b").alias("run_a"), "label",
        F.col("both").alias("b_label"),
    )
    joined = (
        pairs.filter("run_a < run_b")
        .join(back, [*by, "run_a", "run_b", "label"], "left")
    )
    n = F.sum("both").cast("double")
    po = F.sum("agree") / n
    pe = F.sum(F.col("both") * F.coalesce("b_label", F.lit(0))).cast("double") / (n * n)
    return joined.groupBy(*by, "run_a", "run_b").agg(
        F.sum("both").alias("n_common"),
        po.alias("observed"),
        pe.alias("expected"),
        ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"),
    )


def cohen_kappa(
    preds: DataFrame, *, by: list[str] | None = None, runs: DataFrame | None = None,
    dataset: Column | str | None = None, common: str = "all",
) -> DataFrame:
    """Cohen's kappa of every pair; NULL when the expected agreement is 1."""
    return kappa_from_pairs(
        pair_counts(preds, by=by, runs=runs, dataset=dataset, common=common), list(by or [])
    )


def mcnemar_from_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """A13 from :func:`pair_counts`."""
    cells = ("both_ok", "a_only", "b_only", "both_wrong")
    sums = (
        pairs.filter("run_a < run_b")
        .groupBy(*by, "run_a", "run_b")
        .agg(*[F.sum(c).alias(c) for c in cells])
    )
    a, b = F.col("a_only"), F.col("b_only")
    return sums.withColumns(
        {
            "disagreements": a + b,
            "p_value": S.binomial_two_sided(a, b),
            "p_method": F.lit("exact"),
        }
    ).withColumnRenamed("both_ok", "both_correct")


def mcnemar(
    preds: DataFrame, *, by: list[str] | None = None, runs: DataFrame | None = None,
    dataset: Column | str | None = None, common: str = "all",
) -> DataFrame:
    """Correctness table and two-sided McNemar p-value of every pair."""
    return mcnemar_from_pairs(
        pair_counts(preds, by=by, runs=runs, dataset=dataset, common=common), list(by or [])
    )


def agreement_groups(
    runs: DataFrame, *, min_runs: int = 2, max_runs: int = 25
) -> DataFrame:
    """best runs with predictions per dataset and tier, groups of at least ``min_runs``."""
    key = ["dataset_name", "tier_size"]
    win = W.partitionBy(*key)
    place = F.row_number().over(win.orderBy(F.desc_nulls_last("f1_macro"), "run_key"))
    return (
        runs.filter("has_predictions AND dataset_name IS NOT NULL AND dataset_name <> ''")
        .withColumn("place", place)
        .filter(F.col("place") <= max_runs)
        .withColumn("n_runs", F.count(F.lit(1)).over(win))
        .filter(F.col("n_runs") >= min_runs)
        .withColumn(
            "group_key",
            F.concat("dataset_name", F.lit("__tier"), F.coalesce(F.col("tier_size").cast("string"), F.lit("any"))),
        )
    )


def disagreements(
    preds: DataFrame, *, runs: list[str] | None = None, dataset: Column | str | None = None, raw: bool = False
) -> DataFrame:
    """Samples on which the runs give at least two distinct labels.

    ``raw=True`` compares strings as they are; NULL and blank predictions are ignored.
    """
    src = preds if runs is None else preds.filter(F.col("run_id").isin(list(runs)))
    lab = F.nullif(F.col("pred_label"), F.lit("")) if raw else L.canonical_pred(F.col("pred_label"), dataset)
    lo, hi = F.min(lab), F.max(lab)
    return (
        src.groupBy("sample_id")
        .agg(lo.alias("lo"), hi.alias("hi"), F.count_distinct(lab).alias("n_distinct"))
        .filter("lo <> hi")
        .select("sample_id", "n_distinct")
    )


def distinct_preds_report(preds: DataFrame) -> DataFrame:
    """Samples whose runs differ, with the sorted labels joined by ``|``."""
    return (
        preds.filter("pred_label IS NOT NULL")
        .groupBy("sample_id", "pred_label").agg(F.max("true_label").alias("gold"))
        .groupBy("sample_id")
        .agg(
            F.max("gold").alias("gold"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.array_join(F.array_sort(F.collect_set("pred_label")), "|").alias("preds"),
        )
        .filter("n_distinct > 1")
    )
