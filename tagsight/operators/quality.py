"""Label-quality detection: confident learning, outliers, copies and group checks."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import durable
from ..plans.order import exact_quantiles, join_on, value_ranks
from .graph import connected_components
from .metrics import detection_metrics, label_distribution
from .neighbours import threshold_links, topk_similar
from .ranking import quantile_flag


def confident_thresholds(df: DataFrame, by: list[str], *, observed: str = "observed_label") -> DataFrame:
    """Mean self-probability of every observed label."""
    return df.groupBy(*by, F.col(observed).alias("label")).agg(
        F.avg(F.try_element_at("probs", F.col(observed))).alias("threshold"),
        F.count(F.lit(1)).alias("n_label"),
    )


def confident_joint(df: DataFrame, by: list[str], *, observed: str = "observed_label", id_col: str = "sample_id") -> DataFrame:
    """Rows per (observed, confident true label); a row's confident label is the most probable
    one among the labels whose probability reaches that label's threshold."""
    per = _confident_labels(df, by, observed=observed, id_col=id_col)
    return per.filter("confident_label IS NOT NULL").groupBy(*by, observed, "confident_label").agg(
        F.count(F.lit(1)).alias("n")
    )


def _confident_labels(df: DataFrame, by: list[str], *, observed: str, id_col: str) -> DataFrame:
    thr = confident_thresholds(df, by, observed=observed)
    table = thr.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("label", "threshold"))).alias("_thr"))
    src = join_on(df, table, by) if by else df.withColumn("_thr", table.scalar())
    reach = F.filter(
        F.transform(
            F.map_entries("probs"),
            lambda e: F.when(
                e["value"] >= F.try_element_at("_thr", e["key"]),
                F.struct((-e["value"]).alias("p"), e["key"].alias("label")),
            ),
        ),
        lambda e: e.isNotNull(),
    )
    return src.withColumn("confident_label", F.try_element_at(F.array_sort(reach), F.lit(1))["label"]).drop("_thr")


def find_label_issues(
    df: DataFrame, by: list[str] | None = None, *, observed: str = "observed_label", id_col: str = "sample_id"
) -> DataFrame:
    """Confident learning with pruning by noise rate (Northcutt et al., 2021).

    The confident joint is calibrated to the observed label counts; for every
    off-diagonal cell that many rows of the observed label with the largest margin
    ``p(other) - p(observed)`` are flagged.  Adds ``is_flagged``.
    """
    by = list(by or [])
    rows = _confident_labels(df, by, observed=observed, id_col=id_col)
    joint = rows.filter("confident_label IS NOT NULL").groupBy(*by, observed, "confident_label").agg(
        F.count(F.lit(1)).alias("n")
    )
    sizes = df.groupBy(*by, observed).agg(F.count(F.lit(1)).alias("_size"))
    total = F.sum("n").over(W.partitionBy(*by, observed))
    cells = (
        join_on(joint.withColumn("_total", total), sizes, [*by, observed])
        .withColumn("quota", F.round(F.col("n") / F.col("_total") * F.col("_size")).cast("bigint"))
        .filter(F.col(observed) != F.col("confident_label"))
        .select(*by, observed, F.col("confident_label").alias("other"), "quota")
        .filter("quota > 0")
    )
    margin = F.try_element_at("probs", F.col("other")) - F.try_element_at("probs", F.col(observed))
    # one row per candidate label of the cells that need pruning: at most K-1 per row
    cand = join_on(df.select(*by, id_col, observed, "probs"), cells, [*by, observed]).select(
        *by, id_col, observed, "other", "quota", (-margin).alias("_margin")
    )
    ranked = value_ranks(
        durable(cand),  # read for the bucket edges, the bucket sizes and the ranks
        by=[*by, observed, "other"], value="_margin", id_col=id_col,
    )
    hits = ranked.filter(F.col("row_rank") <= F.col("quota")).select(*by, id_col).distinct().withColumn(
        "_hit", F.lit(True)
    )
    return join_on(df, hits, [*by, id_col], "left").withColumn(
        "is_flagged", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def issue_comparison(flags: DataFrame, *, truth: str = "is_corrupted") -> DataFrame:
    """Detection quality of every method, best first."""
    return detection_metrics(flags, ["method"], truth=truth).orderBy(
        F.desc("f1"), F.desc("recall"), F.desc("precision"), "method"
    )


def class_centroids(df: DataFrame, *, vec: str = "embedding", label: str = "true_label") -> DataFrame:
    """Mean vector of every label (a mergeable aggregate, one buffer per label and task)."""
    mean = Summarizer.mean(array_to_vector(F.col(vec)))
    return df.groupBy(label).agg(vector_to_array(mean).alias("centroid"))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def centroid_distance(df: DataFrame, *, vec: str = "embedding", label: str = "true_label") -> DataFrame:
    """Distance of every row to the centroid of its own label."""
    cent = class_centroids(df, vec=vec, label=label)
    return join_on(df, cent, [label]).withColumn("distance", F.sqrt(squared_distance(vec, "centroid"))).drop("centroid")


def centroid_distance_flag(df: DataFrame, *, q: float = 0.9, vec: str = "embedding", label: str = "true_label") -> DataFrame:
    """Rows at or beyond the q-quantile of the distance to their own centroid."""
    return quantile_flag(durable(centroid_distance(df, vec=vec, label=label)), score="distance", q=q)


def outliers(df: DataFrame, *, k: int = 10, q: float = 0.9, vec: str = "embedding", id_col: str = "sample_id") -> DataFrame:
    """Mean cosine distance to the k nearest other rows, flagged from the q-quantile on."""
    near = topk_similar(df, df, k=k, vec=vec, id_col=id_col, exclude_self=True)
    score = near.groupBy(F.col("q_id").alias(id_col)).agg((1 - F.avg("score")).alias("outlier_score"))
    return quantile_flag(durable(score), score="outlier_score", q=q, out="is_outlier")


def near_duplicates(
    df: DataFrame, *, threshold: float = 0.98, vec: str = "embedding", id_col: str = "sample_id"
) -> DataFrame:
    """Sets of rows linked by a cosine >= ``threshold``.

    Equal vectors are first folded into their smallest id, so a large group of
    copies is one row in the search.  Of the others only links that join sets are
    returned, not all pairs; their components are the sets.
    """
    key = F.sha2(F.concat_ws(",", F.col(vec).cast("array<string>")), 256)
    keyed = df.select(id_col, vec, key.alias("_key"))
    reps = durable(
        keyed.groupBy("_key").agg(F.min(F.struct(id_col, vec)).alias("s"), F.count(F.lit(1)).alias("n_copies"))
        .select("_key", "n_copies", "s.*")
    )
    near = durable(threshold_links(reps, threshold=threshold, vec=vec, id_col=id_col))
    links = near.select(F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    )).alias("e")).select(F.lit(0).alias("g"), "e.*").distinct()
    comp = connected_components(
        reps.select(F.lit(0).alias("g"), id_col), links, group=["g"], node=id_col
    ).select(F.col(id_col).alias("_rep"), "component")
    sets = reps.withColumnRenamed(id_col, "_rep").drop(vec).join(comp, "_rep")
    size = sets.groupBy("component").agg(F.sum("n_copies").alias("set_size"))
    members = sets.join(size, "component").select("_key", F.col("component").alias("set_id"), "set_size")
    return keyed.select(id_col, "_key").join(members, "_key").select(
        id_col, "set_id", "set_size", (F.col("set_size") > 1).alias("is_near_duplicate")
    )


def class_imbalance(df: DataFrame, *, label: str = "true_label", factor: float = 0.1) -> DataFrame:
    """Labels whose share is below ``factor / K``."""
    dist = label_distribution(df, label=label)
    k = dist.agg(F.count(F.lit(1))).scalar()
    return dist.withColumn("is_rare", F.col("share") < factor / k)


def underperforming_groups(df: DataFrame, *, cluster: str = "cluster_id", score: str = "self_confidence", ratio: float = 0.75) -> DataFrame:
    """Clusters whose mean self-confidence is below ``ratio`` times the overall mean."""
    mean = df.agg(F.avg(score)).scalar()
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_confidence")).withColumn(
        "is_underperforming", F.col("mean_confidence") < ratio * mean
    )


def non_iid(
    df: DataFrame, *, k: int = 10, bins: int = 100, vec: str = "embedding", id_col: str = "sample_id", position: str = "position"
) -> DataFrame:
    """Are neighbours closer in the table order than random pairs?

    Largest gap between the binned distribution of ``|i - j|`` over neighbour pairs
    and its closed form for random pairs, ``1 - (1 - d/n)^2``.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    where = df.select(F.col(id_col).alias("q_id"), F.col(position).alias("i"))
    near = topk_similar(df, df, k=k, vec=vec, id_col=id_col, exclude_self=True)
    gaps = near.join(where, "q_id").join(
        where.select(F.col("q_id").alias("p_id"), F.col("i").alias("j")), "p_id"
    ).select(F.abs(F.col("i") - F.col("j")).alias("d")).withColumn("n", n)
    slot = F.least(F.lit(bins), F.ceil(F.col("d") * bins / F.col("n"))).cast("int")
    hist = gaps.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(W.partitionBy())
    seen = F.sum("c").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / total
    x = F.col("bin") / F.lit(float(bins))
    ks = hist.withColumn("gap", F.abs(seen - (1 - (1 - x) * (1 - x))))
    return ks.agg(F.sum("c").alias("n_pairs"), F.max("gap").alias("ks_statistic")).withColumn(
        "ks_scaled", F.col("ks_statistic") * F.sqrt("n_pairs")
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """Flagged rows per issue type, most first."""
    return issues.groupBy("issue_type").agg(
        F.count_if("is_issue").alias("num_flagged"), F.count(F.lit(1)).alias("n_rows")
    ).orderBy(F.desc("num_flagged"), "issue_type")


def quality_vs_mismatch(df: DataFrame, *, quality: str = "self_confidence", mismatch: str = "is_mismatch") -> DataFrame:
    """Label quality of matching and mismatching rows, and its correlation with the mismatch."""
    r = df.agg(F.corr(F.col(quality), F.col(mismatch).cast("double"))).scalar()
    base = df.groupBy(mismatch).agg(
        F.count(F.lit(1)).alias("n"), F.avg(quality).alias("mean_quality"),
    )
    med = exact_quantiles(df, by=[mismatch], value=quality, probs={"median_quality": 0.5})
    return join_on(base, med, [mismatch]).withColumn("point_biserial", r)

