"""Exact ranks and cuts that stay distributed when one group holds most rows.

``row_number`` over a partition puts the whole partition in one task.  Here each
partition is first split into ordered buckets, bucket sizes are counted with
map-side combine, and a row's rank is the number of rows in earlier buckets plus
its ``row_number`` inside its own bucket.

* md5 order (all seeded sampling): buckets are prefixes of the md5 key, so they
  are equal in size whatever the data looks like.
* value order: buckets lie between approximate quantiles.  A value that repeats
  often is itself a quantile and gets a bucket of its own, which is then split by
  md5 prefix (ties are ordered by md5 of the id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: least md5 digits and value edges of a ranking; both grow with the table
PREFIX = 2
EDGES = 32
#: bytes, by Spark's estimate, that one bucket is meant to hold
BUCKET_BYTES = 32 << 20
#: groups whose edges go to every task, and parts that the rows of a group are dealt to where there are more
FEW_GROUPS = 1000
PARTS = 16
TOP_ROWS = 10_000
_BEFORE = (W.unboundedPreceding, -1)


def buckets_for(df: DataFrame) -> int:
    """How many buckets a ranking of the table needs, from Spark's own estimate of its size; no job is run."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 20, size // BUCKET_BYTES)


def md5_digits(df: DataFrame) -> int:
    """Digits of the md5 that cut a group into buckets: 256 buckets at least, about a million at most."""
    digits = PREFIX
    while 16**digits < buckets_for(df):
        digits += 1
    return digits


def value_edges(df: DataFrame) -> int:
    """Quantile edges per group: 32 at least, 4096 at most, which keeps the sketch of a group small."""
    return max(EDGES, min(4096, buckets_for(df)))


def seeded_key(seed: int | str, id_col: str) -> Column:
    """The order key of every seeded draw: md5 of ``seed|id``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join that treats NULL keys as equal and keeps one copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _offsets(hist: DataFrame, by: list[str], order: list[str], n: str, out: str) -> DataFrame:
    win = W.partitionBy(*by).orderBy(*order).rowsBetween(*_BEFORE)
    return hist.withColumn(out, F.coalesce(F.sum(n).over(win), F.lit(0)))


def md5_rank(
    df: DataFrame,
    *,
    by: list[str],
    seed: int | str,
    id_col: str = "sample_id",
    out: str = "rank_in_group",
    prefix: int | None = None,
) -> DataFrame:
    """Rank 1..n of every row inside ``by`` in md5 order."""
    prefix = prefix or md5_digits(df)
    keyed = df.withColumn("_key", seeded_key(seed, id_col)).withColumn(
        "_pfx", F.substring("_key", 1, prefix)
    )
    hist = keyed.groupBy(*by, "_pfx").agg(F.count(F.lit(1)).alias("_n"))
    offs = _offsets(hist, by, ["_pfx"], "_n", "_off").drop("_n")
    inner = W.partitionBy(*by, "_pfx").orderBy("_key", id_col)
    return (
        join_on(keyed, offs, [*by, "_pfx"])
        .withColumn(out, (F.col("_off") + F.row_number().over(inner)).cast("bigint"))
        .drop("_key", "_pfx", "_off")
    )


def md5_take(
    df: DataFrame,
    quotas: DataFrame,
    *,
    by: list[str],
    seed: int | str,
    id_col: str = "sample_id",
    quota_col: str = "quota",
    prefix: int | None = None,
) -> DataFrame:
    """The first ``quota`` rows of each group in md5 order.

    Only the md5 buckets that can hold chosen rows are shuffled; the rest is
    dropped by a join against the (groups x buckets) histogram.
    """
    prefix = prefix or md5_digits(df)
    keyed = df.withColumn("_key", seeded_key(seed, id_col)).withColumn(
        "_pfx", F.substring("_key", 1, prefix)
    )
    hist = keyed.groupBy(*by, "_pfx").agg(F.count(F.lit(1)).alias("_n"))
    need = _offsets(hist, by, ["_pfx"], "_n", "_off").drop("_n")
    if by:
        need = join_on(need, quotas.select(*by, F.col(quota_col).alias("_quota")), by)
    else:
        need = need.withColumn("_quota", quotas.select(quota_col).scalar())
    need = need.filter("_off < _quota")
    inner = W.partitionBy(*by, "_pfx").orderBy("_key", id_col)
    return (
        join_on(keyed, need, [*by, "_pfx"])
        .withColumn("_rn", F.row_number().over(inner))
        .filter("_off + _rn <= _quota")
        .drop("_key", "_pfx", "_off", "_quota", "_rn")
    )


def md5_head(
    df: DataFrame, n: int, *, seed: int | str, id_col: str = "sample_id", top_rows: int = TOP_ROWS
) -> DataFrame:
    """The first ``n`` rows of the whole table in md5 order.

    Few rows are a top-n; more are cut by md5 bucket, so they never meet in one task.
    """
    if n <= top_rows:
        return df.orderBy(seeded_key(seed, id_col), id_col).limit(int(n))
    quota = df.sparkSession.createDataFrame([(int(n),)], "quota bigint")
    return md5_take(df, quota, by=[], seed=seed, id_col=id_col)


def _with_edges(df: DataFrame, quant: DataFrame, by: list[str]) -> DataFrame:
    """Every row with the edges of its group, however few the groups are.

    A join by the group would deal all rows of a group to one task. Up to ``FEW_GROUPS`` groups go to every task; of more,
    each row is dealt by its group and a random part, and each part of a group fetches the group's edges.
    """
    if not by:
        return df.withColumn("_edges", quant.scalar())
    found = quant.limit(FEW_GROUPS + 1).collect()
    if len(found) <= FEW_GROUPS:
        return join_on(df, F.broadcast(df.sparkSession.createDataFrame(found, quant.schema)), by)
    parts = df.sparkSession.range(PARTS).withColumnRenamed("id", "_part")
    dealt = df.withColumn("_part", F.floor(F.rand(seed=7) * PARTS).cast("bigint"))
    return join_on(dealt, quant.crossJoin(F.broadcast(parts)), [*by, "_part"]).drop("_part")


def _bucketed(df: DataFrame, by: list[str], value: str, edges: int | None) -> DataFrame:
    """Add ``_b``: an ordered bucket; odd buckets hold one single value."""
    edges = edges or value_edges(df)
    cuts = [i / edges for i in range(1, edges)]
    quant = df.groupBy(*by).agg(
        F.array_sort(
            F.array_distinct(
                F.percentile_approx(F.col(value).cast("double"), cuts, F.lit(100 * edges))
            )
        ).alias("_edges")
    )
    joined = _with_edges(df, quant, by)
    val = F.col(value).cast("double")
    # number of edges below the value, by halving steps instead of a lambda over all edges
    below, step = F.lit(0), 1 << (len(cuts).bit_length() - 1)
    while step:
        below = below + F.when(F.try_element_at("_edges", below + step) < val, step).otherwise(0)
        step //= 2
    return (
        joined.withColumn("_lo", below)
        .withColumn(
            "_b", 2 * F.col("_lo") + F.coalesce(F.try_element_at("_edges", F.col("_lo") + 1) == val, F.lit(False)).cast("int")
        )
        .drop("_edges", "_lo")
    )


def value_counts_below(
    df: DataFrame, *, by: list[str], value: str, edges: int | None = None
) -> DataFrame:
    """One row per distinct value: ``n_equal``, ``n_below`` and group size ``n_group``.

    Ties collapse map-side, so a value held by a third of all rows costs one row.
    """
    present = df.filter(F.col(value).isNotNull()).select(*by, value)
    vals = (
        _bucketed(present, by, value, edges)
        .groupBy(*by, "_b", value)
        .agg(F.count(F.lit(1)).alias("n_equal"))
    )
    hist = vals.groupBy(*by, "_b").agg(F.sum("n_equal").alias("_n"))
    offs = _offsets(hist, by, ["_b"], "_n", "_off").withColumn(
        "n_group", F.sum("_n").over(W.partitionBy(*by))
    )
    inner = W.partitionBy(*by, "_b").orderBy(value).rowsBetween(*_BEFORE)
    return (
        join_on(vals, offs.drop("_n"), [*by, "_b"])
        .withColumn("n_below", F.col("_off") + F.coalesce(F.sum("n_equal").over(inner), F.lit(0)))
        .drop("_b", "_off")
    )


def value_ranks(
    df: DataFrame,
    *,
    by: list[str],
    value: str,
    id_col: str,
    edges: int | None = None,
    prefix: int | None = None,
) -> DataFrame:
    """Add ``row_rank`` (unique), ``avg_rank`` (ties averaged) and ``n_group``.

    Rows with a NULL value are kept and get NULL ranks.  ``df`` is read three times
    (edges, bucket sizes, ranks): store it first when it is costly to compute.
    """
    prefix = prefix or md5_digits(df)
    present = df.filter(F.col(value).isNotNull())
    single = F.col("_b") % 2 == 1
    keyed = (
        _bucketed(present, by, value, edges)
        .withColumn("_key", F.md5(F.col(id_col).cast("string")))
        .withColumn("_sub", F.when(single, F.substring("_key", 1, prefix)).otherwise(F.lit("")))
    )
    hist = keyed.groupBy(*by, "_b", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*by)
    offs = (
        _offsets(hist, by, ["_b", "_sub"], "_n", "_off")
        .withColumn("_b_off", F.min("_off").over(W.partitionBy(*by, "_b")))
        .withColumn("_b_n", F.sum("_n").over(W.partitionBy(*by, "_b")))
        .withColumn("n_group", F.sum("_n").over(whole))
        .drop("_n")
    )
    part = W.partitionBy(*by, "_b", "_sub")
    ties = W.partitionBy(*by, "_b", "_sub", value)
    ranked = (
        join_on(keyed, offs, [*by, "_b", "_sub"])
        .withColumn("_rk", F.rank().over(part.orderBy(value)))
        .withColumn("_eq", F.count(F.lit(1)).over(ties))
        .withColumn(
            "row_rank",
            (F.col("_off") + F.row_number().over(part.orderBy(value, "_key", id_col))).cast("bigint"),
        )
        .withColumn(
            "avg_rank",
            F.when(single, F.col("_b_off") + (F.col("_b_n") + 1) / 2).otherwise(
                F.col("_off") + F.col("_rk") + (F.col("_eq") - 1) / 2
            ),
        )
        .withColumn("n_group", F.col("n_group").cast("bigint"))
        .drop("_b", "_key", "_sub", "_off", "_b_off", "_b_n", "_rk", "_eq")
    )
    absent = df.filter(F.col(value).isNull())
    return ranked.unionByName(absent, allowMissingColumns=True)


def exact_quantiles(
    df: DataFrame, *, by: list[str], value: str, probs: dict[str, float], edges: int | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Works on the distinct-value table, so no task ever holds all values of a group.
    """
    cum = value_counts_below(df, by=by, value=value, edges=edges)
    val = F.col(value).cast("double")

    def at(position: Column) -> Column:
        hit = (F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n_equal"))
        return F.max(F.when(hit, val))

    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n_group") - 1)
        aggs += [
            at(F.floor(pos)).alias(f"_lo_{name}"),
            at(F.ceil(pos)).alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_fr_{name}"),
        ]
    out = cum.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")
            ).alias(n)
            for n in probs
        ],
    )
