"""URL rules as a sorted sweep: reversed hosts and paths turn prefixes into nested intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable

#: rows of one sweep; the number of sweeps follows from the table
ROWS_PER_SWEEP = 250_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for NULL and for urls without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def reversed_host(host: Column) -> Column:
    """``a.b.org`` as ``org.b.a.``: a host and its subdomains become the strings with one prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _stacks(rules: DataFrame, group: str, key: str, item: str) -> DataFrame:
    """One row per rule key and group: the stack of keys open at it, outermost first, by a scan in key order."""
    step = (
        "aggregate(array_sort(collect_set(struct({k} AS k, {i} AS i))), "
        "CAST(array() AS array<struct<k:string,stack:array<struct<k:string,i:string>>>>), "
        "(done, r) -> array_append(done, named_struct('k', r.k, 'stack', array_append("
        "filter(coalesce(try_element_at(done, -1).stack, CAST(array() AS array<struct<k:string,i:string>>)), s -> startswith(r.k, s.k)), r))))"
    ).format(k=key, i=item)
    return (
        rules.groupBy(group).agg(F.expr(step).alias("done"))
        .select(group, F.explode("done").alias("d"))
        .select(group, F.col("d.k").alias("k"), F.expr("transform(d.stack, s -> s.i)").alias("stack"))
    )


def sweep(points: DataFrame, intervals: DataFrame, slices: int) -> DataFrame:
    """Attach to each point (slice, grp, key, ...) the stack of the innermost prefix interval that holds it.

    intervals: (grp, k, stack). Every interval opens at its prefix and closes behind the last string with that
    prefix; prefixes nest or are apart, so at an opening its own stack is active and at a closing the one below.
    Points and boundaries are sorted together and each point takes the last boundary before it. Points are dealt
    to slices at random, the few boundaries go to every slice, so no key is ever hot.
    """
    carried = [c for c in points.columns if c not in ("slice", "grp", "key")]
    opens = intervals.select("grp", F.encode("k", "UTF-8").alias("at"), F.lit(0).alias("turn"), F.col("stack").alias("active"))
    closes = intervals.select(
        "grp", F.concat(F.encode("k", "UTF-8"), F.unhex(F.lit("FF"))).alias("at"), F.lit(1).alias("turn"),
        F.expr("slice(stack, 1, size(stack) - 1)").alias("active"),
    )
    bounds = opens.unionByName(closes).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = points.select("slice", "grp", F.encode("key", "UTF-8").alias("at"), F.lit(2).alias("turn"), F.struct(*carried).alias("row"))
    both = dealt.unionByName(bounds, allowMissingColumns=True)
    # byte FF is in no UTF-8 text, so a closing shares its place with nothing; an opening comes before equal points
    order = Window.partitionBy("slice", "grp").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("stack", F.last("active", ignorenulls=True).over(order)).where("turn = 2")
    return swept.select("slice", "grp", "row.*", F.coalesce("stack", F.expr("CAST(array() AS array<string>)")).alias("stack"))


def url_verdicts(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    rows_per_sweep: int = ROWS_PER_SWEEP,
) -> DataFrame:
    """Host, path, deciding rule and verdict of every page.

    rules: (host, path, verdict). A rule fits its host and all subdomains when the path starts with the rule's; the
    longest rule (host and path together, then the longer host) decides. Where none fits, rule is NULL and the verdict
    is `default`.

    Two sweeps: over reversed hosts, where the stack holds the nested rule hosts; then, for each of them, over paths,
    where the top of the stack is the longest rule path. Rules are a small table next to the pages; they are repeated
    once per slice, pages are never repeated beyond the rule hosts that hold them. One rule host's paths are scanned
    as one list.

    NULL urls and urls without ``://`` have an empty host and path, which only a rule for the empty host fits.
    Rules with NULL host or path are read as empty; repeated rules count once, and of rules with equal host and path
    the smallest verdict holds. Rows that repeat a page are all returned. Columns beside id and url are not read.
    """
    host, path = host_and_path(F.col(url_col))
    spark = pages.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pages.count() / rows_per_sweep))
    given = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("given"),
    ).groupBy("rule_host", "rule_path").agg(F.min("given").alias("given"))
    given = given.withColumn("rkey", reversed_host(F.col("rule_host")))
    hosts = _stacks(given.select(F.lit("").alias("grp"), "rkey").distinct(), "grp", "rkey", "rkey")
    paths = _stacks(given.select(F.col("rkey").alias("grp"), "rule_path"), "grp", "rule_path", "rule_path")

    points = pages.select(
        F.col(id_col).alias("page"), host.alias("host"), path.alias("path"),
        F.monotonically_increasing_id().alias("row_key"),
    ).withColumn("slice", F.pmod(F.xxhash64("page", "row_key"), F.lit(slices)).cast("int"))
    points = durable(points)  # fixes the row keys, which the last join needs
    first = sweep(
        points.select("slice", F.lit("").alias("grp"), reversed_host(F.col("host")).alias("key"), "page", "row_key", "host", "path"), hosts, slices
    )
    inside = first.select("slice", F.explode("stack").alias("grp"), F.col("path").alias("key"), "row_key")
    tops = sweep(inside, paths, slices).where("size(stack) > 0").select("row_key", F.col("grp").alias("rkey"), F.element_at("stack", -1).alias("rule_path"))
    best = (
        tops.join(given, ["rkey", "rule_path"])
        .groupBy("row_key")
        .agg(
            F.max_by(
                F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("given")),
                F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host")),
            ).alias("best")
        )
    )
    return first.join(best, "row_key", "left").select(
        F.col("page").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.given", F.lit(default)).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) as a table."""
    one = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*one))) if one else spark.createDataFrame([], "host string, path string, verdict string")
