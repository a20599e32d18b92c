"""Records of CSV and JSON files whose ends depend on the quotes and brackets before them, read in splits.

A scan cuts the files at every possible end of a record.  A first pass learns, for every split, what it does to the
state (inside quotes, depth of brackets) under both states it may begin in; chained over the splits of a file that
gives the state at every split's start.  The second pass then cuts each split into records on its own.  Only the
pieces of records that cross splits, at most two a split, are shuffled.  Both passes plan their splits from the same files;
should they differ (cores came or went between them, on small inputs), the read fails and never misplaces a record.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import collect_small, durable

STATES = "f string, b bigint, head string, quoted boolean, quoted_after boolean, change bigint"
PIECES = "f string, b bigint, kind int, first boolean, low bigint, text string"
WHOLE, CLOSES, OPEN = 0, 1, 2
MARKS = re.compile(r'\\.|["\[\]{}]', re.S)
WRAPPED = re.compile(r'\s*\{\s*"predictions"\s*:\s*\[')


def csv_step(text: str, quoted: bool) -> tuple[bool, int, int]:
    """Whether the text ends within quotes; a CSV file has no depth."""
    return quoted ^ bool(text.count('"') & 1), 0, 0


def json_step(text: str, quoted: bool) -> tuple[bool, int, int]:
    """(ends within a string, change of depth, least depth on the way) relative to the start of the text."""
    depth = low = 0
    for mark in MARKS.findall(text):
        if mark == '"':
            quoted = not quoted
        elif not quoted and len(mark) == 1:
            depth += 1 if mark in "[{" else -1
            low = min(low, depth)
    return quoted, depth, low


def _scan(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    return spark.read.text(paths, lineSep=sep).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value"
    )


def _effects(step, sep: str):
    def run(frames):
        found: dict[tuple, list] = {}
        for frame in frames:
            for f, b, value in zip(frame["f"], frame["b"], frame["value"]):
                seen = found.setdefault((f, b), [value[:200] if b == 0 else None, False, 0, True, 0])
                for at in (1, 3):
                    seen[at], change, _ = step(value + sep, seen[at])
                    seen[at + 1] += change
        yield pd.DataFrame(
            [(f, b, s[0], q, s[at], s[at + 1]) for (f, b), s in found.items() for q, at in ((False, 1), (True, 3))],
            columns=["f", "b", "head", "quoted", "quoted_after", "change"],
        )

    return run


def _cut(starts: dict, bases: dict, step, sep: str):
    def run(frames):
        now, held = None, []
        for frame in frames:
            out = []
            for f, b, value in zip(frame["f"], frame["b"], frame["value"]):
                if f not in bases:
                    continue
                if (f, b) != now:
                    if (f, b) not in starts:
                        raise RuntimeError(f"{f}: the splits have changed since the first pass (at byte {b}); read it again")
                    if held:
                        out.append((*now, OPEN, first, low, "".join(held)))
                    now, held, first = (f, b), [], b == 0
                    quoted, depth = starts[now]
                    low, inside = depth, not (first or (depth == bases[f] and not quoted))
                value += sep
                quoted, change, dip = step(value, quoted)
                low, depth = min(low, depth + dip), depth + change
                held.append(value)
                if not quoted and depth == bases[f]:
                    out.append((f, b, CLOSES if inside else WHOLE, first, low, "".join(held)))
                    held, low, first, inside = [], depth, False, False
            yield pd.DataFrame(out, columns=["f", "b", "kind", "first", "low", "text"])
        if held:
            yield pd.DataFrame([(*now, OPEN, first, low, "".join(held))], columns=["f", "b", "kind", "first", "low", "text"])

    return run


def _records(scan: DataFrame, starts: dict, bases: dict, step, sep: str) -> DataFrame:
    """(f, base, first, low, closed, text) of every record; ``first`` marks the first of a file."""
    pieces = durable(scan.mapInPandas(_cut(starts, bases, step, sep), PIECES))
    before = F.sum((F.col("kind") == CLOSES).cast("int")).over(
        W.partitionBy("f").orderBy("b", "kind").rowsBetween(W.unboundedPreceding, -1)
    )
    joined = (
        pieces.filter(F.col("kind") != WHOLE)
        .withColumn("chain", F.coalesce(before, F.lit(0)))
        .groupBy("f", "chain")
        .agg(
            F.bool_or("first").alias("first"), F.min("low").alias("low"), F.bool_or(F.col("kind") == CLOSES).alias("closed"),
            F.array_sort(F.collect_list(F.struct("b", "kind", "text"))).alias("parts"),
        )
        .select("f", "first", "low", "closed", F.array_join("parts.text", "").alias("text"))
    )
    return pieces.filter(F.col("kind") == WHOLE).select("f", "first", "low", F.lit(True).alias("closed"), "text").unionByName(joined)


def _states(scan: DataFrame, step, sep: str) -> tuple[dict, dict, dict]:
    """State at the start of every split, state at the end of every file, and how every file begins."""
    effect: dict[str, dict] = {}
    heads = {}
    for r in collect_small(scan.mapInPandas(_effects(step, sep), STATES)):
        effect.setdefault(r["f"], {}).setdefault(r["b"], {})[r["quoted"]] = (r["quoted_after"], r["change"])
        if r["b"] == 0:
            heads[r["f"]] = r["head"]
    starts, ends = {}, {}
    for f, splits in effect.items():
        quoted, depth = False, 0
        for b in sorted(splits):
            starts[f, b] = (quoted, depth)
            quoted, change = splits[b][quoted]
            depth += change
        ends[f] = (quoted, depth)
    return starts, ends, heads


def csv_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(f, text) of the records below the header line; a quoted field may hold line breaks."""
    scan = _scan(spark, paths, "\n")
    starts, ends, _ = _states(scan, csv_step, "\n")
    rows = _records(scan, starts, dict.fromkeys(ends, 0), csv_step, "\n").filter("NOT first")
    return rows.select("f", F.regexp_replace("text", r"\r?\n$", "").alias("text")).filter("text <> ''")


def json_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """(f, text) of the objects in JSON lists, and the files left out because they begin otherwise.

    A file is a list of objects, or an object whose first field ``predictions`` is one; what follows the list is
    ignored.  A file that breaks off within its list gives no rows.
    """
    scan = _scan(spark, paths, "}")
    starts, ends, heads = _states(scan, json_step, "}")
    bases, others = {}, []
    for f, head in heads.items():
        if head.lstrip().startswith("["):
            bases[f] = 1
        elif WRAPPED.match(head):
            bases[f] = 2
        else:
            others.append(f)
    if not bases:
        return spark.createDataFrame([], "f string, text string"), others
    # the last piece of a file has no closing bracket of its own, so a whole file may end one lower
    good = [f for f in bases if not ends[f][0] and ends[f][1] in (0, -1)]
    # other files are passed over in the tasks: a filter would prune them from the scan and so move its splits
    rows = _records(scan, starts, bases, json_step, "}")
    wrapped = F.col("f").isin([f for f in good if bases[f] == 2])
    inside = F.col("first") | (F.col("low") >= F.when(wrapped, 2).otherwise(1))
    return (
        rows.filter(F.col("f").isin(good) & F.col("closed") & inside)
        .select("f", F.regexp_replace("text", F.when(F.col("first") & wrapped, r'^\s*\{\s*"predictions"\s*:\s*\[\s*').otherwise(r"^[\s,\[]+"), F.lit("")).alias("text"))
    ), others
