"""Secrets in texts: fixed forms, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of the base, in their order; (kind, pattern, least length, group that the length counts).
# A-Z and a-z are spelled out where either case counts, so that no other letter folds into them.
FORMS = [
    (
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6, 2,
    ),
    # a run of 20 (24) characters and more is the whole run that the shorter form would take and then measure
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
]
#: Characters that the models know; all others share one more place.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1
#: A run of these characters is a candidate.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Log ratios are kept as whole thousandths.
UNIT = 1000


def spans_of(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, value): code points, end exclusive.

    Matches whose `group` is shorter than `least` are left out; they still use up their characters.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(hits.alias("hit"), F.transform(gaps, F.length).alias("gap"), values.alias("value"))
    kind = "array<struct<start:int,end:int,value:string>>"
    empty = F.array().cast(kind)

    def step(acc, r):
        start = acc["at"] + r["gap"]
        end = start + F.length(r["hit"])
        long = F.length(r["value"]) >= least
        found = F.array(F.struct(start.alias("start"), end.alias("end"), r["value"].alias("value"))).cast(kind)
        return F.struct(
            F.coalesce(end, acc["at"]).alias("at"), F.when(long, F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found")
        )

    first = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    return F.when(text.rlike(pattern), F.aggregate(rows, first, step, lambda acc: acc["found"])).otherwise(empty)


def _place(char: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), char)
    return F.when(at > 0, at - 1).otherwise(SIZE - 1)


def _pairs(text: Column) -> Column:
    """Numbers of the neighbouring character pairs of a text of two characters and more."""
    places = F.transform(F.split(text, ""), _place)
    size = F.size(places) - 1
    return F.zip_with(F.slice(places, F.lit(1), size), F.slice(places, F.lit(2), size), lambda a, b: a * SIZE + b)


def train_markov(samples: DataFrame, text_col: str = "text", label_col: str = "label") -> list[int]:
    """Log-likelihood ratio of each character pair, random strings (label 1) against identifiers (label 0).

    First-order models; a pair's share leans on that of its second character with the weight of one row of the
    alphabet, and every character counts once more than seen. The result has one entry per pair of the alphabet, whatever
    the number of samples: it is the only thing that the driver gets. Samples of under two characters, NULL texts and
    NULL labels teach nothing; without samples all ratios are 0.
    """
    used = samples.where(F.col(label_col).isNotNull() & (F.length(text_col) >= 2))
    pairs = (
        used.select((F.col(label_col) == 1).alias("random"), F.explode(_pairs(F.col(text_col))).alias("pair"))
        .groupBy("random", "pair").count().collect()
    )
    seen = {(r["random"], r["pair"]): r["count"] for r in pairs}

    def logs(random: bool) -> list[float]:
        counts = [[seen.get((random, a * SIZE + b), 0) for b in range(SIZE)] for a in range(SIZE)]
        alone = [1 + sum(row[b] for row in counts) for b in range(SIZE)]
        share = [n / sum(alone) for n in alone]
        return [math.log((row[b] + SIZE * share[b]) / (sum(row) + SIZE)) for row in counts for b in range(SIZE)]

    return [round(UNIT * (p - q)) for p, q in zip(logs(True), logs(False), strict=True)]


def log_ratio(text: Column, model: list[int]) -> Column:
    """Mean log ratio of the pairs of a text, in thousandths."""
    table = F.expr("array(" + ",".join(map(str, model)) + ")")
    total = F.aggregate(_pairs(text), F.lit(0).cast("long"), lambda acc, p: acc + F.get(table, p))
    return total / (F.length(text) - 1)


def training_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 2000) -> DataFrame:
    """Labelled samples: words of up to `max_docs` documents (label 0), and base64 of digests of their ids (label 1).

    The bound holds for the training only; the documents are those whose hashed id is smallest, so the choice is the
    same on every cluster.
    """
    ids = [r[0] for r in docs.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_docs).collect()]
    chosen = docs.where(F.col(id_col).isin(ids))
    words = chosen.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[^A-Za-z0-9_]+")).alias("text"), F.lit(0).alias("label"))
    random = docs.where(F.col(id_col).isin(ids)).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.base64(F.unhex(F.sha2(F.concat_ws("/", F.col(id_col).cast("string"), i), 256))))).alias("text"),
        F.lit(1).alias("label"),
    )
    return words.unionByName(random)


def _marked(turn: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(turn).alias("turn"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def find_secrets(
    docs: DataFrame, model: list[int], id_col: str = "doc_id", text_col: str = "text", least_ratio: int = 700
) -> DataFrame:
    """Spans of secrets per document: id, base (kind, start, end), extra (the same, kind ``markov``).

    The base forms always stay. The models add candidate runs whose mean log ratio per pair is at least
    `least_ratio` thousandths and that touch no base span. Everything happens within the row, nothing is shuffled.

    NULL and empty texts have no spans. Work grows with a text's length, also within one run of millions of characters.
    Rows that repeat a document are all returned. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    for n, (kind, pattern, least, group) in enumerate(FORMS):
        rows = rows.withColumn(f"f{n}", F.transform(spans_of(F.col("body"), pattern, least, group), _marked(n, kind)))
    rows = rows.withColumn("runs", spans_of(F.col("body"), RUN)).drop("body")
    rows = rows.withColumn("base", F.sort_array(F.concat(*[f"f{n}" for n in range(len(FORMS))])))
    free = F.filter(
        "runs",
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        & (log_ratio(s["value"], model) >= least_ratio),
    )
    extra = F.transform(free, _marked(len(FORMS), "markov"))
    return rows.select("id", *[F.size(f"f{n}").cast("long").alias(f"n_{k[0]}") for n, k in enumerate(FORMS)], "base", extra.alias("extra")).withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
