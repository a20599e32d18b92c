"""Registry of queries with their SQL twins, and the fixtures both sides derive from the tables.

The Spark fixtures and the SQL common table expressions below mean the same rows:
only integer arithmetic and md5 are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LANGS = ["de", "en", "es", "fr"]
RUNS = [f"run_{r}" for r in range(5)]
SEED = 42


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def samples(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.lit("train_"), "doc_id").alias("sample_id"),
        F.lit("documents").alias("dataset_name"),
        "text",
        F.col("lang").alias("true_label"),
        *more,
    )


SAMPLES = """samples AS (SELECT 'train_' || doc_id AS sample_id, 'documents' AS dataset_name, text,
  lang AS true_label, doc_id, source, n_chars FROM documents)"""


def next_lang(col):
    return F.when(col == "en", "de").when(col == "de", "fr").when(col == "fr", "es").otherwise("en")


NEXT = "CASE {0} WHEN 'en' THEN 'de' WHEN 'de' THEN 'fr' WHEN 'fr' THEN 'es' ELSE 'en' END"


def preds(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Five runs over the documents with errors, missing labels and confidences."""
    doc, r = F.col("doc_id"), F.col("r")
    h = (doc * 7919 + r * 104729 + ((doc * 31 + r * 17) % 97) * 13) % 100
    src = (
        table(spark, sf, "documents")
        .select("doc_id", "lang", *more, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r"))
        .withColumn("h", h)
    )
    confusing = F.col("h") % 17 == 0
    return src.select(
        F.concat(F.lit("train_"), "doc_id").alias("sample_id"),
        F.concat(F.lit("run_"), "r").alias("run_id"),
        F.lit("documents").alias("dataset_name"),
        F.col("lang").alias("true_label"),
        F.when(F.col("h") >= 4, F.when(F.col("h") < 62 + 6 * r, F.col("lang")).otherwise(next_lang(F.col("lang")))).alias(
            "pred_label"
        ),
        ((F.col("h") % 21) / F.lit(20.0)).alias("confidence"),
        confusing.alias("is_confusing"),
        F.when(confusing, F.col("h") % 3).otherwise(1).cast("int").alias("n_pred_labels"),
        (40 + doc % 9).alias("in_tokens"),
        (5 + F.col("h") % 4).alias("out_tokens"),
        "doc_id",
        "r",
        "h",
        *more,
    )


PREDS = f"""base AS (SELECT doc_id, lang, source, n_chars, r,
    (doc_id*7919 + r*104729 + ((doc_id*31 + r*17) % 97)*13) % 100 AS h
  FROM documents, range(5) AS t(r)),
preds AS (SELECT 'train_' || doc_id AS sample_id, 'run_' || r AS run_id, 'documents' AS dataset_name,
  lang AS true_label,
  CASE WHEN h < 4 THEN NULL WHEN h < 62 + 6*r THEN lang ELSE {NEXT.format('lang')} END AS pred_label,
  (h % 21)::DOUBLE / 20.0 AS confidence, h % 17 = 0 AS is_confusing,
  (CASE WHEN h % 17 = 0 THEN h % 3 ELSE 1 END)::INTEGER AS n_pred_labels,
  40 + doc_id % 9 AS in_tokens, 5 + h % 4 AS out_tokens, doc_id, r, h, source, n_chars FROM base)"""

# correctness after the scalar clean-up, as the row rule states it
SCORED = """scored AS (SELECT *, COALESCE(NOT is_confusing AND pred_label = true_label, FALSE) AS correct FROM preds)"""


def wide_preds_sql(col: str = "pred_label") -> str:
    cells = ", ".join(f"MAX(CASE WHEN run_id = '{r}' THEN {col} END) AS {r}" for r in RUNS)
    return f"wide AS (SELECT sample_id, MAX(true_label) AS true_label, {cells} FROM preds GROUP BY sample_id)"


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """One vote per event: the user is the item, the event type the label."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_type").alias("label"),
        (F.pmod(F.col("event_id") * 37, F.lit(101)) / F.lit(100.0)).alias("confidence"),
        F.col("event_id").alias("seq"),
    )


VOTES = """votes AS (SELECT user_id AS item_id, event_type AS label, ((event_id * 37) % 101)::DOUBLE / 100.0 AS confidence,
  event_id AS seq FROM events)"""


def noisy(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels with about 12 % flipped, and two scores."""
    hit = (F.col("doc_id") * 7919) % 100 < 12
    return table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("sample_id"), "doc_id",
        F.col("quality").alias("true_label"),
        F.when(hit, 1 - F.col("quality")).otherwise(F.col("quality")).alias("observed"),
        hit.alias("is_corrupted"),
        (((F.col("doc_id") * 131) % 50 + F.when(hit, 15).otherwise(0)) / F.lit(10.0)).alias("score"),
        ((F.col("doc_id") * 57 + 3) % 40 / F.lit(8.0)).alias("score2"),
    )


NOISY = """noisy AS (SELECT doc_id::VARCHAR AS sample_id, doc_id, quality AS true_label,
  CASE WHEN (doc_id*7919) % 100 < 12 THEN 1 - quality ELSE quality END AS observed,
  (doc_id*7919) % 100 < 12 AS is_corrupted,
  ((doc_id*131) % 50 + CASE WHEN (doc_id*7919) % 100 < 12 THEN 15 ELSE 0 END)::DOUBLE / 10.0 AS score,
  ((doc_id*57 + 3) % 40)::DOUBLE / 8.0 AS score2 FROM labels)"""


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """Rows flagged by three detectors, long."""
    n = noisy(spark, sf)
    rows = F.array(
        F.struct(F.lit("m1").alias("method"), (F.col("score") >= 4.5).alias("is_flagged")),
        F.struct(F.lit("m2").alias("method"), (F.col("score2") >= 4.0).alias("is_flagged")),
        F.struct(F.lit("m3").alias("method"), (F.col("score") + F.col("score2") >= 8.0).alias("is_flagged")),
    )
    return n.select("sample_id", "is_corrupted", F.inline(rows))


FLAGS = """flags AS (SELECT sample_id, is_corrupted, 'm1' AS method, score >= 4.5 AS is_flagged FROM noisy
  UNION ALL SELECT sample_id, is_corrupted, 'm2', score2 >= 4.0 FROM noisy
  UNION ALL SELECT sample_id, is_corrupted, 'm3', score + score2 >= 8.0 FROM noisy)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("true_label"), "embedding"
    )


VECTORS = """vectors AS (SELECT vec_id AS sample_id, label::VARCHAR AS true_label, embedding::DOUBLE[] AS embedding FROM embeddings)"""


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Raw model texts: fenced JSON or prose around JSON, odd case, invalid labels."""
    doc = F.col("doc_id")
    label = F.when(doc % 7 == 0, "xx").when(doc % 5 == 0, F.upper("lang")).otherwise(F.col("lang"))
    body = F.concat(F.lit('[{"id": "'), doc.cast("string"), F.lit('", "label": "'), label, F.lit('"}]'))
    text = F.when(doc % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(
        F.concat(F.lit("Here is the answer: "), body, F.lit(" as asked."))
    )
    return table(spark, sf, "documents").select("doc_id", "lang", text.alias("raw_text"))


def rank_cte(src: str, label: str = "true_label", seed=SEED, name: str = "ranked", idc: str = "sample_id") -> str:
    part = f"PARTITION BY {label} " if label else ""
    return (
        f"{name} AS (SELECT *, row_number() OVER ({part}ORDER BY md5(concat_ws('|', '{seed}', {idc})), {idc}) AS rk "
        f"FROM {src})"
    )
