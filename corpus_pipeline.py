"""The corpus pipeline: documents that are toxic, copies, near copies or hold benchmark items go; the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns they were given.

Common to all stages: texts are taken whole, however long; NULL and empty texts are kept (the copies among them are
one group); rows are judged by their text, so NULL and repeated ids lose nothing that has no copy; ties go to the
smallest id, then the smallest hash of the text; columns beside doc_id and text pass through unread (lang chooses a
threshold); empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagsight.llm.exact import drop_copies
from tagsight.llm.minmax import drop_near
from tagsight.llm.packing import pack
from tagsight.llm.queries import table, tokenizer_path, toxic_model
from tagsight.llm.tiling import drop_contaminated
from tagsight.llm.toxic import keep_clean
from tagsight.plans.lineage import durable


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the classifier is trained on the labelled ones."""
    return keep_clean(docs, toxic_model(spark, docs, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    return drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their place in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]
#: Trained scores, tilings and rounded fractions have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
