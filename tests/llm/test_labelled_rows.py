from pyspark.sql import functions as F

from tagsight.llm import toxic


def test_texts_without_labels_are_not_shuffled(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    docs = docs.union(spark.createDataFrame([(None, "none", "en"), (7, "again", None)], "doc_id long, text string, lang string"))
    labels = spark.range(0, 20_000, 10).select(F.col("id").cast("int").alias("doc_id"), (F.col("id") % 20 == 0).cast("int").alias("toxic"))
    labels = labels.union(spark.createDataFrame([(7, 1), (99_999, 1), (None, 1)], "doc_id int, toxic int"))
    got = toxic.labelled(docs, labels, "doc_id", "text", "toxic", "lang", 4).collect()
    want = [(i, f"text {i}", "en", int(i % 20 == 0)) for i in range(0, 20_000, 10)] + [(7, "text 7", "en", 1), (7, "again", "", 1)]
    assert sorted((r["id"], r["body"], r["lang"], r["label"]) for r in got) == sorted(want)
    rows = docs.withColumnRenamed("doc_id", "id")
    ids = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"))
    passed = toxic.perhaps_in(rows, ids, 2002)
    assert passed.join(ids, "id", "left_semi").count() == 2002
    assert passed.count() < 4500  # all 20,002 went into the join before
    assert toxic.perhaps_in(rows, ids.limit(0), 0).count() == 0
