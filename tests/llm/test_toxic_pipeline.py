import hashlib

import numpy as np
import public_tokenizers
import pytest
from plain import OTHER, PROSE, TEXTS, by_sequence, near, pieces, rows, table, tiling
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tagsight.llm import exact, minmax, packing, tiling as tiles, toxic
from tagsight.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_scores_do_not_depend_on_neighbours_or_blocks(spark, monkeypatch):
    texts = [t or "" for t in TEXTS]
    model = toxic.fit(["bad word here", "nice word here"] * 20, np.array([1, 0] * 20), epochs=2)
    alone = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(model.scores(texts), alone, atol=1e-6)
    monkeypatch.setattr(toxic, "BLOCK", 7)
    short = [t for t in texts if len(t) < 9000]
    assert np.allclose(model.scores(short), [a for a, t in zip(alone, texts, strict=True) if len(t) < 9000], atol=1e-5)
    assert model.scores([]).shape == (0,)


def test_training_learns_and_calibrates_by_language(spark):
    rng = np.random.default_rng(2)
    calm, words = [f"calm{i}" for i in range(200)], ["awful", "nasty"]
    texts, labels = [], []
    for n in range(600):
        own = list(rng.choice(calm, 40))
        if n // 3 % 3 == 0:
            own[rng.integers(40)] = str(rng.choice(words))
        texts.append(" ".join(own))
        labels.append(int(n // 3 % 3 == 0))
    docs = table(spark, texts)
    marks = spark.createDataFrame([(i, v, None) for i, v in enumerate(labels)] + [(None, 1, None), (3, None, None)], "doc_id long, toxic int, text string")
    model = toxic.train(docs, marks.where("doc_id < 400 OR doc_id IS NULL"), min_calibration=10)
    got = {r["doc_id"]: r for r in toxic.score(docs, model).collect()}
    right = [(got[i]["score"] >= 0.5) == bool(labels[i]) for i in range(400, 600)]
    assert np.mean(right) > 0.97
    assert set(model.thresholds) <= {"", "en", "de"} and model.thresholds
    left = toxic.keep_clean(docs, model)
    assert left.columns == docs.columns and rows(left.select("doc_id")) == sorted(((i,) for i, r in got.items() if not r["rejected"]), key=str)


def test_toxic_nulls_and_empty(spark):
    model = toxic.fit(["bad", "good"] * 10, np.array([1, 0] * 10), epochs=1)
    docs = table(spark, [None, "", "a", "a"], [1, 2, None, None])
    got = rows(toxic.score(docs, model))
    assert len(got) == 4 and all(0 <= r[1] <= 1 for r in got)
    empty = {r[1] for r in got if r[0] in (1, 2)}
    assert len(empty) == 1
    assert toxic.score(docs.limit(0), model).count() == 0
    assert toxic.score(docs.drop("lang"), model).count() == 4
    nothing = toxic.train(docs.limit(0), docs.select("doc_id", F.lit(1).alias("toxic")))
    assert toxic.score(docs, nothing).count() == 4


def test_nothing_is_rejected_without_labels_of_both_kinds(spark):
    docs = table(spark, ["bad", "good", "", None, "bad", "good", "so so", "fine"])
    no_labels = docs.select("doc_id", F.lit(1).alias("toxic")).limit(0)
    elsewhere = docs.select((F.col("doc_id") + 100).alias("doc_id"), F.lit(1).alias("toxic"))
    all_toxic = docs.select("doc_id", F.lit(1).alias("toxic"))
    # every fourth row is held out: here the only labels of kind 0
    held_out_only = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("toxic"))
    for labels in (no_labels, elsewhere, all_toxic, held_out_only):
        model = toxic.train(docs, labels, min_calibration=1)
        assert toxic.keep_clean(docs, model).count() == 8 and toxic.score(docs, model).where("rejected").isEmpty()


def test_held_out_accuracy(spark):
    got = QUERIES["op3_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert judged > 0.9
    assert got.count() == 1000 and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def text_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_follow_plain_versions(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = TEXTS + [bench[0], "intro " + bench[3] + " outro"]
    docs = table(spark, texts)
    have = list(enumerate(texts))

    kept = text_of(stage["exact_dedup"](spark, docs, SF))
    by = {}
    for i, t in have:
        by.setdefault("".join(x for x in t or "" if x not in exact.BLANKS), []).append((-len(t or ""), i))
    assert kept == {min(v)[1]: texts[min(v)[1]] for v in by.values()}

    kept = text_of(stage["near_dedup"](spark, docs, SF))
    assert kept == {i: t for i, t in have if near(have, 5)[i][2]}

    kept = text_of(stage["decontamination"](spark, docs, SF))
    short = [(i, t) for i, t in have if len(t or "") < 3000]
    for i, t in short:
        hit = any(c >= 0.8 * n for c, n in (tiling(t, b, tiles.LEAST) for b in bench.values()) if n)
        assert (i in kept) == (not hit)
    assert len(texts) - 1 not in kept and len(texts) - 2 not in kept

    got = stage["packing"](spark, docs, SF).collect()
    want = pieces(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), have, 0, 2048)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert all(max(o + n for o, n in s) == sum(n for _, n in s) <= 2048 for s in by_sequence(got).values())
    for name in names[:-1]:
        assert stage[name](spark, docs.limit(0), SF).columns == docs.columns


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where("length < 1 OR length > 2048").count() == 0
    left = out.select("doc_id").distinct().count()
    assert 600 < left < 900


@pytest.mark.parametrize("name", ["op2_url_verdicts", "op7_exact_dedup"])
def test_same_rows_as_sql(spark, name):
    from tagsight.llm.queries import ORACLES
    from catalog.check import canonical, connect

    df = QUERIES[name](spark, SF)
    cur = connect(SF).execute(ORACLES[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_labelled_row_is_trained_on(spark, monkeypatch):
    """8,000 labelled rows; a word that tells is only in those beyond the 6,000 smallest hashed ids."""
    monkeypatch.setattr(toxic, "SHARE", 60_000, raising=False)  # several trainers
    ids = spark.range(8000).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"))).alias("place"))
    marks = ids.select("doc_id", (F.crc32(F.concat(F.lit("x"), "doc_id")) % 3 == 0).cast("int").alias("toxic"), "place")
    word = F.when(F.col("toxic") == 0, "calm").when(F.col("place") <= 6000, "awful").otherwise("vicious")
    docs = marks.select("doc_id", F.concat_ws(" ", F.lit("it was a"), word, F.lit("day"), F.col("doc_id") % 97).alias("text"))
    model = toxic.train(docs, marks.select("doc_id", "toxic"), epochs=2)
    right = toxic.score(docs, model).join(marks, "doc_id").groupBy(word.alias("word")).agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int")))
    assert {w: round(x, 2) for w, x in right.collect()} == {"calm": 1.0, "awful": 1.0, "vicious": 1.0}
    again = toxic.train(docs.repartition(5), marks.select("doc_id", "toxic"), epochs=2)
    assert (again.table == model.table).all() and again.shift == model.shift


def test_cuts_of_all_rows_are_the_plain_ones(spark):
    rng = np.random.default_rng(5)
    logits = np.round(rng.normal(size=3000), 2).astype(np.float32)
    labels = (logits + rng.normal(size=3000) > 0.5).astype(int)
    kinds = rng.choice(["a", "b", "c"], 3000)
    labels[kinds == "c"] = 0
    data = spark.createDataFrame([(k, float(x), int(y)) for k, x, y in zip(kinds, logits, labels, strict=True)], "kind string, logit float, label int")
    got = toxic.best_cuts(data.repartition(7))
    for kind in "abc":
        own, y = logits[kinds == kind], labels[kinds == kind]
        assert got[kind][1:] == (len(y), y.sum())
        f1 = {x: 2 * y[own >= x].sum() / ((own >= x).sum() + y.sum()) for x in own} if y.any() else {}
        best = max(f1.items(), key=lambda kv: (kv[1], kv[0]))[0] if f1 else 0.0
        below = own[own < best].max() if f1 else 0.0
        assert got[kind][0] == pytest.approx((float(best) + float(below)) / 2)
    assert toxic.best_cuts(data.limit(0)) == {}
