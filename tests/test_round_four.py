"""Odd inputs and bounded steps of the fourth round's findings."""

import catalog
import numpy as np
import pytest
from catalog.check import compare
from tagsight.operators import neighbours as K
from tagsight.operators import ranking as R
from tagsight.operators import textmodels as T


def tables(path, **kept):
    """A folder of tables as the queries read them, and DuckDB over it."""
    import duckdb

    con = duckdb.connect()
    for name, df in kept.items():
        df.write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    return str(path), con


def test_prior_score_has_its_sql_s_rows_where_texts_hold_no_token(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 12))) for _ in range(60)] + [None, "", " \t\n", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path, con = tables(tmp_path, documents=docs)
    assert compare(spark, con, path, "w7_prior_score")[0] == "ok"
    assert compare(spark, con, path, "w7_prior_stats")[0] == "ok"
    assert catalog.QUERIES["w7_prior_score"](spark, path).count() == 61
    named = docs.selectExpr("string(doc_id) AS sample_id", "text")
    assert R.prior_score(named, R.token_prior(named)).count() == 64


@pytest.mark.parametrize("common", [0, 1, 2, 1000])
def test_equal_priors_deviate_by_nothing(spark, monkeypatch, common):
    monkeypatch.setattr(R, "COMMON", common)
    prior = {"x": 0.1, "y": 0.3, "z": 1e-9}
    texts = ["x x x", "y " * 11, "x x x y", "z x y y", "z", "unknown y", "y " * 6001 + "x"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "sample_id string, text string")
    got = R.prior_stats(docs, spark.createDataFrame(list(prior.items()), "token string, prior double"))
    for r in got.collect():
        p = [prior.get(w, 0.0) for w in texts[int(r["sample_id"])].split()]
        assert r["token_count"] == len(p) and r["prior_mu"] == pytest.approx(np.mean(p), abs=1e-12)
        assert r["prior_sigma"] == pytest.approx(np.std(p), abs=1e-12 if common > 1 or len(set(p)) > 1 else 1e-7)


def test_blocks_are_cut_by_terms_and_read_one_at_a_time(spark, monkeypatch):
    """What a task holds of stored blocks does not grow with the texts: a block has few terms, a row group few blocks."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(T, "BLOCK_ROWS", 50)
    monkeypatch.setattr(T, "BLOCK_TERMS", 40)
    monkeypatch.setattr(T, "BLOCK_FILES", {**T.BLOCK_FILES, "parquet.block.size": "64"})
    texts = [" ".join(f"w{i * j % 97}" for j in range(1, 3 + i % 9)) for i in range(120)] + [" ".join(f"v{j}" for j in range(60))]
    df = spark.createDataFrame([(str(i), "ab"[i % 2], t) for i, t in enumerate(texts)], "sample_id string, true_label string, text string")
    blocks = T.blocks_of(df, 1 << 12, label="true_label")
    sizes = [(len(b["y"]), len(b["places"])) for r in blocks.table.collect() for b in [T._opened(r.asDict())]]
    assert sum(n for n, _ in sizes) == 121 and all(terms <= 40 or n == 1 for n, terms in sizes) and any(n > 1 for n, _ in sizes)
    for path in blocks.table.inputFiles():
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        assert all(meta.row_group(i).num_rows == 1 for i in range(meta.num_row_groups))
        # a writer would hold the values themselves as each group's least and largest until its file ends
        assert all(meta.row_group(i).column(c).statistics is None for i in range(meta.num_row_groups) for c in range(5))
    seen = T.smooth_idf(blocks.total, 1 << 12, 0)
    df_of = np.zeros(1 << 12)
    for t in texts:
        df_of[T.hashed_text(t, 1 << 12)[0]] += 1
    assert np.allclose(seen[0], np.log(122 / (1 + df_of)) + 1, atol=1e-6)


def test_slopes_by_place_are_plain_sums(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(30)], n)) for n in (0, 1, 2, 40, 400, 70_000)]
    ends, places, counts = T.hashed_rows(texts, 64)
    b = {"y": np.zeros(len(texts), "<i4"), "ends": ends, "places": places, "counts": T._packed(counts)}
    ready = T._ready(b, np.ones((1, 64)))
    stored = T._opened({c: np.ascontiguousarray(ready[c]).tobytes() for c in T._KINDS if c in ready})
    assert stored["counts"].dtype == "<u2" and np.array_equal(stored["counts"], counts)
    slopes = rng.normal(size=(len(texts), 3)).astype("f4")
    want = np.zeros((64, 3))
    np.add.at(want, places, slopes[np.repeat(np.arange(len(texts)), np.diff(ends))] * counts[:, None])
    got = np.zeros((64, 3))
    got[stored["used"]] = T._backward(stored, slopes)
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)
    big = T._packed(np.array([1, 1 << 16], np.float32))
    assert big.dtype == "<f4" and list(T._opened({"places": bytes(8), "counts": big.tobytes()})["counts"]) == [1, 65536]


def test_boosting_sums_one_child_of_every_node(spark, monkeypatch):
    """The child with fewer rows is summed, the other one is what it leaves; the root's rows are counted once."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(12)]
    data = [(str(i), "abc"[i % 3], " ".join(rng.choice(words[i % 3 : i % 3 + 8], 6))) for i in range(90)]
    df = spark.createDataFrame(data, "sample_id string, true_label string, text string").repartition(3)
    one = T.fit_boost(T.blocks_of(df, 64, label="true_label"), rounds=3, least_rows=3)
    shapes, total = [], T.Blocks.total

    def seen(self, part, shape):
        shapes.append(shape)
        return total(self, part, shape)

    monkeypatch.setattr(T, "BLOCK_ROWS", 16)
    monkeypatch.setattr(T.Blocks, "total", seen)
    many = T.fit_boost(T.blocks_of(df, 64, label="true_label"), rounds=3, least_rows=3)
    assert [s[:3] for s in shapes if len(s) == 5] == [(3, 3, 1), (3, 3, 1), (3, 3, 2)] + 2 * [(2, 3, 1), (3, 3, 1), (3, 3, 2)]
    split = one.feature >= 0
    assert np.array_equal(one.feature, many.feature) and np.array_equal(one.cut[split], many.cut[split]) and np.abs(one.leaf - many.leaf).max() < 1e-5


def test_stored_codes_give_the_bins_that_the_trees_ask_for():
    feature = np.full((2, 1, 7), -1)
    feature[1, 0, :2] = 3, 1
    model = T.BoostModel(["a"], 4, None, None, np.zeros(1), 3, feature, np.zeros((2, 1, 7), np.int64), np.zeros((2, 1, 8)))
    stored = {"y": [0, 0], "ends": [0, 2, 3], "codes": [1 * 8 + 5, 2 * 8 + 1, 3 * 8 + 7], "z": [0.0, 0.0], "round": [1]}
    kinds = {**T._BOOST, "codes": "<u2"}
    b = T._opened({c: np.asarray(x, kinds[c]).tobytes() for c, x in stored.items()})
    trees = T._binned(b, model, 1)
    assert b["codes"].dtype == "<u2" and b["bins"].tolist() == [[5, 0], [0, 7]] and trees.feature[1, 0].tolist() == [1, 0, -1, -1, -1, -1, -1]


def test_a_query_is_copied_once_for_a_group_of_cells(spark, monkeypatch):
    """Vectors in no order leave nearly all cells open; what is moved is a copy for every group of blocks, not for every cell."""
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(400, 8))
    data = [(i, "abc"[i % 3], [float(x) for x in vecs[i]]) for i in range(400)]
    df = spark.createDataFrame(data, "sample_id bigint, true_label string, embedding array<float>")
    visits, blocked = [], K._blocked

    def seen(asked, *args, **kw):
        visits.append(asked.count())
        return blocked(asked, *args, **kw)

    def answer(**kw):
        out = K.topk_cosine(df, df, k=1, query_id="sample_id", pool_id="sample_id", query_vec="embedding", pool_vec="embedding",
                            query_label="true_label", pool_label="true_label", mode="other_label", **kw)
        return sorted(tuple(r) for r in out.select("q_id", "p_id", "score").collect())

    plain = answer(prune=False)
    links = K.threshold_links(df, threshold=0.9, prune=False).count()
    monkeypatch.setattr(K, "_blocked", seen)
    assert answer(prune=True, block_rows=50) == plain and len(plain) == 400
    assert max(visits) <= 400 * 4  # groups of about 200 rows
    visits.clear()
    assert (K.threshold_links(df, threshold=0.9, prune=True, block_rows=50).count() > 0) == (links > 0)
    assert max(visits) <= 400 * 4


def test_null_labels_and_few_rows_in_the_kernel(spark):
    data = [(0, None, [1.0, 0.0]), (1, "None", [1.0, 0.1]), (2, None, [1.0, 0.2]), (3, "x", [0.0, 1.0])]
    df = spark.createDataFrame(data, "sample_id bigint, true_label string, embedding array<double>")
    out = K.topk_cosine(df, df, k=3, query_id="sample_id", pool_id="sample_id", query_vec="embedding", pool_vec="embedding",
                        query_label="true_label", pool_label="true_label", mode="other_label")
    got = {}
    for r in out.collect():
        got.setdefault(r["q_id"], {})[r["place"]] = r["p_id"]
    assert got == {0: {1: 1, 2: 3}, 1: {1: 2, 2: 0, 3: 3}, 2: {1: 1, 2: 3}, 3: {1: 2, 2: 1, 3: 0}}


@pytest.mark.parametrize("k", [1, 3])
def test_tiles_of_the_pool_give_the_rows_of_the_whole(spark, monkeypatch, k):
    rng = np.random.default_rng(8)
    vecs = rng.integers(-2, 3, (60, 3))  # many equal cosines, which go to the smaller id
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "sample_id bigint, embedding array<double>")
    whole = sorted(tuple(r) for r in K.topk_similar(df, df, k=k, exclude_self=True).select("q_id", "p_id", "score", "place").collect())
    monkeypatch.setattr(K, "TILE_ROWS", 7)
    monkeypatch.setattr(K, "SLICE_ROWS", 11)
    tiles = sorted(tuple(r) for r in K.topk_similar(df, df, k=k, exclude_self=True).select("q_id", "p_id", "score", "place").collect())
    assert tiles == whole and len(whole) == 60 * k
    unit = vecs / np.maximum(1e-300, np.sqrt((vecs**2).sum(1, keepdims=True)))
    unit[~vecs.any(1)] = 0
    sims = np.round(unit @ unit.T, 12)
    for q, p, score, place in whole:
        order = sorted((-sims[q, j], j) for j in range(60) if j != q)
        assert order[place - 1][1] == p and score == pytest.approx(sims[q, p], abs=1e-12)


def test_a_pass_leaves_no_shuffle_files(spark, monkeypatch):
    from pathlib import Path

    from pyspark import SparkFiles

    monkeypatch.setattr(T, "BLOCK_ROWS", 8)
    monkeypatch.setattr(T, "PIECE", 16)
    df = spark.createDataFrame([(str(i), "ab"[i % 2], f"w{i} w{i % 5}") for i in range(60)], "sample_id string, true_label string, text string").repartition(3)
    blocks = T.blocks_of(df, 64, label="true_label")
    held = Path(SparkFiles.getRootDirectory()).parent.parent
    files = lambda: {f for d in held.glob("blockmgr-*") for f in d.rglob("shuffle_*.data")}
    spark.range(100).groupBy("id").count().collect()
    before = files()
    assert before  # the folder is the right one
    for _ in range(3):
        T.smooth_idf(blocks.total, 64, 0)
    assert not files() - before
