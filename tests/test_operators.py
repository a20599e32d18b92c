"""Behaviour of the operators on small frames with known answers."""

import math
from fractions import Fraction

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagsight import schema as SC
from tagsight.functions import labels as L
from tagsight.functions import scores as S
from tagsight.operators import agreement as A
from tagsight.operators import batches as B
from tagsight.operators import calibration as C
from tagsight.operators import graph as G
from tagsight.operators import joins as J
from tagsight.operators import metrics as M
from tagsight.operators import ranking as R
from tagsight.operators import sampling as P
from tagsight.operators import votes as V


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# labels ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("raw, want", [
    ("4.0", "4"), (" a ", "a"), ("nan", None), ("None", None), ("?", None), ("", None), ("0", "0"), ("-3.0", "-3"), ("1.50", "1.50"), (None, None),
])
def test_norm_label(spark, raw, want):
    assert one(spark, L.norm_label(F.lit(raw).cast("string"))) == want


def test_norm_label_numeric(spark):
    assert one(spark, L.norm_label(F.lit(4.0), numeric=True)) == "4"
    assert one(spark, L.norm_label(F.lit(float("inf")), numeric=True)) is None
    assert one(spark, L.norm_label(F.lit(1e7), numeric=True)) == "10000000"


@pytest.mark.parametrize("gold, pred, want", [
    ("2", "methods", True), ("2", "2.0", True), ("0", "background", True), ("3", "method", False), ("conclusion", "4", True), ("0", None, False),
])
def test_ids_and_names_are_equal(spark, gold, pred, want):
    assert one(spark, L.labels_equal(F.lit(gold), F.lit(pred).cast("string"), L.RCT_DATASET)) is want


def test_duplicate_ids_are_refused(spark):
    df = spark.createDataFrame([("a",), ("a",)], "sample_id string")
    with pytest.raises(ValueError, match="duplicate"):
        SC.assert_unique(df)
    with pytest.raises(ValueError, match="missing required"):
        SC.validate_samples(df)


# scores ---------------------------------------------------------------------------------------------

CONFUSED = [("a", "a", False), ("a", None, True), ("b", "b", False), ("b", "a", False)]


def test_confused_rows(spark):
    df = spark.createDataFrame([("r", *x, 1) for x in CONFUSED], "run_id string, true_label string, pred_label string, is_confusing boolean, n_pred_labels int")
    r = M.performance_excluding_confused(df, ["run_id"]).first()
    assert (r["n_total"], r["n_confusing"], r["n_scored"]) == (4, 1, 3)
    assert r["accuracy"] == pytest.approx(2 / 3)
    assert r["f1_macro"] == pytest.approx((2 / 3 + 2 / 3) / 2)
    whole = M.performance_excluding_confused(df, []).first()
    assert whole["accuracy"] == pytest.approx(2 / 3)


def test_zero_and_multi(spark):
    df = spark.createDataFrame([(True, 0), (False, 1), (True, 2)], "is_confusing boolean, n_pred_labels int")
    r = M.confusion_stats(df, []).first()
    assert (r["n_zero_labels"], r["n_multi_labels"]) == (1, 1)


def test_empty_table_scores_zero(spark):
    df = spark.createDataFrame([], "true_label string, pred_label string")
    r = M.performance(df, []).first()
    assert (r["accuracy"], r["f1_macro"], r["n_scored"]) == (0.0, 0.0, 0)


def test_null_policy(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None)], "true_label string, pred_label string")
    assert M.performance(df, []).first()["accuracy"] == 1.0
    assert M.performance(df, [], null_policy="wrong").first()["accuracy"] == 0.5


def test_top_labels_tie_by_name(spark):
    df = spark.createDataFrame([(x,) for x in "b" * 5 + "a" * 5 + "c" * 10], "true_label string")
    assert [r["label"] for r in M.top_labels(df, 3).collect()] == ["c", "a", "b"]


def test_zero_confidence_is_in_the_first_bin(spark):
    df = spark.createDataFrame([(0.0, "a", "a"), (0.05, "a", "b"), (1.0, "a", "a")], "confidence double, true_label string, pred_label string")
    assert rows(C.calibration_bins(df, []), "bin", "n") == [(1, 2), (10, 1)]


@pytest.mark.parametrize("b, c, want", [
    (220, 323, 1.1356105697e-05), (222, 261, 0.08369209626574622), (0, 0, 1.0), (0, 3, 0.25), (5, 5, 1.0), (0, 2000, 2 * 0.5**2000),
])
def test_sign_test_p_values(spark, b, c, want):
    got = one(spark, S.binomial_two_sided(F.lit(b).cast("bigint"), F.lit(c).cast("bigint")))
    assert got == pytest.approx(want, rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("b, c", [(50_200, 49_000), (300_000, 300_900), (7, 150_000), (1, 40), (16, 17), (15, 31)])
def test_sign_test_against_exact_sums(spark, b, c):
    n, k, terms, term = b + c, min(b, c), 0, 1
    for i in range(k + 1):
        terms += term
        term = term * (n - i) // (i + 1)
    want = float(Fraction(2 * terms, 1 << n)) if n < 1000 else None
    if want is None:
        scale = (terms.bit_length() - 200) if terms.bit_length() > 200 else 0
        want = math.exp(math.log(terms >> scale) + (scale + 1 - n) * math.log(2))
    got = one(spark, S.binomial_two_sided(F.lit(b).cast("bigint"), F.lit(c).cast("bigint")))
    assert got == pytest.approx(want, rel=1e-9, abs=1e-300)


# agreement ------------------------------------------------------------------------------------------

TWO_RUNS = [("a", "s1", "A", "A"), ("a", "s2", "A", "A"), ("a", "s3", "B", "B"), ("b", "s2", "A", "A"), ("b", "s3", "B", "A"), ("b", "s4", "B", "B")]


def two_runs(spark):
    return spark.createDataFrame([(*x[:2], "d", "t", *x[2:]) for x in TWO_RUNS], "run_id string, sample_id string, dataset_name string, text string, true_label string, pred_label string")


def test_compare_two_overlapping_runs(spark):
    df = two_runs(spark)
    assert rows(J.compare_runs_wide(df, ["a", "b"]), "sample_id") == [("s2",), ("s3",)]
    assert J.compare_runs_wide(df, ["a", "b"], "outer").count() == 4
    assert rows(A.disagreements(df), "sample_id") == [("s3",)]
    assert A.agreement_matrix(df).filter("run_a = 'a' AND run_b = 'b'").first()["agreement"] == 0.5
    mixed = df.withColumn("dataset_name", F.col("run_id"))
    assert J.compare_runs_wide(mixed, ["a", "b"]).count() == 0


def test_names_agree_with_ids(spark):
    data = [("ids", "s1", "2", "2"), ("ids", "s2", "4", "4"), ("names", "s1", "2", "methods"), ("names", "s2", "4", "Conclusions")]
    df = spark.createDataFrame(data, "run_id string, sample_id string, true_label string, pred_label string")
    m = A.agreement_matrix(df, dataset=L.RCT_DATASET)
    assert {r["agreement"] for r in m.collect()} == {1.0}


def test_agreement_is_symmetric_and_kappa_null_when_certain(spark):
    df = two_runs(spark)
    m = {(r["run_a"], r["run_b"]): r["agreement"] for r in A.agreement_matrix(df).collect()}
    assert all(m[a, b] == m[b, a] for a, b in m)
    same = spark.createDataFrame([(r, s, "A", "A") for r in "xy" for s in "12"], "run_id string, sample_id string, true_label string, pred_label string")
    assert A.cohen_kappa(same).first()["kappa"] is None


def test_nulls_are_ignored_in_diffs(spark):
    df = spark.createDataFrame([("a", "s1", None), ("b", "s1", "x"), ("c", "s1", "x")], "run_id string, sample_id string, pred_label string")
    assert A.disagreements(df, raw=True).count() == 0


@pytest.mark.parametrize("policy, want", [
    ("lexicographic", "a"), ("first_seen", "b"), ("tie_marker", "TIE"), ("confusing", "confusing"), ("confidence", "b"), ("unanimous", "confusing"),
])
def test_vote_ties(spark, policy, want):
    df = spark.createDataFrame([("i", "b", 0.9, 1), ("i", "a", 0.1, 2), ("i", "error", 0.5, 3)], "item string, label string, conf double, seq int")
    df = df.filter("label <> 'error'") if policy not in ("confusing", "unanimous") else df
    got = V.majority_vote(df, ["item"], tie_policy=policy, confidence="conf", order="seq").first()
    assert got["vote"] == want


def test_vote_metrics_of_a_split(spark):
    df = spark.createDataFrame([("i", "a"), ("i", "a"), ("i", "b"), ("i", None), ("j", None)], "sample_id string, pred_label string")
    got = {r["sample_id"]: r for r in V.vote_metrics(df, ["sample_id"]).collect()}
    i, j = got["i"], got["j"]
    h = -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)) / math.log(2)
    assert (i["n_models"], i["n_nonempty"], i["majority_label"]) == (4, 3, "a")
    assert i["entropy"] == pytest.approx(h) and i["vote_margin"] == pytest.approx(1 / 3)
    assert (j["n_nonempty"], j["majority_label"], j["entropy"], j["disagree_any"]) == (0, "", 0.0, False)


def test_components_of_a_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(0, i) for i in range(n + 2)], "g int, id bigint")
    edges = spark.createDataFrame([(0, a, b) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))], "g int, src bigint, dst bigint")
    got = {r["id"]: r["component"] for r in G.connected_components(nodes, edges, group=["g"]).collect()}
    assert {got[i] for i in range(n)} == {0} and got[n] == n and got[n + 1] == n + 1


# sampling -------------------------------------------------------------------------------------------

def labelled(spark, **sizes):
    data = [(f"{k}{i}", "d", f"t{i}", k) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "sample_id string, dataset_name string, text string, true_label string")


def test_take_is_deterministic_and_proportional(spark):
    df = labelled(spark, a=120, b=60, c=20)
    first = rows(P.stratified_take(df, 20, seed=1), "sample_id")
    assert first == rows(P.stratified_take(df.repartition(7), 20, seed=1), "sample_id")
    assert first != rows(P.stratified_take(df, 20, seed=2), "sample_id") and len(first) == 20
    big = P.stratified_take(labelled(spark, a=700, b=200, c=100), 100, seed=1)
    assert rows(big.groupBy("true_label").count()) == [("a", 70), ("b", 20), ("c", 10)]


def test_take_edge_cases(spark):
    assert P.stratified_take(labelled(spark, a=10), 5, seed=1).count() == 5
    assert P.stratified_take(labelled(spark, a=10, b=2), 50, seed=1).count() == 12
    assert P.stratified_take(labelled(spark, a=10), 0, seed=1).count() == 0
    with pytest.raises(ValueError):
        P.stratified_take(labelled(spark, a=10), -1, seed=1)


@pytest.mark.parametrize("sizes, n", [({"a": 1000, "b": 1, "c": 1}, 5), ({"a": 3, "b": 3}, 5), ({"a": 1, "b": 1, "c": 98}, 3), ({"x": 7, "y": 2}, 9)])
def test_quotas_add_up(sizes, n):
    q = P.proportional_quotas(sizes, n)
    assert sum(q.values()) == n and all(q[k] <= sizes[k] for k in sizes)
    if n >= len(sizes):
        assert min(q.values()) >= 1


def test_vault_tiers_are_disjoint(spark):
    df = labelled(spark, a=70, b=20, c=10)
    train, test, status = P.build_seed_vault(df, df, seed=3, train_tiers=[30, 10], test_tiers=[20, 5000])
    assert rows(train.groupBy("tier").count()) == [(10, 10), (30, 30), (None, 60)]
    assert train.select("sample_id").distinct().count() == 100
    assert status == {"train_seed_10": "ok", "train_seed_30": "ok", "test_20": "ok", "test_5000": "clipped"}
    assert rows(test.groupBy("tier").count()) == [(20, 20), (5000, 100)]
    with pytest.raises(ValueError):
        P.build_seed_vault(df, df, seed=3, train_tiers=[101], test_tiers=[5])


def test_swap_overlap_keeps_val(spark):
    df = labelled(spark, a=20, b=20)
    train = df.filter("sample_id IN ('a1', 'a2', 'b1')")
    val = df.filter("sample_id IN ('a1', 'b1', 'b2')")
    got = {r[0] for r in P.swap_overlap(train, val, df, labels=["a", "b"], seed=1).collect()}
    assert "a2" in got and not got & {"a1", "b1", "b2"} and len(got) == 3


def test_balanced_batches_are_mixed(spark):
    b = B.label_balanced_batches(labelled(spark, a=30, b=30), 5, seed=1)
    per = b.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_distinct("true_label").alias("k")).collect()
    assert len(per) == 12 and all(r["n"] == 5 for r in per) and sum(r["k"] == 2 for r in per) >= 10
    assert b.select("sample_id").distinct().count() == 60


def test_unequal_batches_fail(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"])], "gold array<string>, pred array<string>")
    with pytest.raises(Exception, match="differ in length"):
        B.flatten_batches(df).collect()


@pytest.mark.parametrize("total, n", [(10, 3), (2, 5), (0, 4), (9, 3)])
def test_call_tokens_are_preserved(spark, total, n):
    df = spark.range(n).select(S.call_share(F.lit(total), F.col("id"), F.lit(n)).alias("t"))
    got = [r["t"] for r in df.collect()]
    assert sum(got) == total and sorted(got, reverse=True) == got


def test_quintiles_match_equal_frequency_bins(spark):
    for n in (10, 11, 12, 23, 50):
        df = spark.range(n).select(F.col("id").cast("string").alias("i"), (F.col("id") * 1.5).alias("s"))
        got = R.quintiles(df, by=[], score="s", id_col="i").orderBy("s").collect()
        edges = [(n - 1) * k / 5 for k in range(1, 6)]
        want = [next(k for k, e in enumerate(edges, 1) if i <= e + 1e-12) for i in range(n)]
        assert [r["quantile"] for r in got] == want


def test_robust_z_falls_back(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (1.0, 5.0), (1.0, 2.0)], "flat double, spiky double")
    got = R.robust_z(df, ["flat", "spiky"]).collect()
    assert {r["flat_z"] for r in got} == {0.0}
    assert max(r["spiky_z"] for r in got) == pytest.approx(3 / math.sqrt(27 / 16))


def test_long_context_is_refused(spark):
    df = spark.createDataFrame([("k", 1, "abc"), ("k", 2, "def")], "key string, pos int, text string")
    assert {r["context"] for r in J.group_context(df, "key", "pos").collect()} == {"abc def"}


def test_missing_id_in_order(spark):
    df = labelled(spark, a=3)
    assert [r["sample_id"] for r in J.select_in_order(df, ["a2", "a0"]).collect()] == ["a2", "a0"]
    with pytest.raises(KeyError):
        J.select_in_order(df, ["zz"])


def test_leaderboard_merge_keeps_zero_f1(spark):
    df = spark.createDataFrame([("k", "legacy", 0.9, 0), ("k", "harness_report", 0.0, 1), ("", "legacy", 0.5, 2)], "run_key string, format string, f1_macro double, source_order int")
    got = R.merge_leaderboard(df).collect()
    assert len(got) == 1 and got[0]["f1_macro"] == 0.0


def many_runs(spark, n_runs, n_samples):
    import random

    rng = random.Random(5)
    data = [(f"r{r:04}", s, rng.choice("ABC"), rng.choice(["A", "B", "C", None])) for r in range(n_runs) for s in range(n_samples)]
    gold = {s: rng.choice("ABC") for s in range(n_samples)}
    data = [(r, s, gold[s], p) for r, s, _, p in data]
    return data, spark.createDataFrame(data, "run_id string, sample_id long, true_label string, pred_label string")


def test_runs_beyond_one_block_agree_with_plain_counts(spark):
    data, df = many_runs(spark, 37, 9)
    pred = {(r, s): p for r, s, _, p in data}
    gold = {s: t for _, s, t, _ in data}
    names = sorted({r for r, *_ in data})
    got = {(r["run_a"], r["run_b"]): r["agreement"] for r in A.agreement_matrix(df).collect()}
    tests = {(r["run_a"], r["run_b"]): (r["both_correct"], r["a_only"], r["b_only"], r["both_wrong"]) for r in A.mcnemar(df, common="pair").collect()}
    for a in names:
        for b in names:
            both = [s for s in gold if pred[a, s] and pred[b, s]]
            if both:
                want = 1.0 if a == b else sum(pred[a, s] == pred[b, s] for s in both) / len(both)
                assert abs(got[a, b] - want) < 1e-12
                ok = [(pred[a, s] == gold[s], pred[b, s] == gold[s]) for s in both]
                if a < b:
                    assert tests[a, b] == tuple(ok.count(x) for x in ((True, True), (True, False), (False, True), (False, False)))
    full = [(r, s, t, "A" if p is None else p) for r, s, t, p in data if s < 8] + [("r0000", 8, "A", "A")]
    whole = spark.createDataFrame(full, df.schema)
    assert {r["n_common"] for r in A.cohen_kappa(whole).collect()} == {8}  # the ninth sample has one run only


def test_five_hundred_runs(spark):
    _, df = many_runs(spark, 500, 2)
    m = A.agreement_matrix(df.fillna("A", ["pred_label"]))
    assert m.count() == 250_000
    assert m.filter("run_a = run_b AND agreement <> 1").count() == 0


def test_a_hub_and_a_chain_are_one_component_each(spark):
    from tagsight.operators.graph import connected_components

    n = 100_000
    hub = spark.range(1, n).select(F.lit(0).alias("g"), F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(n, n + 63).select(F.lit(0).alias("g"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    one = hub.unionByName(chain)
    edges = one.unionByName(one.select("g", F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = spark.range(n + 65).select(F.lit(0).alias("g"), "id")
    got = connected_components(nodes, edges, group=["g"]).groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in got} == {(0, n), (n, 64), (n + 64, 1)}


def test_spread_lookup_is_a_join(spark):
    from tagsight.plans.spread import spread_lookup

    rows_ = spark.createDataFrame([(i, "hot" if i % 3 else str(i % 7)) for i in range(300)] + [(900, None), (901, "gone")], "id long, key string")
    table = spark.createDataFrame([("hot", 1), ("0", 2), ("3", 3)], "key string, v int")
    for how in ("left", "inner"):
        got = spread_lookup(rows_, table, ["key"], by=["id"], how=how).select("id", "key", "v").collect()
        assert sorted(got, key=str) == sorted(rows_.join(table, "key", how).select("id", "key", "v").collect(), key=str)
