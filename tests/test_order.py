"""Distributed ranks against brute force, with a third of all rows in one group or one value."""

import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagsight.plans import order as O


@pytest.fixture(scope="module")
def skewed(spark):
    data = []
    for i in range(1200):
        group = "hot" if i % 3 == 0 else f"g{i % 7}"
        score = 5.0 if i % 3 == 1 else float((i * 37) % 101) / 4
        data.append((f"id{i}", group, None if i % 50 == 0 else score))
    return data, spark.createDataFrame(data, "sample_id string, g string, score double")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("prefix", [0, 1, 2, 3])
def test_md5_rank(skewed, prefix):
    data, df = skewed
    got = {r["sample_id"]: r["r"] for r in O.md5_rank(df, by=["g"], seed=7, out="r", prefix=prefix).collect()}
    for g in {d[1] for d in data}:
        ids = sorted((d[0] for d in data if d[1] == g), key=lambda x: (md5(f"7|{x}"), x))
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("prefix", [0, 1, 3])
def test_md5_take(spark, skewed, prefix):
    data, df = skewed
    quotas = {"hot": 137, "g1": 3, "g2": 0, "g3": 10_000}
    table = spark.createDataFrame(list(quotas.items()), "g string, quota bigint")
    got = {r[0] for r in O.md5_take(df, table, by=["g"], seed=7, prefix=prefix).select("sample_id").collect()}
    want = set()
    for g, q in quotas.items():
        want |= set(sorted((d[0] for d in data if d[1] == g), key=lambda x: (md5(f"7|{x}"), x))[:q])
    assert got == want


def test_md5_head_both_ways(skewed):
    _, df = skewed
    few = rows(O.md5_head(df, 99, seed=3), "sample_id")
    assert few == rows(O.md5_head(df, 99, seed=3, top_rows=10), "sample_id")
    assert len(few) == 99


@pytest.mark.parametrize("edges", [2, 5, 32])
def test_value_ranks_with_hot_value(skewed, edges):
    data, df = skewed
    got = {r["sample_id"]: r for r in O.value_ranks(df, by=["g"], value="score", id_col="sample_id", edges=edges).collect()}
    assert len(got) == len(data)
    for g in {d[1] for d in data}:
        part = sorted(((d[2], md5(d[0]), d[0]) for d in data if d[1] == g and d[2] is not None))
        for i, (score, _, sid) in enumerate(part, 1):
            same = [k for k, x in enumerate(part, 1) if x[0] == score]
            assert got[sid]["row_rank"] == i
            assert got[sid]["avg_rank"] == pytest.approx(sum(same) / len(same))
            assert got[sid]["n_group"] == len(part)
    assert all(got[d[0]]["row_rank"] is None for d in data if d[2] is None)


def test_exact_quantiles(skewed):
    import numpy as np

    data, df = skewed
    probs = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    for r in O.exact_quantiles(df, by=["g"], value="score", probs=probs, edges=4).collect():
        vals = [d[2] for d in data if d[1] == r["g"] and d[2] is not None]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(vals, p))


def test_partitioning_does_not_change_results(skewed):
    _, df = skewed
    one = rows(O.md5_rank(df.coalesce(1), by=[], seed=1, out="r"), "sample_id", "r")
    assert one == rows(O.md5_rank(df.repartition(8), by=[], seed=1, out="r"), "sample_id", "r")


def test_no_window_without_buckets(skewed):
    """The row-level window of a ranked table is partitioned by the md5 bucket, not by the group alone."""
    _, df = skewed
    plan = O.md5_rank(df, by=["g"], seed=7)._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert wide and all("_pfx" in line.split("], [")[1] for line in wide)


def test_null_group(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "sample_id string, g string")
    assert sorted(r["r"] for r in O.md5_rank(df, by=["g"], seed=1, out="r").collect()) == [1, 1, 2]
    assert df.filter(F.col("g").isNull()).count() == 2
