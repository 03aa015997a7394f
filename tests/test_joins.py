import numpy as np
import pandas as pd
import pytest

from coreline.functions.nullsafe import mean_lenient, mean_strict, sum_lenient, sum_strict
from coreline.operators import joins as J
from conftest import rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dimension_is_projected_and_collisions_are_refused(spark):
    fact = spark.createDataFrame([("a", 1), ("z", 2)], "site string, short int")
    dim = spark.createDataFrame([("a", 9, 7)], "site string, short int, year int")
    with pytest.raises(ValueError, match="short"):
        J.join_dim(fact, dim, "site", ["short"])
    got = rows(J.join_dim(fact, dim, "site", ["year"]), "site")
    assert got == [{"site": "a", "short": 1, "year": 7}, {"site": "z", "short": 2, "year": None}]


def test_broadcast_only_under_the_checked_size(spark):
    fact = spark.range(1000).withColumnRenamed("id", "k")
    dim = spark.range(50).selectExpr("id AS k", "id * 2 AS v")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(J.join_dim(fact, dim, "k", ["v"], max_rows=50))
        assert "SortMergeJoin" in plan(J.join_dim(fact, dim, "k", ["v"], max_rows=49))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_size_may_be_counted_on_a_cheaper_frame(spark):
    source = spark.range(10)
    dim = J.counted_by(source.selectExpr("id AS k"), source)
    assert J.at_most(dim, 10) and not J.at_most(dim, 9)


def skewed(spark, seed=3, n=900):
    """One key holds a third of the rows; one key is missing."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 60, n)).astype(object)
    key[rng.random(n) < 0.02] = None
    x = rng.normal(10, 3, n).round(3).astype(object)
    x[rng.random(n) < 0.01] = None
    frame = pd.DataFrame({"k": key, "x": x, "i": range(n)})
    data = [(None if a is None else int(a), None if b is None else float(b), int(i))
            for a, b, i in frame.itertuples(index=False)]
    return spark.createDataFrame(data, "k int, x double, i int"), pd.DataFrame(data, columns=["k", "x", "i"])


@pytest.mark.parametrize(
    "aggregate, brute",
    [
        (sum_strict, lambda v: v.sum(skipna=False)),
        (sum_lenient, lambda v: v.sum()),
        (mean_strict, lambda v: v.mean(skipna=False)),
        (mean_lenient, lambda v: v.mean()),
    ],
)
def test_group_total_on_every_row(spark, aggregate, brute):
    df, frame = skewed(spark)
    want = frame.assign(g=frame["k"].fillna(-1)).groupby("g")["x"].transform(brute)
    got = rows(J.attach_group_total(df, "k", aggregate, "x", "t"), "i")
    assert len(got) == len(frame)
    np.testing.assert_allclose(
        [np.nan if r["t"] is None else r["t"] for r in got], want.astype(float), rtol=1e-9
    )


@pytest.mark.parametrize("how", ["left", "right"])
def test_many_to_one_equals_plain_join(spark, how):
    many, _ = skewed(spark)
    one = spark.createDataFrame([(k, f"v{k}") for k in range(0, 90, 2)], "k int, v string")
    want = rows(many.join(one, "k", how), "i", "k")
    got = rows(J.join_many_to_one(many, one, "k", how), "i", "k")
    assert [(r["k"], r["x"], r["i"], r["v"]) for r in got] == [
        (r["k"], r["x"], r["i"], r["v"]) for r in want
    ]


@pytest.mark.parametrize("least", [1, 20, 1000])
def test_salted_right_join_equals_plain_join(spark, least, monkeypatch):
    many, frame = skewed(spark)
    one = spark.createDataFrame([(k, f"v{k}") for k in range(0, 90, 2)] + [(None, "none")], "k int, v string")
    monkeypatch.setattr(J, "HOT_KEYS", 10)
    hot = J.hot_keys(many, "k", least)
    assert hot is None or hot.count() <= 10
    assert (hot is None) == (least == 1000)
    want = rows(many.join(one, "k", "right").select("k", "x", "i", "v"), "i", "k")
    got = rows(J.join_many_to_one(many, one, "k", "right", least_hot=least), "i", "k")
    assert [(r["k"], r["x"], r["i"], r["v"]) for r in got] == [(r["k"], r["x"], r["i"], r["v"]) for r in want]


def test_right_join_shuffles_the_many_side_once_and_splits_a_hot_key(spark):
    many = spark.range(0, 60_000, 1, 8).selectExpr("IF(id % 3 = 0, 7, id) AS k", "id AS x")
    one = spark.range(0, 70_000, 1, 4).selectExpr("id AS k", "id % 5 AS v")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for least in (1_000, 100_000):
            out = J.join_many_to_one(many, one, "k", "right", least_hot=least)
            text = plan(out)
            assert text.count("Exchange hashpartitioning(k") == 2 and "SortMergeJoin" in text
            assert ("_salt" in text) == (least == 1_000)
            # 40,000 rows of own keys, 20,000 of key 7 beside its own, and keys without rows
            assert out.count() == 60_000 + 70_000 - 40_000 - (7 % 3 == 0)
            assert out.where("x IS NULL").count() == 70_000 - 40_000
        dealt = J.hot_keys(many, "k", 1_000).first()
        assert (dealt["_hot_key"], dealt["_salts"]) == (7, 21)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_many_to_one_refuses_other_joins(spark):
    with pytest.raises(ValueError):
        J.join_many_to_one(spark.range(1), spark.range(1), "id", "full")


def test_hot_join_key_is_split_adaptively(spark):
    """The mapping's slice-to-core join splits a core with a third of the rows."""
    from coreline.runtime import configure

    configure(spark)
    saved = {
        k: spark.conf.get(k)
        for k in (
            "spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
        )
    }
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20000")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
        many = spark.range(0, 60_000, 1, 8).selectExpr(
            "IF(id % 3 = 0, 7, id) AS core_no", "rand(1) AS x"
        )
        one = spark.range(0, 60_000, 1, 4).selectExpr("id AS core_no", "id % 5 AS site")
        out = many.join(one, "core_no").groupBy("core_no", "site").sum("x")
        assert len(out.collect()) == 40_000 + (7 % 3 == 0)
        assert "skew=true" in plan(out)
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
