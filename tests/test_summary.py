import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coreline.functions.nullsafe import mean_strict, sum_strict
from coreline.operators import summary as S
from conftest import rows


def test_policy_is_required_and_checked(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, x double")
    with pytest.raises(TypeError):
        S.mean_se(df, "k", "x")
    with pytest.raises(ValueError):
        S.mean_se(df, "k", "x", "whatever")
    with pytest.raises(ValueError):
        S.group_sum(df, "k", "x", "mixed")


@pytest.mark.parametrize(
    "policy, mean, sd", [("lenient", 2.0, 2 ** 0.5), ("strict", None, None), ("mixed", 2.0, None)]
)
def test_policies(spark, policy, mean, sd):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    got = S.mean_se(df, [], "x", policy).collect()[0]
    assert (got.av, got.sd, got.n) == (mean, pytest.approx(sd) if sd else None, 3)


def test_rounding_is_sequential(spark):
    df = spark.createDataFrame([(1.0,), (1.1,), (1.25,)], "x double")
    got = S.mean_se(df, [], "x", "lenient", digits=1).collect()[0]
    assert got.sd == 0.1 and got.se == 0.1  # 0.1 / sqrt(3) = 0.0577
    got = S.multi_measure(df, [], {"x": 2}, "mixed", round_sd=True).collect()[0]
    assert got.sd_x == 0.13 and got.se_x == 0.08
    got = S.multi_measure(df, [], {"x": 2}, "mixed").collect()[0]
    assert got.sd_x != 0.13 and got.se_x == 0.07


def test_two_level(spark):
    df = spark.createDataFrame(
        [("s", "c1", 1.0), ("s", "c1", 2.0), ("s", "c2", 5.0), ("s", "c3", None), ("s", "c3", 1.0)],
        "site string, core string, x double",
    )
    got = S.two_level(df, ["site", "core"], "site", "x", "strict", "lenient").collect()[0]
    assert (got.av, got.n) == (4.0, 3)
    got = S.two_level(df, ["site", "core"], "site", "x", "lenient", "lenient").collect()[0]
    assert got.av == 3.0


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, x double")
    got = rows(S.mean_se(df, "k", "x", "lenient"), "k")
    assert [(r["k"], r["av"]) for r in got] == [(None, 2.0), ("a", 5.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_moments_equal_attaching_to_every_row(spark, seed):
    rng = np.random.default_rng(seed)
    n = 600
    # one core holds a third of all rows
    core = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    frame = pd.DataFrame({"site": core % 4, "core": core, "x": rng.normal(50, 9, n), "p": rng.random(n)})
    frame.loc[rng.random(n) < 0.01, "x"] = np.nan
    frame.loc[rng.random(n) < 0.05, "p"] = np.nan
    df = spark.createDataFrame(frame).replace(float("nan"), None)

    total = frame.groupby("core")["x"].transform(lambda v: v.sum(skipna=False))
    frame["value"] = total * frame["p"]
    want = frame.groupby("site")["value"].agg(["mean", "std", "size"])
    moments = S.group_moments(df, ["site", "core"], "p", total=sum_strict("x"))
    got = rows(S.merge_moments(moments, "site", "total"), "site")
    assert [r["n"] for r in got] == want["size"].tolist()
    np.testing.assert_allclose([r["av"] for r in got], want["mean"], rtol=1e-10)
    np.testing.assert_allclose([r["sd"] for r in got], want["std"], rtol=1e-8)

    frame["value"] = frame.groupby("core")["x"].transform(lambda v: v.mean(skipna=False))
    want = frame.groupby("site")["value"].agg(["mean", "std", "size"])
    moments = S.group_moments(df, ["site", "core"], total=mean_strict("x"))
    got = rows(S.merge_moments(moments, "site", F.col("total")), "site")
    np.testing.assert_allclose([r["av"] for r in got], want["mean"], rtol=1e-10)
    np.testing.assert_allclose([r["sd"] for r in got], want["std"], rtol=1e-8)


@pytest.mark.parametrize("mean", [0.0, 1e6, 1e8, 1e9])
def test_moments_keep_the_spread_beside_a_large_mean(spark, mean):
    df = spark.range(100_000).selectExpr("id % 3 AS site", "id % 300 AS core", f"{mean!r}D + rand(5) AS p", "1.0D AS one")
    moments = S.group_moments(df, ["site", "core"], "p", one=F.max("one"))
    got = rows(S.merge_moments(moments, "site", "one"), "site")
    frame = df.select("site", (F.col("p") - F.lit(mean)).alias("d")).toPandas()  # exact differences
    want = frame.groupby("site")["d"].agg(["mean", "std"])
    # beside 1e9 a double holds the fraction to 1e-7 only
    np.testing.assert_allclose([r["sd"] for r in got], want["std"], rtol=2e-8 if mean > 1e8 else 1e-9)
    np.testing.assert_allclose([r["av"] for r in got], mean + want["mean"], rtol=1e-12)


def test_moments_with_nothing_present(spark):
    df = spark.createDataFrame([("s", "c", None, 1.0), ("s", "c", 2.0, None)],
                               "site string, core string, x double, p double")
    moments = S.group_moments(df, ["site", "core"], "p", total=sum_strict("x"))
    got = S.merge_moments(moments, "site", "total").collect()[0]
    assert (got.av, got.sd, got.n, got.se) == (None, None, 2, None)


def test_attach_range_and_band(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,)], "x double")
    got = S.attach_range(df, "x").collect()
    assert {(r.min_x, r.max_x) for r in got} == {(1.0, 5.0)} and len(got) == 3
    band = S.reference_band(df.withColumnRenamed("x", "av")).collect()[0]
    assert (band.band_lo, band.band_hi, band.groups) == (1.0, 5.0, 3)
    lo_hi = S.bounds(spark.createDataFrame([(4.0, 1.5)], "av double, se double")).collect()[0]
    assert (lo_hi.lo, lo_hi.hi) == (2.5, 5.5)
    assert S.value_range(df, ["x"]).collect()[0].asDict() == {"min_x": 1.0, "max_x": 5.0}


def test_weighted_summary_under_several_weights(spark):
    df = spark.createDataFrame([(1.0, 1.0), (4.0, 3.0), (None, 9.0)], "x double, w double")
    got = S.weighted_summary(df, [], "x", also={"by_w": "w"}).collect()[0]
    assert (got.av, got.by_w, got.n) == (2.5, 3.25, 3)
