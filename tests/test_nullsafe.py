import math

from pyspark.sql import functions as F

from coreline.functions import nullsafe as N
from coreline.functions import tdist
from coreline.operators import reshape
from coreline.operators.summary import group_ratio, mean_se, percent_of
from conftest import rows


def one(df, **columns):
    return df.agg(*[c.alias(k) for k, c in columns.items()]).collect()[0].asDict()


def values(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x double")


def test_strict_and_lenient_aggregates(spark):
    got = one(
        values(spark, 1.0, None, 3.0),
        strict=N.sum_strict("x"), lenient=N.sum_lenient("x"),
        mean_s=N.mean_strict("x"), mean_l=N.mean_lenient("x"),
        sd_s=N.sd_strict("x"), sd_l=N.sd_lenient("x"), n=N.n_rows(),
    )
    assert got == {
        "strict": None, "lenient": 4.0, "mean_s": None, "mean_l": 2.0,
        "sd_s": None, "sd_l": math.sqrt(2.0), "n": 3,
    }


def test_strict_equals_lenient_without_missing_values(spark):
    got = one(values(spark, 1.0, 2.0, 6.0), a=N.sum_strict("x"), b=N.sum_lenient("x"),
              c=N.mean_strict("x"), d=N.mean_lenient("x"))
    assert got["a"] == got["b"] == 9.0 and got["c"] == got["d"] == 3.0


def test_lenient_sum_of_nothing_is_zero_and_strict_is_missing(spark):
    got = one(values(spark, None, None), a=N.sum_lenient("x"), b=N.sum_strict("x"), c=N.mean_lenient("x"))
    assert got == {"a": 0.0, "b": None, "c": None}


def test_sd_of_one_row_is_missing_but_n_counts_all_rows(spark):
    got = mean_se(values(spark, 5.0), [], "x", "lenient").collect()[0]
    assert (got.av, got.sd, got.n, got.se) == (5.0, None, 1, None)


def test_se_divides_by_all_rows(spark):
    got = mean_se(values(spark, 1.0, 3.0, None, None), [], "x", "lenient").collect()[0]
    assert got.n == 4 and math.isclose(got.se, math.sqrt(2.0) / 2.0)


def test_choice_is_missing_where_condition_is(spark):
    df = values(spark, 0.0, 2.0, None)
    got = [r.y for r in df.select(N.ifelse_na(F.col("x") == 0, F.lit(1.0), F.lit(2.0)).alias("y")).collect()]
    assert got == [1.0, 2.0, None]


def test_tolerant_number(spark):
    df = spark.createDataFrame([("1980A",), ("1980",), ("BP",), (None,)], "t string")
    assert [r.y for r in df.select(N.try_number("t").alias("y")).collect()] == [None, 1980.0, None, None]


def test_weighted_mean_skips_missing_and_defaults_to_plain_mean(spark):
    df = spark.createDataFrame([(1.0, 1.0), (4.0, 3.0), (None, 5.0)], "x double, w double")
    got = one(df, plain=N.weighted_mean("x"), weighted=N.weighted_mean("x", "w"))
    assert got == {"plain": 2.5, "weighted": 13.0 / 4.0}


def test_split_pads_missing_and_drops_extra_pieces(spark):
    df = spark.createDataFrame([("A_1_x",), ("B",), (None,)], "k string")
    got = rows(reshape.split_key(df, "k", ["site", "number"]), "k")
    assert [(r["site"], r["number"]) for r in got] == [(None, None), ("A", "1"), ("B", None)]


def test_split_can_replace_its_source(spark):
    df = spark.createDataFrame([("A_1",)], "site string")
    assert reshape.split_key(df, "site", ["site", "n"], keep=False).collect()[0].asDict() == {"site": "A", "n": "1"}
    df = spark.createDataFrame([("A.1",)], "k string")
    assert reshape.split_key(df, "k", ["a", "b"], sep=".", keep=False).collect()[0].asDict() == {"a": "A", "b": "1"}


def test_mean_and_se_text(spark):
    df = spark.createDataFrame([(1.0, 0.25), (100.0, None), (None, 2.5)], "a double, s double")
    got = [r.t for r in reshape.unite_pm(df, "t", "a", "s", 2).collect()]
    assert got == ["1 ± 0.25", "100 ± NA", "NA ± 2.5"]
    df = spark.createDataFrame([(100.0, 20.0)], "a double, s double")
    assert reshape.unite_pm(df, "t", "a", "s", 0).collect()[0].t == "100 ± 20"


def test_fill_zero_hits_null_and_nan_in_numbers_only(spark):
    df = spark.createDataFrame([(None, float("nan"), None)], "a double, b double, c string")
    assert reshape.fill_zero(df).collect()[0].asDict() == {"a": 0.0, "b": 0.0, "c": None}


def test_unlisted_levels_become_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "k string")
    got = rows(reshape.level_order(df, "k", ["b", "a"]), "level_idx", "k")
    assert [(r["k"], r["level_idx"]) for r in got] == [(None, None), (None, None), ("b", 1), ("a", 2)]


def test_repeated_names_select_once(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert reshape.select_distinct_names(df, "b", "a", "b").columns == ["b", "a"]


def test_unpivot_and_tagged_union(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0)], "site string, a double, b double")
    got = rows(reshape.unpivot_measures(df, ["site"], ["a", "b"]), "measure")
    assert [(r["measure"], r["value"]) for r in got] == [("a", 1.0), ("b", 2.0)]
    part = spark.createDataFrame([("s", 3.0), ("s", 3.0)], "site string, av double")
    both = reshape.mirror(reshape.tagged_union({"Plant": part, "Soil": part}), "Soil")
    assert sorted(r.av for r in both.collect()) == [-3.0, -3.0, 3.0, 3.0]


def test_ratio_addresses_groups_by_key(spark):
    df = spark.createDataFrame([("A", 2.0), ("B", 8.0), ("C", 100.0)], "k string, x double")
    got = group_ratio(df, "k", "x", "A", "B").collect()[0]
    assert (got.percent, got.times, got.difference) == (25.0, 4.0, 6.0)


def test_percent_of_zero_reference_is_missing(spark):
    ref = spark.createDataFrame([(0.0,)], "av double")
    assert percent_of(values(spark, 1.0), "x", ref).collect()[0].percent is None


def two_sided_p(spark, *pairs):
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pairs)], "i int, t double, df double")
    return [r.p for r in df.select("i", tdist.t_two_sided_p("t", "df").alias("p")).orderBy("i").collect()]


def quantile(spark, *pairs):
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pairs)], "i int, p double, df double")
    return [r.q for r in df.select("i", tdist.t_quantile("p", "df").alias("q")).orderBy("i").collect()]


def test_t_probabilities(spark):
    # T, df and p of a published fit
    got = two_sided_p(spark, (2.973, 7.048), (3.356, 7.002), (0.0, 3.0), (2.0, 5.0), (-2.0, 5.0))
    assert abs(got[0] - 0.0206) < 5e-5 and abs(got[1] - 0.0121) < 5e-5
    assert got[2] == 1.0 and abs(got[3] - 0.10193947) < 1e-7 and got[4] == got[3]
    got = quantile(spark, (0.975, 10), (0.975, 1e9), (0.025, 10), (0.5, 3))
    assert abs(got[0] - 2.228138851964939) < 1e-9
    assert abs(got[1] - 1.959963984540054) < 1e-6
    assert abs(got[2] + 2.228138851964939) < 1e-9
    assert got[3] == 0.0


def test_t_probabilities_of_odd_arguments(spark):
    df = spark.createDataFrame([(None, 5.0), (1.0, -1.0), (1.0, 0.0), (1.0, None)], "t double, df double")
    odd = [r.p for r in df.select(tdist.t_two_sided_p("t", "df").alias("p")).collect()]
    assert odd == [None] * 4
    nan = float("nan")
    assert two_sided_p(spark, (nan, 5), (1, nan), (float("inf"), 2), (1e300, 3)) == [None, None, 0.0, 0.0]
    assert quantile(spark, (0, 3), (1, 3), (nan, 3), (0.9, nan), (0.9, 0)) == [None] * 5
    # far tails, and a law whose quantile no number holds
    far = quantile(spark, (1e-300, 1e9), (1 - 1e-9, 1), (1 - 2**-53, 0.1))
    assert abs(far[0] + 37.0471) < 1e-3 and abs(far[1] / 318309886.18 - 1) < 1e-6 and far[2] == float("inf")


def test_t_law_of_few_degrees_matches_its_closed_forms(spark):
    import math

    ts = [1e-6, 0.1, 1.0, 7.5, 300.0, 1e6]
    got = two_sided_p(spark, *[(t, 1) for t in ts], *[(t, 2) for t in ts])
    cauchy = [2 / math.pi * math.atan2(1.0, t) for t in ts]
    two = [2.0 / (math.sqrt(2.0 + t * t) * (math.sqrt(2.0 + t * t) + t)) for t in ts]
    assert all(abs(a / b - 1) < 1e-12 for a, b in zip(got, cauchy + two, strict=True))


def test_t_law_has_no_step_in_df(spark):
    import numpy as np

    df = np.geomspace(1e2, 1e12, 400)
    for values in (two_sided_p(spark, *[(2.0, x) for x in df]), quantile(spark, *[(0.975, x) for x in df])):
        assert (np.diff(values) <= 1e-12).all()
    # a normal law is reached, never switched to: the gap is (z**3 + z) / (4 df)
    z = 1.959963984540054
    large = np.geomspace(1e3, 1e8, 60)
    gap = np.array(quantile(spark, *[(0.975, x) for x in large])) - z
    np.testing.assert_allclose(gap * large, (z**3 + z) / 4, rtol=0.01)
    # Exact quantiles for few degrees of freedom
    exact = [12.706204736432095, 4.302652729911275, 3.182446305284263]
    np.testing.assert_allclose(quantile(spark, (0.975, 1), (0.975, 2), (0.975, 3)), exact)


def test_nan_counts_as_missing(spark):
    from coreline.functions.nullsafe import mean_lenient, sd_lenient, sum_lenient, sum_strict, weighted_mean, without_nan
    from coreline.operators.summary import value_range

    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    got = df.agg(
        sum_lenient("x").alias("a"), mean_lenient("x").alias("b"), sd_lenient("x").alias("c"),
        sum_strict("x").alias("d"), weighted_mean("x").alias("e"),
    ).first()
    assert (got.a, got.b, round(got.c, 9), got.d, got.e) == (4.0, 2.0, 1.414213562, None, 2.0)
    assert tuple(value_range(df, ["x"]).first()) == (1.0, 3.0)
    assert [r.x for r in without_nan(df).collect()] == [1.0, None, 3.0]


def test_number_text(spark):
    from coreline.functions.nullsafe import try_number

    texts = ["1980", "1980A", "1980D", "1980f", " 12.5 ", "-3e2", ".5", "NaN", "Infinity", "", None, "0x1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(try_number("t")).collect()]
    assert got == [1980.0, None, None, None, 12.5, -300.0, 0.5, None, None, None, None, None]
