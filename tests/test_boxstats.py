import numpy as np
import pandas as pd
import pytest

from coreline.operators import boxstats as B
from conftest import rows


def brute(values, limits=None):
    v = np.array([x for x in values if x is not None and not np.isnan(x)])
    if limits:
        v = v[(v >= limits[0]) & (v <= limits[1])]
    lower, middle, upper = np.quantile(v, [0.25, 0.5, 0.75])
    reach = 1.5 * (upper - lower)
    inside = (v >= lower - reach) & (v <= upper + reach)
    return lower, middle, upper, v[inside].min(), v[inside].max(), len(v), int((~inside).sum())


def check(spark, frame, accuracy, limits=None):
    df = spark.createDataFrame(
        [(g, None if pd.isna(x) and keep else x) for g, x, keep in frame], "g string, x double"
    )
    got = rows(B.box_stats(df, ["g"], "x", limits, accuracy), "g")
    groups = sorted({g for g, _, _ in frame}, key=lambda g: (g is not None, g))
    assert [r["g"] for r in got] == groups
    for r in got:
        want = brute([x for g, x, _ in frame if g == r["g"]], limits)
        have = [r[c] for c in ("lower", "middle", "upper", "ymin", "ymax", "n", "outliers")]
        np.testing.assert_allclose(have, want, rtol=1e-12)


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quartiles_are_exact_also_through_brackets(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    frame = [("hot", float(x), True) for x in rng.lognormal(3, 1, 20_000)]
    frame += [("few", float(x), True) for x in rng.normal(0, 1, 7)]
    frame += [("ties", float(x), True) for x in rng.integers(0, 4, 900)]
    frame += [(None, float(x), True) for x in rng.normal(5, 2, 60)]
    frame += [("one", 4.25, True)]
    frame += [("hot", float("nan"), True), ("hot", float("nan"), False)]
    check(spark, frame, accuracy)


def test_one_value_holds_most_rows(spark):
    frame = [("a", 5.0, True)] * 3000 + [("a", float(i), True) for i in range(100)]
    check(spark, frame, accuracy=30)


def test_limits_drop_values_before_the_statistics(spark):
    rng = np.random.default_rng(0)
    frame = [(g, float(x), True) for g in "ab" for x in rng.normal(100, 60, 500)]
    check(spark, frame, 40, limits=(0.0, 150.0))


def test_ungrouped_quantiles(spark):
    values = [float(x) for x in np.random.default_rng(9).normal(0, 1, 501)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = B.quantiles(df, [], "x", (0.1, 0.9), accuracy=20).collect()[0]
    np.testing.assert_allclose([got.q0, got.q1], np.quantile(values, [0.1, 0.9]), rtol=1e-12)


def test_outlier_rows(spark):
    frame = [("a", float(x), i) for i, x in enumerate([1, 2, 3, 4, 5, 60, -40])]
    df = spark.createDataFrame(frame, "g string, x double, i int")
    assert sorted(r.i for r in B.box_outliers(df, ["g"], "x").collect()) == [5, 6]


@pytest.mark.parametrize("kind", ["even", "heavy tails", "two values and little between", "few values", "sorted"])
def test_one_group_of_all_rows_is_never_ranked_whole(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "even": rng.random(30_000),
        "heavy tails": np.exp(rng.normal(0, 90, 30_000)) * rng.choice([-1, 1], 30_000),
        "two values and little between": np.r_[np.zeros(9_000), np.ones(11_000), rng.random(400)],
        "few values": rng.integers(0, 3, 30_000).astype(float),
        "sorted": np.arange(30_000.0),
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in values], "x double").repartition(4)
    most = 300
    rows_ = df.select(df.x.alias("_v"))
    state = B._brackets(rows_, [], B.QUARTILES, 100, most).first()["_state"]
    # what the last step's window sees: no more rows than stated, and the wanted ranks are among them
    ordered = np.sort(values)
    for p, s in zip(B.QUARTILES, state, strict=True):
        rank = int(np.floor((len(values) - 1) * p))
        if s.x is None:
            assert s.n <= most and s.n == ((values >= s.lo) & (values <= s.hi)).sum()
            assert s.below == (values < s.lo).sum() <= rank and s.lo <= ordered[rank] <= ordered[rank + 1] <= s.hi
        else:
            assert s.x == ordered[rank] and (s.y == ordered[rank + 1] or s.h == rank)
    got = B.quantiles(df, [], "x", accuracy=100, most_ranked=most).first()
    np.testing.assert_allclose(list(got), np.quantile(values, B.QUARTILES), rtol=1e-12)


def test_groups_narrow_at_their_own_pace(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.normal(0, 1, 20_000), "ties": rng.integers(0, 2, 5_000), "few": rng.random(9), None: rng.random(700)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, x double").repartition(5)
    got = {r.g: r[1:] for r in B.quantiles(df, ["g"], "x", accuracy=50, most_ranked=100).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        np.testing.assert_allclose(got[g], np.quantile(v, B.QUARTILES), rtol=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan"))], "g string, x double")
    assert B.quantiles(df, ["g"], "x").collect() == []
    assert tuple(B.quantiles(df, [], "x").first()) == (None, None, None)
