import numpy as np
import pytest
from pyspark.sql import functions as F

import survey_data as D
from coreline.operators import models as M
from conftest import rows


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    x = rng.uniform(10, 90, 200)
    return x, 12.0 + 0.7 * x + rng.normal(0, 6, 200)


def frame(spark, x, y):
    data = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (3.0, None)]
    return spark.createDataFrame(data, "x double, y double")


def least_squares(design, y):
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rss = float(((y - design @ beta) ** 2).sum())
    df = len(y) - design.shape[1]
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss / df)
    return beta, se, rss, df


def test_simple_regression(spark, points):
    x, y = points
    beta, se, rss, df = least_squares(np.column_stack([np.ones_like(x), x]), y)
    fit = M.ols_simple(frame(spark, x, y), "x", "y").collect()[0]
    np.testing.assert_allclose([fit.intercept, fit.slope], beta, rtol=1e-9)
    np.testing.assert_allclose([fit.se_intercept, fit.se_slope], se, rtol=1e-8)
    assert (fit.df, fit.x_min, fit.x_max) == (df, x.min(), x.max())
    assert fit.r2 == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())
    terms = {r.term: r for r in M.ols_simple_terms(frame(spark, x, y), "x", "y").collect()}
    assert terms["x"].t == pytest.approx(beta[1] / se[1])


def test_regression_through_origin(spark, points):
    x, y = points
    beta, se, rss, df = least_squares(x[:, None], y)
    fit = M.ols_origin(frame(spark, x, y), "x", "y").collect()[0]
    np.testing.assert_allclose([fit.slope, fit.se_slope], [beta[0], se[0]], rtol=1e-9)
    assert fit.df == df and fit.r2 == pytest.approx(1 - rss / (y ** 2).sum())


def test_models_per_group(spark, points):
    x, y = points
    df = frame(spark, x, y).withColumn("g", (F.col("x") > 50).cast("int")).dropna()
    got = rows(M.ols_simple(df, "x", "y", ["g"]), "g")
    for r in got:
        keep = (x > 50) == bool(r["g"])
        beta, *_ = least_squares(np.column_stack([np.ones(keep.sum()), x[keep]]), y[keep])
        np.testing.assert_allclose([r["intercept"], r["slope"]], beta, rtol=1e-8)


def test_degenerate_regressions_give_missing_values(spark):
    one = spark.createDataFrame([(2.0, 5.0)], "x double, y double")
    fit = M.ols_simple(one, "x", "y").collect()[0]
    assert fit.s2 is None and fit.se_slope is None
    fit = M.ols_origin(one, "x", "y").collect()[0]
    assert fit.slope == 2.5 and fit.se_slope is None


@pytest.mark.parametrize("ref", [None, "c"])
def test_factor_model(spark, ref):
    rng = np.random.default_rng(2)
    g = rng.choice(list("abcd"), 120, p=[0.6, 0.2, 0.15, 0.05])
    y = rng.normal(10, 2, 120) + (g == "b") * 3
    first = ref or "a"
    levels = [first] + [v for v in "abcd" if v != first]
    design = np.column_stack([np.ones(120)] + [(g == v).astype(float) for v in levels[1:]])
    beta, se, _, df = least_squares(design, y)
    data = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, y)], "g string, y double")
    got = {r.term: r for r in M.ols_factor(data, "g", "y", ref).collect()}
    for name, b, s in zip(["(Intercept)"] + [f"g{v}" for v in levels[1:]], beta, se):
        assert got[name].estimate == pytest.approx(b) and got[name].se == pytest.approx(s)
        assert got[name].df == df


def test_band(spark, points):
    x, y = points
    band = rows(M.ols_band(frame(spark, x, y), "x", "y", points=5), "step")
    beta, _, rss, df = least_squares(np.column_stack([np.ones_like(x), x]), y)
    grid = np.linspace(x.min(), x.max(), 5)
    np.testing.assert_allclose([r["x"] for r in band], grid)
    np.testing.assert_allclose([r["fit"] for r in band], beta[0] + beta[1] * grid)
    half = 1.97202 * np.sqrt(rss / df * (1 / 200 + (grid - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
    np.testing.assert_allclose([r["hi"] - r["fit"] for r in band], half, rtol=1e-5)
    np.testing.assert_allclose([r["fit"] - r["lo"] for r in band], half, rtol=1e-5)


# --- random intercept against a dense fit -------------------------------------

class Dense:
    """REML on full matrices, for small data only."""

    def __init__(self, level, site, y, ref):
        self.y = np.asarray(y)
        self.levels = [ref] + sorted(set(level) - {ref})
        self.x = np.column_stack(
            [np.ones(len(y))] + [(np.asarray(level) == v).astype(float) for v in self.levels[1:]]
        )
        z = (np.asarray(site)[:, None] == np.unique(site)[None, :]).astype(float)
        self.zz = z @ z.T

    def parts(self, s, tau):
        v = s * np.eye(len(self.y)) + tau * self.zz
        vi = np.linalg.inv(v)
        c = np.linalg.inv(self.x.T @ vi @ self.x)
        beta = c @ self.x.T @ vi @ self.y
        r = self.y - self.x @ beta
        value = np.linalg.slogdet(v)[1] - np.linalg.slogdet(c)[1] + r @ vi @ r
        return value, beta, c

    def fit(self):
        def profile(ratio):
            n, p = self.x.shape
            v = np.eye(n) + ratio * self.zz
            vi = np.linalg.inv(v)
            a = self.x.T @ vi @ self.x
            beta = np.linalg.solve(a, self.x.T @ vi @ self.y)
            r = self.y - self.x @ beta
            s = r @ vi @ r / (n - p)
            return (n - p) * np.log(s) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], s

        lo, hi = -12.0, 8.0
        golden = (5 ** 0.5 - 1) / 2
        for _ in range(80):
            a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
            if profile(np.exp(a))[0] < profile(np.exp(b))[0]:
                hi = b
            else:
                lo = a
        ratio = np.exp((lo + hi) / 2)
        s = profile(ratio)[1]
        tau = ratio * s
        _, beta, c = self.parts(s, tau)
        theta, h = np.array([s, tau]), np.array([s, tau]) * 1e-3

        def at(i, j):
            return self.parts(*(theta + i * np.array([h[0], 0]) + j * np.array([0, h[1]])))[0]

        hess = np.array([
            [(at(1, 0) - 2 * at(0, 0) + at(-1, 0)) / h[0] ** 2,
             (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / (4 * h[0] * h[1])],
            [0, (at(0, 1) - 2 * at(0, 0) + at(0, -1)) / h[1] ** 2],
        ])
        hess[1, 0] = hess[0, 1]
        cov = 2 * np.linalg.inv(hess)
        df = []
        for k in range(len(beta)):
            g = np.array([
                (self.parts(s + h[0], tau)[2][k, k] - self.parts(s - h[0], tau)[2][k, k]) / (2 * h[0]),
                (self.parts(s, tau + h[1])[2][k, k] - self.parts(s, tau - h[1])[2][k, k]) / (2 * h[1]),
            ])
            df.append(2 * c[k, k] ** 2 / (g @ cov @ g))
        return beta, np.sqrt(np.diag(c)), np.array(df), s, tau


@pytest.mark.parametrize("levels, seed", [("ab", 1), ("abc", 4)])
def test_random_intercept_equals_dense_reml(spark, levels, seed):
    rng = np.random.default_rng(seed)
    level, site, y = [], [], []
    for i in range(14):
        effect = rng.normal(0, 4)
        lv = levels[i % len(levels)]
        for _ in range(rng.integers(1, 9)):
            level.append(lv), site.append(f"s{i}")
            y.append(50 + 10 * (lv == "b") + effect + rng.normal(0, 3))
    beta, se, df, s, tau = Dense(level, site, y, "a").fit()
    data = spark.createDataFrame(list(zip(level, site, map(float, y))), "type string, site string, y double")
    got = M.lmm_random_intercept(data, "type", "site", "y", "a").collect()
    assert [r.term for r in got] == ["(Intercept)"] + [f"type{v}" for v in levels[1:]]
    np.testing.assert_allclose([r.estimate for r in got], beta, rtol=1e-5)
    np.testing.assert_allclose([r.se for r in got], se, rtol=1e-4)
    np.testing.assert_allclose([r.df for r in got], df, rtol=2e-3)
    np.testing.assert_allclose([got[0].sigma2, got[0].site_variance], [s, tau], rtol=1e-3)


def test_random_intercept_without_site_variance(spark):
    data = [("ab"[i % 2], f"s{i}", v) for i in range(6) for v in (1.0, 2.0, 3.0)]
    df = spark.createDataFrame(data, "type string, site string, y double")
    got = M.lmm_random_intercept(df, "type", "site", "y", "a").collect()
    assert got[0].site_variance == 0.0 and got[0].estimate == pytest.approx(2.0)
    assert got[1].estimate == pytest.approx(0.0, abs=1e-12) and got[0].df == 16.0


def test_plant_carbon_model_matches_recorded_result(spark):
    plots = spark.createDataFrame(D.plant_values(), "site string, plant_c double")
    plots = plots.join(D.sites(spark).select("site", "site_type"), "site")
    fit = M.lmm_random_intercept(plots, "site_type", "site", "plant_c", "Rehabilitated")
    got = {r.term: r for r in M.model_table({"plant": fit}).collect()}
    # Recorded estimate, SE, df, t, p
    want = {
        "(Intercept)": (49.413, 16.621, 7.048, 2.973, 0.0206),
        "site_typeEstablished": (96.444, 28.740, 7.002, 3.356, 0.0121),
    }
    for term, (estimate, se, df, t, p) in want.items():
        r = got[term]
        assert r.estimate == pytest.approx(estimate, rel=2e-3)
        assert r.se == pytest.approx(se, rel=2e-3)
        assert r.df == pytest.approx(df, rel=2e-3)
        assert r.t == pytest.approx(t, rel=2e-3)
        assert r.p == pytest.approx(p, rel=1e-2)
        assert r.ci_lo < r.estimate < r.ci_hi


def test_models_fitted_together_equal_single_fits(spark):
    rng = np.random.default_rng(8)
    models = {}
    for name, spread in (("a", 5.0), ("b", 0.2)):
        data = [
            ("xyz"[i % 3], f"s{i}", float(rng.normal(20 + i % 3, 2) + effect))
            for i, effect in enumerate(rng.normal(0, spread, 15))
            for _ in range(1 + i % 4)
        ]
        df = spark.createDataFrame(data, "type string, site string, y double")
        models[name] = M.RandomIntercept(df, "type", "site", "y", "y")
    together = rows(M.lmm_fit(models), "model", "term")
    for name, m in models.items():
        single = rows(M.lmm_random_intercept(m.data, m.fixed, m.site, m.y, m.ref), "term")
        for a, b in zip([r for r in together if r["model"] == name], single):
            for column in ("estimate", "se", "t", "df"):
                assert a[column] == pytest.approx(b[column], rel=1e-6)


def test_no_residual_variance_is_refused(spark):
    df = spark.createDataFrame([("a", "s1", 1.0), ("b", "s2", 2.0)], "type string, site string, y double")
    with pytest.raises(ValueError, match="no residual variance"):
        M.lmm_random_intercept(df, "type", "site", "y", "a")


def test_absent_reference_level_is_named(spark):
    df = spark.createDataFrame([("b", "s1", 1.0), ("b", "s1", 2.0), ("c", "s2", 3.0)], "f string, s string, y double")
    with pytest.raises(ValueError, match="no level 'a'"):
        M.lmm_random_intercept(df, "f", "s", "y", "a")
    with pytest.raises(ValueError, match="no complete rows"):
        M.lmm_random_intercept(df.filter("y > 9"), "f", "s", "y", "b")


def test_age_fit_on_the_recorded_sites(spark):
    """Dirty years and ages outside the axis take no part: five of six sites stay."""
    from pyspark.sql import functions as F

    import survey_data as D
    from coreline.catalog.statistics import AGE_LIMITS
    from coreline.plans.cores import stand_age

    means = spark.createDataFrame([(s, float(m)) for s, m, *_ in D.PLANT], "site string, biomass double")
    placed = means.join(D.sites(spark), "site").filter("site_type = 'Rehabilitated'")
    aged = placed.withColumn("age", stand_age("site_year")).filter(F.col("age").between(*AGE_LIMITS))
    fit = M.ols_simple(aged, "age", "biomass").first()
    assert fit.n == 5 and fit.df == 3 and 0 < fit.p < 1
    assert fit.t == pytest.approx(fit.slope / fit.se_slope)
