"""Linear and random-intercept models from distributed sufficient statistics.

Each fit is one aggregation of the data (two for factor levels) followed by a
closed form on rows of group size.  Rows with a missing response or predictor
do not take part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreline.functions.nullsafe import n_rows, present
from coreline.functions.tdist import t_quantile, t_two_sided_p
from coreline.runtime import cut_lineage, drop_checkpoint

COEFFICIENTS = ("term", "estimate", "se", "t", "df")


def _complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with all of these; NaN counts as missing."""
    return df.dropna("any", subset=list(columns))


def _long(row: DataFrame, keys: Sequence[str], terms: dict[str, tuple[str, str]], df: str):
    """One row per term from a one-row-per-model table."""
    entries = F.array(
        *[
            F.struct(F.lit(t).alias("term"), F.col(b).alias("estimate"), F.col(s).alias("se"))
            for t, (b, s) in terms.items()
        ]
    )
    return (
        row.select(*keys, F.explode(entries).alias("_e"), F.col(df).cast("double").alias("df"))
        .select(
            *keys,
            "_e.term",
            "_e.estimate",
            "_e.se",
            F.try_divide(F.col("_e.estimate"), F.col("_e.se")).alias("t"),
            "df",
        )
    )


def ols_simple(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``y ~ x``: one row per model with slope, intercept, SEs, R2, spread, and
    the slope's t and p."""
    xc, yc = present(F.col(x).cast("double")), present(F.col(y).cast("double"))
    fit = df.groupBy(*by).agg(
        F.regr_count(yc, xc).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"),
        F.regr_avgx(yc, xc).alias("x_mean"),
        F.regr_sxx(yc, xc).alias("sxx"),
        F.regr_syy(yc, xc).alias("syy"),
        F.regr_sxy(yc, xc).alias("sxy"),
        F.min(F.when(yc.isNotNull(), xc)).alias("x_min"),
        F.max(F.when(yc.isNotNull(), xc)).alias("x_max"),
    )
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    fit = fit.withColumn("df", F.col("n") - 2).withColumn(
        "s2", F.when(F.col("df") > 0, rss / F.col("df"))
    )
    return fit.withColumns(
        {
            "se_slope": F.sqrt(F.try_divide(F.col("s2"), F.col("sxx"))),
            "se_intercept": F.sqrt(
                F.col("s2") * (F.try_divide(F.lit(1.0), F.col("n"))
                               + F.try_divide(F.pow("x_mean", F.lit(2.0)), F.col("sxx")))
            ),
        }
    ).withColumn("t", F.try_divide(F.col("slope"), F.col("se_slope"))).withColumn(
        "p", t_two_sided_p(F.col("t"), F.col("df").cast("double"))
    )


def ols_simple_terms(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    fit = ols_simple(df, x, y, by)
    terms = {"(Intercept)": ("intercept", "se_intercept"), x: ("slope", "se_slope")}
    return _long(fit, by, terms, "df")


def ols_origin(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``y ~ 0 + x``: one row per model; R2 is uncentred."""
    rows = _complete(df, x, y)
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    sums = rows.groupBy(*by).agg(
        n_rows().alias("n"),
        F.sum(xc * yc).alias("sxy"),
        F.sum(xc * xc).alias("sxx"),
        F.sum(yc * yc).alias("syy"),
    )
    fit = sums.withColumn("slope", F.try_divide(F.col("sxy"), F.col("sxx"))).withColumns(
        {
            "df": F.col("n") - 1,
            "rss": F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)),
        }
    )
    return fit.withColumns(
        {
            "se_slope": F.sqrt(
                F.try_divide(F.try_divide(F.col("rss"), F.col("df")), F.col("sxx"))
            ),
            "r2": 1 - F.try_divide(F.col("rss"), F.col("syy")),
        }
    )


def ols_origin_terms(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return _long(ols_origin(df, x, y, by), by, {x: ("slope", "se_slope")}, "df")


def ols_factor(df: DataFrame, factor: str, y: str, ref: str | None = None) -> DataFrame:
    """``y ~ factor``: one row per level in contrast with the reference level.

    The reference defaults to the alphabetically first level.
    """
    levels = (
        _complete(df, factor, y)
        .groupBy(F.col(factor).cast("string").alias("level"))
        .agg(
            n_rows().alias("n"),
            F.avg(y).alias("m"),
            F.coalesce(F.var_pop(y) * n_rows(), F.lit(0.0)).alias("ss"),
        )
    )
    whole = levels.agg(
        F.struct(
            F.sum("n").alias("n"),
            (F.sum("n") - n_rows()).alias("df"),
            F.sum("ss").alias("ss"),
            F.min("level").alias("first"),
        ).alias("w")
    )
    chosen = F.col("w.first") if ref is None else F.lit(ref)
    with_whole = levels.withColumn("w", whole.scalar())
    reference = with_whole.filter(F.col("level") == chosen).agg(
        F.max(F.struct("level", "n", "m")).alias("r")
    )
    s2 = F.try_divide(F.col("w.ss"), F.col("w.df"))
    is_ref = F.col("level") == F.col("r.level")
    return (
        with_whole.withColumn("r", reference.scalar())
        .select(
            F.when(is_ref, F.lit("(Intercept)")).otherwise(F.concat(F.lit(factor), F.col("level"))).alias("term"),
            F.when(is_ref, F.col("m")).otherwise(F.col("m") - F.col("r.m")).alias("estimate"),
            F.sqrt(
                s2 * F.when(is_ref, F.lit(1.0) / F.col("n")).otherwise(
                    F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("r.n")
                )
            ).alias("se"),
            F.col("w.df").cast("double").alias("df"),
        )
        .select("term", "estimate", "se", F.try_divide(F.col("estimate"), F.col("se")).alias("t"), "df")
    )


def ols_band(
    df: DataFrame, x: str, y: str, points: int = 80, level: float = 0.95,
    t_value: float | None = None,
) -> DataFrame:
    """Fitted line with its confidence band on an even grid over the x range."""
    fit = ols_simple(df, x, y)
    t = F.lit(float(t_value)) if t_value is not None else t_quantile(
        F.lit((1.0 + level) / 2.0), F.col("df").cast("double")
    )
    fit = fit.withColumn("_t", t).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    fit = fit.withColumn(
        "x", F.col("x_min") + F.col("step") * ((F.col("x_max") - F.col("x_min")) / (points - 1))
    ).withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
    half = F.col("_t") * F.sqrt(
        F.col("s2") * (1.0 / F.col("n") + F.pow(F.col("x") - F.col("x_mean"), F.lit(2.0)) / F.col("sxx"))
    )
    return fit.select("step", "x", "fit", (F.col("fit") - half).alias("lo"), (F.col("fit") + half).alias("hi"))


# --- random intercept: y ~ type + (1 | site), REML ---------------------------
#
# The fixed factor is constant within a site, so a site enters only through its
# row count n, mean m and within sum of squares.  With ratio = site variance /
# residual variance, each site has weight w = n / (1 + ratio n), and per type
# the estimate is the w-weighted mean of site means.


def site_statistics(df: DataFrame, fixed: str, site: str, y: str) -> DataFrame:
    return (
        _complete(df, fixed, site, y)
        .groupBy(F.col(fixed).cast("string").alias("level"), F.col(site).alias("site"))
        .agg(
            n_rows().cast("double").alias("n"),
            F.avg(y).alias("m"),
            F.coalesce(F.var_pop(y) * n_rows(), F.lit(0.0)).alias("ss"),
        )
    )


Ratios = Sequence[float] | Column


def _by_ratio(sites: DataFrame, ratios: Ratios, by: Sequence[str] = ()) -> DataFrame:
    """REML pieces per variance ratio and level."""
    grid = ratios if isinstance(ratios, Column) else F.lit([float(r) for r in ratios])
    w = F.col("n") / (1 + F.col("ratio") * F.col("n"))
    return (
        sites.withColumn("ratio", F.explode(F.array_distinct(grid)))
        .groupBy(*by, "ratio", "level")
        .agg(
            F.sum(w).alias("w"),
            F.sum(w * F.col("m")).alias("wm"),
            F.sum(w * F.col("m") * F.col("m")).alias("wmm"),
            F.sum("ss").alias("ss"),
            F.sum(F.log1p(F.col("ratio") * F.col("n"))).alias("logs"),
            F.sum("n").alias("n"),
        )
    )


def lmm_profile(sites: DataFrame, ratios: Ratios, by: Sequence[str] = ()) -> DataFrame:
    """REML deviance (up to a constant) and residual variance per ratio.

    Both are missing where no residual freedom or variance is left.  ``rise``
    is the deviance without its large constant part, for comparing ratios.
    """
    out = _by_ratio(sites, ratios, by).groupBy(*by, "ratio").agg(
        (F.sum("n") - n_rows()).alias("free"),
        F.sum("ss").alias("ss"),
        F.sum(F.col("wmm") - F.col("wm") * F.col("wm") / F.col("w")).alias("between"),
        (F.sum("logs") + F.sum(F.log("w"))).alias("_logs"),
    )
    ss, between = F.col("ss"), F.col("between")
    out = out.withColumn("sigma2", F.try_divide(ss + between, F.col("free")))
    grown = F.when(ss > 0, F.log1p(F.try_divide(between, ss))).otherwise(F.log(between))
    return out.select(
        *by,
        "ratio",
        "sigma2",
        (F.col("free") * F.log("sigma2") + F.col("_logs")).alias("deviance"),
        F.when(F.col("sigma2") > 0, F.col("free") * grown + F.col("_logs")).alias("rise"),
    )


def lmm_profile_terms(sites: DataFrame, ratios: Ratios, ref: str) -> DataFrame:
    """Profile with the level estimates: one row per ratio and level."""
    levels = _by_ratio(sites, ratios).select(
        "ratio", "level", (F.col("wm") / F.col("w")).alias("mean"), "w"
    )
    reference = levels.filter(F.col("level") == ref).select(
        "ratio", F.col("mean").alias("ref_mean"), F.col("w").alias("ref_w")
    )
    is_ref = F.col("level") == ref
    return (
        levels.join(reference, "ratio")
        .join(lmm_profile(sites, ratios), "ratio")
        .select(
            "ratio",
            "level",
            "deviance",
            "sigma2",
            F.when(is_ref, F.col("mean")).otherwise(F.col("mean") - F.col("ref_mean")).alias("estimate"),
            F.sqrt(
                F.col("sigma2")
                * F.when(is_ref, 1 / F.col("w")).otherwise(1 / F.col("w") + 1 / F.col("ref_w"))
            ).alias("se"),
        )
    )


_GRID = 512


def _per_model(values: dict[str, float]) -> Column:
    """The value of each row's model."""
    pairs = chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in values.items())
    return F.create_map(*pairs)[F.col("model")]


def _per_model_text(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("model")]


def _lowest_on_grid(sites: DataFrame, largest: dict[str, float]) -> dict[str, tuple[float, float, float]]:
    """The ratio of lowest profiled deviance on a coarse grid, and its two neighbours, per model.

    One Spark job for all models; one row per model comes back.  ``largest`` is each
    model's largest site: ratios far below its inverse equal no site variance.
    """
    steps = F.sequence(F.lit(0), F.lit(_GRID))
    # 0, and even steps of the exponent from 1e-6 / largest up to 1e8; further
    # up for models whose deviance may still be falling there
    first = {k: -6.0 - math.log10(n) for k, n in largest.items()}
    top = dict.fromkeys(largest, 8.0)
    while True:
        rise = {k: (top[k] - e) / _GRID for k, e in first.items()}
        exponent, pace = _per_model(first), _per_model(rise)
        powers = F.transform(steps, lambda k: F.pow(F.lit(10.0), exponent + pace * k))
        lowest = lmm_profile(sites, F.concat(F.array(F.lit(0.0)), powers), ["model"]).groupBy("model")
        best = {r["model"]: r["best"] for r in lowest.agg(F.min_by("ratio", "rise").alias("best")).collect()}
        empty = sorted(k for k, v in best.items() if v is None)
        if empty:
            raise ValueError(f"no residual variance left in {empty}")
        open_ended = [k for k, r in best.items() if r >= 10.0 ** (top[k] - rise[k] / 2)]
        if not open_ended:
            break
        if max(top.values()) >= 40.0:
            raise ValueError(f"the site variance has no bound in {sorted(open_ended)}")
        top |= {k: top[k] + 16.0 for k in open_ended}
    out = {}
    for k, r in best.items():
        least, step = 10.0 ** first[k], 10.0 ** rise[k]
        out[k] = (0.0 if r <= least * 1.001 else r / step, r, r * step if r > 0.0 else least)
    return out


def _slopes(sites: DataFrame, ratio: Column) -> dict[str, tuple[float, float, float]]:
    """First and second derivative of the profiled deviance in the ratio, and the
    residual variance, per model at its ratio; one row per model comes back."""
    w, m = F.col("n") / (1 + ratio * F.col("n")), F.col("m")
    weights = {"w": w, "u": -w * w, "v": 2 * w * w * w}  # the weight and its derivatives
    sums = [F.sum(x * m**k if k else x).alias(f"{name}{k}") for name, x in weights.items() for k in range(3)]
    levels = sites.groupBy("model", "level").agg(*sums, F.sum("n").alias("n"), F.sum("ss").alias("ss"))
    rows = levels.selectExpr(
        "model", "n", "ss", "w0", "u0", "u0 / w0 AS log1", "v0 / w0 - u0 * u0 / (w0 * w0) AS log2",
        "w2 - w1 * w1 / w0 AS b",
        "u2 - 2 * w1 * u1 / w0 + w1 * w1 * u0 / (w0 * w0) AS b1",
        """v2 - 2 * (u1 * u1 + w1 * v1) / w0 + (4 * w1 * u1 * u0 + w1 * w1 * v0) / (w0 * w0)
           - 2 * w1 * w1 * u0 * u0 / (w0 * w0 * w0) AS b2""",
    )
    found = (
        rows.groupBy("model")
        .agg(
            F.expr("sum(n) - count(*)").alias("free"), F.expr("sum(ss) + sum(b)").alias("rss"),
            *[F.sum(c).alias(c) for c in ("b1", "b2", "w0", "u0", "log1", "log2")],
        )
        .selectExpr(
            "model", "free * b1 / rss + w0 + log1 AS g",
            "free * (b2 / rss - b1 * b1 / (rss * rss)) + u0 + log2 AS h", "rss / free AS sigma2",
        )
    )
    return {r["model"]: (r["g"], r["h"], r["sigma2"]) for r in found.collect()}


def _best_ratios(sites: DataFrame, largest: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Ratio and residual variance where the profiled deviance is lowest, per model.

    Newton steps on the logarithm of the ratio, kept between the neighbours of the
    lowest grid point and replaced by halving where they leave it; each round is one
    Spark job for all models.  A deviance that rises from 0 on has its optimum there.
    """
    bracket = _lowest_on_grid(sites, largest)
    at = {k: r for k, (_, r, _) in bracket.items()}
    low = {k: a for k, (a, _, _) in bracket.items()}
    high = {k: b for k, (_, _, b) in bracket.items()}
    done: dict[str, tuple[float, float]] = {}
    for _ in range(200):
        now = {k: r for k, r in at.items() if k not in done}
        if not now:
            return done
        running = sites.filter(F.col("model").isin(list(now)))
        for k, (g, h, sigma2) in _slopes(running, _per_model(now)).items():
            r = at[k]
            if (r == 0.0 and g >= 0.0) or g == 0.0 or high[k] - low[k] <= 1e-14 * high[k]:
                done[k] = (r, sigma2)
                continue
            low[k], high[k] = (r, high[k]) if g < 0.0 else (low[k], r)
            middle = math.sqrt(low[k] * high[k]) if low[k] > 0.0 else high[k] / 2.0
            if r == 0.0:
                step = -g / h if h > 0.0 else middle
            else:
                slope = g + r * h
                step = r * math.exp(max(-50.0, min(50.0, -g / slope))) if slope > 0.0 else middle
            if abs(step - r) <= 1e-11 * r:
                done[k] = (r, sigma2)
            at[k] = step if low[k] < step < high[k] else middle
    raise ArithmeticError(f"no optimum found for {sorted(set(at) - set(done))}")


@dataclass(frozen=True)
class RandomIntercept:
    """``y ~ fixed + (1 | site)``; ``ref`` is the reference level of ``fixed``."""

    data: DataFrame
    fixed: str
    site: str
    y: str
    ref: str


def _variance_sums(sites: DataFrame, s: Column, tau: Column) -> DataFrame:
    """Per model and level, sums over sites of the weight and its derivatives.

    ``d = s + tau n`` is the spread of a site; ``u = n / d`` its weight.
    """
    d, n, m = s + tau * F.col("n"), F.col("n"), F.col("m")
    weights = {
        "u": n / d,
        "us": -n / (d * d),
        "ut": -n * n / (d * d),
        "uss": 2 * n / (d * d * d),
        "ust": 2 * n * n / (d * d * d),
        "utt": 2 * n * n * n / (d * d * d),
    }
    sums = [
        F.sum(w * f).alias(f"{k}{p}")
        for k, w in weights.items()
        for p, f in enumerate((F.lit(1.0), m, m * m))
    ]
    logs = [
        F.sum(-F.lit(1.0) / (d * d)).alias("lss"),
        F.sum(-n / (d * d)).alias("lst"),
        F.sum(-n * n / (d * d)).alias("ltt"),
    ]
    return sites.groupBy("model", "level").agg(
        *sums, *logs, F.sum("n").alias("n"), F.sum("ss").alias("ss"), n_rows().alias("sites")
    )


def _curvature(sums: DataFrame, s: Column) -> DataFrame:
    """Second derivatives of -2 log REML in (residual, site) variance, per model."""

    def pair(a: str, b: str, ab: str, logs: str) -> Column:
        return F.expr(
            f"""sum({ab}2 - 2 * ({b}1 * {a}1 + u1 * {ab}1) / u0
                + (2 * u1 * ({a}1 * {b}0 + {b}1 * {a}0) + u1 * u1 * {ab}0 - {a}0 * {b}0) / (u0 * u0)
                - 2 * u1 * u1 * {a}0 * {b}0 / (u0 * u0 * u0) + {ab}0 / u0 + {logs})"""
        )

    found = sums.groupBy("model").agg(
        pair("us", "us", "uss", "lss").alias("h_ss"),
        pair("us", "ut", "ust", "lst").alias("h_st"),
        pair("ut", "ut", "utt", "ltt").alias("h_tt"),
        F.expr("sum(n - sites)").alias("free"),
        F.sum("ss").alias("rss"),
        F.expr("CAST(sum(n) - count(*) AS DOUBLE)").alias("rest"),
    )
    full = F.col("h_ss") - F.col("free") / (s * s) + 2 * F.col("rss") / (s * s * s)
    return found.select(
        "model", "rest", full.alias("h_ss"), "h_st", "h_tt", (full * F.col("h_tt") - F.col("h_st") ** 2).alias("det")
    )


def _terms(sums: DataFrame, curves: DataFrame, ref: Column, named: Column, center: Column, s: Column, tau: Column):
    """Coefficients, SEs and Satterthwaite df: a row per model and level, all in Spark."""
    fields = ("u0", "u1", "us0", "ut0")
    base = sums.filter(F.col("level") == ref).select("model", F.struct(*fields).alias("r"))
    is_ref = F.col("level") == ref
    rows = (
        # a row for each model on these two sides
        sums.join(F.broadcast(base), "model")
        .join(F.broadcast(curves), "model")
        .select(
            "model",
            is_ref.alias("is_ref"),
            F.when(is_ref, "(Intercept)").otherwise(F.concat(named, F.col("level"))).alias("term"),
            F.when(is_ref, center + F.col("u1") / F.col("u0"))
            .otherwise(F.col("u1") / F.col("u0") - F.col("r.u1") / F.col("r.u0"))
            .alias("estimate"),
            (1 / F.col("u0") + F.when(is_ref, 0.0).otherwise(1 / F.col("r.u0"))).alias("variance"),
            *[
                (-F.col(c) / F.col("u0") ** 2 - F.when(is_ref, 0.0).otherwise(F.col(f"r.{c}") / F.col("r.u0") ** 2)).alias(g)
                for c, g in (("us0", "gs"), ("ut0", "gt"))
            ],
            "rest", "h_ss", "h_st", "h_tt", "det", s.alias("sigma2"), tau.alias("site_variance"),
        )
    )
    # covariance of the variances: twice the inverse curvature
    freedom = F.expr("variance * variance * det / (gs * gs * h_tt - 2 * gs * gt * h_st + gt * gt * h_ss)")
    known = (F.col("site_variance") > 0.0) & (F.col("det") > 0.0)
    se = F.sqrt("variance")
    return rows.orderBy("model", F.desc("is_ref"), "term").select(
        "model", "term", "estimate", se.alias("se"), (F.col("estimate") / se).alias("t"),
        F.when(known, freedom).otherwise(F.col("rest")).alias("df"), "sigma2", "site_variance",
    )


def lmm_fit(models: dict[str, RandomIntercept]) -> DataFrame:
    """REML fits with Satterthwaite df, several models at once.

    One row per model and level.  Site statistics, sums per level and coefficients
    stay in Spark; one row per model and round reaches the driver, however many
    levels and sites there are.  The result is a small written table; the files of
    the statistics go when the fit is done or fails.
    """
    stats = [
        site_statistics(m.data, m.fixed, m.site, m.y).withColumn("model", F.lit(name))
        for name, m in models.items()
    ]
    sites = cut_lineage(reduce(DataFrame.unionByName, stats))
    try:
        return cut_lineage(_fit_kept(models, sites))
    finally:
        drop_checkpoint(sites)


def _fit_kept(models: dict[str, RandomIntercept], sites: DataFrame) -> DataFrame:
    ref = _per_model_text({k: m.ref for k, m in models.items()})
    whole = {
        r["model"]: r
        for r in sites.groupBy("model")
        .agg(
            F.max("n").alias("largest"),
            (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("center"),
            F.bool_or(F.col("level") == ref).alias("has_ref"),
        )
        .collect()
    }
    for name, model in models.items():
        if name not in whole:
            raise ValueError(f"model {name!r} has no complete rows")
        if not whole[name]["has_ref"]:
            raise ValueError(f"model {name!r} has no level {model.ref!r} of {model.fixed!r}")
    center = _per_model({k: r["center"] for k, r in whole.items()})
    # centred site means keep the sums of squares free of cancellation
    sites = sites.withColumn("m", F.col("m") - center)
    best = _best_ratios(sites, {k: r["largest"] for k, r in whole.items()})
    s = _per_model({k: sigma2 for k, (_, sigma2) in best.items()})
    tau = _per_model({k: ratio * sigma2 for k, (ratio, sigma2) in best.items()})
    named = _per_model_text({k: m.fixed for k, m in models.items()})
    sums = _variance_sums(sites, s, tau)
    return _terms(sums, _curvature(sums, s), ref, named, center, s, tau)


def lmm_random_intercept(df: DataFrame, fixed: str, site: str, y: str, ref: str) -> DataFrame:
    """A single random-intercept fit, one row per level."""
    return lmm_fit({"": RandomIntercept(df, fixed, site, y, ref)}).drop("model")


def with_probabilities(rows: DataFrame, level: float = 0.95) -> DataFrame:
    """Coefficient rows with two-sided p and confidence limits."""
    half = t_quantile(F.lit((1.0 + level) / 2.0), F.col("df")) * F.col("se")
    return rows.withColumns({"p": t_two_sided_p(F.col("t"), F.col("df")), "_half": half}).select(
        "model",
        *COEFFICIENTS,
        "p",
        (F.col("estimate") - F.col("_half")).alias("ci_lo"),
        (F.col("estimate") + F.col("_half")).alias("ci_hi"),
    )


def model_table(models: dict[str, DataFrame], level: float = 0.95) -> DataFrame:
    """Coefficient rows of several models with confidence limits and p."""
    rows = reduce(
        DataFrame.unionByName,
        [m.select(F.lit(name).alias("model"), *COEFFICIENTS) for name, m in models.items()],
    )
    return with_probabilities(rows, level)
