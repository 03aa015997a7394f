"""Linear and random-intercept models."""

from pyspark.sql import functions as F

from coreline.catalog.carbon import horizon_accretion, located_plots
from coreline.catalog.registry import query
from coreline.catalog.sql_views import VIEWS
from coreline.catalog.summaries import core_totals
from coreline.constants import CONVERTED, ESTABLISHED, REHABILITATED
from coreline.operators import models as M
from coreline.operators.joins import join_dim
from coreline.plans import cores as C
from coreline.plans import plots as P

_OLS_SQL = """
    SELECT *, sqrt(s2 / sxx) AS se_slope, sqrt(s2 * (1e0 / n + x_mean * x_mean / sxx)) AS se_intercept
    FROM (SELECT *, (syy - slope * sxy) / (n - 2) AS s2, n - 2 AS df
          FROM (SELECT CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS slope,
                       regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
                       regr_avgx(y, x) AS x_mean, regr_sxx(y, x) AS sxx,
                       regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy,
                       min(x) AS x_min, max(x) AS x_max
                FROM {table}))"""

# share of a t distribution below |t|, as an integral of cos(u) ** (df - 1) up to
# atan(|t| / sqrt(df)); beyond 40 standard deviations nothing is left of it
_CUT = "CASE WHEN df < 1000 THEN pi() / 2 ELSE atan(40 / sqrt(df)) END"


def _integral(upper: str) -> str:
    return f"""({upper}) / 6000 * list_sum(list_transform(range(0, 2001), lambda k:
        CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
        * power(cos(({upper}) * k / 2000e0), df - 1)))"""


# rows of estimate, se and df (and anything else) with t, p and 95% limits
_P_SQL = f"""
    SELECT r.*, r.estimate / r.se AS t,
           greatest(0, 1 - r.inside / q.whole) AS p,
           estimate - q * se AS ci_lo, estimate + q * se AS ci_hi, q.q
    FROM (SELECT *, {_integral(f"least(atan(abs(estimate / se) / sqrt(df)), {_CUT})")} AS inside
          FROM (SELECT * REPLACE (CAST(df AS DOUBLE) AS df) FROM ({{rows}}))) AS r
    JOIN (WITH RECURSIVE halves AS (
            SELECT df, 0e0 AS lo, {_CUT} AS hi, {_integral(_CUT)} AS whole, 0 AS i
            FROM (SELECT DISTINCT CAST(df AS DOUBLE) AS df FROM ({{rows}}))
            UNION ALL
            SELECT df, CASE WHEN below < 0.95 THEN mid ELSE lo END,
                   CASE WHEN below < 0.95 THEN hi ELSE mid END, whole, i + 1
            FROM (SELECT *, {_integral("mid")} / whole AS below
                  FROM (SELECT *, (lo + hi) / 2 AS mid FROM halves WHERE i < 50)))
          SELECT df, whole, tan((lo + hi) / 2) * sqrt(df) AS q FROM halves WHERE i = 50) AS q
      ON r.df = q.df"""

# biomass of rehabilitated sites against stand age, one point per site
_SITE_POINTS = """(SELECT * FROM (
                     SELECT 2017 - CASE WHEN regexp_full_match(site_year, '[0-9]+')
                                        THEN CAST(site_year AS DOUBLE) END AS x, avg(biomass_mg_ha) AS y
                     FROM plants WHERE treatment2 = 'Rehabilitated' GROUP BY site, site_year)
                   WHERE x BETWEEN 14 AND 40)"""
# Limits of the age axis; points outside take no part
AGE_LIMITS = (14.0, 40.0)


def site_points(s):
    plots = P.plot_carbon(s.plots()).filter(F.col("treatment2") == REHABILITATED)
    means = plots.groupBy("site").agg(F.avg("biomass_mg_ha").alias("biomass"))
    placed = join_dim(means, s.sites(), "site", ["site_year"])
    aged = placed.withColumn("age", C.stand_age("site_year"))
    return aged.filter(F.col("age").between(*AGE_LIMITS))


_SIMPLE_SQL = _OLS_SQL.format(table=_SITE_POINTS)


@query(
    "n:i slope:6 intercept:4 r2:6 se_slope:6 se_intercept:4 df:i t:5 p:6",
    _P_SQL.format(rows=f"SELECT *, slope AS estimate, se_slope AS se FROM ({_SIMPLE_SQL})"),
)
def ols_simple(s):
    """Biomass against stand age over sites, inside the age limits."""
    return M.ols_simple(site_points(s), "age", "biomass")


@query(
    "step:i x:6 fit:4 lo:4 hi:4",
    f"""SELECT step, x, fit, fit - half AS lo, fit + half AS hi FROM (
          SELECT *, intercept + slope * x AS fit,
                 q * sqrt(s2 * (1e0 / n + power(x - x_mean, 2) / sxx)) AS half
          FROM (SELECT *, x_min + step * ((x_max - x_min) / 79e0) AS x
                FROM ({_P_SQL.format(rows=f"SELECT *, slope AS estimate, se_slope AS se FROM ({_SIMPLE_SQL})")}),
                     range(80) AS r(step)))""",
)
def ols_band(s):
    """Fitted line and its 95% band over the ages."""
    return M.ols_band(site_points(s), "age", "biomass")


_ORIGIN_SQL = """
    SELECT *, sqrt(rss / df / sxx) AS se_slope, 1 - rss / syy AS r2
    FROM (SELECT *, syy - slope * sxy AS rss, n - 1 AS df
          FROM (SELECT *, sxy / sxx AS slope
                FROM (SELECT count(*) AS n, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy
                      FROM {table} WHERE x IS NOT NULL AND y IS NOT NULL)))"""
_ORIGIN_TABLES = {
    "plant": "(SELECT plant_age AS x, plant_c AS y FROM plants WHERE treatment2 <> 'Disturbed')",
    "soil_100cm": """(SELECT 2017 - site_year_numeric AS x, total_lenient AS y
                      FROM core_100 WHERE site_type <> 'Converted')""",
    "soil_horizon": """(SELECT stand_age AS x, total AS y
                        FROM core_horizon WHERE site_type <> 'Converted')""",
    "soil_rate": "(SELECT stand_age AS x, per_year AS y FROM core_horizon)",
}


def origin_inputs(s):
    """The four data sets fitted through the origin: (frame, x, y)."""
    plots = located_plots(s, "site_year_numeric").filter(F.col("treatment2") != "Disturbed")
    plots = plots.withColumn("age", C.stand_age("site_year_numeric"))
    soil = core_totals(s, "site_type", "site_year_numeric", policy="lenient").filter(
        F.col("site_type") != "Converted"
    )
    soil = soil.withColumn("age", C.stand_age("site_year_numeric"))
    horizon = C.core_stock(
        C.clip_at_horizon(
            s.locate(C.slice_carbon(s.slices()), "horizon_cm", "site_type", "site_year_numeric")
        ),
        [s.key, "site_type", "site_year_numeric"], "strict", value="stock_to_horizon",
    ).filter(F.col("site_type") != "Converted")
    horizon = horizon.withColumn("age", C.stand_age("site_year_numeric"))
    return {
        "plant": (plots, "age", "plant_c"),
        "soil_100cm": (soil, "age", "total"),
        "soil_horizon": (horizon, "age", "total"),
        "soil_rate": (horizon_accretion(s), "stand_age", "per_year"),
    }


@query(
    "n:i slope:6 se_slope:6 df:i r2:6",
    _ORIGIN_SQL.format(table=_ORIGIN_TABLES["plant"]),
)
def ols_origin(s):
    """Plant carbon against stand age through the origin."""
    return M.ols_origin(*origin_inputs(s)["plant"])


_FACTOR_SQL = """
    SELECT CASE WHEN level = first THEN '(Intercept)' ELSE 'site' || level END AS term,
           CASE WHEN level = first THEN m ELSE m - ref_m END AS estimate,
           sqrt(s2 * CASE WHEN level = first THEN 1e0 / n ELSE 1e0 / n + 1e0 / ref_n END) AS se,
           df
    FROM (SELECT *, sum(ss) OVER () / (sum(n) OVER () - count(*) OVER ()) AS s2,
                 sum(n) OVER () - count(*) OVER () AS df,
                 min(level) OVER () AS first,
                 first_value(m) OVER (ORDER BY level) AS ref_m,
                 first_value(n) OVER (ORDER BY level) AS ref_n
          FROM (SELECT {x} AS level, count(*) AS n, avg({y}) AS m, var_pop({y}) * count(*) AS ss
                FROM {table} WHERE {y} IS NOT NULL GROUP BY {x}))"""


@query(
    "term estimate:4 se:4 t:4 df:2",
    f"SELECT *, estimate / se AS t FROM ({_FACTOR_SQL.format(x='site', y='total_lenient', table='core_100')})",
)
def ols_factor(s):
    """Soil stock by site, against the first site."""
    return M.ols_factor(core_totals(s, policy="lenient"), "site", "total")


_BY_SITE = "(SELECT * FROM complete_plants WHERE treatment2 <> 'Disturbed')"
_MODEL_ROWS = " UNION ALL ".join(
    [
        f"SELECT '{name}' AS model, '{'stand_age' if name == 'soil_rate' else 'age'}' AS term, "
        f"slope AS estimate, se_slope AS se, df FROM ({_ORIGIN_SQL.format(table=t)})"
        for name, t in _ORIGIN_TABLES.items()
    ]
    + [
        f"SELECT 'plant_by_site', term, estimate, se, df "
        f"FROM ({_FACTOR_SQL.format(x='site', y='plant_c', table=_BY_SITE)})",
        f"SELECT 'soil_by_site', term, estimate, se, df "
        f"FROM ({_FACTOR_SQL.format(x='site', y='total_lenient', table='core_100')})",
        f"SELECT 'biomass_by_age', 'age', slope, se_slope, df FROM ({_SIMPLE_SQL})",
        f"SELECT 'biomass_by_age', '(Intercept)', intercept, se_intercept, df FROM ({_SIMPLE_SQL})",
    ]
)


@query(
    "model term estimate:4 se:4 t:4 df:2 p:4 ci_lo:4 ci_hi:4",
    _P_SQL.format(rows=_MODEL_ROWS),
)
def model_table(s):
    """All fixed-effect models: estimates, SE, t, df, p and 95% limits."""
    fits = {name: M.ols_origin_terms(*args) for name, args in origin_inputs(s).items()}
    plots = P.complete_plots(P.plot_carbon(s.plots()), s.sites(), ["treatment2", "plant_c"])
    plots = plots.filter(F.col("treatment2") != "Disturbed")
    fits["plant_by_site"] = M.ols_factor(plots, "site", "plant_c")
    fits["biomass_by_age"] = M.ols_simple_terms(site_points(s), "age", "biomass")
    fits["soil_by_site"] = M.ols_factor(core_totals(s, policy="lenient"), "site", "total")
    return M.model_table(fits)


RATIOS = (0.0, 0.001, 0.01, 0.1, 1.0, 10.0)
_RATIO_ROWS = ", ".join(f"({r!r}e0)" for r in RATIOS)


@query(
    "ratio:4 level estimate:4 se:4 sigma2:3 deviance:4",
    f"""WITH levels AS (
          SELECT ratio, level, sum(w) AS w, sum(w * m) / sum(w) AS mean, sum(ss) AS ss,
                 sum(w * m * m) - sum(w * m) * sum(w * m) / sum(w) AS between_ss,
                 sum(ln(1 + ratio * n)) AS logs, sum(n) AS n
          FROM (SELECT *, n / (1 + ratio * n) AS w
                FROM (SELECT site_type AS level, site, count(*) AS n, avg(plant_c) AS m,
                             var_pop(plant_c) * count(*) AS ss
                      FROM plants WHERE plant_c IS NOT NULL AND treatment2 <> 'Disturbed'
                      GROUP BY ALL), (VALUES {_RATIO_ROWS}) AS g(ratio))
          GROUP BY ratio, level),
        fits AS (
          SELECT ratio, (sum(ss) + sum(between_ss)) / (sum(n) - count(*)) AS sigma2,
                 (sum(n) - count(*)) * ln((sum(ss) + sum(between_ss)) / (sum(n) - count(*)))
                   + sum(logs) + sum(ln(w)) AS deviance
          FROM levels GROUP BY ratio)
        SELECT l.ratio, l.level, f.sigma2, f.deviance,
               CASE WHEN l.level = 'Rehabilitated' THEN l.mean ELSE l.mean - r.mean END AS estimate,
               sqrt(f.sigma2 * CASE WHEN l.level = 'Rehabilitated' THEN 1 / l.w
                                    ELSE 1 / l.w + 1 / r.w END) AS se
        FROM levels l JOIN fits f USING (ratio)
             JOIN levels r ON r.ratio = l.ratio AND r.level = 'Rehabilitated'""",
)
def lmm_profile(s):
    """REML deviance and estimates of plant carbon by type on a fixed grid."""
    plots = located_plots(s, "site_type").filter(F.col("treatment2") != "Disturbed")
    sites = M.site_statistics(plots, "site_type", "site", "plant_c")
    return M.lmm_profile_terms(sites, RATIOS, REHABILITATED)


# --- random intercepts in SQL: the same optimum by zooming in on the derivative's sign ---

_LMM_ROWS = " UNION ALL ".join(
    f"SELECT '{model}' AS model, '{ref}' AS ref, site_type AS level, site, {y} AS y FROM {table}"
    for model, ref, y, table in (
        ("plant", REHABILITATED, "plant_c", _BY_SITE),
        ("plant_rate", ESTABLISHED, "plant_per_year", _BY_SITE),
        ("soil", CONVERTED, "total_lenient", f"(SELECT * FROM core_100 WHERE site_type <> '{REHABILITATED}')"),
        ("soil_rate", CONVERTED, "per_year", "core_horizon"),
    )
)


def _lowest(grid: str) -> str:
    """Per model the ratio of lowest deviance on a grid of ``model, ratio`` rows."""
    return f"""
        SELECT model, arg_min(ratio, rise) AS best, arg_min(sigma2, rise) AS sigma2 FROM (
          SELECT model, ratio, (sum(ss) + sum(between_ss)) / (sum(n) - count(*)) AS sigma2,
                 (sum(n) - count(*)) * ln(1 + sum(between_ss) / sum(ss)) + sum(logs) + sum(ln(w)) AS rise
          FROM (SELECT model, ratio, level, sum(w) AS w, sum(ss) AS ss, sum(n) AS n,
                       sum(w * m * m) - sum(w * m) * sum(w * m) / sum(w) AS between_ss,
                       sum(ln(1 + ratio * n)) AS logs
                FROM (SELECT *, n / (1 + ratio * n) AS w FROM lmm_sites JOIN ({grid}) USING (model))
                GROUP BY model, ratio, level)
          GROUP BY model, ratio)
        GROUP BY model"""


def _zoomed(best: str, low: str, high: str) -> str:
    """Per model the last ratio on an even grid where the deviance still falls (the first, if it never does)."""
    return f"""
        SELECT model, coalesce(max(ratio) FILTER (WHERE g < 0), min(ratio)) AS best,
               arg_min(sigma2, ratio) AS sigma2, any_value(width) AS width
        FROM (
          SELECT model, ratio, any_value(width) AS width, (sum(ss) + sum(b)) / (sum(n) - count(*)) AS sigma2,
                 (sum(n) - count(*)) * sum(b1) / (sum(ss) + sum(b)) + sum(w) + sum(w1 / w) AS g
          FROM (SELECT model, ratio, level, any_value(width) AS width, sum(w) AS w, sum(-w * w) AS w1, sum(ss) AS ss,
                       sum(n) AS n, sum(w * m * m) - sum(w * m) * sum(w * m) / sum(w) AS b,
                       sum(-w * w * m * m) - 2 * sum(w * m) * sum(-w * w * m) / sum(w)
                         + power(sum(w * m), 2) * sum(-w * w) / power(sum(w), 2) AS b1
                FROM (SELECT *, n / (1 + ratio * n) AS w FROM lmm_sites JOIN
                      (SELECT model, ({low}) + k * (({high}) - ({low})) / 512e0 AS ratio,
                              (({high}) - ({low})) / 512e0 AS width
                       FROM {best} JOIN lmm_reach USING (model), range(513) AS r(k)) USING (model))
                GROUP BY model, ratio, level)
          GROUP BY model, ratio)
        GROUP BY model"""


_WEIGHTS = {
    "u": "n / d", "us": "-n / (d * d)", "ut": "-n * n / (d * d)", "uss": "2 * n / (d * d * d)",
    "ust": "2 * n * n / (d * d * d)", "utt": "2 * n * n * n / (d * d * d)",
}
_SUMS = ", ".join(
    f"sum({w} * {f}) AS {k}{p}" for k, w in _WEIGHTS.items() for p, f in enumerate(("1", "m", "m * m"))
)


def _pair(a: str, b: str, ab: str, logs: str) -> str:
    return f"""sum({ab}2 - 2 * ({b}1 * {a}1 + u1 * {ab}1) / u0 + 2 * u1 * ({a}1 * {b}0 + {b}1 * {a}0) / power(u0, 2)
          + power(u1, 2) * {ab}0 / power(u0, 2) - 2 * power(u1, 2) * {a}0 * {b}0 / power(u0, 3)
          + {ab}0 / u0 - {a}0 * {b}0 / power(u0, 2) + {logs})"""


VIEWS |= {
    "lmm_sites": f"""
        SELECT * REPLACE (m - sum(n * m) OVER (PARTITION BY model) / sum(n) OVER (PARTITION BY model) AS m),
               sum(n * m) OVER (PARTITION BY model) / sum(n) OVER (PARTITION BY model) AS center
        FROM (SELECT model, ref, level, site, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m,
                     var_pop(y) * count(*) AS ss
              FROM ({_LMM_ROWS}) WHERE level IS NOT NULL AND site IS NOT NULL AND y IS NOT NULL
              GROUP BY ALL)""",
    "lmm_reach": """
        SELECT model, e, (8 - e) / 512e0 AS rise
        FROM (SELECT model, -6 - log10(max(n)) AS e FROM lmm_sites GROUP BY model)""",
    "lmm_first": _lowest(
        """SELECT model, CASE WHEN k < 0 THEN 0e0 ELSE power(10e0, e + rise * k) END AS ratio
           FROM lmm_reach, range(-1, 513) AS r(k)"""
    ),
    "lmm_second": _zoomed(
        "lmm_first",
        "CASE WHEN best <= power(10e0, e) * 1.001e0 THEN 0e0 ELSE best / power(10e0, rise) END",
        "CASE WHEN best > 0 THEN best * power(10e0, rise) ELSE power(10e0, e) END",
    ),
    # a zoom keeps the cell behind its last falling ratio; a deviance that rises from 0 on stays at 0
    "lmm_third": _zoomed("lmm_second", "best", "best + width"),
    "lmm_fourth": _zoomed("lmm_third", "best", "best + width"),
    "lmm_best": _zoomed("lmm_fourth", "best", "best + width"),
    "lmm_sums": f"""
        SELECT model, ref, level, s, tau, center, {_SUMS}, sum(n) AS n, sum(ss) AS ss, count(*) AS sites,
               sum(-1 / (d * d)) AS lss, sum(-n / (d * d)) AS lst, sum(-n * n / (d * d)) AS ltt
        FROM (SELECT *, sigma2 AS s, best * sigma2 AS tau, sigma2 + best * sigma2 * n AS d
              FROM lmm_sites JOIN lmm_best USING (model))
        GROUP BY model, ref, level, s, tau, center""",
    "lmm_curves": f"""
        SELECT *, h_ss * h_tt - h_st * h_st AS det
        FROM (SELECT model, sum(n) - count(*) AS rest,
                     {_pair("us", "us", "uss", "lss")} - sum(n - sites) / power(any_value(s), 2)
                       + 2 * sum(ss) / power(any_value(s), 3) AS h_ss,
                     {_pair("us", "ut", "ust", "lst")} AS h_st,
                     {_pair("ut", "ut", "utt", "ltt")} AS h_tt
              FROM lmm_sums GROUP BY model)""",
    "lmm_terms": """
        SELECT model, term, estimate, sqrt(variance) AS se,
               CASE WHEN tau <= 0 OR det <= 0 THEN rest
                    ELSE 2 * variance * variance * det
                         / (2 * (gs * gs * h_tt - 2 * gs * gt * h_st + gt * gt * h_ss)) END AS df
        FROM (SELECT x.model, x.tau, c.*,
                     CASE WHEN x.level = x.ref THEN '(Intercept)' ELSE 'site_type' || x.level END AS term,
                     CASE WHEN x.level = x.ref THEN x.center + x.u1 / x.u0
                          ELSE x.u1 / x.u0 - r.u1 / r.u0 END AS estimate,
                     1 / x.u0 + CASE WHEN x.level = x.ref THEN 0 ELSE 1 / r.u0 END AS variance,
                     -x.us0 / power(x.u0, 2) - CASE WHEN x.level = x.ref THEN 0 ELSE r.us0 / power(r.u0, 2) END AS gs,
                     -x.ut0 / power(x.u0, 2) - CASE WHEN x.level = x.ref THEN 0 ELSE r.ut0 / power(r.u0, 2) END AS gt
              FROM lmm_sums x JOIN lmm_sums r ON r.model = x.model AND r.level = x.ref
                   JOIN lmm_curves c ON c.model = x.model)""",
}


@query(
    "model term estimate:3 se:3 t:3 df:2 p:3 ci_lo:2 ci_hi:2",
    _P_SQL.format(rows="SELECT model, term, estimate, se, df FROM lmm_terms"),
)
def lmm_random_intercept(s):
    """Type effects with a random site intercept: plant, soil and rates."""
    plots = P.complete_plots(P.plot_carbon(s.plots()), s.sites(), ["treatment2", "biomass_kg", "plant_c"]).filter(
        F.col("treatment2") != "Disturbed"
    )
    soil = core_totals(s, "site_type", policy="lenient").filter(
        F.col("site_type") != REHABILITATED
    )
    fits = M.lmm_fit(
        {
            name: M.RandomIntercept(data, "site_type", "site", y, ref)
            for name, data, y, ref in (
                ("plant", plots, "plant_c", REHABILITATED),
                ("soil", soil, "total", CONVERTED),
                ("soil_rate", horizon_accretion(s, "site_type"), "per_year", CONVERTED),
                ("plant_rate", P.plot_rate(plots), "plant_per_year", ESTABLISHED),
            )
        }
    )
    return M.with_probabilities(fits)
