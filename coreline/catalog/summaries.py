"""Aggregates, attached totals and box statistics."""

from pyspark.sql import functions as F

from coreline.catalog.registry import query
from coreline.catalog.sql_views import box_sql, mean_se_sql, multi_measure_sql
from coreline.constants import ESTABLISHED, REHABILITATED
from coreline.functions.nullsafe import n_rows, sum_strict
from coreline.operators import boxstats, summary
from coreline.operators.joins import attach_group_total, join_dim
from coreline.plans import cores as C
from coreline.plans import plots as P

MEAN_SE = "av:4 sd:4 n:i se:4"
BOX = "lower:6 middle:6 upper:6 ymin:6 ymax:6 n:i outliers:i"


def core_totals(s, *columns, max_depth=100.0, policy="strict"):
    """Totals per core, grouped by core number before any join."""
    totals = C.core_stock(C.slice_carbon(s.slices()), s.key, policy, max_depth)
    return s.locate(totals, *columns)


def horizon_slices(s, *columns):
    located = s.locate(C.slice_carbon(s.slices()), "horizon_cm", *columns)
    return C.clip_at_horizon(located)


def horizon_totals(s, *columns, policy="strict"):
    return summary.group_sum(
        horizon_slices(s, *columns), [s.key, "site", *columns], "stock_to_horizon", policy
    )


@query("core_no site total:8", "SELECT core_no, site, total FROM core_100", name="sum_strict")
def sum_strict_query(s):
    """Core stock, missing if any slice is missing."""
    return core_totals(s)


@query(
    "core_no total:8",
    "SELECT core_no, total_lenient AS total FROM core_100",
    name="sum_lenient",
)
def sum_lenient_query(s):
    """Core stock over the slices present; 0 where none is."""
    return core_totals(s, policy="lenient")


@query(f"site {MEAN_SE}", mean_se_sql("core_100", "site", "total", "lenient"))
def mean_se_lenient(s):
    """Mean and SD skip missing cores, N and SE count them."""
    return summary.mean_se(core_totals(s), "site", "total", "lenient")


@query(f"site_type_25y {MEAN_SE}", mean_se_sql("core_100", "site_type_25y", "total", "strict"))
def mean_se_strict(s):
    """One missing core makes its group's mean and SD missing."""
    return summary.mean_se(core_totals(s, "site_type_25y"), "site_type_25y", "total", "strict")


@query(f"site {MEAN_SE}", mean_se_sql("plants", "site", "biomass_mg_ha", "mixed"))
def mean_se_mixed(s):
    """Lenient mean, strict SD."""
    return summary.mean_se(P.plot_carbon(s.plots()), "site", "biomass_mg_ha", "mixed")


@query(
    f"site {MEAN_SE} lo:4 hi:4",
    f"SELECT *, av - se AS lo, av + se AS hi FROM ({mean_se_sql('core_100', 'site', 'total', 'lenient')})",
)
def mean_se_bounds(s):
    """Error-bar ends around the mean."""
    return summary.bounds(summary.mean_se(core_totals(s), "site", "total", "lenient"))


@query(
    f"site {MEAN_SE} av_by_length:4",
    """SELECT *, sd / sqrt(n) AS se FROM (
         SELECT site, avg(per_year) AS av, stddev_samp(per_year) AS sd, count(*) AS n,
                sum(per_year * stand_age) / sum(stand_age) FILTER (per_year IS NOT NULL) AS av_by_length
         FROM core_horizon GROUP BY site)""",
    name="weighted_mean",
)
def weighted_mean_query(s):
    """Weighted mean with weights of 1, and weighted by stand age."""
    cores = C.core_accretion(
        horizon_slices(s, "site_year_numeric"), [s.key, "site", "site_year_numeric"]
    )
    return summary.weighted_summary(
        cores, "site", "per_year", also={"av_by_length": "stand_age"}
    )


@query(
    "min_compaction:6 max_compaction:6 min_carbon_stock:8 max_carbon_stock:8 "
    "min_carbon_density:10 max_carbon_density:10",
    """SELECT min(compaction) AS min_compaction, max(compaction) AS max_compaction,
              min(carbon_stock) AS min_carbon_stock, max(carbon_stock) AS max_carbon_stock,
              min(carbon_density) AS min_carbon_density, max(carbon_density) AS max_carbon_density
       FROM carbon""",
)
def range_check(s):
    """Sanity ranges over all slices."""
    return summary.value_range(
        C.slice_carbon(s.slices()), ["compaction", "carbon_stock", "carbon_density"]
    )


@query(
    "band_lo:4 band_hi:4 groups:i",
    f"""SELECT min(av) AS band_lo, max(av) AS band_hi, count(*) AS groups
        FROM ({mean_se_sql("core_horizon", "site", "total", "lenient", "site_type = 'Established'")})""",
)
def reference_band(s):
    """Lowest and highest site mean of the reference type."""
    totals = horizon_totals(s, "site_type").filter(F.col("site_type") == ESTABLISHED)
    return summary.reference_band(summary.mean_se(totals, "site", "total", "lenient"))


@query(
    "av:4 se:4 lo:4 hi:4",
    f"""SELECT av, se, av - se AS lo, av + se AS hi
        FROM ({mean_se_sql("core_horizon", "", "total", "lenient", "site_type = 'Established'")})""",
)
def reference_band_se(s):
    """Mean and SE band of the reference type."""
    totals = horizon_totals(s, "site_type").filter(F.col("site_type") == ESTABLISHED)
    return summary.bounds(summary.mean_se(totals, [], "total", "lenient"))


@query(MEAN_SE, mean_se_sql("plants", "", "plant_c", "mixed", "site_type = 'Rehabilitated'"))
def global_mean_se(s):
    """One row over all rehabilitated plots."""
    placed = join_dim(P.plot_carbon(s.plots()), s.sites(), "site", ["site_type"])
    return summary.mean_se(
        placed.filter(F.col("site_type") == REHABILITATED), [], "plant_c", "mixed"
    )


@query(f"site_type {MEAN_SE}", mean_se_sql("core_50", "site_type", "total", "lenient"))
def two_level(s):
    """Slice to core to type."""
    located = s.locate(
        C.slice_carbon(s.slices()).filter(F.col("depth_to") <= 50), "site_type"
    )
    return summary.two_level(
        located, ["site_type", s.key], "site_type", "carbon_stock", "strict", "lenient"
    )


_RATES = {"per_year": 1, "total": 1}
_RATE_COLUMNS = " ".join(f"av_{m}:4 n_{m}:i sd_{m}:4 se_{m}:4" for m in _RATES)


def rehabilitated_accretion(s):
    clipped = horizon_slices(s, "site_type", "site_year_numeric").filter(
        F.col("site_type") == REHABILITATED
    )
    return C.core_accretion(clipped, [s.key, "site", "site_type", "site_year_numeric"])


_REHABILITATED_CORES = """(SELECT site, per_year, total_lenient AS total
                           FROM core_horizon WHERE site_type = 'Rehabilitated')"""


@query(f"site {_RATE_COLUMNS}", multi_measure_sql(_REHABILITATED_CORES, "site", _RATES))
def multi_measure(s):
    """Several measures summarised in one pass."""
    return summary.multi_measure(rehabilitated_accretion(s), "site", _RATES, "mixed")


@query(
    f"site {_RATE_COLUMNS}",
    multi_measure_sql(_REHABILITATED_CORES, "site", _RATES, round_sd=True),
)
def rounded_se(s):
    """SE computed from the already rounded SD."""
    return summary.multi_measure(rehabilitated_accretion(s), "site", _RATES, "mixed", round_sd=True)


@query("site site_type", "SELECT DISTINCT site, site_type FROM located")
def distinct_values(s):
    """Sites and types that occur among the slices."""
    cores = s.slices().select(s.key).distinct()
    return s.locate(cores, "site_type").select("site", "site_type").distinct()


@query(
    "site_type n_plots:i av_plant:4",
    """SELECT site_type, count(*) AS n_plots, avg(plant_per_year) AS av_plant
       FROM rehabilitated_both GROUP BY site_type""",
)
def null_group(s):
    """Plots without a core form a group of their own."""
    return (
        rehabilitated_both(s)
        .groupBy("site_type")
        .agg(n_rows().alias("n_plots"), F.avg("plant_per_year").alias("av_plant"))
    )


def rehabilitated_both(s):
    """Rehabilitated plots with the rates of their cores."""
    plots = join_dim(s.plots(), s.sites(), "site", ["site_year_numeric"])
    plots = P.plot_rate(plots.filter(F.col("treatment2") == REHABILITATED)).select(
        s.key, "site", "plant_per_year"
    )
    cores = rehabilitated_accretion(s).select(
        s.key, "site_type", F.col("per_year").alias("soil_per_year")
    )
    return P.combine_plots_and_cores(plots, cores, s.key, keep="plots")


@query(
    "numerator_av:4 denominator_av:4 percent:4 times:4 difference:4",
    """SELECT *, numerator_av / denominator_av * 100 AS percent,
              denominator_av / numerator_av AS times,
              denominator_av - numerator_av AS difference
       FROM (SELECT avg(total) FILTER (site_type = 'Converted') AS numerator_av,
                    avg(total) FILTER (site_type = 'Established') AS denominator_av
             FROM core_100)""",
)
def group_ratio(s):
    """Converted against established, addressed by key."""
    return summary.group_ratio(
        core_totals(s, "site_type"), "site_type", "total", "Converted", ESTABLISHED
    )


# --- box statistics -----------------------------------------------------------

@query(f"site_type {BOX}", box_sql("core_50", "site_type", "total"))
def box_stats(s):
    """Box statistics of the top 50 cm by type."""
    return boxstats.box_stats(core_totals(s, "site_type", max_depth=50.0), ["site_type"], "total")


@query(
    f"site_type {BOX}",
    box_sql(
        "core_horizon", "site_type", "total",
        "total BETWEEN 0 AND 150 AND site_type IN ('Converted', 'Established')",
    ),
)
def box_stats_censored(s):
    """Values outside the axis limits leave before the statistics."""
    totals = horizon_totals(s, "site_type").filter(
        F.col("site_type").isin("Converted", "Established")
    )
    return boxstats.box_stats(totals, ["site_type"], "total", limits=(0.0, 150.0))


@query(
    "core_no site_type total:6",
    """SELECT core_no, site_type, total
       FROM (SELECT *, quantile_cont(total, 0.25) OVER w AS lower,
                    quantile_cont(total, 0.75) OVER w AS upper
             FROM core_50 WHERE total IS NOT NULL WINDOW w AS (PARTITION BY site_type))
       WHERE NOT total BETWEEN lower - (upper - lower) * 1.5e0 AND upper + (upper - lower) * 1.5e0""",
)
def box_outliers(s):
    """The cores drawn as outlier points."""
    totals = core_totals(s, "site_type", max_depth=50.0).select(s.key, "site_type", "total")
    return boxstats.box_outliers(totals, ["site_type"], "total")


# --- totals attached to rows --------------------------------------------------

@query(
    "core_no depth_from:2 section_stock:6 core_total:6",
    """SELECT *, CASE WHEN count(section_stock) OVER w = count(*) OVER w
                      THEN sum(section_stock) OVER w END AS core_total
       FROM slices WHERE depth_to <= 100 WINDOW w AS (PARTITION BY core_no)""",
)
def window_total(s):
    """The strict core total on every slice."""
    rows = s.slices().filter(F.col("depth_to") <= 100).select(s.key, "depth_from", "section_stock")
    return attach_group_total(rows, s.key, sum_strict, "section_stock", "core_total")


@query(
    f"site_type {MEAN_SE} av_co2:4 se_co2:4",
    f"""SELECT *, av * 3.67e0 AS av_co2, se * 3.67e0 AS se_co2 FROM (
        {mean_se_sql('''(SELECT site_type, 100 * CASE WHEN count(r) OVER w = count(*) OVER w
                                                 THEN avg(r) OVER w END AS core_mean
                         FROM (SELECT *, c_perc / 100 * mar AS r FROM located
                               LEFT JOIN rates USING (site) WHERE depth_to <= 30)
                         WINDOW w AS (PARTITION BY core_no))''',
                     'site_type', 'core_mean', 'lenient')})""",
)
def window_mean_reagg(s):
    """Core mean rate counted once per slice, summarised by type."""
    cores = s.locate(C.shallow_core_moments(s.slices(), s.key), "site_type")
    return C.accretion_dated_shallow(join_dim(cores, s.rates(), "site", ["mar"]), "site_type")


@query(
    "core_no depth_from:2 rate:8 min_rate:8 max_rate:8",
    """SELECT core_no, depth_from, rate, min(rate) OVER () AS min_rate, max(rate) OVER () AS max_rate
       FROM (SELECT *, c_perc / 100 * mar * 100 AS rate FROM located LEFT JOIN rates USING (site)
             WHERE site_type = 'Established')""",
)
def global_minmax_attach(s):
    """The range over all established slices on each of them."""
    located = s.locate(s.slices(), "site_type").filter(F.col("site_type") == ESTABLISHED)
    rated = join_dim(located, s.rates(), "site", ["mar"]).withColumn("rate", C.dated_rate())
    return summary.attach_range(rated, "rate")
