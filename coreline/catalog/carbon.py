"""The survey's own results: stocks, rates, tables."""

from pyspark.sql import functions as F

from coreline.catalog.registry import query
from coreline.catalog.sql_views import box_sql, mean_se_sql, multi_measure_sql, number_sql
from coreline.catalog.summaries import (
    BOX,
    MEAN_SE,
    core_totals,
    horizon_slices,
    horizon_totals,
    rehabilitated_both,
)
from coreline.constants import ESTABLISHED, REHABILITATED, REHABILITATED_YOUNG, TYPE_LEVELS
from coreline.operators import boxstats, reshape, summary
from coreline.operators.joins import join_dim
from coreline.plans import cores as C
from coreline.plans import plots as P


def located_plots(s, *columns):
    return join_dim(P.plot_carbon(s.plots()), s.sites(), "site", columns)


# --- stocks -------------------------------------------------------------------

@query(f"site_type {MEAN_SE}", mean_se_sql("core_100", "site_type", "total", "lenient"))
def stock_by_type(s):
    """Mean stock of the top 100 cm per site type: the headline result."""
    return summary.mean_se(core_totals(s, "site_type"), "site_type", "total", "lenient")


@query(
    f"site site_type {MEAN_SE}",
    mean_se_sql("core_100", "site, site_type", "total_lenient", "lenient"),
)
def stock_by_site(s):
    """Mean stock of the top 100 cm per site from lenient core sums."""
    totals = core_totals(s, "site_type", policy="lenient")
    return summary.mean_se(totals, ["site", "site_type"], "total", "lenient")


@query(
    f"site_type site site_short {MEAN_SE}",
    mean_se_sql("core_50", "site_type, site, site_short", "total", "strict"),
)
def stock_50cm_by_site(s):
    """Strict mean stock of the top 50 cm per site."""
    totals = core_totals(s, "site_type", "site_short", max_depth=50.0)
    return summary.mean_se(totals, ["site_type", "site", "site_short"], "total", "strict")


@query(
    "site av:4 sd:4 n:i se:4",
    mean_se_sql("core_horizon", "site", "total", "lenient", digits=1),
)
def stock_to_horizon(s):
    """Mean stock above the dated horizon per site, to one digit."""
    return summary.mean_se(horizon_totals(s), "site", "total", "lenient", digits=1)


@query(f"site_type {MEAN_SE}", mean_se_sql("core_horizon", "site_type", "total", "lenient"))
def stock_to_horizon_by_type(s):
    """Mean stock above the dated horizon per type."""
    return summary.mean_se(horizon_totals(s, "site_type"), "site_type", "total", "lenient")


@query(
    f"{MEAN_SE} site_year site_type",
    f"""SELECT *, '1970' AS site_year, 'Established' AS site_type
        FROM ({mean_se_sql("core_100", "", "total", "lenient", "site_type = 'Established'")})""",
)
def reference_stock(s):
    """One row: mean stock of the reference type."""
    return C.reference_stock(core_totals(s, "site_type"), ESTABLISHED)


@query(
    f"{MEAN_SE} site_year site_type",
    f"""SELECT *, '1970' AS site_year, 'Established' AS site_type
        FROM ({mean_se_sql("core_horizon", "", "total", "lenient", "site_type = 'Established'")})""",
)
def reference_stock_to_horizon(s):
    """One row: mean stock of the reference type above its horizon."""
    return C.reference_stock(horizon_totals(s, "site_type"), ESTABLISHED)


@query(
    f"site_type {MEAN_SE}",
    mean_se_sql(
        """(SELECT site_type, total / (SELECT avg(total) FROM core_100
                                       WHERE site_type = 'Established') * 100 AS share
            FROM core_all WHERE site_type = 'Converted')""",
        "site_type", "share", "lenient",
    ),
)
def pct_of_reference(s):
    """Converted cores (whole depth) against the reference mean (top 100 cm)."""
    reference = C.reference_stock(core_totals(s, "site_type"), ESTABLISHED).select("av")
    whole = core_totals(s, "site_type", max_depth=None)
    return C.percent_of_reference(whole, reference, "Converted")


@query(
    f"site_type {MEAN_SE}",
    mean_se_sql(
        """(SELECT site_type, plant_c / (SELECT avg(plant_c) FROM plants
                                         WHERE site_type = 'Established') * 100 AS share
            FROM plants WHERE site_type = 'Rehabilitated')""",
        "site_type", "share", "lenient",
    ),
)
def pct_of_reference_plant(s):
    """Rehabilitated plots against the mean reference plot."""
    plots = located_plots(s, "site_type")
    reference = summary.mean_se(
        plots.filter(F.col("site_type") == ESTABLISHED), [], "plant_c", "lenient"
    ).select("av")
    return C.percent_of_reference(plots, reference, REHABILITATED, "plant_c")


@query(
    MEAN_SE,
    mean_se_sql(
        f"""(SELECT av AS site_mean FROM ({mean_se_sql(
            "core_100", "site", "total", "lenient", "site_type = 'Established'")}))""",
        "", "site_mean", "lenient",
    ),
)
def reference_of_site_means(s):
    """Mean over the reference sites' means (N counts sites)."""
    totals = core_totals(s, "site_type").filter(F.col("site_type") == ESTABLISHED)
    means = summary.mean_se(totals, "site", "total", "lenient")
    return summary.mean_se(means.select(F.col("av").alias("site_mean")), [], "site_mean", "lenient")


# --- plots --------------------------------------------------------------------

@query(
    f"site site_type {MEAN_SE} co2_equivalent:4",
    f"""SELECT *, av * 3.67e0 AS co2_equivalent
        FROM ({mean_se_sql("plants", "site, site_type", "plant_c", "mixed")})""",
)
def plot_carbon_by_site(s):
    """Plant carbon per site with CO2."""
    out = summary.mean_se(located_plots(s, "site_type"), ["site", "site_type"], "plant_c", "mixed")
    return out.withColumn("co2_equivalent", F.col("av") * 3.67)


@query(
    f"level_idx:i site_type_25y {MEAN_SE}",
    f"""SELECT *, list_position(['Converted', 'Established', 'Rehabilitated_young',
                                 'Rehabilitated_old'], site_type_25y) AS level_idx
        FROM ({mean_se_sql("plants", "site_type_25y", "plant_c", "strict")})""",
)
def plot_carbon_by_type(s):
    """Strict plant carbon summary per type, in level order."""
    out = summary.mean_se(
        located_plots(s, "site_type_25y"), "site_type_25y", "plant_c", "strict"
    )
    return reshape.level_order(out, "site_type_25y", TYPE_LEVELS)


@query(
    f"site age_from_text:2 {MEAN_SE}",
    f"""SELECT m.*, 2017 - TRY_CAST(site_year AS DOUBLE) AS age_from_text
        FROM ({mean_se_sql("plants", "site", "biomass_mg_ha", "mixed", "treatment2 = 'Rehabilitated'")}) m
        JOIN sites USING (site)""",
)
def plot_biomass_by_age(s):
    """Biomass (not carbon) of rehabilitated sites with their stand age."""
    plots = P.plot_carbon(s.plots()).filter(F.col("treatment2") == REHABILITATED)
    out = summary.mean_se(plots, "site", "biomass_mg_ha", "mixed")
    return join_dim(out, s.sites(), "site", ["site_year"]).withColumn(
        "age_from_text", C.stand_age("site_year")
    )


@query(f"site_type_25y {BOX}", box_sql("plants", "site_type_25y", "plant_c"))
def plot_carbon_box(s):
    """Box statistics of plant carbon per type."""
    return boxstats.box_stats(located_plots(s, "site_type_25y"), ["site_type_25y"], "plant_c")


@query(
    "site_type remnant_plant:4",
    f"""SELECT site_type, avg(av) AS remnant_plant
        FROM ({mean_se_sql("plants", "site, site_type", "plant_c", "mixed", "site_type = 'Established'")})
        GROUP BY site_type""",
)
def plot_reference_line(s):
    """Mean of the reference sites' plant carbon means."""
    plots = located_plots(s, "site_type").filter(F.col("site_type") == ESTABLISHED)
    means = summary.mean_se(plots, ["site", "site_type"], "plant_c", "mixed")
    return means.groupBy("site_type").agg(F.avg("av").alias("remnant_plant"))


# --- older core method --------------------------------------------------------

_LEGACY = """(SELECT *, core_total * (100 - (depth_to / compaction - depth_to) / depth_to * 100) / 100
                     AS corrected
              FROM (SELECT *, CASE WHEN count(section_stock) OVER w = count(*) OVER w
                                   THEN sum(section_stock) OVER w END AS core_total
                    FROM located WHERE depth_to <= {depth} WINDOW w AS (PARTITION BY core_no)))"""


@query(
    f"site {MEAN_SE}",
    mean_se_sql(_LEGACY.format(depth=100), "site", "corrected", "lenient"),
)
def legacy_core_correction(s):
    """Depth-percentage correction, averaged over the slices of each site."""
    return C.legacy_core_correction(s.locate(C.legacy_core_moments(s.slices(), s.key)), "site")


@query(
    "core_no treatment2 av:5~ sd:4~ n:i se:4~",
    mean_se_sql(
        f"(SELECT core_no, site_old_name AS treatment2, corrected FROM {_LEGACY.format(depth=50)})",
        "core_no, treatment2", "corrected", "lenient",
    ),
)
def legacy_core_correction_50cm(s):
    """The older correction per core for the top 50 cm."""
    moments = C.legacy_core_moments(s.slices(), s.key, 50.0)
    by_core = C.legacy_core_correction(moments, s.key)
    return s.locate(by_core, "site_old_name").withColumnRenamed("site_old_name", "treatment2")


@query(
    f"treatment2 {BOX}",
    box_sql(
        f"""(SELECT treatment2, av FROM ({mean_se_sql(
            f"(SELECT core_no, site_old_name AS treatment2, corrected FROM {_LEGACY.format(depth=50)})",
            "core_no, treatment2", "corrected", "lenient")}))""",
        "treatment2", "av",
    ),
)
def legacy_box(s):
    """Box statistics of the older per-core means by former site class."""
    return boxstats.box_stats(legacy_core_correction_50cm(s), ["treatment2"], "av")


# --- above and below ----------------------------------------------------------

@query(
    f"site site_type {MEAN_SE} stock",
    f"""SELECT site, site_type, coalesce(av, 0) AS av, coalesce(sd, 0) AS sd, n,
               coalesce(se, 0) AS se, 'Plant' AS stock
        FROM ({mean_se_sql("plants", "site, site_type", "plant_c", "mixed")})
        UNION ALL
        SELECT site, site_type, -av, sd, n, se, 'Soil'
        FROM ({mean_se_sql("core_50", "site, site_type", "total", "strict")})""",
)
def tagged_union(s):
    """Plant above and soil (negated) below, one table."""
    by = ["site", "site_type"]
    plant = reshape.fill_zero(summary.mean_se(located_plots(s, "site_type"), by, "plant_c", "mixed"))
    soil = summary.mean_se(core_totals(s, "site_type", max_depth=50.0), by, "total", "strict")
    return P.above_below(plant, soil)


@query(
    f"site {MEAN_SE} stock site_type site_old_name",
    f"""SELECT m.*, site_type, site_old_name FROM (
          SELECT site, coalesce(av, 0) AS av, coalesce(sd, 0) AS sd, n, coalesce(se, 0) AS se,
                 'Plant' AS stock
          FROM ({mean_se_sql("plants", "site", "plant_c", "mixed")})
          UNION ALL
          SELECT site, -av, sd, n, se, 'Soil'
          FROM ({mean_se_sql("core_100", "site", "total", "lenient")})) m
        JOIN sites USING (site) WHERE site_old_name = 'Remnant'""",
)
def above_below_remnant(s):
    """The mirrored table of one former site class."""
    plant = reshape.fill_zero(summary.mean_se(P.plot_carbon(s.plots()), "site", "plant_c", "mixed"))
    soil = summary.mean_se(core_totals(s), "site", "total", "lenient")
    out = join_dim(P.above_below(plant, soil), s.sites(), "site", ["site_type", "site_old_name"])
    return out.filter(F.col("site_old_name") == "Remnant")


@query(
    f"site site_type_25y {MEAN_SE} stock",
    f"""SELECT * FROM (
          SELECT site, site_type_25y, coalesce(av, 0) AS av, coalesce(sd, 0) AS sd, n,
                 coalesce(se, 0) AS se, 'Plant' AS stock
          FROM ({mean_se_sql("plants", "site, site_type_25y", "plant_c", "mixed")})
          UNION ALL
          SELECT site, site_type_25y, -av, sd, n, se, 'Soil'
          FROM ({mean_se_sql("core_50", "site, site_type_25y", "total", "strict")}))
        WHERE site_type_25y = 'Rehabilitated_young'""",
)
def above_below_young(s):
    """The mirrored table of young rehabilitated sites, top 50 cm."""
    by = ["site", "site_type_25y"]
    plant = summary.mean_se(located_plots(s, "site_type_25y"), by, "plant_c", "mixed")
    soil = summary.mean_se(core_totals(s, "site_type_25y", max_depth=50.0), by, "total", "strict")
    both = P.above_below(reshape.fill_zero(plant), soil)
    return both.filter(F.col("site_type_25y") == REHABILITATED_YOUNG)


@query(
    "site site_type av:4 se:4 stock_source",
    f"""SELECT site, site_type_25y AS site_type, round(av, 2) AS av, round(se, 2) AS se,
               'Belowground' AS stock_source
        FROM ({mean_se_sql("core_100", "site, site_type_25y", "total_lenient", "strict")})
        UNION ALL
        SELECT site, site_type_25y, round(av, 2), round(se, 2), 'Aboveground'
        FROM ({mean_se_sql("complete_plants", "site, site_type_25y", "plant_c", "strict",
                           "treatment2 <> 'Disturbed'")})""",
)
def site_effect_table(s):
    """Site means above and below ground, by age bucket."""
    plots = P.complete_plots(P.plot_carbon(s.plots()), s.sites(), ["treatment2", "plant_c"]).filter(
        F.col("treatment2") != "Disturbed"
    )
    above = plots.select("site", P.age_bucket().alias("bucket"), F.col("plant_c").alias("value"))
    below = core_totals(s, "site_type_25y", policy="lenient").select(
        "site", F.col("site_type_25y").alias("bucket"), F.col("total").alias("value")
    )
    return P.site_effect_table(above, below)


# --- accretion ----------------------------------------------------------------

@query(
    "site site_year_numeric:i site_type mean_car:5 n_car:i sd_car:5 se_car:5",
    """SELECT *, sd_car / sqrt(n_car) AS se_car FROM (
         SELECT site, site_year_numeric, site_type, avg(rate) AS mean_car, count(*) AS n_car,
                stddev_samp(rate) AS sd_car
         FROM (SELECT *, c_perc / 100 * mar * 100 AS rate
               FROM located LEFT JOIN rates USING (site) WHERE site_type <> 'Converted')
         GROUP BY ALL)""",
)
def accretion_dated(s):
    """Accretion from dated rates, per site."""
    by = ["site", "site_year_numeric", "site_type"]
    cores = s.locate(C.carbon_moments(s.slices(), s.key), *by)
    rated = join_dim(cores.filter(F.col("site_type") != "Converted"), s.rates(), "site", ["mar"])
    return C.accretion_dated(rated, by)


@query(
    f"level_idx:i site_type_25y {MEAN_SE} co2_equivalent:4",
    f"""SELECT *, av * 3.67e0 AS co2_equivalent,
               list_position(['Converted', 'Established', 'Rehabilitated_young',
                              'Rehabilitated_old'], site_type_25y) AS level_idx
        FROM ({mean_se_sql("core_horizon", "site_type_25y", "per_year", "strict")})""",
)
def accretion_horizon(s):
    """Yearly burial since the horizon, per type, with CO2."""
    return C.accretion_by_type(horizon_accretion(s, "site_type_25y"), "site_type_25y", TYPE_LEVELS)


def horizon_accretion(s, *columns):
    extra = ["site_year_numeric", *columns]
    return C.core_accretion(horizon_slices(s, *extra), [s.key, "site", *extra])


@query(
    "core_no site site_year_numeric:i site_type_25y total:8 stand_age:2 per_year:6~ per_year_shown:6~",
    """SELECT core_no, site, site_year_numeric, site_type_25y, total_lenient AS total, stand_age,
              per_year, CASE WHEN site_type_25y = 'Converted' THEN 0 ELSE per_year END AS per_year_shown
       FROM core_horizon""",
)
def accretion_by_core(s):
    """Yearly burial of every core; converted sites shown as 0."""
    return C.zero_for_converted(horizon_accretion(s, "site_type_25y"))


@query(
    f"site_type_25y {BOX}",
    box_sql(
        """(SELECT site_type_25y, CASE WHEN site_type_25y = 'Converted' THEN 0
                                       ELSE per_year END AS shown FROM core_horizon)""",
        "site_type_25y", "shown",
    ),
)
def accretion_box(s):
    """Box statistics of yearly burial per type."""
    shown = C.zero_for_converted(horizon_accretion(s, "site_type_25y"))
    return boxstats.box_stats(shown, ["site_type_25y"], "per_year_shown")


@query(
    "site site_year_numeric:i site_type mean_car:4 n_car:i sd_car:4 se_car:4 stand_age:2",
    """SELECT *, sd_car / sqrt(n_car) AS se_car, 2017 - site_year_numeric AS stand_age FROM (
         SELECT site, site_year_numeric, site_type, avg(per_year) AS mean_car, count(*) AS n_car,
                stddev_samp(per_year) AS sd_car
         FROM core_horizon GROUP BY ALL)""",
)
def accretion_horizon_by_site(s):
    """Yearly burial since the horizon, per site, with stand age."""
    by = ["site", "site_year_numeric", "site_type"]
    out = summary.weighted_summary(horizon_accretion(s, "site_type"), by, "per_year")
    return out.select(
        *by,
        F.col("av").alias("mean_car"),
        F.col("n").alias("n_car"),
        F.col("sd").alias("sd_car"),
        F.col("se").alias("se_car"),
        C.stand_age("site_year_numeric").alias("stand_age"),
    )


# --- accumulation table -------------------------------------------------------

_SUMMARY = " ".join(f"av_{m}:4 n_{m}:i sd_{m}:4 se_{m}:4" for m in P.ACCUMULATION_DIGITS)
_ESTABLISHED_DIGITS = {**P.ACCUMULATION_DIGITS, "soil_per_year": 1}


def _text_sql(table: str, digits: dict[str, int]) -> str:
    text = ", ".join(
        f"{number_sql('av_' + m, digits[m])} || ' ± ' || {number_sql('se_' + m, digits[m])} AS {name}"
        for m, name in P.ACCUMULATION_TEXT.items()
    )
    return f"SELECT site, {text} FROM ({multi_measure_sql(table, 'site', digits)})"


_TEXT_COLUMNS = "site " + " ".join(P.ACCUMULATION_TEXT.values())


@query(_TEXT_COLUMNS, _text_sql("rehabilitated_both", P.ACCUMULATION_DIGITS))
def accumulation_table(s):
    """Plant, soil and combined yearly accumulation of rehabilitated sites."""
    return P.accumulation_table(rehabilitated_both(s), ["site"])


@query(
    f"site_type {_SUMMARY}",
    multi_measure_sql("rehabilitated_both", "site_type", P.ACCUMULATION_DIGITS),
)
def accumulation_overall(s):
    """The same over all rehabilitated plots; those without a core apart."""
    return P.accumulation_summary(rehabilitated_both(s), "site_type")


def established_both(s):
    """Established cores with the rates of their plots."""
    plots = join_dim(s.plots(), s.sites(), "site", ["site_year_numeric"])
    plots = P.plot_rate(plots.filter(F.col("treatment2") == "Remnant")).select(
        s.key, "plant_per_year"
    )
    cores = horizon_accretion(s, "site_type").filter(F.col("site_type") == ESTABLISHED).select(
        s.key, "site", "site_type", F.col("per_year").alias("soil_per_year")
    )
    return P.combine_plots_and_cores(plots, cores, s.key, keep="cores")


@query(_TEXT_COLUMNS, _text_sql("established_both", _ESTABLISHED_DIGITS))
def accumulation_established(s):
    """The accumulation table of established sites, starting from cores."""
    return P.accumulation_table(established_both(s), ["site"], _ESTABLISHED_DIGITS)


@query(
    f"site_type {_SUMMARY}",
    multi_measure_sql("established_both", "site_type", P.ACCUMULATION_DIGITS),
)
def accumulation_established_overall(s):
    """The same over all established cores."""
    return P.accumulation_summary(established_both(s), "site_type")
