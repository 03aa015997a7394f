"""Vegetation plots, and plots combined with cores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreline.constants import (
    DEFAULTS,
    REHABILITATED,
    REHABILITATED_OLD,
    REHABILITATED_YOUNG,
    Constants,
)
from coreline.operators.joins import join_dim, join_many_to_one
from coreline.operators.reshape import mirror, tagged_union, unite_pm
from coreline.operators.summary import mean_se, multi_measure
from coreline.plans.cores import stand_age


def plot_carbon(plots: DataFrame, constants: Constants = DEFAULTS) -> DataFrame:
    """Biomass in Mg/ha and plant carbon per plot."""
    return plots.withColumn(
        "biomass_mg_ha", F.col("biomass_kg") / constants.kg_per_100m2_to_mg_per_ha
    ).withColumn("plant_c", constants.biomass_to_carbon * F.col("biomass_mg_ha"))


def plot_rate(plots: DataFrame, constants: Constants = DEFAULTS) -> DataFrame:
    """Plant carbon per year of stand age; needs ``site_year_numeric``."""
    return (
        plot_carbon(plots, constants)
        .withColumn("plant_age", stand_age("site_year_numeric", constants))
        .withColumn("plant_per_year", F.try_divide(F.col("plant_c"), F.col("plant_age")))
    )


def complete_plots(
    plots: DataFrame, sites: DataFrame, columns: Sequence[str], site_columns: Sequence[str] = ("site_type", "site_year_numeric")
) -> DataFrame:
    """Plots of which nothing is missing: neither the given columns nor the site's.

    The columns are chosen and the site joined before incomplete rows drop out,
    so a gap elsewhere does no harm, and plots of unknown sites go.
    """
    wanted = list(dict.fromkeys(["site", *columns]))
    return join_dim(plots.select(*wanted), sites, "site", list(site_columns)).dropna("any")


def age_bucket(constants: Constants = DEFAULTS) -> Column:
    """Rehabilitated sites split by planting year; other types unchanged."""
    rehabilitated = F.col("site_type") == REHABILITATED
    year = F.col("site_year_numeric")
    cut = constants.young_stand_from_year
    return (
        F.when(rehabilitated & (year < cut), REHABILITATED_OLD)
        .when(rehabilitated & (year >= cut), REHABILITATED_YOUNG)
        .when(rehabilitated & year.isNull(), F.lit(None))
        .otherwise(F.col("site_type"))
    )


def combine_plots_and_cores(
    plots: DataFrame,
    cores: DataFrame,
    key: str,
    keep: str,
    constants: Constants = DEFAULTS,
) -> DataFrame:
    """Yearly plant and soil rates side by side, their sum and its CO2.

    ``keep="plots"`` keeps plots without a core, ``keep="cores"`` cores without
    a plot.  ``plots`` has ``plant_per_year``; ``cores`` has ``soil_per_year``
    and each key once.
    """
    how = {"plots": "left", "cores": "right"}[keep]
    both = join_many_to_one(plots, cores, key, how)
    return both.withColumn(
        "combined", F.col("soil_per_year") + F.col("plant_per_year")
    ).withColumn("co2", F.col("combined") * constants.carbon_to_co2)


# Display digits of the accumulation table
ACCUMULATION_DIGITS = {"soil_per_year": 3, "plant_per_year": 1, "combined": 1, "co2": 1}
ACCUMULATION_TEXT = {
    "soil_per_year": "soil_carbon_per_year",
    "plant_per_year": "plant_carbon_per_year",
    "combined": "combined_accumulation",
    "co2": "co2_eq_per_ha_per_year",
}


def accumulation_summary(
    combined: DataFrame, by, digits: Mapping[str, int] = ACCUMULATION_DIGITS
) -> DataFrame:
    """Mean, N, SD and SE of the four measures."""
    return multi_measure(combined, by, digits, "mixed")


def accumulation_table(
    combined: DataFrame, by: Sequence[str], digits: Mapping[str, int] = ACCUMULATION_DIGITS
) -> DataFrame:
    """The summary as ``mean ± se`` text."""
    out = accumulation_summary(combined, by, digits)
    for measure, name in ACCUMULATION_TEXT.items():
        out = unite_pm(out, name, f"av_{measure}", f"se_{measure}", digits[measure])
    return out.select(*by, *ACCUMULATION_TEXT.values())


def above_below(plant: DataFrame, soil: DataFrame) -> DataFrame:
    """Plant and soil summaries in one table, soil mirrored below zero."""
    return mirror(tagged_union({"Plant": plant, "Soil": soil}), "Soil")


def site_effect_table(above: DataFrame, below: DataFrame, digits: int = 2) -> DataFrame:
    """Strict mean and SE by site and age bucket, above and below ground.

    Both inputs have ``site``, ``bucket`` and ``value``.
    """
    def side(df):
        return (
            mean_se(df, ["site", "bucket"], "value", "strict")
            .select(
                "site",
                F.col("bucket").alias("type"),
                F.round("av", digits).alias("av"),
                F.round("se", digits).alias("se"),
            )
            .withColumnRenamed("type", "site_type")
        )

    return tagged_union({"Belowground": side(below), "Aboveground": side(above)}, "stock_source")
