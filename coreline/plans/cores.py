"""Soil cores: slice carbon, depth and horizon stocks, accretion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreline.constants import CONVERTED, DEFAULTS, Constants
from coreline.functions.nullsafe import ifelse_na, mean_strict, present, sum_strict, try_number
from coreline.operators.joins import join_dim
from coreline.operators.reshape import level_order, split_key
from coreline.operators.summary import (
    group_moments,
    group_sum,
    mean_se,
    merge_moments,
    percent_of,
)


def slice_carbon(slices: DataFrame, constants: Constants = DEFAULTS) -> DataFrame:
    """Corrected carbon density (g/cm3) and stock (Mg/ha) per slice."""
    area = F.pi() * (constants.pipe_diameter_cm / 2) ** 2
    return (
        slices.withColumns(
            {
                "c_percent": ifelse_na(
                    F.col("c_perc") == 0, F.lit(constants.zero_carbon_floor_perc), F.col("c_perc")
                ),
                "slice_length": F.col("depth_to") - F.col("depth_from"),
                "bulk_density_corrected": F.col("dry_bulk_density") * F.col("compaction"),
            }
        )
        .withColumns(
            {
                "sample_volume": area * F.col("slice_length"),
                "carbon_density": F.col("bulk_density_corrected") * F.col("c_percent") / 100,
            }
        )
        .withColumn("carbon_stock", F.col("carbon_density") * 100 * F.col("slice_length"))
    )


def clip_at_horizon(slices: DataFrame) -> DataFrame:
    """Cut slices at ``horizon_cm``; slices that start below it, and sites
    without a horizon, drop out.  Adds ``depth_at_horizon`` and ``stock_to_horizon``.
    """
    # NaN compares as the largest number; here it is no horizon
    kept = slices.filter(present(F.col("horizon_cm")) >= F.col("depth_from"))
    end = ifelse_na(
        F.col("depth_to") <= F.col("horizon_cm"), F.col("depth_to"), F.col("horizon_cm")
    )
    return (
        kept.withColumn("depth_at_horizon", end)
        .withColumn("slice_to_horizon", F.col("depth_at_horizon") - F.col("depth_from"))
        .withColumn("stock_to_horizon", F.col("carbon_density") * 100 * F.col("slice_to_horizon"))
    )


def horizon_clip(
    slices: DataFrame, sites: DataFrame, columns: Sequence[str] = ("horizon_cm",), on: str = "site"
) -> DataFrame:
    """Join the site horizon and clip."""
    return clip_at_horizon(join_dim(slices, sites, on, columns))


def stand_age(year: str | Column, constants: Constants = DEFAULTS) -> Column:
    """Years from planting to the survey; missing for unparsable years."""
    return F.lit(constants.survey_year) - try_number(year)


def core_stock(
    slices: DataFrame, core, policy: str, max_depth: float | None = None, value="carbon_stock"
) -> DataFrame:
    """Stock per core (column ``total``), optionally down to a fixed depth."""
    if max_depth is not None:
        slices = slices.filter(F.col("depth_to") <= max_depth)
    return group_sum(slices, core, value, policy)


def place_cores(totals: DataFrame, sites: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Site columns for totals keyed by ``site_core`` (text ``site_number``)."""
    return join_dim(split_key(totals, "site_core", ["site", "core_number"]), sites, "site", columns)


def stock_to_depth(
    slices: DataFrame, sites: DataFrame, by: str, max_depth: float,
    sum_policy: str = "strict", mean_policy: str = "lenient",
) -> DataFrame:
    """Mean stock to a fixed depth per site or site type."""
    totals = core_stock(slice_carbon(slices), "site_core", sum_policy, max_depth)
    placed = place_cores(totals, sites, [] if by == "site" else [by])
    return mean_se(placed, by, "total", mean_policy)


def stock_to_horizon(
    slices: DataFrame, sites: DataFrame, by: str, digits: int | None = None,
    mean_policy: str = "lenient",
) -> DataFrame:
    """Mean stock above the dated horizon per site or site type."""
    clipped = horizon_clip(slice_carbon(slices), sites)
    totals = core_stock(clipped, "site_core", "strict", value="stock_to_horizon")
    placed = place_cores(totals, sites, [] if by == "site" else [by])
    return mean_se(placed, by, "total", mean_policy, digits)


def reference_stock(placed: DataFrame, site_type: str, by: str = "site_type") -> DataFrame:
    """Global mean and SE of the core totals of one site type."""
    return mean_se(placed.filter(F.col(by) == site_type), [], "total", "lenient").withColumns(
        {"site_year": F.lit(DEFAULTS.reference_plot_year), "site_type": F.lit(site_type)}
    )


def percent_of_reference(
    placed: DataFrame, reference: DataFrame, site_type: str, value: str = "total"
) -> DataFrame:
    """Mean percentage of the reference mean for one site type."""
    chosen = percent_of(placed.filter(F.col("site_type") == site_type), value, reference)
    return mean_se(chosen, "site_type", "percent", "lenient")


def legacy_depth_percent() -> Column:
    """Share of stock kept after the older depth correction, in percent."""
    corrected = F.try_divide(F.col("depth_to"), F.col("compaction"))
    return 100 - F.try_divide(corrected - F.col("depth_to"), F.col("depth_to")) * 100


def legacy_core_moments(slices: DataFrame, core, max_depth: float = 100.0) -> DataFrame:
    """Per core: strict section total, and moments of the slices' kept share."""
    return group_moments(
        slices.filter(F.col("depth_to") <= max_depth),
        core,
        legacy_depth_percent() / 100,
        core_total=sum_strict("section_stock"),
    )


def legacy_core_correction(moments: DataFrame, by) -> DataFrame:
    """Older method: core total times each slice's depth percentage, averaged
    over the slices of a group (N counts slices)."""
    return merge_moments(moments, by, "core_total")


def dated_rate() -> Column:
    """Carbon accretion (Mg/ha/y) of a slice from its carbon share and dated rate."""
    return F.col("c_perc") / 100 * F.col("mar") * 100


def carbon_moments(slices: DataFrame, core) -> DataFrame:
    """Per core: moments of the carbon percentage over its slices."""
    return group_moments(slices, core, "c_perc")


def accretion_dated(moments: DataFrame, by) -> DataFrame:
    """Mean dated accretion over slices, from core moments with ``mar``.

    The rate is the same throughout a core, so it scales the core's moments.
    """
    return merge_moments(moments, by, "mar").withColumnsRenamed(
        {"av": "mean_car", "sd": "sd_car", "n": "n_car", "se": "se_car"}
    )


def shallow_core_moments(slices: DataFrame, core, max_depth: float = 30.0) -> DataFrame:
    """Per core: slices down to ``max_depth`` and their strict mean carbon percentage."""
    return group_moments(
        slices.filter(F.col("depth_to") <= max_depth), core, core_mean=mean_strict("c_perc")
    )


def accretion_dated_shallow(moments: DataFrame, by, constants: Constants = DEFAULTS) -> DataFrame:
    """Shallow variant: the core mean rate counted once per slice, with CO2."""
    out = merge_moments(moments, by, F.col("core_mean") * F.col("mar"))
    return out.withColumns(
        {
            "av_co2": F.col("av") * constants.carbon_to_co2,
            "se_co2": F.col("se") * constants.carbon_to_co2,
        }
    )


def core_accretion(clipped: DataFrame, keys: Sequence[str], constants: Constants = DEFAULTS) -> DataFrame:
    """Yearly burial per core since its horizon.

    ``keys`` identify a core and must include ``site_year_numeric``.
    ``per_year`` is missing where the stand age is 0.
    """
    totals = group_sum(clipped, keys, "stock_to_horizon", "lenient")
    return totals.withColumn("stand_age", stand_age("site_year_numeric", constants)).withColumn(
        "per_year", F.try_divide(F.col("total"), F.col("stand_age"))
    )


def zero_for_converted(accretion: DataFrame, by: str = "site_type_25y") -> DataFrame:
    """Second rate column that is 0 at converted sites."""
    return accretion.withColumn(
        "per_year_shown", ifelse_na(F.col(by) == CONVERTED, F.lit(0.0), F.col("per_year"))
    )


def accretion_by_type(
    accretion: DataFrame, by: str, levels: Sequence[str], constants: Constants = DEFAULTS
) -> DataFrame:
    """Strict mean yearly burial per site type, with CO2, in level order."""
    out = mean_se(accretion, by, "per_year", "strict").withColumn(
        "co2_equivalent", F.col("av") * constants.carbon_to_co2
    )
    return level_order(out, by, levels)
