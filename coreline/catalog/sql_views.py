"""SQL twins of the survey mapping, as common table expressions."""

from __future__ import annotations

import re

from coreline.sources.rates import DATED_RATES, values_sql

_RATES = values_sql([(i, mar, se) for i, (_, mar, se) in enumerate(DATED_RATES)])

VIEWS = {
    "sites": """
        SELECT *, CAST(site_year_numeric AS VARCHAR)
                    || CASE site_no % 7 WHEN 3 THEN 'A' WHEN 5 THEN 'D' ELSE '' END AS site_year,
               CASE WHEN site_type <> 'Rehabilitated' THEN site_type
                    WHEN site_year_numeric < 1992 THEN 'Rehabilitated_old'
                    ELSE 'Rehabilitated_young' END AS site_type_25y
        FROM (SELECT n_nationkey AS site_no,
                     replace(n_name, '_', '') AS site,
                     'S' || CAST(n_nationkey AS VARCHAR) AS site_short,
                     r_name AS region,
                     CASE WHEN r_name IN ('AFRICA', 'AMERICA') THEN 1917 + 4 * n_nationkey
                          ELSE 1972 + (3 * n_nationkey) // 2 END AS site_year_numeric,
                     CASE r_name WHEN 'AFRICA' THEN 'Disturbed' WHEN 'AMERICA' THEN 'Remnant'
                          ELSE 'Rehabilitated' END AS site_old_name,
                     CASE r_name WHEN 'AFRICA' THEN 'Converted' WHEN 'AMERICA' THEN 'Established'
                          ELSE 'Rehabilitated' END AS site_type,
                     CASE n_nationkey % 5 WHEN 0 THEN 1000e0 WHEN 1 THEN 50e0
                          WHEN 2 THEN 10.5e0 WHEN 3 THEN 6.5e0 END AS horizon_cm
              FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 23)""",
    "rates": f"""
        SELECT replace(n_name, '_', '') AS site, mar, mar_se
        FROM nation JOIN (VALUES {_RATES}) AS v(slot, mar, mar_se)
          ON n_nationkey % {len(DATED_RATES)} = v.slot""",
    "places": """
        SELECT n_nationkey AS site_no, replace(n_name, '_', '') AS site, sites.* EXCLUDE (site_no, site)
        FROM nation LEFT JOIN sites ON n_nationkey = site_no""",
    "cores": """
        SELECT o_orderkey AS core_no, c_nationkey AS site_no
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "raw_slices": """
        SELECT l_orderkey AS core_no,
               CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F'
                    THEN 'Saltmarsh_natural' ELSE 'Mangrove' END AS treatment,
               depth_from, depth_to,
               CAST(depth_from AS VARCHAR) || 'to' || CAST(depth_to AS VARCHAR) AS depth_range,
               CASE WHEN l_quantity <> 15 THEN l_discount * 100 END AS c_perc,
               CASE WHEN l_quantity NOT IN (13, 14) THEN l_quantity / 50e0 END AS dry_bulk_density,
               1 - l_tax AS compaction,
               CASE WHEN l_quantity <> 13 THEN l_extendedprice / 1000e0 END AS section_stock
        FROM lineitem JOIN (
          SELECT CAST(k AS INTEGER) AS line, lag(below, 1, 0e0) OVER (ORDER BY k) AS depth_from, below AS depth_to
          FROM (SELECT k, k * 10e0 + CASE WHEN k = 5 THEN 0.5e0 WHEN k >= 7 THEN 40e0 ELSE 0e0 END AS below
                FROM range(1, 100) AS r(k))) AS depths ON line = l_linenumber""",
    "slices": "SELECT * FROM raw_slices WHERE treatment <> 'Saltmarsh_natural'",
    "located": """
        SELECT slices.*, places.*, site || '_' || CAST(slices.core_no AS VARCHAR) AS site_core
        FROM slices LEFT JOIN cores ON slices.core_no = cores.core_no
             LEFT JOIN places ON cores.site_no = places.site_no""",
    "carbon": """
        SELECT *, density * 100 * slice_length AS carbon_stock, density AS carbon_density
        FROM (SELECT *, bulk_density_corrected * c_percent / 100 AS density,
                     pi() * power(5e0 / 2, 2) * slice_length AS sample_volume
              FROM (SELECT *, CASE WHEN c_perc = 0 THEN 0.001e0 ELSE c_perc END AS c_percent,
                           depth_to - depth_from AS slice_length,
                           dry_bulk_density * compaction AS bulk_density_corrected
                    FROM located))""",
    "clipped": """
        SELECT *, depth_at_horizon - depth_from AS slice_to_horizon,
               carbon_density * 100 * (depth_at_horizon - depth_from) AS stock_to_horizon
        FROM (SELECT *, CASE WHEN depth_to <= horizon_cm THEN depth_to
                             WHEN depth_to > horizon_cm THEN horizon_cm END AS depth_at_horizon
              FROM carbon WHERE horizon_cm >= depth_from)""",
    "plots": """
        SELECT o_orderkey AS core_no, places.*,
               site || '_' || CAST(o_orderkey AS VARCHAR) AS subplot_name,
               site_old_name AS treatment2,
               CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
                    THEN o_totalprice / 100e0 END AS biomass_kg
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey
             LEFT JOIN places ON c_nationkey = site_no""",
    "plants": """
        SELECT *, biomass_kg / 10 AS biomass_mg_ha, 0.464e0 * (biomass_kg / 10) AS plant_c,
               2017 - site_year_numeric AS plant_age,
               0.464e0 * (biomass_kg / 10) / (2017 - site_year_numeric) AS plant_per_year
        FROM plots""",
    "complete_plants": """
        SELECT * FROM plants WHERE plant_c IS NOT NULL AND treatment2 IS NOT NULL
          AND site_type IS NOT NULL AND site_year_numeric IS NOT NULL""",
    # core totals: every depth, to 100 cm, to 50 cm, to the horizon
    "core_all": """
        SELECT site_core, core_no, site, site_short, site_type, site_type_25y, site_year_numeric,
               CASE WHEN count(carbon_stock) = count(*) THEN sum(carbon_stock) END AS total
        FROM carbon GROUP BY ALL""",
    "core_100": """
        SELECT site_core, core_no, site, site_short, site_type, site_type_25y, site_year_numeric,
               CASE WHEN count(carbon_stock) = count(*) THEN sum(carbon_stock) END AS total,
               coalesce(sum(carbon_stock), 0) AS total_lenient
        FROM carbon WHERE depth_to <= 100 GROUP BY ALL""",
    "core_50": """
        SELECT site_core, core_no, site, site_short, site_type, site_type_25y, site_year_numeric,
               CASE WHEN count(carbon_stock) = count(*) THEN sum(carbon_stock) END AS total
        FROM carbon WHERE depth_to <= 50 GROUP BY ALL""",
    "core_horizon": """
        SELECT *, 2017 - site_year_numeric AS stand_age,
               total_lenient / (2017 - site_year_numeric) AS per_year
        FROM (SELECT site_core, core_no, site, site_short, site_type, site_type_25y,
                     site_year_numeric,
                     CASE WHEN count(stock_to_horizon) = count(*)
                          THEN sum(stock_to_horizon) END AS total,
                     coalesce(sum(stock_to_horizon), 0) AS total_lenient
              FROM clipped GROUP BY ALL)""",
    "rehabilitated_both": """
        SELECT p.site, c.site_type, c.per_year AS soil_per_year, p.plant_per_year,
               c.per_year + p.plant_per_year AS combined,
               (c.per_year + p.plant_per_year) * 3.67e0 AS co2
        FROM plants p LEFT JOIN (SELECT * FROM core_horizon WHERE site_type = 'Rehabilitated') c
          ON p.core_no = c.core_no
        WHERE p.treatment2 = 'Rehabilitated'""",
    "established_both": """
        SELECT c.site, c.site_type, c.per_year AS soil_per_year, p.plant_per_year,
               c.per_year + p.plant_per_year AS combined,
               (c.per_year + p.plant_per_year) * 3.67e0 AS co2
        FROM core_horizon c LEFT JOIN (SELECT * FROM plants WHERE treatment2 = 'Remnant') p
          ON p.core_no = c.core_no
        WHERE c.site_type = 'Established'""",
}


def with_views(sql: str) -> str:
    """Prefix the views that ``sql`` uses, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {views}\n{sql}" if needed else sql


def mean_se_sql(
    table: str, keys: str, value: str, policy: str, where: str = "TRUE", digits: int | None = None
) -> str:
    """Mean, SD, N, SE per group under a missing-value policy."""
    whole = f"count({value}) = count(*)"
    mean, sd = f"avg({value})", f"stddev_samp({value})"
    if policy == "strict":
        mean = f"CASE WHEN {whole} THEN {mean} END"
    if policy in ("strict", "mixed"):
        sd = f"CASE WHEN {whole} THEN {sd} END"
    se = "sd / sqrt(n)"
    if digits is not None:
        mean, sd, se = (f"round({x}, {digits})" for x in (mean, sd, se))
    by, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT *, {se} AS se FROM (
        SELECT {by}{mean} AS av, {sd} AS sd, count(*) AS n
        FROM {table} WHERE {where} {group})"""


def multi_measure_sql(
    table: str, keys: str, digits: dict[str, int], round_sd: bool = False
) -> str:
    """Lenient mean and strict SD of several measures."""
    inner, outer = [], []
    for name, d in digits.items():
        sd = f"CASE WHEN count({name}) = count(*) THEN stddev_samp({name}) END"
        sd = f"round({sd}, {d})" if round_sd else sd
        inner += [
            f"round(avg({name}), {d}) AS av_{name}",
            f"count(*) AS n_{name}",
            f"{sd} AS sd_{name}",
        ]
        outer.append(f"round(sd_{name} / sqrt(n_{name}), {d}) AS se_{name}")
    return f"""SELECT *, {', '.join(outer)} FROM (
        SELECT {keys}, {', '.join(inner)} FROM {table} GROUP BY {keys})"""


def number_sql(x: str, digits: int) -> str:
    """Number text without trailing zeros, NA where missing."""
    text = f"printf('%.{digits}f', round({x}, {digits}))"
    text = f"regexp_replace(regexp_replace({text}, '0+$', ''), '\\.$', '')"
    return f"CASE WHEN {x} IS NULL THEN 'NA' ELSE {text} END"


def box_sql(table: str, keys: str, value: str, where: str = "TRUE") -> str:
    """Quartiles, whiskers and outlier count."""
    return f"""SELECT {keys}, lower, middle, upper,
            min({value}) FILTER (inside) AS ymin, max({value}) FILTER (inside) AS ymax,
            count(*) AS n, count(*) FILTER (NOT inside) AS outliers
        FROM (SELECT *, {value} BETWEEN lower - (upper - lower) * 1.5e0
                               AND upper + (upper - lower) * 1.5e0 AS inside
              FROM (SELECT *, quantile_cont({value}, 0.25) OVER w AS lower,
                           quantile_cont({value}, 0.5) OVER w AS middle,
                           quantile_cont({value}, 0.75) OVER w AS upper
                    FROM {table} WHERE {value} IS NOT NULL AND {where}
                    WINDOW w AS (PARTITION BY {keys})))
        GROUP BY {keys}, lower, middle, upper"""
