"""Scans, sinks, projections, filters, joins and reshapes."""

from pyspark.sql import functions as F

from coreline.catalog.registry import query
from coreline.catalog.sql_views import mean_se_sql, number_sql
from coreline.constants import ESTABLISHED, REHABILITATED
from coreline.functions.nullsafe import ifelse_na, sum_strict
from coreline.operators import reshape
from coreline.operators.joins import join_dim, join_many_to_one
from coreline.operators.summary import mean_se
from coreline.plans import cores as C
from coreline.plans import plots as P
from coreline.runtime import drop_path, new_path
from coreline.sources import tables


# --- sources and sinks --------------------------------------------------------

@query(
    "core_no treatment depth_from:2 depth_to:2 depth_range c_perc:6 dry_bulk_density:6 "
    "compaction:6 section_stock:6",
    "SELECT * FROM raw_slices",
)
def scan_slices(s):
    """Every slice as measured."""
    return s.raw_slices()


@query(
    "site mar:4 mar_se:4 plots:i",
    "SELECT site, mar, mar_se, count(*) AS plots FROM plots JOIN rates USING (site) GROUP BY ALL",
)
def literal_rates(s):
    """The literal rate of every site that has plots, with its plot count."""
    per_site = s.plots().groupBy("site").agg(F.count(F.lit(1)).alias("plots"))
    return join_dim(per_site, s.rates(), "site", ["mar", "mar_se"])


@query("site_core site total:8", "SELECT site_core, site, total FROM core_100")
def sink_roundtrip(s):
    """Core totals written as CSV, read back by header, then kept as Parquet."""
    totals = s.locate(C.core_stock(C.slice_carbon(s.slices()), s.key, "strict", 100.0))
    fields = {"site_core": ("site_core", "string"), "site": ("site", "string"),
              "total": ("total", "double")}
    path = tables.write_csv(totals.select(*fields), new_path(s.spark, "core-totals-csv"))
    try:
        return tables.materialise(
            tables.read_csv(s.spark, path, fields), new_path(s.spark, "core-totals")
        )
    finally:
        drop_path(s.spark, path)


@query(
    "core_no:i depth_from:2 depth_to:2 c_perc:4 treatment",
    "SELECT core_no, depth_from, depth_to, c_perc, treatment FROM raw_slices",
)
def scan_csv_files(s):
    """Slices from CSV files of two column orders, each read by its own header."""
    slices = s.raw_slices().withColumn("core_no", F.col(s.key).cast("string"))
    fields = {"core_no": ("Core", "string")} | {
        k: tables.SLICE_FIELDS[k] for k in ("depth_from", "depth_to", "c_perc", "treatment")
    }
    paths = []
    for part, order in enumerate((list(fields), list(reversed(fields)))):
        some = slices.filter(F.pmod(F.xxhash64("core_no"), F.lit(2)) == part)
        named = some.select(*[F.col(k).alias(fields[k][0]) for k in order])
        paths.append(tables.write_csv(named, new_path(s.spark, "slices-csv")))
    return tables.read_csv(s.spark, paths, fields)


# --- projections --------------------------------------------------------------

@query(
    "site site_short site_core treatment depth_to:2 depth_range section_stock:6 compaction:6",
    "SELECT site, site_short, site_core, treatment, depth_to, depth_range, section_stock, "
    "compaction FROM located",
)
def select_cols(s):
    """Column selection in which a repeated name appears once."""
    return reshape.select_distinct_names(
        s.locate(s.slices(), "site_short"),
        "site", "site_short", "site_core", "treatment", "depth_to", "depth_range",
        "site_core", "section_stock", "compaction",
    )


@query(
    "subplot_name site biomass_kg:6 biomass_mg_ha:8 plant_c:8",
    "SELECT subplot_name, site, biomass_kg, biomass_mg_ha, plant_c FROM plants",
)
def plot_carbon(s):
    """Biomass and carbon of every plot."""
    return P.plot_carbon(s.plots())


@query(
    "core_no depth_from:2 depth_to:2 c_percent:6 slice_length:4 sample_volume:6 "
    "bulk_density_corrected:8 carbon_density:10 carbon_stock:8",
    "SELECT * FROM carbon",
)
def slice_carbon(s):
    """Corrected density, carbon density and stock of every slice."""
    return C.slice_carbon(s.slices())


@query(
    "core_no site depth_from:2 depth_to:2 horizon_cm:2 depth_at_horizon:2 slice_to_horizon:2 "
    "stock_to_horizon:8",
    "SELECT * FROM clipped",
)
def horizon_clip(s):
    """Slices cut at their site's horizon."""
    located = s.locate(C.slice_carbon(s.slices()))
    return C.horizon_clip(located, s.sites())


@query(
    "core_no depth_from:2 c_percent:6 density_class marker",
    """SELECT core_no, depth_from, c_percent,
              CASE WHEN dry_bulk_density >= 0.5 THEN 'dense'
                   WHEN dry_bulk_density < 0.5 THEN 'loose' END AS density_class,
              CASE WHEN site = 'NATION3' THEN 'lightgrey' ELSE 'black' END AS marker
       FROM carbon""",
    name="ifelse_na",
)
def two_way_choice(s):
    """Two-way choices that stay missing where their condition is missing."""
    located = s.locate(C.slice_carbon(s.slices()))
    return located.withColumns(
        {
            "density_class": ifelse_na(
                F.col("dry_bulk_density") >= 0.5, F.lit("dense"), F.lit("loose")
            ),
            "marker": ifelse_na(F.col("site") == "NATION3", F.lit("lightgrey"), F.lit("black")),
        }
    )


@query(
    "subplot_name site_year age_from_text:2 age:2",
    """SELECT subplot_name, site_year, 2017 - TRY_CAST(site_year AS DOUBLE) AS age_from_text,
              2017 - site_year_numeric AS age FROM plots""",
)
def stand_age(s):
    """Stand age from dirty year text (missing if unparsable) and from numbers."""
    placed = join_dim(s.plots(), s.sites(), "site", ["site_year", "site_year_numeric"])
    return placed.withColumns(
        {"age_from_text": C.stand_age("site_year"), "age": C.stand_age("site_year_numeric")}
    )


@query(
    "level_idx:i site_type av:4 sd:4 n:i se:4",
    f"""SELECT *, list_position(['Converted', 'Established'], type3) AS level_idx,
               CASE WHEN type3 IN ('Converted', 'Established') THEN type3 END AS site_type
        FROM ({mean_se_sql("(SELECT *, site_type AS type3 FROM plants)", "type3", "plant_c", "lenient")})""",
)
def level_order(s):
    """Plot summary in a given level order; unlisted types become missing."""
    placed = join_dim(P.plot_carbon(s.plots()), s.sites(), "site", ["site_type"])
    out = mean_se(placed, "site_type", "plant_c", "lenient")
    return reshape.level_order(out, "site_type", ["Converted", "Established"]).orderBy("level_idx")


@query(
    "subplot_name site_type site_year_numeric:i bucket",
    """SELECT subplot_name, site_type, site_year_numeric, site_type_25y AS bucket FROM plots""",
)
def age_bucket(s):
    """Young and old stands from planting year and type."""
    placed = join_dim(s.plots(), s.sites(), "site", ["site_type", "site_year_numeric"])
    return placed.withColumn("bucket", P.age_bucket())


# --- filters ------------------------------------------------------------------

@query(
    "core_no site treatment depth_from:2 depth_to:2 section_stock:6",
    "SELECT * FROM located WHERE site_type <> 'Rehabilitated'",
)
def filter_type(s):
    """Equality and inequality filters; a missing comparison drops the row."""
    assessed = s.raw_slices().filter(F.col("treatment") != "Saltmarsh_natural")
    return s.locate(assessed, "site_type").filter(F.col("site_type") != REHABILITATED)


@query(
    "core_no total:8",
    "SELECT core_no, total FROM core_50",
)
def stock_topk_depth(s):
    """Core stock of the top 50 cm; the depth cut reaches the scan."""
    return C.core_stock(C.slice_carbon(s.slices()), s.key, "strict", 50.0)


@query(
    "site_type av:4 sd:4 n:i se:4",
    mean_se_sql(
        "(SELECT site_type, core_no, CASE WHEN count(carbon_stock) = count(*) "
        "THEN sum(carbon_stock) END AS total FROM carbon WHERE depth_to < 51 "
        "AND (site_type = 'Converted' OR site_type = 'Established') GROUP BY ALL)",
        "site_type", "total", "strict",
    ),
)
def filter_or(s):
    """Two types, slices above 51 cm, strict summary by type."""
    shallow = C.slice_carbon(s.slices()).filter(F.col("depth_to") < 51)
    totals = s.locate(C.core_stock(shallow, s.key, "strict"), "site_type")
    two = totals.filter(F.col("site_type").isin("Converted", ESTABLISHED))
    return mean_se(two, "site_type", "total", "strict")


@query(
    "subplot_name treatment2 biomass_kg:6 plant_c:8",
    "SELECT * FROM complete_plants WHERE treatment2 <> 'Disturbed'",
)
def complete_cases(s):
    """Plots of known sites with every value present, disturbed sites left out."""
    rows = P.complete_plots(P.plot_carbon(s.plots()), s.sites(), ["subplot_name", "treatment2", "biomass_kg", "plant_c"])
    return rows.filter(F.col("treatment2") != "Disturbed")


@query(
    "site av:4 sd:4 n:i se:4",
    f"""SELECT site, coalesce(av, 0) AS av, coalesce(sd, 0) AS sd, n, coalesce(se, 0) AS se
        FROM ({mean_se_sql("plants", "site", "plant_c", "mixed")})""",
)
def fill_zero(s):
    """Plot summary with 0 in place of missing numbers."""
    return reshape.fill_zero(
        mean_se(P.plot_carbon(s.plots()), "site", "plant_c", "mixed")
    )


# --- joins --------------------------------------------------------------------

@query(
    "core_no site depth_to:2 site_type site_type_25y horizon_cm:2",
    "SELECT * FROM located",
    name="join_dim",
)
def join_dimension(s):
    """Slices with their projected site dimension."""
    return join_dim(
        s.locate(s.slices()), s.sites(), "site", ["site_type", "site_type_25y", "horizon_cm"]
    )


@query(
    "core_no site plant_c:8 total:8",
    """SELECT p.core_no, p.site, plant_c, total
       FROM plants p LEFT JOIN core_100 c ON p.core_no = c.core_no""",
)
def join_plot_core(s):
    """Every plot with the stock of its core, if it has one."""
    totals = C.core_stock(C.slice_carbon(s.slices()), s.key, "strict", 100.0)
    plots = P.plot_carbon(s.plots()).select(s.key, "site", "plant_c")
    return join_many_to_one(plots, totals, s.key, "left")


@query(
    "core_no total:8 plant_c:8",
    """SELECT c.core_no, total, plant_c
       FROM core_100 c LEFT JOIN plants p ON p.core_no = c.core_no""",
)
def join_core_plot(s):
    """Every core with the carbon of its plots, if it has any."""
    totals = C.core_stock(C.slice_carbon(s.slices()), s.key, "strict", 100.0)
    plots = P.plot_carbon(s.plots()).select(s.key, "plant_c")
    return join_many_to_one(plots, totals, s.key, "right")


@query(
    "core_no plant_c:8 slices:i deepest:2 total:8",
    """SELECT p.core_no, any_value(plant_c) AS plant_c, count(r.core_no) AS slices,
              max(depth_to) AS deepest, CASE WHEN count(*) = count(section_stock) THEN sum(section_stock) END AS total
       FROM plants p LEFT JOIN raw_slices r ON p.core_no = r.core_no GROUP BY p.core_no""",
)
def join_saved_by_core(s):
    """Every plot with the slices of its core, from tables saved by core: neither side is shuffled."""
    plots = P.plot_carbon(s.plots()).select(s.key, "plant_c")
    at = new_path(s.spark, "by-core")
    slices, plots = tables.save_together(
        s.raw_slices().select(s.key, "depth_to", "section_stock"), plots, s.key,
        int(s.spark.conf.get("spark.sql.shuffle.partitions")), at.rsplit("/", 1)[1].replace("-", "_"), at,
    )
    met = plots.join(slices.withColumn("is_slice", F.lit(1)), s.key, "left")
    return met.groupBy(s.key).agg(
        F.first("plant_c").alias("plant_c"),
        F.count("is_slice").alias("slices"),
        F.max("depth_to").alias("deepest"),
        sum_strict("section_stock").alias("total"),
    )


@query(
    "site site_type site_year horizon_cm:2 mar:4 mar_se:4 cores:i",
    """SELECT site, site_type, site_year, horizon_cm, mar, mar_se, count(core_no) AS cores
       FROM sites LEFT JOIN rates USING (site) LEFT JOIN cores USING (site_no) GROUP BY ALL""",
)
def join_rates(s):
    """Site dimension with its dated rates and number of cores."""
    sites = join_dim(s.sites(), s.rates(), "site", ["mar", "mar_se"])
    return join_dim(sites, s.core_counts(), "site", ["cores"]).fillna(0, ["cores"])


@query(
    "site site_type site_year_numeric:i av:4 sd:4 n:i se:4 marker",
    f"""SELECT m.*, site_type, site_year_numeric,
               CASE WHEN site = 'NATION3' THEN 'lightgrey' ELSE 'black' END AS marker
        FROM ({mean_se_sql("core_horizon", "site", "total", "lenient")}) m JOIN sites USING (site)""",
)
def join_after_agg(s):
    """Aggregate first, then join the few result rows to their attributes."""
    clipped = C.clip_at_horizon(s.locate(C.slice_carbon(s.slices()), "horizon_cm"))
    totals = C.core_stock(clipped, [s.key, "site"], "strict", value="stock_to_horizon")
    out = mean_se(totals, "site", "total", "lenient")
    out = join_dim(out, s.sites(), "site", ["site_type", "site_year_numeric"])
    return out.withColumn(
        "marker", F.when(F.col("site") == "NATION3", "lightgrey").otherwise("black")
    )


@query(
    "core_no site depth_from:2 mar:4 site_type rate:8",
    """SELECT core_no, site, depth_from, mar, site_type, c_perc / 100 * mar * 100 AS rate
       FROM located LEFT JOIN rates USING (site)""",
)
def join_chain(s):
    """Slices joined to dated rates, then to the projected site dimension."""
    rated = join_dim(s.locate(s.slices()), s.rates(), "site", ["mar"])
    return join_dim(rated, s.sites(), "site", ["site_type"]).withColumn("rate", C.dated_rate())


# --- reshape ------------------------------------------------------------------

@query(
    "subplot_name measure value:8",
    """SELECT subplot_name, 'biomass_mg_ha' AS measure, biomass_mg_ha AS value FROM plants
       UNION ALL SELECT subplot_name, 'plant_c', plant_c FROM plants""",
)
def unpivot_measures(s):
    """Plot measures in long form."""
    return reshape.unpivot_measures(
        P.plot_carbon(s.plots()), ["subplot_name"], ["biomass_mg_ha", "plant_c"]
    )


@query(
    "site_core site core_number depth_class missing_piece",
    """SELECT site_core, split_part(site_core, '_', 1) AS site,
              split_part(site_core, '_', 2) AS core_number,
              split_part(depth_range, 'to', 1) AS depth_class,
              CAST(NULL AS VARCHAR) AS missing_piece
       FROM located""",
)
def split_key(s):
    """Text split into columns; absent pieces are missing."""
    rows = s.locate(s.slices()).select("site_core", "depth_range")
    parts = reshape.split_key(rows, "site_core", ["site", "core_number", "missing_piece"])
    return reshape.split_key(parts, "depth_range", ["depth_class"], sep="to", keep=False)


@query(
    "site_type plant_text",
    f"""SELECT site_type, {number_sql("av", 1)} || ' ± ' || {number_sql("se", 1)} AS plant_text
        FROM ({mean_se_sql("plants", "site_type", "plant_c", "mixed")})""",
)
def unite_pm(s):
    """Mean and SE as one text; the text NA where missing."""
    placed = join_dim(P.plot_carbon(s.plots()), s.sites(), "site", ["site_type"])
    return reshape.unite_pm(
        mean_se(placed, "site_type", "plant_c", "mixed"), "plant_text", "av", "se", 1
    )


@query(
    "core_no depth_from:2 depth_to:2 c_percent:6 carbon_stock:8",
    """SELECT * FROM carbon
       ORDER BY core_no, depth_from, c_percent, carbon_stock NULLS FIRST LIMIT 6""",
)
def head_rows(s):
    """First six slices in a stated order."""
    rows = C.slice_carbon(s.slices())
    return rows.orderBy(s.key, "depth_from", "c_percent", "carbon_stock").limit(6)
