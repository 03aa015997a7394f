"""The driver's star schema seen as a survey.

lineitem = core slices, orders = cores and vegetation plots, customer's nation
= site.  Joins here carry only keys; descriptive text is attached last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreline.constants import CONVERTED, DEFAULTS, ESTABLISHED, REHABILITATED
from coreline.functions.nullsafe import without_nan
from coreline.operators.joins import broadcast_checked, counted_by
from coreline.runtime import configure
from coreline.sources.rates import DATED_RATES, values_sql
from coreline.sources.survey import FieldSurvey


# This site has cores and plots, but no row in the site dimension.
UNKNOWN_SITE = 23

# Columns in use; a stated schema saves the pass that infers one.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string",
}


class DriverSurvey(FieldSurvey):
    """Slices, plots, sites and rates of one scale-factor folder.

    Cores are identified by number, so that slices need no join to be grouped
    by core; ``locate`` finds the site of a core number.
    """

    key = "core_no"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, build) -> DataFrame:
        # One DataFrame object per lookup, so its size is checked once.
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def sites(self) -> DataFrame:
        """One row per site; ``site_no`` is the join key inside this mapping."""
        return self._once("sites", self._build_sites)

    def rates(self) -> DataFrame:
        """The literal dated rates, keyed by site in rotation."""
        return self._once("rates", self._build_rates)

    def _build_sites(self) -> DataFrame:
        number = F.col("n_nationkey")
        kind = (
            F.when(F.col("r_name") == "AFRICA", CONVERTED)
            .when(F.col("r_name") == "AMERICA", ESTABLISHED)
            .otherwise(REHABILITATED)
        )
        planted = (F.lit(1972) + F.floor(3 * number / 2)).cast("int")
        year = F.when(kind == REHABILITATED, planted).otherwise(F.lit(1917) + 4 * number)
        young = F.when(year < DEFAULTS.young_stand_from_year, "Rehabilitated_old").otherwise(
            "Rehabilitated_young"
        )
        nation = self.table("nation")
        region = self.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
        sites = nation.filter(number != UNKNOWN_SITE).join(region, "n_regionkey").select(
            number.alias("site_no"),
            F.replace("n_name", F.lit("_"), F.lit("")).alias("site"),
            F.concat(F.lit("S"), number.cast("string")).alias("site_short"),
            F.col("r_name").alias("region"),
            F.concat(
                year.cast("string"), F.when(number % 7 == 3, "A").when(number % 7 == 5, "D").otherwise("")
            ).alias("site_year"),
            year.alias("site_year_numeric"),
            F.when(kind == CONVERTED, "Disturbed")
            .when(kind == ESTABLISHED, "Remnant")
            .otherwise(REHABILITATED)
            .alias("site_old_name"),
            kind.alias("site_type"),
            F.when(kind == REHABILITATED, young).otherwise(kind).alias("site_type_25y"),
            F.when(number % 5 == 0, 1000.0)
            .when(number % 5 == 1, 50.0)
            .when(number % 5 == 2, 10.5)
            .when(number % 5 == 3, 6.5)
            .alias("horizon_cm"),
        )
        return counted_by(sites, nation)

    def _build_rates(self) -> DataFrame:
        keyed = [(i, mar, se) for i, (_, mar, se) in enumerate(DATED_RATES)]
        literal = self.spark.sql(
            f"SELECT * FROM VALUES {values_sql(keyed)} AS rates(slot, mar, mar_se)"
        )
        nation = self.table("nation").select(
            F.replace("n_name", F.lit("_"), F.lit("")).alias("site"),
            (F.col("n_nationkey") % len(keyed)).alias("slot"),
        )
        rates = nation.join(literal, "slot").select("site", "mar", "mar_se")
        return counted_by(rates, nation)

    def _places(self) -> DataFrame:
        """Every site by number, with the columns of those that the dimension knows."""
        return self._once("places", self._build_places)

    def _build_places(self) -> DataFrame:
        nation = self.table("nation")
        names = nation.select(
            F.col("n_nationkey").alias("site_no"), F.replace("n_name", F.lit("_"), F.lit("")).alias("site")
        )
        return counted_by(names.join(self.sites().drop("site"), "site_no", "left"), nation)

    def _owned(self, orders: DataFrame) -> DataFrame:
        """Rows with ``o_custkey`` and the number of their site instead."""
        owner = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("site_no")
        )
        return orders.join(owner, "o_custkey", "left").drop("o_custkey")

    def cores(self) -> DataFrame:
        """Which site each core belongs to: keys only."""
        return self._owned(
            self.table("orders").select(F.col("o_orderkey").alias("core_no"), "o_custkey")
        )

    def core_counts(self) -> DataFrame:
        """Cores per site: one row per site at most."""
        counts = self.cores().groupBy("site_no").agg(F.count(F.lit(1)).alias("cores"))
        sites = broadcast_checked(self.sites(), ["site_no", "site"])
        return counted_by(counts.join(sites, "site_no").select("site", "cores"), self.sites())

    def raw_slices(self) -> DataFrame:
        """Slice measurements by core number, all habitats."""
        return without_nan(self._as_slices(self.table("lineitem")))

    def slices(self) -> DataFrame:
        """Slices of the assessed habitats, by core number.

        The habitat test is put on stored columns, so that the scan applies it.
        """
        assessed = (F.col("l_returnflag") != "R") | (F.col("l_linestatus") != "F")
        return without_nan(self._as_slices(self.table("lineitem").filter(assessed)))

    @staticmethod
    def _as_slices(lineitem: DataFrame) -> DataFrame:
        def depth(line):
            # the fifth slice ends between 50 and 51 cm, the seventh beyond 100 cm
            return line * 10.0 + F.when(line == 5, 0.5).when(line >= 7, 40.0).otherwise(0.0)

        start, end = depth(F.col("l_linenumber") - 1), depth(F.col("l_linenumber"))
        nan = F.lit(float("nan"))
        quantity = F.col("l_quantity")
        measured = F.col("l_quantity") != 13
        saltmarsh = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
        return lineitem.select(
            F.col("l_orderkey").alias("core_no"),
            F.when(saltmarsh, DEFAULTS.excluded_treatment).otherwise("Mangrove").alias("treatment"),
            start.alias("depth_from"),
            end.alias("depth_to"),
            F.concat(start.cast("string"), F.lit("to"), end.cast("string")).alias("depth_range"),
            F.when(quantity == 15, nan).otherwise(F.col("l_discount") * 100).alias("c_perc"),
            F.when(quantity == 14, nan).when(measured, quantity / 50).alias("dry_bulk_density"),
            (1 - F.col("l_tax")).alias("compaction"),
            F.when(measured, F.col("l_extendedprice") / 1000).alias("section_stock"),
        )

    def _at_sites(self, rows: DataFrame, *columns: str) -> DataFrame:
        wanted = list(dict.fromkeys(["site_no", "site", *columns]))
        places = broadcast_checked(self._places(), wanted)
        return rows.join(places, "site_no", "left").withColumn(
            "site_core", F.concat("site", F.lit("_"), F.col("core_no").cast("string"))
        )

    def locate(self, by_core: DataFrame, *columns: str) -> DataFrame:
        """Attach site columns (and ``site_core``) to rows keyed by core number."""
        return self._at_sites(by_core.join(self.cores(), "core_no", "left"), *columns)

    def plots(self) -> DataFrame:
        """One vegetation plot per order."""
        unmeasured = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
        biomass = self.table("orders").select(
            F.col("o_orderkey").alias("core_no"),
            "o_custkey",
            F.when(~unmeasured, F.col("o_totalprice") / 100).alias("biomass_kg"),
        )
        return self._at_sites(self._owned(biomass), "site_short", "site_old_name").select(
            "core_no",
            "site",
            "site_short",
            F.col("site_core").alias("subplot_name"),
            F.col("site_old_name").alias("treatment2"),
            "biomass_kg",
        )
