"""A field survey: slices, plots, sites and dated rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreline.constants import DEFAULTS
from coreline.functions.nullsafe import without_nan
from coreline.operators.joins import join_dim
from coreline.operators.reshape import split_key
from coreline.runtime import configure
from coreline.sources import tables
from coreline.sources.rates import dated_rates

MEASURES = (
    "treatment",
    "depth_from",
    "depth_to",
    "depth_range",
    "c_perc",
    "dry_bulk_density",
    "compaction",
    "section_stock",
)


class FieldSurvey:
    """Survey tables in their usual columns (see :mod:`coreline.sources.tables`).

    ``key`` names the column that identifies a core.  Here it is ``site_core``,
    text of the form ``site_number`` from which the site is read.
    """

    key = "site_core"

    def __init__(
        self,
        slices: DataFrame,
        plots: DataFrame,
        sites: DataFrame,
        rates: DataFrame | None = None,
    ):
        self.spark = configure(slices.sparkSession)
        self._slices, self._plots, self._sites = map(without_nan, (slices, plots, sites))
        self._rates = without_nan(rates if rates is not None else dated_rates(self.spark))

    @classmethod
    def from_csv(cls, spark: SparkSession, slices: str, plots: str, sites: str) -> FieldSurvey:
        return cls(
            tables.read_slices(spark, slices),
            tables.read_plots(spark, plots),
            tables.read_sites(spark, sites),
        )

    def raw_slices(self) -> DataFrame:
        """Slice measurements by core, all habitats."""
        return self._slices.select(self.key, *[c for c in MEASURES if c in self._slices.columns])

    def slices(self) -> DataFrame:
        """Slices of the assessed habitats."""
        return self.raw_slices().filter(F.col("treatment") != DEFAULTS.excluded_treatment)

    def plots(self) -> DataFrame:
        """Vegetation plots; a plot carries the key of its core."""
        return self._plots.withColumn(self.key, F.col("subplot_name"))

    def sites(self) -> DataFrame:
        return self._sites

    def rates(self) -> DataFrame:
        return self._rates

    def locate(self, by_core: DataFrame, *columns: str) -> DataFrame:
        """Attach site columns to rows that carry a core key."""
        named = split_key(by_core, self.key, ["site"])
        return join_dim(named, self.sites(), "site", [c for c in columns if c != "site"])

    def core_counts(self) -> DataFrame:
        """Cores per site."""
        cores = split_key(self.slices().select(self.key).distinct(), self.key, ["site"])
        return cores.groupBy("site").agg(F.count(F.lit(1)).alias("cores"))
