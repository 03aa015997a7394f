"""Readers and writers for survey tables.

CSV columns are found by header name and cast explicitly; the text NA is
missing.  No schema inference pass is made.  Parquet is the format for scale.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coreline.functions.nullsafe import present, try_number
from coreline.operators.joins import hot_keys

# Column name here -> (column name in survey files, type)
SLICE_FIELDS = {
    "site": ("Site", "string"),
    "site_short": ("Site_short", "string"),
    "site_core": ("Site_Core", "string"),
    "treatment": ("Treatment", "string"),
    "treatment2": ("Treatment2", "string"),
    "depth_from": ("Depth_from", "double"),
    "depth_to": ("Depth_to", "double"),
    "depth_range": ("Depth_Range", "string"),
    "c_perc": ("C_perc", "double"),
    "dry_bulk_density": ("Dry_bulk_density_gcm3", "double"),
    "compaction": ("Lab_Compaction_Correction_Value", "double"),
    "section_stock": ("Carbon_stock_in_section_Mg_Cha", "double"),
}
PLOT_FIELDS = {
    "site": ("Site", "string"),
    "site_short": ("Site_short", "string"),
    "subplot_name": ("Subplot_Name", "string"),
    "treatment2": ("Treatment2", "string"),
    "biomass_kg": ("Total_Aboveground_Biomass_kg_100m2", "double"),
}
SITE_FIELDS = {
    "site": ("Site", "string"),
    "site_year": ("SiteYear", "string"),
    "site_year_numeric": ("SiteYearNumeric", "int"),
    "site_short": ("Site_short", "string"),
    "site_short_old": ("Site_short_old", "string"),
    "site_year_old": ("SiteYear_old", "string"),
    "site_old_name": ("SiteOldName", "string"),
    "site_type": ("SiteRenamed", "string"),
    "horizon_cm": ("DepthTo_SinceRehabilitated_cm", "double"),
    "site_type_25y": ("SiteRenamed_25y", "string"),
}

#: Columns that only some of the reports use.
OPTIONAL = (
    "site_short", "treatment2", "depth_range", "section_stock", "site_short_old", "site_year_old", "site_old_name",
    "site_type", "site_type_25y", "site_year",
)


class MissingColumns(ValueError):
    """A file lacks columns that it must have."""


def header_groups(spark: SparkSession, path: str) -> list[list[str]]:
    """The data files under ``path`` (a file, folder or pattern), grouped by their header line.

    Only file names and the first line of each file are read, a small job a file; one
    file needs none.
    """
    listed = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    names = sorted(r["path"] for r in listed.collect())
    if len(names) < 2:
        return [[path]]
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(spark.read.text(name).first()["value"], []).append(name)
    return list(groups.values()) if len(groups) > 1 else [[path]]


def read_csv(
    spark: SparkSession, path: str | Sequence[str], fields: dict, optional: Iterable[str] = ()
) -> DataFrame:
    """Read the listed columns by header name; unparsable numbers are NULL.

    Files of one folder may have different headers (other columns, another order):
    they are grouped by header line, and each group is read by its own names in
    one scan, never by position.  A list of paths is read path by path.  A column
    that is absent from a file raises, unless it is ``optional``: then it is left out,
    or NULL beside files that have it.
    """
    if not isinstance(path, str):
        parts = [read_csv(spark, p, fields, optional) for p in path]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    groups = header_groups(spark, path)
    parts = [_read_alike(spark, files, fields, optional) for files in groups]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[n for n in fields if n in out.columns])


def _read_alike(spark: SparkSession, files: list[str], fields: dict, optional: Iterable[str]) -> DataFrame:
    """Files with one header."""
    raw = spark.read.csv(files, header=True, nullValue="NA", enforceSchema=False)
    present_fields = {n: f for n, f in fields.items() if f[0] in raw.columns}
    absent = sorted(fields[n][0] for n in set(fields) - set(present_fields) - set(optional))
    if absent:
        raise MissingColumns(f"{', '.join(files)} has no column {', '.join(absent)}")
    kinds = {n: _number if kind in ("double", "int") else _text for n, (_, kind) in present_fields.items()}
    return raw.select(*[kinds[n](F.col(f"`{source}`"), kind).alias(n) for n, (source, kind) in present_fields.items()])


def _number(text: Column, kind: str) -> Column:
    value = present(try_number(text))
    return value if kind == "double" else F.when(value == F.floor(value), value).try_cast(kind)


def _text(text: Column, kind: str) -> Column:
    return text.cast(kind)


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SLICE_FIELDS, OPTIONAL)


def read_plots(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PLOT_FIELDS, OPTIONAL)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SITE_FIELDS, OPTIONAL)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    """CSV with a header and NA for missing values; one file per partition."""
    df.write.mode(mode).csv(path, header=True, nullValue="NA")
    return path


def materialise(
    df: DataFrame, path: str, mode: str = "error", partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Write an intermediate as Parquet and read it back.

    Partitioned by site or type, later filters on those columns skip whole
    folders.
    """
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_by_core(
    df: DataFrame, table: str, key: str, buckets: int, mode: str = "error", path: str | None = None
) -> DataFrame:
    """Save rows bucketed by core, so that grouping or joining by core needs no shuffle.

    Rows are dealt to their buckets once, so that each bucket is one sorted file.
    Tables of one ``key`` type and number of ``buckets`` meet without a shuffle.  Choose
    ``buckets`` so that a bucket is a few hundred MB; keep a table with one dominating
    core unbucketed (see :func:`save_together`).  ``path`` keeps the files outside the
    warehouse.  Rows without a key lie in one bucket.
    """
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def save_together(
    many: DataFrame, one: DataFrame, key: str, buckets: int, name: str, path: str, least_hot: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Save rows and the side they are often joined with, so that joins by ``key`` shuffle neither.

    A bucket is read by one task and can't be split.  So keys are counted first; where one
    has more than a ten-thousandth of all rows of ``many`` (and ``least_hot``), both tables
    are saved plain, and joins shuffle and split them adaptively.  The tables are called
    ``{name}_many`` and ``{name}_one``, their files lie in folders of ``path``.
    """
    sides = {"many": many, "one": one}
    if hot_keys(many, key, least_hot) is None:
        return tuple(
            save_by_core(df, f"{name}_{side}", key, buckets, path=f"{path}/{side}") for side, df in sides.items()
        )
    for side, df in sides.items():
        df.write.option("path", f"{path}/{side}").saveAsTable(f"{name}_{side}")
    return tuple(df.sparkSession.table(f"{name}_{side}") for side, df in sides.items())
