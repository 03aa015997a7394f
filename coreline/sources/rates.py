"""Dated accretion rates, a literal lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (site, rate g/cm2/y, standard error)
DATED_RATES = (
    ("MNND", 0.095, 0.008),
    ("SNND", 0.096, 0.016),
    ("MNDC", None, None),
    ("MDBP", 0.0, 0.0),
    ("MDSD", 0.0, 0.0),
    ("MR1991", 0.0324, 0.0010),
    ("MR1992", 0.076, 0.005),
    ("MRAP", 0.32, 0.11),
    ("MRCH1", None, None),
    ("MRCH2", 0.16, 0.02),
    ("MRPL", None, None),
    ("MDTUCK", None, None),
    ("MNPL", 0.045, 0.002),
)


def values_sql(rows) -> str:
    """Literal rows as a SQL VALUES list."""
    def text(v):
        if v is None:
            return "CAST(NULL AS DOUBLE)"
        if isinstance(v, str):
            return f"'{v}'"
        return str(v) if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)"

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


def dated_rates(spark: SparkSession) -> DataFrame:
    return spark.sql(
        f"SELECT * FROM VALUES {values_sql(DATED_RATES)} AS rates(site, mar, mar_se)"
    )
