"""Aggregates and conditionals with an explicit missing-value policy.

*strict*  - one missing input makes the result missing.
*lenient* - missing inputs are skipped.

NaN counts as missing, as NULL does.  All are built-in aggregates, so partial
aggregation and code generation stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_column(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x: Column) -> Column:
    """The value, or NULL where it is NaN."""
    return F.when(~F.isnan(x), x)


def without_nan(df: DataFrame) -> DataFrame:
    """The rows with NULL for NaN in every floating column."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: present(F.col(f"`{c}`")) for c in floats})


def n_rows() -> Column:
    """Rows of the group, missing values included."""
    return F.count(F.lit(1))


def _complete(x: Column) -> Column:
    return F.count(x) == n_rows()


def sum_strict(x: ColumnOrName) -> Column:
    x = present(as_column(x))
    return F.when(_complete(x), F.sum(x))


def sum_lenient(x: ColumnOrName) -> Column:
    """Sum of the present values; 0 where none is present."""
    return F.coalesce(F.sum(present(as_column(x))), F.lit(0.0))


def mean_strict(x: ColumnOrName) -> Column:
    x = present(as_column(x))
    return F.when(_complete(x), F.avg(x))


def mean_lenient(x: ColumnOrName) -> Column:
    return F.avg(present(as_column(x)))


def sd_strict(x: ColumnOrName) -> Column:
    x = present(as_column(x))
    return F.when(_complete(x), F.stddev_samp(x))


def sd_lenient(x: ColumnOrName) -> Column:
    return F.stddev_samp(present(as_column(x)))


def weighted_mean(x: ColumnOrName, weight: ColumnOrName | None = None) -> Column:
    """Weighted mean over the present values; weight 1 where none is given."""
    x = present(as_column(x))
    if weight is None:
        return F.avg(x)
    weight = as_column(weight)
    return F.try_divide(F.sum(x * weight), F.sum(F.when(x.isNotNull(), weight)))


def standard_error(sd: ColumnOrName, n: ColumnOrName) -> Column:
    return as_column(sd) / F.sqrt(as_column(n))


def ifelse_na(condition: Column, yes, no) -> Column:
    """Two-way choice that is missing where the condition is missing."""
    return F.when(condition, yes).when(~condition, no)


def try_number(x: ColumnOrName, to: str = "double") -> Column:
    """Number from dirty text; missing where it does not parse.

    Only plain decimal and exponent notation is a number, so that ``1980D``
    is none.
    """
    text = F.trim(as_column(x).cast("string"))
    plain = F.rlike(text, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"))
    return F.when(plain, text).try_cast(to)
