"""Splitting, unpivoting, text joining, tagging and ordering."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_key(
    df: DataFrame, column: str, into: Sequence[str], sep: str = "_", keep: bool = True
) -> DataFrame:
    """Split text into columns; missing pieces are NULL, extra ones are dropped."""
    pieces = F.split(F.col(column), re.escape(sep))
    out = df.withColumns({name: F.get(pieces, F.lit(i)) for i, name in enumerate(into)})
    return out if keep or column in into else out.drop(column)


def unpivot_measures(
    df: DataFrame, ids: Sequence[str], measures: Sequence[str], key="measure", value="value"
) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(measures), key, value)


def number_text(x: Column, digits: int) -> Column:
    """Rounded number without trailing zeros; the text NA where missing."""
    text = F.format_string(f"%.{digits}f", F.round(x, digits))
    text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "") if digits else text
    return F.when(x.isNull(), F.lit("NA")).otherwise(text)


def unite_pm(df: DataFrame, out: str, mean: str, se: str, digits: int, sep=" ± ") -> DataFrame:
    """``mean ± se`` as text, in place of the two columns."""
    text = F.concat_ws(sep, number_text(F.col(mean), digits), number_text(F.col(se), digits))
    return df.withColumn(out, text).drop(mean, se)


def tagged_union(parts: dict[str, DataFrame], tag: str = "stock") -> DataFrame:
    """Row bind by name, duplicates kept, each part tagged with its label."""
    tagged = [df.withColumn(tag, F.lit(label)) for label, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def mirror(df: DataFrame, below: str, value: str = "av", tag: str = "stock") -> DataFrame:
    """Negate ``value`` on the rows tagged ``below``, for mirrored display."""
    signed = F.when(F.col(tag) == below, -F.col(value)).otherwise(F.col(value))
    return df.withColumn(value, signed)


def level_order(
    df: DataFrame, column: str, levels: Sequence[str], index: str = "level_idx"
) -> DataFrame:
    """Position of each value in ``levels``; unlisted values become NULL."""
    lookup = F.create_map(*chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(levels, 1)))
    position = F.try_element_at(lookup, F.col(column))
    return df.withColumn(index, position).withColumn(
        column, F.when(F.col(index).isNotNull(), F.col(column))
    )


def fill_zero(df: DataFrame) -> DataFrame:
    """0 in place of NULL and NaN in every numeric column."""
    return df.fillna(0)


def select_distinct_names(df: DataFrame, *columns: str) -> DataFrame:
    """Select columns, each name once, in first-mention order."""
    return df.select(*dict.fromkeys(columns))
