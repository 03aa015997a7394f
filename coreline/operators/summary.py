"""Group summaries with a required missing-value policy."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreline.functions.nullsafe import (
    as_column,
    mean_lenient,
    mean_strict,
    n_rows,
    present,
    sd_lenient,
    sd_strict,
    standard_error,
    sum_lenient,
    sum_strict,
    weighted_mean,
)
from coreline.operators.joins import attach_group_total

# policy -> (mean, standard deviation); N always counts all rows
_POLICIES = {
    "lenient": (mean_lenient, sd_lenient),
    "strict": (mean_strict, sd_strict),
    "mixed": (mean_lenient, sd_strict),
}
_SUMS = {"strict": sum_strict, "lenient": sum_lenient}


def _policy(name: str):
    if name not in _POLICIES:
        raise ValueError(f"policy must be one of {sorted(_POLICIES)}, not {name!r}")
    return _POLICIES[name]


def _keys(keys: str | Iterable[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def group_sum(df: DataFrame, keys, value, policy: str, out: str = "total") -> DataFrame:
    if policy not in _SUMS:
        raise ValueError(f"policy must be one of {sorted(_SUMS)}, not {policy!r}")
    return df.groupBy(*_keys(keys)).agg(_SUMS[policy](value).alias(out))


def mean_se(
    df: DataFrame, keys, value, policy: str, digits: int | None = None
) -> DataFrame:
    """Mean, SD, N and SE per group (no keys: one row for the whole input).

    With ``digits``, mean and SD are rounded first and SE is computed from the
    rounded SD, then rounded itself.
    """
    mean, sd = _policy(policy)
    out = df.groupBy(*_keys(keys)).agg(
        _rounded(mean(value), digits).alias("av"),
        _rounded(sd(value), digits).alias("sd"),
        n_rows().alias("n"),
    )
    return out.withColumn("se", _rounded(standard_error("sd", "n"), digits))


def _rounded(x: Column, digits: int | None) -> Column:
    return x if digits is None else F.round(x, digits)


def two_level(
    df: DataFrame, inner_keys, outer_keys, value, sum_policy: str, mean_policy: str
) -> DataFrame:
    """Sum per inner group, then mean and SE of the sums per outer group.

    Outer keys must be among the inner keys.
    """
    totals = group_sum(df, inner_keys, value, sum_policy)
    return mean_se(totals, outer_keys, "total", mean_policy)


def multi_measure(
    df: DataFrame,
    keys,
    measures: Mapping[str, int],
    policy: str,
    round_sd: bool = False,
) -> DataFrame:
    """Mean, N, SD and SE of several measures in one pass.

    ``measures`` maps a column to its display digits.  Mean and SE are rounded;
    SD only with ``round_sd``, and then SE starts from the rounded SD.
    """
    mean, sd = _policy(policy)
    aggregates = []
    for name, digits in measures.items():
        spread = sd(name)
        aggregates += [
            F.round(mean(name), digits).alias(f"av_{name}"),
            n_rows().alias(f"n_{name}"),
            (F.round(spread, digits) if round_sd else spread).alias(f"sd_{name}"),
        ]
    return df.groupBy(*_keys(keys)).agg(*aggregates).withColumns(
        {
            f"se_{name}": F.round(standard_error(f"sd_{name}", f"n_{name}"), digits)
            for name, digits in measures.items()
        }
    )


def weighted_summary(
    df: DataFrame, keys, value, weight=None, also: Mapping[str, str] | None = None
) -> DataFrame:
    """Weighted mean with lenient SD, N over all rows, and SE.

    ``also`` names further means of the same value under other weights.
    """
    others = [weighted_mean(value, w).alias(name) for name, w in (also or {}).items()]
    return (
        df.groupBy(*_keys(keys))
        .agg(
            weighted_mean(value, weight).alias("av"),
            sd_lenient(value).alias("sd"),
            n_rows().alias("n"),
            *others,
        )
        .withColumn("se", standard_error("sd", "n"))
    )


def group_moments(df: DataFrame, keys, value: Column | str | None = None, **aggregates) -> DataFrame:
    """Reduce each group to the count, mean and variance of ``value``.

    Together with further aggregates of the group, these are enough for
    :func:`merge_moments` to summarise ``value`` times any quantity that is
    constant within the group, so the rows themselves never move again.
    ``value`` defaults to 1.
    """
    value = F.lit(1.0) if value is None else as_column(value)
    # whole parts sum exactly, so a large mean keeps the digits of its fraction
    whole = F.rint(value)
    mean = F.try_divide(F.sum(whole), F.count(value)) + F.try_divide(F.sum(value - whole), F.count(value))
    return df.groupBy(*_keys(keys)).agg(
        n_rows().alias("m_rows"),
        F.count(value).alias("m_present"),
        mean.alias("m_mean"),
        F.var_pop(value).alias("m_var"),
        *[a.alias(name) for name, a in aggregates.items()],
    )


def merge_moments(moments: DataFrame, keys, scale: Column | str) -> DataFrame:
    """Lenient mean, SD, N and SE of ``value * scale`` over all original rows.

    Each row of ``moments`` is one inner group; ``scale`` is its constant.
    """
    scale = as_column(scale)
    keys = _keys(keys)
    k = F.when(scale.isNotNull(), F.col("m_present")).otherwise(0)
    part = F.struct(
        k.cast("double").alias("k"),
        (scale * F.col("m_mean")).alias("m"),
        (k * scale * scale * F.col("m_var")).alias("s"),
    )
    parts = moments.select(*keys, "m_rows", F.when((k > 0) & F.col("m_mean").isNotNull(), part).alias("_part"))
    # Deviations are taken from the plain mean of the inner groups, so that they are
    # small beside the spread and no large squares cancel.
    centred = attach_group_total(parts.withColumn("_m", F.col("_part.m")), keys, F.avg, "_m", "_centre")
    centred = centred.withColumn("_d", F.col("_m") - F.col("_centre"))
    k, d = F.col("_part.k"), F.col("_d")
    merged = centred.groupBy(*keys).agg(
        F.max("_centre").alias("_centre"),
        F.sum(k).alias("_k"),
        F.sum(k * d).alias("_shift"),
        (F.sum("_part.s") + F.sum(k * d * d)).alias("_square"),
        F.sum("m_rows").alias("n"),
    )
    shift = F.try_divide(F.col("_shift"), F.col("_k"))
    spread = F.col("_square") - F.col("_shift") * shift
    return (
        merged.withColumn("av", F.col("_centre") + shift)
        .withColumn("sd", F.when(F.col("_k") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("_k") - 1))))
        .withColumn("se", standard_error("sd", "n"))
        .select(*keys, "av", "sd", "n", "se")
    )


def bounds(df: DataFrame, mean: str = "av", se: str = "se") -> DataFrame:
    """Error-bar ends."""
    return df.withColumns({"lo": F.col(mean) - F.col(se), "hi": F.col(mean) + F.col(se)})


def value_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and maximum of each column, one row; NaN is missing."""
    return df.agg(
        *[
            f(present(F.col(c))).alias(f"{name}_{c}")
            for c in columns
            for name, f in (("min", F.min), ("max", F.max))
        ]
    )


def attach_range(df: DataFrame, value: str) -> DataFrame:
    """Whole-set minimum and maximum of ``value`` on every row."""
    x = present(F.col(value))
    whole = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    return df.withColumns(
        {
            f"min_{value}": whole.select("lo").scalar(),
            f"max_{value}": whole.select("hi").scalar(),
        }
    )


def percent_of(df: DataFrame, value: str, reference: DataFrame, out: str = "percent") -> DataFrame:
    """``value`` as a percentage of the single value in ``reference``."""
    return df.withColumn(out, F.try_divide(F.col(value), reference.scalar()) * 100)


def group_ratio(
    df: DataFrame, key: str, value: str, numerator: str, denominator: str
) -> DataFrame:
    """Ratio of two groups' means, addressed by key and never by position."""
    means = df.groupBy().agg(
        F.avg(F.when(F.col(key) == numerator, as_column(value))).alias("numerator_av"),
        F.avg(F.when(F.col(key) == denominator, as_column(value))).alias("denominator_av"),
    )
    return means.withColumns(
        {
            "percent": F.try_divide(F.col("numerator_av"), F.col("denominator_av")) * 100,
            "times": F.try_divide(F.col("denominator_av"), F.col("numerator_av")),
            "difference": F.col("denominator_av") - F.col("numerator_av"),
        }
    )


def reference_band(means: DataFrame, mean: str = "av") -> DataFrame:
    """Lowest and highest of the group means, one row."""
    return means.agg(
        F.min(mean).alias("band_lo"), F.max(mean).alias("band_hi"), n_rows().alias("groups")
    )
