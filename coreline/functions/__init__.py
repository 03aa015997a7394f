from coreline.functions.nullsafe import (
    as_column,
    ifelse_na,
    mean_lenient,
    mean_strict,
    n_rows,
    sd_lenient,
    sd_strict,
    standard_error,
    sum_lenient,
    sum_strict,
    try_number,
    weighted_mean,
)
from coreline.functions.tdist import t_quantile, t_two_sided_p

__all__ = [
    "as_column",
    "ifelse_na",
    "mean_lenient",
    "mean_strict",
    "n_rows",
    "sd_lenient",
    "sd_strict",
    "standard_error",
    "sum_lenient",
    "sum_strict",
    "t_quantile",
    "t_two_sided_p",
    "try_number",
    "weighted_mean",
]
