"""Student t probabilities as column expressions.

Spark has no t distribution.  One formula holds for all degrees of freedom: the
unnormalised density ``(1 + x**2 / df) ** (-(df + 1) / 2)`` is integrated over the
tail and over the half line by double-exponential quadrature, a fold over the
numbers of the nodes, and the probability is the ratio of the two.  No gamma
function is needed, and nothing leaves the JVM.  The nodes reach far enough for
df of 0.1 and more (errors below 1e-13); below, the tail that they miss counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from coreline.functions.nullsafe import ColumnOrName, as_column, present

#: nodes are ``_STEP`` apart and reach from -6 to 6 on the transformed axis
_STEP = 1.0 / 16
_LAST = 96
#: Newton steps of a quantile; most take about ten
_ROUNDS = 250
_FAR = 1e150
_HALF_PI = math.pi / 2


def _log_density(x: Column, df: Column) -> Column:
    return -(df + 1.0) / 2.0 * F.log1p(x * (x / df))


def _mills(t: Column, df: Column) -> Column:
    """Integral of the density from ``t`` on, over the density at ``t``."""
    # beyond t the density falls over a length of about (1 + t**2 / df) / t
    scale = (1.0 + t * t / df) / F.greatest(t, F.lit(1.0))

    def add(total: Column, node: Column) -> Column:
        u = node * _STEP
        width = _HALF_PI * F.sinh(u)
        weight = _STEP * _HALF_PI * F.cosh(u)
        fall = _log_density(t + scale * F.exp(width), df) - _log_density(t, df)
        return total + weight * F.exp(width + fall)

    return scale * F.aggregate(F.sequence(F.lit(-_LAST), F.lit(_LAST)), F.lit(0.0), add)


def _freedom(df: ColumnOrName) -> Column:
    df = present(as_column(df).cast("double"))
    return F.when(df > 0.0, df)


def t_two_sided_p(t: ColumnOrName, df: ColumnOrName) -> Column:
    """P(|T| > |t|); NULL for a missing argument or df <= 0, 0 for an infinite t.

    Squares of more than 1e150 leave the range of numbers; such a t counts as 1e150.
    """
    t, df = F.abs(present(as_column(t).cast("double"))), _freedom(df)
    near = F.when(t > _FAR, _FAR).otherwise(t)
    ratio = F.exp(_log_density(near, df)) * _mills(near, df) / _mills(F.lit(0.0), df)
    return F.when(t == float("inf"), F.when(df.isNotNull(), F.lit(0.0))).otherwise(ratio)


def t_quantile(p: ColumnOrName, df: ColumnOrName) -> Column:
    """Quantile for 0 < p < 1; NULL outside, for a missing argument or df <= 0.

    The logarithm of the two-sided probability is concave and falling in log t, so
    Newton's steps come down on the root from the right, from any start; a step up is
    at most 2, so that a nearly normal law isn't overshot by far.  A quantile beyond
    1e150 is infinite.
    """
    p, df = present(as_column(p).cast("double")), _freedom(df)
    target = F.log(2.0 * F.least(p, 1.0 - p))
    most = math.log(_FAR)

    def step(state: Column, _: Column) -> Column:
        t, low = F.exp(state["s"]), _log_density(F.exp(state["s"]), state["df"])
        # the ratio is one value of an array, as both its uses would compute it anew
        moved = F.transform(
            F.array(_mills(t, state["df"])),
            lambda mills: (F.log(mills / state["half"]) + low - state["target"]) * (mills / t),
        )[0]
        fresh = F.least(state["s"] + F.least(moved, F.lit(2.0)), F.lit(most))
        # once on its way down, a step up is rounding
        arrived = (F.abs(moved) <= 1e-15) | ((moved >= 0.0) & state["falls"]) | (fresh >= most)
        return F.when(state["end"], state).otherwise(
            F.struct(
                fresh.alias("s"),
                (moved < 0.0).alias("falls"),
                arrived.alias("end"),
                state["df"].alias("df"),
                state["half"].alias("half"),
                state["target"].alias("target"),
            )
        )

    start = F.struct(
        F.lit(0.0).alias("s"),
        F.lit(False).alias("falls"),
        F.lit(False).alias("end"),
        df.alias("df"),
        _mills(F.lit(0.0), df).alias("half"),
        target.alias("target"),
    )
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(_ROUNDS)),
        start,
        step,
        lambda state: F.when(state["s"] >= most, F.lit(float("inf"))).otherwise(F.exp(state["s"])),
    )
    value = F.when(p == 0.5, F.lit(0.0)).when(p < 0.5, -found).otherwise(found)
    return F.when((p > 0.0) & (p < 1.0) & df.isNotNull(), value)
