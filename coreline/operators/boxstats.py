"""Exact box-plot statistics without holding a group in one task.

Quartiles interpolate linearly between order statistics at ``(n - 1) * p``
(type 7).  The order statistics are found by narrowing rounds.  Each round knows a
bracket that holds the wanted ranks, with exact counts (first the whole group); a
mergeable sketch of the values in it proposes two probes around the rank, and one pass
counts what lies below, on, between and above them.  The wanted ranks lie in one of these five parts,
which is the next bracket, or at the border of two of them, which settles both values.
Counts decide, so a sketch that is off costs a round and never a wrong value; a part
of one repeated value settles it, so ties cost nothing either.  Rounds go on until
every bracket has at most ``MOST_RANKED`` rows; only these are ranked, whatever the
size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coreline.functions.nullsafe import n_rows
from coreline.runtime import cut_lineage, drop_checkpoint

QUARTILES = (0.25, 0.5, 0.75)
ACCURACY = 2_000
#: rows of a bracket that the last step ranks
MOST_RANKED = 1 << 17

_STATE = ("h", "below", "n", "lo", "hi", "a", "b", "x", "y")


def _present(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value)


def _cells(accuracy: int) -> int:
    return min(max(accuracy // 5, 1), 250)


def _sketch(value: str, accuracy: int) -> str:
    """Values at the cell borders of ``value``; NULLs don't count."""
    cells = _cells(accuracy)
    shares = ", ".join(f"{c / cells!r}D" for c in range(cells + 1))
    return f"percentile_approx({value}, array({shares}), {accuracy})"


# The steps below are SQL text: a round has hundreds of small expressions, and building
# them one by one in Python takes longer than running them on a moderate table.

#: the two ranks, from 1, that position h interpolates; one rank where it is whole
_RANK, _SECOND = "(floor({h}) + 1)", "(ceil({h}) + 1)"


def _probe(sketch: str, rank: str, n: str, lo: str, hi: str, accuracy: int) -> tuple[str, str]:
    """Cell borders around a rank among the ``n`` values of a sketch, a cell of margin on either side."""
    cells = _cells(accuracy)
    first = f"(CAST(floor(try_divide({rank} * {cells}, {n})) AS INT) - 1)"
    last = f"(CAST(ceil(try_divide(({rank} + 1) * {cells}, {n})) AS INT) + 1)"
    return (
        f"CASE WHEN {first} >= 0 THEN get({sketch}, {first}) ELSE {lo} END",
        f"CASE WHEN {last} <= {cells} THEN get({sketch}, {last}) ELSE {hi} END",
    )


def _state(**fields: str) -> str:
    """One quantile of a group: position, rows below the bracket and in it, bracket, probes, values."""
    kinds = {"below": "BIGINT", "n": "BIGINT"}
    parts = (f"'{k}', CAST({fields[k]} AS {kinds.get(k, 'DOUBLE')})" for k in _STATE)
    return f"named_struct({', '.join(parts)})"


def _first_state(rows: DataFrame, by: list[str], probs: Sequence[float]) -> DataFrame:
    """The whole group as bracket, its ends as probes."""
    found = rows.groupBy(*by).agg(n_rows().alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    same = "IF(_lo = _hi, _lo, NULL)"
    states = [
        _state(
            h=f"((_n - 1) * {float(p)!r}D)", below="0", n="IF(_lo < _hi, _n, 0)",
            lo="_lo", hi="_hi", a="_lo", b="_hi", x=same, y=same,
        )
        for p in probs
    ]
    return found.select(*by, F.expr(f"array({', '.join(states)})").alias("_state"))


def _narrowed(keyed: DataFrame, by: list[str], k: int, accuracy: int) -> DataFrame:
    """One round: count the parts that the probes cut, and keep the part of the wanted ranks."""
    aggregates = ["first(_state) AS _state"]
    parts = []
    for i in range(k):
        s = f"_state[{i}]"
        inside = f"_v BETWEEN {s}.lo AND {s}.hi AND {s}.x IS NULL"
        under, over, between = (f"{inside} AND {c}" for c in (f"_v < {s}.a", f"_v > {s}.b", f"_v > {s}.a AND _v < {s}.b"))
        on_a, on_b = f"{inside} AND _v = {s}.a", f"{inside} AND _v = {s}.b AND {s}.b > {s}.a"
        counts = ", ".join(f"count_if({c})" for c in (under, on_a, between, on_b, over))
        aggregates += [
            f"array({counts}) AS _n{i}",
            f"max(IF({under}, _v, NULL)) AS _under{i}",
            f"min(IF({between}, _v, NULL)) AS _from{i}",
            f"max(IF({between}, _v, NULL)) AS _to{i}",
            f"min(IF({over}, _v, NULL)) AS _over{i}",
            f"{_sketch(f'IF({between}, _v, NULL)', accuracy)} AS _s{i}",
        ]
        parts.append(
            f"named_struct('old', {s}, 'n', _n{i}, 'lo', array({s}.lo, {s}.a, _from{i}, {s}.b, _over{i}), "
            f"'hi', array(_under{i}, {s}.a, _to{i}, {s}.b, {s}.hi), 'sketch', _s{i})"
        )
    found = keyed.groupBy(*by).agg(*[F.expr(a) for a in aggregates])
    rank, second = (r.format(h="p.old.h") for r in (_RANK, _SECOND))
    kept = ", ".join(f"'{c}', p.{c}" for c in ("old", "n", "lo", "hi", "sketch"))
    # rows below each of the five parts, then the parts of the two ranks
    before = "transform(sequence(0, 5), j -> p.old.below + aggregate(slice(p.n, 1, j), 0L, (t, c) -> t + c))"
    part = "size(filter(slice(p.before, 2, 5), c -> c < {rank}))"
    lo, hi, n, below = (f"p.{c}[p.i]" for c in ("lo", "hi", "n", "before"))
    a, b = _probe("p.sketch", f"({rank} - {below})", n, lo, hi, accuracy)
    settled = f"(p.i <> p.j OR {lo} = {hi})"
    new = _state(
        h="p.old.h", below=below, n=f"IF({settled}, 0, {n})", lo=lo, hi=hi,
        a=f"IF(p.i = 2, {a}, {lo})", b=f"IF(p.i = 2, {b}, {hi})",
        x=f"IF({settled}, {hi}, NULL)", y=f"IF({settled}, p.lo[p.j], NULL)",
    )
    steps = (
        f"named_struct({kept}, 'before', {before})",
        f"named_struct({kept}, 'before', p.before, 'i', {part.format(rank=rank)}, 'j', {part.format(rank=second)})",
        f"IF(p.old.x IS NOT NULL, p.old, {new})",
    )
    states = reduce(lambda inner, step: f"transform({inner}, p -> {step})", steps, f"array({', '.join(parts)})")
    return found.select(*by, F.expr(states).alias("_state"))


def _brackets(rows: DataFrame, by: list[str], probs: Sequence[float], accuracy: int, most: int) -> DataFrame:
    """Rounds until no bracket has more than ``most`` rows; one number a round reaches the driver."""
    state = _first_state(rows, by, probs)
    while (state.agg(F.max(F.array_max("_state.n"))).first()[0] or 0) > most:
        last = state
        state = cut_lineage(_narrowed(_join_groups(rows, last, by), by, len(probs), accuracy))
        drop_checkpoint(last)
    return state


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float] = QUARTILES,
    accuracy: int = ACCURACY,
    most_ranked: int | None = None,
) -> DataFrame:
    """Exact type-7 quantiles per group as columns ``q0, q1, ...``.

    NULL and NaN values don't count; a group without others is left out (without
    ``by`` it gives NULLs).  The rounds run when this is called.  They read the keys
    and values from one written table, so that what made them runs once; it and the
    last round's row for each group stay in the shared folder.
    """
    by = list(by)
    return _quantiles(_values(df, by, value), by, probs, accuracy, most_ranked)


def _values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return cut_lineage(df.filter(_present(value)).select(*by, F.col(value).cast("double").alias("_v")))


def _quantiles(
    rows: DataFrame, by: list[str], probs: Sequence[float], accuracy: int, most_ranked: int | None = None
) -> DataFrame:
    k = len(probs)
    state = _brackets(rows, by, probs, accuracy, MOST_RANKED if most_ranked is None else most_ranked)
    wanted = [f"(_state[{i}].x IS NULL AND _v BETWEEN _state[{i}].lo AND _state[{i}].hi)" for i in range(k)]
    targets = ", ".join(
        f"IF({w}, named_struct('q', {i}, 'h', _state[{i}].h, 'below', _state[{i}].below), NULL)" for i, w in enumerate(wanted)
    )
    counted = (
        _join_groups(rows, state, by)
        .filter(" OR ".join(wanted))
        .select(*by, "_v", F.expr(f"explode(array_compact(array({targets})))").alias("_t"))
        .groupBy(*by, "_t", "_v")
        .agg(n_rows().alias("_c"))
    )
    # a bracket's distinct values: at most ``most_ranked``
    upto = Window.partitionBy(*by, "_t").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto_here = counted.withColumn("_cum", F.col("_t.below") + F.sum("_c").over(upto))
    ranked = upto_here.groupBy(*by, "_t").agg(
        *[F.expr(f"min(IF(_cum >= {r.format(h='_t.h')}, _v, NULL))").alias(c) for r, c in ((_RANK, "_x"), (_SECOND, "_y"))]
    )
    settled = state.select(*by, F.posexplode("_state").alias("_q", "_t")).filter("_t.x IS NOT NULL")
    both = ranked.select(*by, F.col("_t.q").alias("_q"), F.col("_t.h").alias("_h"), "_x", "_y").unionByName(
        settled.select(*by, "_q", F.col("_t.h").alias("_h"), F.col("_t.x").alias("_x"), F.col("_t.y").alias("_y"))
    )
    part = F.col("_h") - F.floor("_h")
    between = F.col("_x") + F.when(part == 0, F.lit(0.0)).otherwise(part * (F.col("_y") - F.col("_x")))
    return both.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == i, between)).alias(f"q{i}") for i in range(k)])


def _join_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Attach one row per group; Spark broadcasts it if its measured size allows."""
    if not by:
        return rows.withColumns(
            {c: groups.select(c).scalar() for c in groups.columns}
        )
    renamed = groups.select(*[F.col(k).alias(f"_g_{k}") for k in by], *[c for c in groups.columns if c not in by])
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return rows.join(renamed, same, "inner").drop(*[f"_g_{k}" for k in by])


def box_stats(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    limits: tuple[float, float] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Quartiles, whisker ends (furthest values within 1.5 IQR) and outliers.

    ``limits`` drops values outside the range before anything is computed, as
    an axis limit does.
    """
    by = list(by)
    rows = _values(df if limits is None else df.filter(F.col(value).between(*limits)), by, value)
    boxes = _quantiles(rows, by, QUARTILES, accuracy).select(
        *by, F.col("q0").alias("lower"), F.col("q1").alias("middle"), F.col("q2").alias("upper")
    )
    reach = (F.col("upper") - F.col("lower")) * 1.5
    inside = F.col("_v").between(F.col("lower") - reach, F.col("upper") + reach)
    return (
        _join_groups(rows, boxes, by)
        .groupBy(*by, "lower", "middle", "upper")
        .agg(
            F.min(F.when(inside, F.col("_v"))).alias("ymin"),
            F.max(F.when(inside, F.col("_v"))).alias("ymax"),
            n_rows().alias("n"),
            F.count(F.when(~inside, F.lit(1))).alias("outliers"),
        )
    )


def box_outliers(df: DataFrame, by: Sequence[str], value: str, accuracy: int = ACCURACY) -> DataFrame:
    """The rows beyond the whiskers."""
    by = list(by)
    rows = df.filter(_present(value))
    boxes = quantiles(rows, by, value, QUARTILES, accuracy).select(
        *by, F.col("q0").alias("lower"), F.col("q2").alias("upper")
    )
    reach = (F.col("upper") - F.col("lower")) * 1.5
    inside = F.col(value).between(F.col("lower") - reach, F.col("upper") + reach)
    return _join_groups(rows, boxes, by).filter(~inside).select(*df.columns)
