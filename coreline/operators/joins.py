"""Joins whose strategy follows checked sizes and survives hot keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000

_CHECKED: WeakKeyDictionary = WeakKeyDictionary()
_COUNTED_BY: WeakKeyDictionary = WeakKeyDictionary()


def counted_by(dim: DataFrame, source: DataFrame) -> DataFrame:
    """State that ``dim`` has no more rows than ``source``, which is cheaper to count."""
    _COUNTED_BY[dim] = source
    return dim


def at_most(dim: DataFrame, max_rows: int) -> bool:
    """Whether ``dim`` has at most ``max_rows`` rows.

    Reading stops one row after that; the answer is kept per DataFrame.
    """
    while dim in _COUNTED_BY:
        dim = _COUNTED_BY[dim]
    checked = _CHECKED.setdefault(dim, {})
    if max_rows not in checked:
        checked[max_rows] = dim.offset(max_rows).isEmpty()
    return checked[max_rows]


def broadcast_checked(dim: DataFrame, columns: Sequence[str], max_rows: int = BROADCAST_ROWS):
    """The named columns, with a broadcast hint if ``dim`` is small enough.

    A larger side gets no hint: Spark then shuffles both sides and splits hot
    keys adaptively.
    """
    side = dim.select(*columns)
    return F.broadcast(side) if at_most(dim, max_rows) else side


def join_dim(
    fact: DataFrame,
    dim: DataFrame,
    on: str,
    columns: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join of a projected dimension.

    Only ``on`` and ``columns`` of the dimension take part, so no column name
    can collide; a column the fact already has is refused.
    """
    clash = sorted(set(columns) & set(fact.columns))
    if clash:
        raise ValueError(f"rename or drop before the join: {clash}")
    return fact.join(broadcast_checked(dim, [on, *columns], max_rows), on, "left")


def attach_group_total(
    df: DataFrame, keys: str | Iterable[str], aggregate, value: str, out: str
) -> DataFrame:
    """Put a group aggregate on every row of its group; missing keys are a group.

    Totals are aggregated first (partially before the shuffle) and joined back:
    a group of any size is one row on that side, and adaptive execution splits
    its rows on the other.

    ``aggregate`` is one of the functions in ``coreline.functions``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    totals = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(aggregate(value).alias(out))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(totals, same).select(*df.columns, out)


#: a key is hot with more than a 10,000th of all rows (and a million): at most so many keys are hot
HOT_KEYS = 10_000
LEAST_HOT = 1_000_000


def hot_keys(many: DataFrame, key: str, least: int | None = None) -> DataFrame | None:
    """``_hot_key, _salts`` of the keys with the most rows; None where no key is hot.

    One pass over the key column, aggregated before it is shuffled.  As a hot key has
    more than a ``HOT_KEYS``-th of all rows, at most ``HOT_KEYS`` rows reach the
    driver, and each salt of a key gets about a ``HOT_KEYS``-th of all rows at most.
    """
    least = LEAST_HOT if least is None else least
    counts = many.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot_key")).agg(F.count("*").alias("_rows"))
    total = many.count()
    if total <= least:
        return None
    each = max(least, total // HOT_KEYS)
    salts = F.ceil(F.col("_rows") / each).cast("int").alias("_salts")
    found = counts.where(F.col("_rows") > each).select("_hot_key", salts)
    schema, rows = found.schema, found.collect()
    return many.sparkSession.createDataFrame(rows, schema) if rows else None


def join_many_to_one(
    many: DataFrame, one: DataFrame, key: str, how: str = "left", least_hot: int | None = None
) -> DataFrame:
    """Join rows to a side that has each key at most once.

    ``how="left"`` keeps every row of ``many``; adaptive execution can split a hot
    key there.  ``how="right"`` keeps every row of ``one``, where Spark can't split
    ``many``: keys are counted first (when this is called), the rows of a hot key are
    dealt to salts by a hash of the row, and its row of ``one`` is repeated for each
    salt, so that either way ``many`` is shuffled once.  A hot key has rows, so its
    repeats that find none are dropped; a missing key of ``many`` finds nothing.
    """
    if how not in ("left", "right"):
        raise ValueError("how must be 'left' or 'right'")
    columns = [key, *[c for c in many.columns if c != key], *[c for c in one.columns if c != key]]
    if how == "left":
        return many.join(one, key, "left").select(*columns)
    hot = hot_keys(many, key, least_hot)
    if hot is None:
        return many.join(one, key, "right").select(*columns)
    # bounded by HOT_KEYS
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = many.join(hot, F.col(key) == F.col("_hot_key"), "left").select(
        *many.columns, F.pmod(F.xxhash64(*many.columns), salts).alias("_salt"), F.lit(True).alias("_found")
    )
    repeated = one.join(hot, F.col(key) == F.col("_hot_key"), "left").select(
        *one.columns,
        F.col("_salts").isNotNull().alias("_is_hot"),
        F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long"))).alias("_salt"),
    )
    met = dealt.join(repeated, [key, "_salt"], "right")
    return met.where(F.col("_found").isNotNull() | ~F.col("_is_hot")).select(*columns)
