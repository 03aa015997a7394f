"""Connected components of an edge table by alternating star contractions.

Large-star and small-star rounds (Kiveris et al., "Connected components in
MapReduce and beyond", 2014) until every node hangs on the smallest node of its
component.  Each round is a grouped minimum and a join, and its edges are
written to the shared folder, so lineage stays short and nothing but two numbers
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreline.llm.common import frozen


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``a, b`` longs) but the components' own smallest.

    Loops and repeated edges do no harm; no edges give no rows.
    """
    now = frozen(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = frozen(_small_star(_large_star(now)).where("a <> b").distinct(), "edges")
        last, state = state, _state(now)
        if state == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
