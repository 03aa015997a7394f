import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coreline.llm import hard_negatives as hn
from coreline.llm.hard_negatives import hard_negatives, scaled, vertical_scan

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, v int, extra string, stripe int, one int"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, "x", 3, 4) for i, v, y in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def expected(rows, is_anchor, positives=5, negatives=3):
    taken = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken[i] = min(taken.get(i, (y, v)), (y, v))
    vectors = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, (_, v) in taken.items()}
    out = []
    for a, (label, _) in taken.items():
        if not is_anchor(a):
            continue
        score = {b: sum(p * q for p, q in zip(vectors[a], vectors[b])) for b in taken if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if taken[b][0] == label][:positives]:
            fit = [b for b in order if taken[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(fit[:negatives])]
    return sorted(out)


def rows_of(seed, n=400, dims=20, labels=4, values=None):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    out = []
    for i in range(n):
        c = rng.choice(centre)
        v = [x + rng.gauss(0, 0.5) for x in c] if values is None else [rng.choice(values) for _ in range(dims)]
        out.append((i, v, rng.randrange(labels)))
    return out


EDGE = [
    (0, [0.5, 0.5], 1), (0, [0.25, 0.5], 1), (0, [0.5, 0.5], 2), (5, [0.5, 0.5], 1), (5, [0.5, 0.5], 1),
    (10, None, 1), (11, [None, 0.5], 1), (12, [float("nan"), 0.5], 1), (13, [float("inf"), 0.5], 2), (14, [0.5, 0.5], None),
    (None, [0.5, 0.5], 1), (15, [], 1), (16, [0.4], 2), (17, [0.5, 0.1, 0.9], 2), (18, [0.3, 0.3], 2), (19, [0.3, 0.3], 2),
    (20, [-0.5, -0.5], 1), (21, [0.0, 0.0], 2), (22, [0.0, 0.0], 1),
]


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_brute_force(spark, seed):
    rows = rows_of(seed) + [(900 + i, v, y) for i, v, y in EDGE if i]
    df = hard_negatives(frame(spark, rows), F.col("vec_id") % 7 == 0)
    assert got(df) == expected(rows, lambda i: i % 7 == 0) != []


def test_ties_and_a_hot_label(spark):
    rows = rows_of(5, 300, 6, 2, values=[0.0, 0.25, 0.5])
    rows += [(1000 + i, [0.5] * 6, 0) for i in range(150)] + [(2000 + i, [0.25] * 6, 1) for i in range(150)]
    df = hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert got(df) == expected(rows, lambda i: i % 5 == 0) != []


def test_edges_and_empty_tables(spark):
    everyone = F.lit(True)
    assert got(hard_negatives(frame(spark, EDGE), everyone)) == expected(EDGE, lambda i: True) != []
    assert got(hard_negatives(frame(spark, []), everyone)) == []
    assert got(hard_negatives(frame(spark, EDGE), F.col("vec_id") == 77)) == []
    assert got(hard_negatives(frame(spark, [(1, [0.5], 1)]), everyone)) == []


def test_large_components_are_exact_or_refused(spark):
    rows = [(1, [1e6, 3.0], 1), (2, [1e6, 2.0], 1), (3, [6e5, 1.0], 2), (4, [9e5, 0.1], 2)]
    assert got(hard_negatives(frame(spark, rows), F.lit(True))) == expected(rows, lambda i: True) != []
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives(frame(spark, [(1, [1e30], 1), (2, [1e30], 1)]), F.lit(True)).collect()


def test_many_tiles_give_the_same_rows(spark, monkeypatch):
    rows = rows_of(9, 500)
    monkeypatch.setattr(hn, "_sizes", lambda a, n: (5, 7))
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    assert got(hard_negatives(frame(spark, rows), F.col("vec_id") % 3 == 0)) == expected(rows, lambda i: i % 3 == 0)


def test_the_scan_drops_rows_before_the_last_dimension():
    rng = np.random.default_rng(1)
    x = rng.integers(-99, 99, (32, 500)).astype(np.float32)
    a = np.array([200, 100] + [1] * 30, np.float32)
    seen = []

    def keep(least, most):
        seen.append(len(least))
        return most >= np.sort(least)[-1]

    alive, score = vertical_scan(a, x, np.arange(500), keep, step=2)
    exact = a @ x
    assert exact.max() in score and (exact[alive] == score).all() and seen[1] < 250


def test_scaling_floors_and_pads():
    lists = pa.array([[0.5, -0.001], [], [1 / 256]], pa.list_(pa.float32()))
    assert scaled(lists, 256.0).tolist() == [[128, 0, 1], [-1, 0, 0]]
