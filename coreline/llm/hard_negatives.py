"""Hard negatives by a vertical scan with branch and bound (BOND).

Rows are stored in blocks whose dimensions are columns.  For each anchor the
dimensions are read in descending magnitude of the anchor, ``STEP`` at a time, and
every row keeps a partial inner product.  What the unread dimensions can still add
lies between bounds from each dimension's least and largest value in the block, so
rows that can no longer matter leave the candidate bitmap; the rows left after the
last dimension have exact scores.

1. Positives: a row of the anchor's label stays while its upper bound reaches the
   k-th best score that is already sure.
2. Negatives: each positive's score p opens the window of scores s with
   50 p <= 100 s <= 95 p.  A row of another label stays while it may still lie in a
   window and reach the k-th best score that is already sure to lie in it.

Anchors are a stated query set, met with all rows in tiles: anchors are dealt to
groups and rows to stripes, and the tile of a group and a stripe is one key of one
shuffle.  A task reads a tile's anchors, then the stripe's blocks one by one, and
keeps its anchors' best rows, so a few rows for each anchor and stripe are merged in
the end.  Group and stripe sizes follow the number of anchors (``_sizes``); nothing
is broadcast, and no candidates are capped.

Results for odd input: rows with a NULL label, a NULL id, a NULL vector or any NULL
or non-finite component take no part.  Of several rows with one id the least by
(label, vector) takes part.  Shorter vectors count as filled with zeros.  Equal
scores are ordered by smaller id.  Anchors without positives, and positives without
negatives in the window, give no rows; an empty table gives none.  Other columns are
ignored.  Scores that may not fit into 64 bits raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coreline.llm.common import bounded_batches, frozen, shares

BLOCK_ROWS = 4096
STEP = 16
GROUPS = 256
STRIPE = 8

_PACKED = "{key} int, ids binary, labels binary, extra binary, width int, vectors binary"
_LEAST = np.iinfo(np.int64).min


def scaled(lists: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, a column for each vector; short vectors end in zeros."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((int(size.max(initial=0)), len(size)))
    owner = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), owner] = flat
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as they need."""
    most = np.abs(x).max(initial=0.0)
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8")


def _wide(row: dict) -> dict:
    """A packed row's arrays."""
    ids = np.frombuffer(row["ids"], np.int64)
    kind = {2: "<i2", 4: "<i4", 8: "<f8"}[row["width"]]
    vectors = np.frombuffer(row["vectors"], kind)
    return {
        "ids": ids,
        "labels": np.frombuffer(row["labels"], np.int64),
        "extra": np.frombuffer(row["extra"], np.int64).reshape(len(ids), -1),
        "vectors": vectors.reshape(-1, len(ids)),
    }


def _joined(blocks: list[dict]) -> dict:
    """Blocks side by side."""
    dims = max(b["vectors"].shape[0] for b in blocks)
    grown = [np.pad(b["vectors"], ((0, dims - b["vectors"].shape[0]), (0, 0))) for b in blocks]
    out = {k: np.concatenate([b[k] for b in blocks]) for k in ("ids", "labels", "extra")}
    return out | {"vectors": np.concatenate(grown, axis=1)}


def _packed(rows: DataFrame, key: str, scale: float) -> DataFrame:
    """Rows of each key in columnar blocks of at most ``BLOCK_ROWS`` (from rows sorted by key)."""

    def pack(number: int, some: pa.RecordBatch) -> pa.RecordBatch:
        vectors = _narrow(scaled(some.column("v"), scale))
        extra = pc.list_flatten(some.column("extra")).to_numpy(zero_copy_only=False)
        blobs = [
            some.column("vec_id").to_numpy().tobytes(),
            some.column("label").to_numpy().tobytes(),
            extra.astype(np.int64).tobytes(),
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int32()),
                *[pa.array([b], pa.binary()) for b in blobs],
                pa.array([vectors.itemsize], pa.int32()),
                pa.array([vectors.tobytes()], pa.binary()),
            ],
            [key, "ids", "labels", "extra", "width", "vectors"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0

        def whole() -> pa.RecordBatch:
            return pack(now, pa.Table.from_batches(held).combine_chunks().to_batches()[0])

        for batch in batches:
            keys = batch.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for at, end in zip(cuts, cuts[1:]):
                while at < end:
                    if n and (keys[at] != now or n >= BLOCK_ROWS):
                        yield whole()
                        held, n = [], 0
                    now, some = int(keys[at]), min(end - at, BLOCK_ROWS - n)
                    held.append(batch.slice(at, some))
                    at, n = at + some, n + some
        if n:
            yield whole()

    return bounded_batches(rows).mapInArrow(run, _PACKED.format(key=key))


def _fitting(anchors: dict, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and rows in the fastest numbers that hold every score exactly."""
    a, x = anchors["vectors"], block["vectors"]
    dims = min(len(a), len(x))
    a, x = a[:dims], x[:dims]
    most = max(dims, 1) * math.prod(max(1.0, float(np.abs(m.astype(float)).max(initial=0))) for m in (a, x))
    if most >= 2.0**62:
        raise OverflowError("a score may not fit into 64 bits")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return a.astype(kind), x.astype(kind)


def vertical_scan(a: np.ndarray, x: np.ndarray, alive: np.ndarray, keep, step: int = STEP):
    """Rows of ``x`` (a column each) that ``keep`` leaves, and their exact scores with ``a``.

    ``keep(least, most)`` gets bounds on the scores of the rows still alive and
    says which of them stay.
    """
    order = np.argsort(-np.abs(a), kind="stable")
    ends = a[:, None] * np.stack([x.min(axis=1), x.max(axis=1)], axis=1)
    low, high = (np.append(np.cumsum(f(ends, axis=1)[order][::-1])[::-1], 0) for f in (np.min, np.max))
    partial = np.zeros(len(alive), x.dtype)
    for at in range(0, len(order), step):
        if not len(alive):
            break
        dims = order[at : at + step]
        partial = partial + a[dims] @ x[np.ix_(dims, alive)]
        rest = min(at + step, len(order))
        stay = keep(partial + low[rest], partial + high[rest])
        if not stay.all():
            alive, partial = alive[stay], partial[stay]
    return alive, partial.astype(np.int64)


class _Best:
    """The k best (score, id) of several lists."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score = np.full((lists, k), _LEAST)
        self.ids = np.zeros((lists, k), np.int64)
        self.n = np.zeros(lists, np.int64)

    def floor(self, i: int) -> int:
        """What a score must reach to matter."""
        return int(self.score[i, -1])

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[score >= least], ids[score >= least]
        n = self.n[i]
        score, ids = np.append(self.score[i, :n], score), np.append(self.ids[i, :n], ids)
        order = np.lexsort((ids, -score))[: self.k]
        self.n[i] = len(order)
        self.score[i, : len(order)], self.ids[i, : len(order)] = score[order], ids[order]


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def _scan_positives(anchors: dict, block: dict, best: _Best) -> None:
    a, x = _fitting(anchors, block)
    k = best.k
    for i, (vec_id, label) in enumerate(zip(anchors["ids"], anchors["labels"], strict=True)):
        alive = np.flatnonzero((block["labels"] == label) & (block["ids"] != vec_id))

        def keep(least: np.ndarray, most: np.ndarray, i: int = i) -> np.ndarray:
            sure = _kth(least, k)
            return most >= (best.floor(i) if sure is None else max(best.floor(i), sure))

        alive, score = vertical_scan(a[:, i], x, alive, keep)
        best.add(i, score, block["ids"][alive])


def _scan_negatives(anchors: dict, block: dict, best: _Best, windows: np.ndarray) -> None:
    """``windows`` holds the least and the largest score for each anchor and positive (empty: least > largest)."""
    a, x = _fitting(anchors, block)
    k, each = best.k, windows.shape[1]
    for i, label in enumerate(anchors["labels"]):
        opened = [w for w in range(each) if windows[i, w, 0] <= windows[i, w, 1]]
        if not opened:
            continue
        alive = np.flatnonzero(block["labels"] != label)

        def keep(least: np.ndarray, most: np.ndarray, i: int = i, opened: list = opened) -> np.ndarray:
            stay = np.zeros(len(least), bool)
            spread = most[0] - least[0] if len(least) else 0
            for w in opened:
                bottom, top = windows[i, w]
                floor = max(int(bottom), best.floor(i * each + w))
                if spread <= top - bottom:
                    sure = _kth(least[(least >= bottom) & (most <= top)], k)
                    floor = floor if sure is None else max(floor, int(sure))
                stay |= (most >= floor) & (least <= top)
            return stay

        alive, score = vertical_scan(a[:, i], x, alive, keep)
        for w in opened:
            inside = (score >= windows[i, w, 0]) & (score <= windows[i, w, 1])
            if inside.any():
                best.add(i * each + w, score[inside], block["ids"][alive[inside]])


def _sizes(anchors: int, rows: int) -> tuple[int, int]:
    """Numbers of anchor groups and of row stripes.

    A group has 1,024 to 65,536 anchors, so that there are ``GROUPS`` of them where
    that fits, and a stripe ``STRIPE`` times as many rows.
    """
    group = min(1 << 16, max(1 << 10, shares(anchors, GROUPS)))
    return shares(anchors, group), shares(rows, STRIPE * group)


def _dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    number = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    return rows.withColumn(key, number).repartition(n, key).sortWithinPartitions(key)


def _tiles(anchors: DataFrame, blocks: DataFrame, groups: int, stripes: int) -> DataFrame:
    """Every group's anchors (part 0), then every stripe's blocks (part 1), by tile."""
    names = ("ids", "labels", "extra", "width", "vectors")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    first = anchors.select("group", every(stripes).alias("stripe"), F.lit(0).alias("part"), *names)
    second = blocks.select(every(groups).alias("group"), "stripe", F.lit(1).alias("part"), *names)
    met = first.unionByName(second).repartition(groups * stripes, "group", "stripe")
    return bounded_batches(met.sortWithinPartitions("group", "stripe", "part"))


def _scan(tiles: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work(anchors, blocks)`` on each tile; it gives one record batch."""

    def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                yield (row["group"], row["stripe"]), row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, held, state = None, [], [], None

        def scan() -> None:
            nonlocal anchors, held, state
            if state is None:
                anchors = _joined(anchors)
                state = work(anchors)
            state.scan(_joined(held))
            held = []

        for tile, row in by_tile(batches):
            if tile != now:
                if held:
                    scan()
                if state is not None:
                    yield state.found()
                now, anchors, held, state = tile, [], [], None
            if row["part"] == 0:
                anchors.append(_wide(row))
            elif anchors:
                held.append(_wide(row))
                if sum(len(b["ids"]) for b in held) >= BLOCK_ROWS:
                    scan()
        if held:
            scan()
        if state is not None:
            yield state.found()

    return tiles.mapInArrow(run, schema)


class _Positives:
    def __init__(self, anchors: dict, k: int):
        self.anchors, self.best = anchors, _Best(len(anchors["ids"]), k)

    def scan(self, block: dict) -> None:
        _scan_positives(self.anchors, block, self.best)

    def found(self) -> pa.RecordBatch:
        real = np.arange(self.best.k) < self.best.n[:, None]
        columns = [np.repeat(self.anchors["ids"], self.best.n), self.best.ids[real], self.best.score[real]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "positive_score"])


class _Negatives:
    """``extra`` of an anchor: its positives' ids, then their scores; the number of them comes first."""

    def __init__(self, anchors: dict, each: int, k: int, low: int, high: int):
        self.anchors, self.each = anchors, each
        self.best = _Best(len(anchors["ids"]) * each, k)
        self.ids, self.score = anchors["extra"][:, 1 : each + 1], anchors["extra"][:, each + 1 :]
        self.windows = np.zeros((len(self.ids), each, 2), np.int64)
        self.windows[:, :, 0] = 1
        for i, n in enumerate(anchors["extra"][:, 0]):
            for w in range(n):
                p = int(self.score[i, w])
                self.windows[i, w] = -(-low * p // 100), high * p // 100

    def scan(self, block: dict) -> None:
        _scan_negatives(self.anchors, block, self.best, self.windows)

    def found(self) -> pa.RecordBatch:
        n = self.best.n
        real = np.arange(self.best.k) < n[:, None]
        columns = [
            np.repeat(np.repeat(self.anchors["ids"], self.each), n),
            np.repeat(self.ids.reshape(-1), n),
            np.repeat(self.score.reshape(-1), n),
            self.best.ids[real],
            self.best.score[real],
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns],
            ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
        )


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(scale * x), scores are integer inner products.  An
    anchor (``anchor`` is a condition on column ``vec_id``) has its first
    ``positives`` other rows of its label; each gets the first ``negatives`` rows of
    other labels with ``low * positive_score <= 100 * negative_score <= high *
    positive_score``.
    """
    x = F.col(vector)
    real = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(math.inf)))
    label = F.col(label) if isinstance(label, str) else label
    kept = (
        rows.where(x.isNotNull() & real)
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), x.alias("v")).alias("one"))
        .where("vec_id IS NOT NULL AND one.label IS NOT NULL")
        .groupBy("vec_id")
        .agg(F.min("one").alias("one"))
        .select("vec_id", "one.*")
    )
    none = F.array().cast("array<long>").alias("extra")
    kept = frozen(kept, "vectors")
    asked = kept.where(anchor)
    groups, stripes = _sizes(asked.count(), kept.count())
    blocks = frozen(_packed(_dealt(kept.select("*", none), "stripe", stripes), "stripe", scale), "blocks")

    queries = _packed(_dealt(asked.select("*", none), "group", groups), "group", scale)
    near = _scan(
        _tiles(queries, blocks, groups, stripes),
        lambda anchors: _Positives(anchors, positives),
        "anchor_id long, positive_id long, positive_score long",
    )
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    # at most ``positives`` rows of an anchor are left; lists are filled up to one width
    ordered = F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score")))
    filled = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(0).cast("long"), positives)), 1, positives)
    lists = best.groupBy("anchor_id").agg(ordered.alias("p")).select(
        F.col("anchor_id").alias("vec_id"),
        F.concat(
            F.array(F.size("p").cast("long")), filled(F.col("p.positive_id")), filled(F.col("p.positive_score"))
        ).alias("extra"),
    )
    with_positives = frozen(asked.join(lists, "vec_id"), "anchors")
    queries = _packed(_dealt(with_positives, "group", groups), "group", scale)
    far = _scan(
        _tiles(queries, blocks, groups, stripes),
        lambda anchors: _Negatives(anchors, positives, negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        far.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


ORACLE = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score
    FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""
