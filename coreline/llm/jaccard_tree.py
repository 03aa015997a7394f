"""Exact n-gram Jaccard join with signature trees.

1.  Every text becomes its set of word shingles.  Texts with equal sets are one
    class, found by a digest of the set; classes need no pairs.
2.  A set that links with another one has at least ``percent`` % of its shingles in
    it.  A third of all shingles, chosen by hash, are counted over the table; a set
    goes on only if enough of its counted shingles occur in another set, were all
    it may lack among them.  Texts that merely share a passage stop here.
3.  Candidate search loses no pair.  A set that links with another one lacks at most
    f = floor((1 - j) n) of its n shingles there.  All sets order shingles alike,
    those of the fewest sets first, so the first shingle that a linked pair shares
    is among the first f + 1 of either set.  Sets meet only at such a rare shingle:
    a passage that many texts share is late in the order.  Sets that meet are
    linked to the smallest digest there, and connected components of those edges
    are the candidate clusters.
4.  In a cluster, a signature tree holds the OR of its members' shingle bitmaps
    and their size range in every node.  Two trees (or one with itself) are
    traversed together; a pair of nodes whose largest possible overlap is too
    small is dropped with everything below it.  Pairs of sets that remain are
    intersected exactly, unless links found before connect them already.
5.  Connected components of the links and classes name each document's group.

A cluster of more than ``BLOCK_SHINGLES`` shingles is cut into blocks, and each
pair of blocks is a task of its own, so no task holds a whole large cluster.
Records of steps 2 and 3 travel as packed arrays, one for each task and hash range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreline.llm.common import bounded_batches, frozen, shares, slices, text_bytes
from coreline.llm.components import components
from coreline.llm.records import (
    digit_bytes,
    from_low_bytes,
    low_bytes,
    member_ids,
    members_of,
    rows_by_key,
    split_digits,
)
from coreline.llm.rolling import mixed
from coreline.llm.shingles import shingle_sets

BATCH_BYTES = 4 << 20
COUNT_BYTES = 64 << 20
SHARD_BYTES = 256 << 20
#: Shingles of candidate sets that one task counts or orders.
TASK_SHINGLES = 1 << 19
#: One shingle in so many is counted.
COUNTED = 3
BLOCK_SHINGLES = 1 << 18
FANOUT = 8
#: A NULL doc_id counts as the largest id.
NO_ID = (1 << 63) - 1

_C1, _C2 = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25))


def _digest(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    edges = np.searchsorted(owner, np.arange(n + 1))
    out = []
    for c in (_C1, _C2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ c), dtype=np.uint64)])
        out.append(mixed(sums[edges[1:]] - sums[edges[:-1]]).astype(np.int64))
    return out[0], out[1]


def _least_size(percent: int) -> int:
    """Shingles of the smallest set that can have an unequal partner."""
    # sets of n and n + 1 shingles, one inside the other, must pass
    return next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1))


def _map_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Text hash, size and digests of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                n = batch.num_rows
                values, owner = shingle_sets(batch.column("text"), shingle)
                counted = np.bincount(owner[values % COUNTED == 0], minlength=n)
                columns = (np.bincount(owner, minlength=n), counted, *_digest(values, owner, n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), batch.column("hash"), *map(pa.array, columns)],
                    ["doc_id", "hash", "n", "counted", "d1", "d2"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(run, "doc_id long, hash long, n long, counted long, d1 long, d2 long")


def _packed(key: np.ndarray, doc: np.ndarray, d1: np.ndarray, width: int, buckets: int) -> pa.RecordBatch | None:
    """Records of one batch by hash range: the sets' names, and sorted keys with their members."""
    key = key >> np.uint64(64 - 8 * width)
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    cuts = split_digits(key, width, buckets)
    rows = []
    for k in range(buckets):
        part = slice(cuts[k], cuts[k + 1])
        if cuts[k] < cuts[k + 1]:
            rows.append((k, *members_of(doc[part], d1), low_bytes(key[part], width)))
    if not rows:
        return None
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(next(columns), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
        ["bucket", "names", "member", "sig"],
    )


_PACKED = "bucket int, names binary, member binary, sig binary"


def _unpacked(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and names in rising order, and where a new key starts."""
    key = np.concatenate([from_low_bytes(r["sig"], width) for r in rows])
    name = np.concatenate([member_ids(r["names"], r["member"]) for r in rows])
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key, name, new


def _shared_counts(docs: DataFrame, shingle: int, width: int, buckets: int, shards: int) -> DataFrame:
    """``d1, shared``: how many counted shingles of a set occur in another set.

    A hash range answers in one packed row for each of ``shards`` groups of sets, so
    that what comes back are rows of ranges and groups, and then a row for each set.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                values, owner = shingle_sets(batch.column("text"), shingle)
                d1, _ = _digest(values, owner, batch.num_rows)
                some = values % COUNTED == 0
                if found := _packed(values[some], owner[some], d1, width, buckets):
                    yield found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in rows_by_key(batches, "bucket"):
            key, name, new = _unpacked(rows, width)
            fresh = new.copy()
            fresh[1:] |= name[1:] != name[:-1]
            group = np.cumsum(new) - 1
            sets = np.bincount(group[fresh])
            names, shared = np.unique(name[fresh & (sets[group] > 1)], return_counts=True)
            if not len(names):
                continue
            shard = mixed(names.view(np.uint64)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            names, shared = names[order], shared[order].astype("<u4")
            found, at = np.unique(shard[order], return_index=True)
            columns = [[x.tobytes() for x in np.split(c, at[1:])] for c in (names, shared)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)],
                ["shard", "names", "shared"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in rows_by_key(batches, "shard"):
            names, place = np.unique(np.concatenate([np.frombuffer(r["names"], np.int64) for r in rows]), return_inverse=True)
            shared = np.concatenate([np.frombuffer(r["shared"], "<u4") for r in rows])
            total = np.bincount(place, shared).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["d1", "shared"])

    sent = docs.select("text").mapInArrow(send, _PACKED)
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counts = dealt.mapInArrow(count, "shard int, names binary, shared binary")
    return counts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(add, "d1 long, shared long")


def _zipped(docs: DataFrame) -> DataFrame:
    """``node, hash, body``: ids, text hashes and compressed texts; each task sends one row of an id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            new = []
            for i, key in enumerate(zip(batch.column("node").to_pylist(), batch.column("hash").to_pylist(), strict=True)):
                if key not in sent:
                    sent.add(key)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            body = [pack(x.as_buffer()) for x in batch.column("text").fill_null("").cast(pa.large_binary())]
            columns = [batch.column("node"), batch.column("hash"), pa.array(body, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "hash", "body"])

    node = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("node")
    return docs.select(node, F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "node long, hash long, body binary")


def _unzipped(bodies) -> pa.Array:
    unzip = zstandard.ZstdDecompressor().decompress
    return pa.array([unzip(x).decode() for x in bodies], pa.large_string())


def _classes(sets: np.ndarray) -> np.ndarray:
    """Order of shingles by the number of sets that hold them, in one byte; 0 where it is one set."""
    return np.where(sets > 1, np.minimum(1 + np.floor(8 * np.log2(sets)), 255), 0).astype(np.uint8)


def rare_keys(key: np.ndarray, name: np.ndarray, order: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys at which a set can meet a linked one, and the set's name, from all keys of whole sets.

    Keys of one set that are alike by chance count as often as they occur: then
    those before the first common key are still shingles that the other set lacks.
    """
    by = np.lexsort((key, order, name))
    key, name, order = key[by], name[by], order[by]
    _, first, n = np.unique(name, return_index=True, return_counts=True)
    rank = np.arange(len(name)) - np.repeat(first, n)
    wanted = (rank <= np.repeat(n * (100 - percent) // 100, n)) & (order > 0)
    return key[wanted], name[wanted]


def _rare_shingles(near: DataFrame, shingle: int, percent: int, width: int, buckets: int) -> DataFrame:
    """The shingles of all sets at which they can meet, by hash range.

    Ranges of shingles count the sets of each; the counts go to groups of whole
    sets, which choose.  Shingles are cut to ``width`` bytes; those that are alike
    by chance cost a comparison and nothing else.
    """
    shift = np.uint64(64 - 8 * width)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body", BATCH_BYTES // 4):
                values, owner = shingle_sets(_unzipped(batch.column("body").to_pylist()), shingle)
                d1, _ = _digest(values, owner, batch.num_rows)
                if found := _packed(values, owner, d1, width, buckets):
                    yield found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in rows_by_key(batches, "bucket"):
            key, name, new = _unpacked(rows, width)
            fresh = new.copy()
            fresh[1:] |= name[1:] != name[:-1]
            group = np.cumsum(new) - 1
            order = _classes(np.bincount(group[fresh]))[group]
            names, place = np.unique(name, return_inverse=True)
            shard = (mixed(names.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)[place]
            by = np.argsort(shard, kind="stable")
            found, at = np.unique(shard[by], return_index=True)
            parts = np.split(by, at[1:])
            columns = zip(*((*members_of(place[i], names), low_bytes(key[i], width), order[i].tobytes()) for i in parts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
                ["shard", "names", "member", "sig", "order"],
            )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in rows_by_key(batches, "shard"):
            key = np.concatenate([from_low_bytes(r["sig"], width) for r in rows])
            name = np.concatenate([member_ids(r["names"], r["member"]) for r in rows])
            order = np.concatenate([np.frombuffer(r["order"], np.uint8) for r in rows])
            key, name = rare_keys(key, name, order, percent)
            names, place = np.unique(name, return_inverse=True)
            if found := _packed(key << shift, place, names, width, buckets):
                yield found

    sent = near.select("body").mapInArrow(send, _PACKED)
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counts = dealt.mapInArrow(count, "shard int, names binary, member binary, sig binary, order binary")
    return counts.repartition(buckets, "shard").sortWithinPartitions("shard").mapInArrow(choose, _PACKED)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest node of each component of these edges to its other nodes."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        if (least == label[i]).all() and (least == label[j]).all():
            break
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = label[label]
        label = label[label]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _stars(meetings: DataFrame, width: int, buckets: int) -> DataFrame:
    """Edges ``a, b`` that connect the sets that meet at a shingle.

    Each hash range sends a spanning forest: no more edges than it has members.
    """

    def edges(rows: list[dict]) -> pa.RecordBatch | None:
        _, name, new = _unpacked(rows, width)
        center = name[np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))]
        apart = center != name
        if not apart.any():
            return None
        a, b = _forest(center[apart], name[apart])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in rows_by_key(batches, "bucket"):
            if found := edges(rows):
                yield found

    dealt = meetings.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long").distinct()


class SignatureTree:
    """Bitmaps and size ranges of sets, level by level; each node has ``FANOUT`` children."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.members = order
        self.sets = [sets[i] for i in order]
        words = np.zeros((len(sets), bits // 64), np.uint64)
        for i, one in enumerate(self.sets):
            at = mixed(one) & np.uint64(bits - 1)
            np.bitwise_or.at(words[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        size = np.array([len(x) for x in self.sets], np.int64)
        spare = size - np.bitwise_count(words).sum(axis=1)
        #: bitmap, least and largest size, most shingles that share another's bit
        self.levels = [(words, size, size, spare)]
        while len(self.levels[-1][0]) > 1:
            words, low, high, spare = self.levels[-1]
            at = np.arange(0, len(words), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(words, at),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(spare, at),
                )
            )


def _possible(x, y, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some member of node ``i`` and one of node ``j`` can pass.

    A set has at most (its spare shingles + common bits) shingles in the other.
    """
    (wx, lx, hx, sx), (wy, ly, hy, sy) = x, y
    out = np.zeros(len(i), bool)
    step = max(1, (1 << 21) // wx.shape[1])
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        common = np.bitwise_count(wx[a] & wy[b]).sum(axis=1).astype(np.int64)
        most = np.minimum(np.minimum(hx[a], hy[b]), common + np.minimum(sx[a], sy[b]))
        sizes = (100 * hx[a] >= percent * ly[b]) & (100 * hy[b] >= percent * lx[a])
        out[k : k + step] = sizes & ((100 + percent) * most >= percent * (lx[a] + ly[b]))
    return out


def tree_pairs(x: SignatureTree, y: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs that the dual traversal can't rule out, some at a time; each pair once if ``x is y``."""
    top = max(len(x.levels), len(y.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        at, to = (t.levels[min(level, len(t.levels) - 1)] for t in (x, y))
        fit = _possible(at, to, i, j, percent)
        i, j = i[fit], j[fit]
        if not len(i):
            continue
        if level == 0:
            if x is y:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096], j[k : k + 4096]
            for tree, first in ((x, True), (y, False)):
                if level < len(tree.levels):
                    wide = len(tree.levels[level - 1][0])
                    child = (a if first else b)[:, None] * FANOUT + np.arange(FANOUT)
                    row, col = np.nonzero(child < wide)
                    child = child[row, col]
                    a, b = (child, b[row]) if first else (a[row], child)
            if x is y:
                a, b = a[a <= b], b[a <= b]
            stack.append((level - 1, a, b))


def linked(sets_x: list[np.ndarray], sets_y: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among these sets: indexes into x, then y behind them."""
    sizes = [len(s) for s in sets_x + (sets_y or [])]
    bits = 1 << max(8, (2 * max(sizes) - 1).bit_length())
    x = SignatureTree(sets_x, bits)
    y = x if sets_y is None else SignatureTree(sets_y, bits)
    shift = 0 if y is x else len(sets_x)
    name = np.arange(len(sizes))
    out = []
    for i, j in tree_pairs(x, y, percent):
        a, b = np.array(x.members)[i], np.array(y.members)[j] + shift
        for at in range(0, len(a), 1024):
            some = slice(at, at + 1024)
            for k in np.flatnonzero(name[a[some]] != name[b[some]]) + at:
                p, q = int(a[k]), int(b[k])
                if name[p] == name[q]:
                    continue
                one, two = x.sets[i[k]], y.sets[j[k]]
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    out.append((p, q))
                    name[name == name[q]] = name[p]
    return out


def _verified(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links ``a, b`` between nodes, from rows of ``cluster, bi, bj, block, node, d1, body``."""

    def links(group: list[tuple]) -> pa.RecordBatch | None:
        values, owner = shingle_sets(_unzipped(g[-1] for g in group), shingle)
        edges = np.searchsorted(owner, np.arange(len(group) + 1))
        d1, _ = _digest(values, owner, len(group))
        sides: dict[int, list[tuple[int, np.ndarray]]] = {}
        done = set()
        for i, (block, node, digest, _) in enumerate(group):
            if int(d1[i]) == digest and digest not in done:
                done.add(digest)
                sides.setdefault(block, []).append((node, values[edges[i] : edges[i + 1]]))
        lists = list(sides.values())
        nodes = [n for side in lists for n, _ in side]
        found = linked(*([s for _, s in side] for side in lists), *([None] * (len(lists) == 1)), percent)
        if not found:
            return None
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[k] for k in a], pa.int64()), pa.array([nodes[k] for k in b], pa.int64())], ["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            for cluster, bi, bj, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, bi, bj) != now:
                    if len(group) > 1 and (found := links(group)):
                        yield found
                    now, group = (cluster, bi, bj), []
                if bi == bj or rest[0] in (bi, bj):
                    group.append(tuple(rest))
        if len(group) > 1 and (found := links(group)):
            yield found

    key = ["cluster", "bi", "bj"]
    rows = rows.select(*key, "block", "node", "d1", "body")
    return rows.repartition(*key).sortWithinPartitions(*key, "block").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` and ``d1`` (a digest of the set) of every row of ``docs``.

    Two rows link when 100 * |intersection| >= ``percent`` * |union| of their
    sets of ``shingle``-word shingles; ``component_id`` is the smallest doc_id that
    links reach.  A text of fewer words has one shingle, its whole sequence.  NULL
    texts and texts without words have none and link with nothing.

    Rows that share a doc_id are one document: each has its own ``n_shingles``,
    and they are in one component.  So are rows without a doc_id; where nothing
    else is reached, their component is NULL.  Other columns are ignored, an empty
    table gives no rows.
    """
    size = text_bytes(bounded_batches(docs))
    width = digit_bytes(size)
    sets = frozen(_map_sets(docs, shingle), "shingle-sets").select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("node"), "hash", "n", "counted", "d1", "d2"
    )
    full = sets.where("n > 0")
    classes = full.groupBy("d1", "d2").agg(
        F.min(F.struct("node", "hash")).alias("least"), F.first("n").alias("n"), F.first("counted").alias("counted")
    )
    classes = classes.select("d1", "d2", F.col("least.node").alias("rep"), F.col("least.hash").alias("hash"), "n", "counted")
    shared = _shared_counts(docs, shingle, width, shares(size, COUNT_BYTES), shares(size, SHARD_BYTES))
    lack = F.floor(F.col("n") * (100 - percent) / 100)
    near = classes.where(F.col("n") >= _least_size(percent)).join(shared, "d1", "left")
    near = near.where(F.coalesce("shared", F.lit(0)) >= F.col("counted") - lack)
    near = near.withColumnRenamed("rep", "node").join(_zipped(docs), ["node", "hash"])
    # one body for each set, however many rows have its id and text
    near = near.dropDuplicates(["node", "hash"]).select("d1", "n", "node", "body")
    near = frozen(near, "near-sets", "none")
    buckets = shares(near.agg(F.sum("n")).first()[0] or 0, TASK_SHINGLES)
    clusters = components(_stars(_rare_shingles(near, shingle, percent, width, buckets), width, buckets))
    # every set that meets another, and its cluster
    named = clusters.select(F.col("node").alias("d1"), F.col("component").alias("cluster"))
    centers = clusters.select(F.col("component").alias("d1"), F.col("component").alias("cluster")).distinct()
    placed = near.select("d1", "n").join(named.unionByName(centers), "d1")
    weights = placed.groupBy("cluster").agg(F.sum("n").alias("weight"), F.count("*").alias("many")).where("many > 1")
    blocks = F.ceil(F.col("weight") / BLOCK_SHINGLES)
    block = F.pmod(F.xxhash64("d1"), F.col("blocks"))
    work = placed.join(weights, "cluster").withColumn("blocks", blocks).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    work = work.select("cluster", "blocks", "block", "d1").join(near.select("d1", "node", "body"), "d1")
    work = work.withColumn("other", other).select(
        "cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "d1", "body"
    )
    links = _verified(work, shingle, percent)
    members = full.join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).where("node <> rep")
    found = components(links.unionByName(members.select(F.col("node").alias("a"), F.col("rep").alias("b"))))
    out = sets.join(found, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "node").alias("component_id"),
        "d1",
    )
    return out.withColumn("component_id", F.when(F.col("component_id") != NO_ID, F.col("component_id")))


def one_of_each_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: one of each group of linked texts stays.

    It is the one with the smallest doc_id (a NULL last, equal ids by a hash of
    their texts).  Here texts link, not ids: rows that share a doc_id but not
    their text are compared like any others, rows of one text are one.  Texts
    without words link with nothing and all stay.
    """
    wordy = F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    # the input travels as one struct, so that no name of its own can clash
    rows = docs.where(wordy).select(
        F.xxhash64("text").bitwiseAND(F.lit(NO_ID)).alias("name"),
        F.xxhash64(F.lit(1), F.reverse("text")).alias("name2"),
        F.struct("*").alias("doc"),
    )
    groups = jaccard_components(rows.select(F.col("name").alias("doc_id"), "doc.text"), shingle, percent)
    groups = groups.select(F.col("doc_id").alias("name"), "component_id").distinct()
    # texts are told apart by two hashes
    ids = rows.select("name", "name2", F.col("doc.doc_id").alias("id")).distinct().join(groups, "name")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "name", "name2")).alias("first")
    stays = ids.groupBy("component_id").agg(first).select("first.name", "first.name2", F.col("first.id").alias("id"))
    met = rows.join(stays, ["name", "name2"]).where(F.col("doc.doc_id").eqNullSafe(F.col("id")))
    kept = met.dropDuplicates(["name", "name2"]).select("doc.*")
    return kept.unionByName(docs.where(~wordy))
