"""Conversations formatted as prefix trees.

Conversations that share their first turns share the tokens of those turns: the
turns form a prefix tree, its nodes are emitted once, depth first, and each node
carries what training needs beside its token ids: its place in the output
(``start``), its position in the conversation (``position``, the tokens before it on
its path) and the intervals of the output that it may attend to (its ancestors;
neighbours are merged).  ``loss_from, loss_to`` span the tokens of an assistant's
text, without markers.

Depth first by sorting: a turn has a 16-byte digest, a conversation the digests of
its turns end to end (its path).  In the order of paths every subtree is contiguous,
and a conversation emits only the turns behind what it shares with the one before.
So no tree is built in memory: conversations are range-partitioned by path, each part
runs through a stack of one path, and a fold over one small record a part (its first
and last path) finds the shared turns at part borders, drops them from the later part
and gives every part its offset.  A hot first turn spreads over parts, since paths
differ behind it; equal conversations are one leaf, however many there are, and
their ids stay in a table beside the tree.

A conversation is never held as a whole: it streams in turn order and is cut into
segments of ``SEGMENT_CHARS`` characters or ``SEGMENT_TURNS`` turns.  A longer
conversation goes on in a new tree below its context (the digest of all turns before):
its positions go on, and its attention starts anew there.

Template: ``[INST] text [/INST]`` for users, `` text </s>`` for assistants and
``[ROLE:name] text [/ROLE]`` for all other roles.  Inside texts and names a backslash
is doubled and one is put behind the first character of a control string, so that no
text can look like a marker and reading back is exact.

Results for odd input: a NULL text, role or turn counts as empty text, empty role,
first turn; rows with a NULL conv_id form one conversation.  Rows of one turn come in
the order of role and text, and repeated rows are repeated turns.  Only the role
``assistant`` is under the loss.  Other columns are ignored; an empty table gives no
conversations.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreline.llm.common import bounded_batches, frozen, shares
from coreline.runtime import configure, new_path

SEGMENT_CHARS = 1 << 20
SEGMENT_TURNS = 1024
PART_BYTES = 16 << 20
#: strings that mark turns, or that the vocabulary holds as special tokens
CONTROL = ("[INST]", "[/INST]", "</s>", "<s>", "[ROLE:", "[/ROLE]", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")
_DIGEST = 16


def escape(text: str) -> str:
    """A text in which no control string occurs."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def framed(role: str, text: str) -> tuple[str, str, str]:
    """Opening marker, escaped text, closing marker."""
    if role == "user":
        return "[INST] ", escape(text), " [/INST]"
    if role == "assistant":
        return " ", escape(text), " </s>"
    # a bracket in a role's name would end it
    name = escape(role).replace("]", "\\)")
    return f"[ROLE:{name}] ", escape(text), " [/ROLE]"


_TURN = re.compile(
    r"\[ROLE:(?P<name>[^\]]*)\] (?P<other>.*) \[/ROLE\]|\[INST\] (?P<user>.*) \[/INST\]| (?P<assistant>.*) </s>", re.S
)


def parsed(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    m = _TURN.fullmatch(formatted)
    if m["name"] is not None:
        name = re.sub(r"\\(.)", lambda x: "]" if x[1] == ")" else x[1], m["name"], flags=re.S)
        return name, unescape(m["other"])
    role = "user" if m["user"] is not None else "assistant"
    return role, unescape(m[role])


class _Coder:
    """Token ids of formatted pieces, and their exact bytes again."""

    def __init__(self, path: str):
        from coreline.llm.alignment import ByteLevel

        coder = ByteLevel(path)
        self.pieces, self.vocabulary = coder.pieces, coder.vocabulary

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        ids, counts = self.pieces.encode(pa.array(pieces, pa.large_string()))
        return np.split(ids.astype("<u4"), np.cumsum(counts)[:-1]) if pieces else []

    def decode(self, ids: np.ndarray) -> str:
        return self.vocabulary.bytes_of(ids.astype(np.int64)).tobytes().decode("utf-8")


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> _Coder:
    return _Coder(path)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


_SEGMENT = (
    "conv_id long, segment int, last boolean, full boolean, context binary, before long, leaf binary, path binary, "
    "roles array<string>, texts array<string>"
)


def _segments(rows: DataFrame, tokenizer: str, most_chars: int, most_turns: int) -> DataFrame:
    """Segments of all conversations; those that a task has just seen come without their turns.

    ``context`` is the digest of the turns before a segment, ``leaf`` that of all
    turns to its end, ``before`` the number of tokens before it.  A ``full`` segment
    has reached a limit, so that it may have a continuation, here or in another
    conversation.
    """
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    strings = pa.list_(pa.string())
    types = {
        "conv_id": pa.int64(), "segment": pa.int32(), "last": pa.bool_(), "full": pa.bool_(), "context": pa.binary(),
        "before": pa.int64(), "leaf": pa.binary(), "path": pa.binary(), "roles": strings, "texts": strings,
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        out: list[tuple] = []
        held: dict = {}
        begun = False

        def full() -> bool:
            return held["chars"] >= most_chars or len(held["path"]) >= most_turns

        def start(conv_id, segment: int, context: bytes, before: int) -> None:
            held.update(id=conv_id, segment=segment, context=context, before=before, path=[], roles=[], texts=[], chars=0)

        def close(last: bool) -> tuple[bytes, int]:
            path = b"".join(held["path"])
            leaf = hashlib.sha256(held["context"] + path).digest()[:_DIGEST]
            turns = (held["roles"], held["texts"])
            ahead = held["before"]
            if not last:
                coder = _coder(tokenizer)
                pieces = [p for r, t in zip(*turns, strict=True) for p in framed(r, t)]
                ahead += sum(len(x) for x in coder.encode(pieces))
            if leaf in seen:
                turns = (None, None)
            else:
                seen[leaf] = None
                if len(seen) > 1 << 16:
                    seen.pop(next(iter(seen)))
            out.append((held["id"], held["segment"], last, full(), held["context"], held["before"], leaf, path, *turns))
            return leaf, ahead

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not begun or conv_id != held["id"]:
                    if begun:
                        close(True)
                    start(conv_id, 0, b"", 0)
                    begun = True
                elif full():
                    leaf, ahead = close(False)
                    start(conv_id, held["segment"] + 1, leaf, ahead)
                held["path"].append(hashlib.sha256(repr((role, text)).encode("utf-8", "surrogatepass")).digest()[:_DIGEST])
                held["roles"].append(role)
                held["texts"].append(text)
                held["chars"] += len(text)
            if out:
                yield _batch(out, types)
                out.clear()
        if begun:
            close(True)
            yield _batch(out, types)

    return bounded_batches(dealt).mapInArrow(run, _SEGMENT)


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share from their start."""
    n = min(len(a), len(b)) // _DIGEST
    x, y = (np.frombuffer(p, f"V{_DIGEST}", n) for p in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_NODE = (
    "part int, at long, depth int, position long, ids binary, loss_from int, loss_to int, leaf binary, cut boolean, "
    "parents array<struct<from:long,to:long>>, context binary, border string"
)
_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_NODE_TYPES = {
    "part": pa.int32(), "at": pa.int64(), "depth": pa.int32(), "position": pa.int64(), "ids": pa.binary(),
    "loss_from": pa.int32(), "loss_to": pa.int32(), "leaf": pa.binary(), "cut": pa.bool_(), "parents": _SPANS,
    "context": pa.binary(), "border": pa.string(),
}


def _emitted(leaves: DataFrame, tokenizer: str) -> DataFrame:
    """Nodes of each part, depth first, with offsets inside the part.

    ``leaf`` is set where a conversation or a segment ends (``cut``: at a limit).  A part's last
    row is its border (JSON): path and spans of its first and of its last leaf.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        part, context, path, stack, at, first = None, b"", b"", [], 0, None
        for batch in batches:
            rows = batch.to_pylist()
            fresh, pieces = [], []
            # which turns are new, then all their ids at once
            for row in rows:
                same = part is not None and context == row["context"]
                fresh.append((_shared(path, row["path"]) if same else 0, same and path == row["path"]))
                part, context, path = row["part"], row["context"], row["path"]
                for role, text in zip(row["roles"][fresh[-1][0] :], row["texts"][fresh[-1][0] :], strict=True):
                    pieces += framed(role, text)
            ids, used, out = coder.encode(pieces), 0, []
            for row, (shared, repeat) in zip(rows, fresh, strict=True):
                if repeat:
                    continue
                del stack[shared:]
                depth = len(row["roles"])
                for k in range(shared, depth):
                    opening, text, closing = ids[used : used + 3]
                    used += 3
                    size = len(opening) + len(text) + len(closing)
                    before = stack[-1][2] + stack[-1][1] - stack[-1][0] if stack else row["before"]
                    loss = (len(opening), len(opening) + len(text)) if row["roles"][k] == "assistant" else (0, 0)
                    ends = k == depth - 1
                    out.append((
                        part, at, k, before, np.concatenate([opening, text, closing]).tobytes(), *loss,
                        row["leaf"] if ends else None, ends and row["full"],
                        [{"from": a, "to": b} for a, b in _merged([x[:2] for x in stack])], row["context"], None,
                    ))
                    stack.append((at, at + size, before))
                    at += size
                if first is None:
                    first = {"context": row["context"].hex(), "path": row["path"].hex(), "ends": [x[1] for x in stack]}
            if out:
                yield _batch(out, _NODE_TYPES)
        if first is not None:
            last = {"context": context.hex(), "path": path.hex(), "spans": [x[:2] for x in stack]}
            border = json.dumps({"first": first, "last": last, "tokens": at})
            yield _batch([(part, at, -1, 0, None, 0, 0, None, False, None, None, border)], _NODE_TYPES)

    return leaves.mapInArrow(run, _NODE)


_BORDER = "part int, offset long, head long, carried array<struct<from:long,to:long>>"


def _borders(nodes: DataFrame) -> DataFrame:
    """For each part: the tokens at its head that an earlier part has already
    (``head``), where they are (``carried``), and what to add to its offsets.

    One task reads one record of each part, in order.
    """
    types = {"part": pa.int32(), "offset": pa.int64(), "head": pa.int64(), "carried": _SPANS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, last, spans = 0, None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                border = json.loads(row["border"])
                first = border["first"]
                m = 0
                if last is not None and last["context"] == first["context"]:
                    m = _shared(bytes.fromhex(last["path"]), bytes.fromhex(first["path"]))
                head = first["ends"][m - 1] if m else 0
                carried, offset = spans[:m], base - head
                last = border["last"]
                spans = [
                    carried[k] if at < head else (at + offset, end + offset) for k, (at, end) in enumerate(last["spans"])
                ]
                base += border["tokens"] - head
                out.append((row["part"], offset, head, [{"from": a, "to": b} for a, b in carried]))
            yield _batch(out, types)

    records = nodes.where("depth < 0").select("part", "border")
    return records.repartition(1).sortWithinPartitions("part").mapInArrow(run, _BORDER)


_PLACED = (
    "part int, start long, depth int, position long, ids binary, loss_from int, loss_to int, leaf binary, cut boolean, "
    "parents array<struct<from:long,to:long>>, context binary"
)


def _placed(nodes: DataFrame, borders: DataFrame) -> DataFrame:
    """Nodes at their places in the whole output; those that an earlier part has are dropped."""
    kept = ("depth", "position", "ids", "loss_from", "loss_to", "leaf", "cut")

    def moved(parents: list[dict], offset: int, head: int, carried: list[dict]) -> list[dict]:
        spans = []
        for span in parents:
            a, b = span["from"], span["to"]
            if a < head:
                done = 0
                for x in carried:
                    done += x["to"] - x["from"]
                    if done > b:
                        break
                    spans.append((x["from"], x["to"]))
                a = head
            if a < b:
                spans.append((a + offset, b + offset))
        return [{"from": a, "to": b} for a, b in _merged(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = pc.add(batch.column("at"), batch.column("offset"))
            names = ("parents", "offset", "head", "carried")
            parents = [moved(*x) for x in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), start, *[batch.column(c) for c in kept], pa.array(parents, _SPANS), batch.column("context")],
                ["part", "start", *kept, "parents", "context"],
            )

    met = nodes.where("depth >= 0").drop("border").join(borders, "part").where(F.col("at") >= F.col("head"))
    return bounded_batches(met).mapInArrow(run, _PLACED)


def write_chat_tree(
    conversations: DataFrame,
    tokenizer: str,
    path: str | None = None,
    part_bytes: int = PART_BYTES,
    segment_chars: int = SEGMENT_CHARS,
    segment_turns: int = SEGMENT_TURNS,
) -> str:
    """Write all conversations (``conv_id, turn, role, text``) as prefix trees; returns the folder.

    ``nodes``: a row for each distinct turn behind its distinct history, with token
    ids (little-endian, 32 bits); ``conversations``: the leaf of each conversation
    (of each segment); ``borders``: what open turns each part has from earlier ones.
    """
    spark = configure(conversations.sparkSession)
    path = path or new_path(spark, "chat-tree")
    segments = frozen(_segments(conversations, tokenizer, segment_chars, segment_turns), "segments")
    segments.select("conv_id", "segment", "last", "leaf").write.parquet(f"{path}/conversations")
    leaves = segments.where("roles IS NOT NULL").drop("conv_id", "segment", "last")
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t)) + F.octet_length("path")
    parts = shares(leaves.agg(F.sum(size)).first()[0] or 0, part_bytes)
    ordered = leaves.repartitionByRange(parts, "context", "path").sortWithinPartitions("context", "path")
    numbered = bounded_batches(ordered.withColumn("part", F.spark_partition_id()))
    nodes = frozen(_emitted(numbered, tokenizer), "nodes")
    borders = frozen(_borders(nodes), "borders")
    borders.write.parquet(f"{path}/borders")
    _placed(nodes, borders).sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/nodes")
    return path


class _Digest:
    """What is reported of a path, grown turn by turn."""

    __slots__ = ("chars", "loss", "loss_chars", "turns", "turns_n")

    def __init__(self, before: _Digest | None = None):
        self.turns = before.turns.copy() if before else hashlib.sha256()
        self.loss = before.loss.copy() if before else hashlib.sha256()
        self.turns_n = before.turns_n if before else 0
        self.loss_chars = before.loss_chars if before else 0
        self.chars = before.chars if before else 0

    def add(self, role: str, text: str, chars: int, loss: str) -> _Digest:
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(loss.encode())
        self.turns_n += 1
        self.loss_chars += len(loss)
        self.chars += chars
        return self

    def row(self) -> tuple:
        return self.turns_n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_REPORT = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_REPORT_TYPES = {
    "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(),
    "formatted_chars": pa.int64(),
}
_TURN_TYPE = pa.list_(
    pa.struct([("role", pa.string()), ("text", pa.string()), ("chars", pa.int64()), ("loss", pa.string())])
)


def _leaves_read(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Digests of every leaf, from the tokens on its path; segments of longer
    conversations come with their turns."""
    nodes = spark.read.parquet(f"{path}/nodes").select(
        "part", "start", "depth", "ids", "loss_from", "loss_to", "leaf", "cut", "context"
    )
    borders = spark.read.parquet(f"{path}/borders")
    open_turns = borders.select("part", F.explode("carried.from").alias("start"))
    # an open turn stands before all own turns of its part
    carried = nodes.drop("part", "leaf").join(open_turns, "start").withColumn("leaf", F.lit(None).cast("binary"))
    both = nodes.unionByName(carried).repartition("part").sortWithinPartitions("part", "start")
    types = {"leaf": pa.binary(), "turns": _TURN_TYPE} | _REPORT_TYPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _coder(tokenizer).vocabulary
        part, stack = None, []
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("ids")]
            flat = np.concatenate(ids).astype(np.int64)
            raw = vocabulary.bytes_of(flat).tobytes()
            # bytes before each id
            place = np.append(0, np.cumsum(vocabulary.size[flat]))
            at, out = 0, []
            names = ("part", "depth", "loss_from", "loss_to", "leaf", "cut", "context")
            for own, *row in zip(ids, *(batch.column(c).to_pylist() for c in names), strict=True):
                number, depth, loss_from, loss_to, leaf, cut, context = row
                text = lambda a, b: raw[place[at + a] : place[at + b]].decode()  # noqa: B023, E731
                formatted, loss = text(0, len(own)), unescape(text(loss_from, loss_to))
                at += len(own)
                if number != part:
                    part, stack = number, []
                del stack[depth:]
                role, plain = parsed(formatted)
                digest = _Digest(stack[-1][0] if stack else None).add(role, plain, len(formatted), loss)
                stack.append((digest, (role, plain, len(formatted), loss)))
                if leaf is not None:
                    turns = None
                    if cut or context:
                        turns = [dict(zip(("role", "text", "chars", "loss"), t, strict=True)) for _, t in stack]
                    out.append((leaf, turns, *digest.row()))
            if out:
                yield _batch(out, types)

    turn = "array<struct<role:string,text:string,chars:long,loss:string>>"
    return bounded_batches(both).mapInArrow(run, f"leaf binary, turns {turn}, {_REPORT}")


def read_chat_tree(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of every
    conversation, read from the written trees."""
    report = list(_REPORT_TYPES)
    ends = spark.read.parquet(f"{path}/conversations")
    leaves = frozen(_leaves_read(configure(spark), path, tokenizer), "leaves")
    whole = (F.col("segment") == 0) & F.col("last")
    short = ends.where(whole).join(leaves.drop("turns"), "leaf").select("conv_id", *report)
    longer = ends.where(~whole).join(leaves.select("leaf", "turns"), "leaf").select("conv_id", "segment", "turns")
    types = {"conv_id": pa.int64()} | _REPORT_TYPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["segment"] == 0:
                    if digest is not None:
                        out.append((now, *digest.row()))
                    now, digest = row["conv_id"], _Digest()
                for turn in row["turns"]:
                    digest.add(turn["role"], turn["text"], turn["chars"], turn["loss"])
            if out:
                yield _batch(out, types)
        if digest is not None:
            yield _batch([(now, *digest.row())], types)

    streamed = bounded_batches(longer.repartition("conv_id").sortWithinPartitions("conv_id", "segment"))
    return short.unionByName(streamed.mapInArrow(run, f"conv_id long, {_REPORT}"))


ORACLE = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
    SELECT *,
        length(text) + length(text) - length(replace(text, '\', ''))
            + len(regexp_extract_all(text, '\[/?INST\]|</?s>|\[ROLE:|\[/ROLE\]|<\|endoftext\|>'))
            + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 16 + length(role) END AS chars
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
        AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
