import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coreline.llm.chat_tree import CONTROL, _coder, escape, framed, parsed, read_chat_tree, unescape, write_chat_tree

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, part int, start long, leaf string, path string"
SMALL = {"part_bytes": 400, "segment_chars": 10**9, "segment_turns": 10**9}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(4)


def turns_of(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in out.items()}


def expected(rows):
    out = []
    for c, turns in turns_of(rows).items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        chars = sum(len("".join(framed(r, t))) for r, t in turns)
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), chars))
    return sorted(map(repr, out))


def got(spark, path):
    return sorted(repr(tuple(r)) for r in read_chat_tree(spark, path, PATH).collect())


def conversations(seed, n=60):
    """Random conversations that share beginnings, some equal, some a beginning of others."""
    rng = random.Random(seed)
    words = ["ok", "wörd", "two\nlines", "", " ", "\\", "[", "</s>", "[INST] x [/INST]", "[ROLE:", "a\\[INST]", "<|endoftext|>", "語"]
    known = []
    for _ in range(n):
        own = list(rng.choice(known)) if known and rng.random() < 0.7 else []
        own = own[: rng.randrange(len(own) + 1)] if rng.random() < 0.6 else own
        for _ in range(rng.randrange(0 if own else 1, 4)):
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(5)))
            own.append((rng.choice(["user", "assistant", "system", "tool]", "x[INST]\\)"]), text))
        known.append(own)
    return [(i, k, r, t) for i, own in enumerate(known) for k, (r, t) in enumerate(own)]


@settings(max_examples=300, deadline=None)
@given(role=st.text(max_size=8) | st.sampled_from(["user", "assistant", "]\\)"]), parts=st.lists(st.sampled_from([*CONTROL, "\\", "[", "<", " ", "a", "\n"])))
def test_turns_come_back_and_hold_no_control_strings(role, parts):
    text = "".join(parts)
    opening, inner, closing = framed(role, text)
    assert not any(c in inner for c in CONTROL) and unescape(inner) == text == unescape(escape(text))
    assert parsed(opening + inner + closing) == (role, text)
    assert sum((opening + inner + closing).count(c) for c in ("</s>", "[INST]", "[ROLE:")) == 1


@pytest.mark.parametrize("seed", range(3))
def test_digests_equal_brute_force(spark, seed):
    rows = conversations(seed)
    assert got(spark, write_chat_tree(frame(spark, rows), PATH)) == expected(rows)
    assert got(spark, write_chat_tree(frame(spark, rows), PATH, **SMALL)) == expected(rows)


def test_every_shared_beginning_is_emitted_once_with_its_ancestors(spark):
    rows = conversations(4, 90)
    path = write_chat_tree(frame(spark, rows), PATH, **SMALL)
    nodes = spark.read.parquet(path + "/nodes").orderBy("start").collect()
    assert len({n.part for n in nodes}) > 5
    all_turns = turns_of(rows).values()
    assert len(nodes) == len({tuple(t[: k + 1]) for t in all_turns for k in range(len(t))})
    # gapless, depth first
    flat = np.concatenate([np.frombuffer(n.ids, "<u4") for n in nodes])
    assert [n.start for n in nodes] == (np.cumsum([len(n.ids) // 4 for n in nodes]) - [len(n.ids) // 4 for n in nodes]).tolist()
    tokenizer = Tokenizer.from_file(PATH)
    decode = _coder(PATH).decode
    seen = set()
    for n in nodes:
        before = np.concatenate([flat[a:b] for a, b in n.parents] or [flat[:0]])
        assert n.position == len(before)
        assert all(b <= n.start for _, b in n.parents) and all(x[1] < y[0] for x, y in zip(n.parents, n.parents[1:]))
        own = np.frombuffer(n.ids, "<u4")
        role, text = parsed(decode(own))
        if role == "assistant":
            assert unescape(decode(own[n.loss_from : n.loss_to])) == text
        else:
            assert n.loss_from == n.loss_to
        want = [i for piece in framed(role, text) for i in tokenizer.encode(piece, add_special_tokens=False).ids]
        assert own.tolist() == want
        seen.add(decode(np.concatenate([before, own])))
    assert seen == {"".join("".join(framed(*x)) for x in t[: k + 1]) for t in all_turns for k in range(len(t))}


def test_long_conversations_are_cut_and_read_whole(spark):
    rows = conversations(6, 30) + [(500 + c, k, ("user", "assistant")[k % 2], f"turn {k // (c + 1)}") for c in range(3) for k in range(23)]
    for limit in ({"segment_turns": 3}, {"segment_chars": 12}, {"segment_turns": 23}, {"segment_turns": 1}):
        path = write_chat_tree(frame(spark, rows), PATH, **(SMALL | limit))
        assert got(spark, path) == expected(rows), limit


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (1, None, "user", None), (1, 0, None, "x"),
        (2, 0, "user", "tie b"), (2, 0, "user", "tie a"), (2, 0, "user", "tie a"), (3, 5, "Assistant", "</s>"),
        (4, 0, "assistant", None), (5, 0, "user", "long " * 40_000), (5, 1, "assistant", "語" * 30_000),
        (6, 0, "user", "long " * 40_000),
    ]
    assert got(spark, write_chat_tree(frame(spark, rows), PATH)) == expected(rows)
    assert got(spark, write_chat_tree(frame(spark, []), PATH)) == []


def test_many_equal_conversations_are_one_leaf(spark):
    rows = [(i, k, ("user", "assistant")[k], f"same {k}") for i in range(300) for k in range(2)]
    path = write_chat_tree(frame(spark, rows), PATH, part_bytes=50)
    assert spark.read.parquet(path + "/nodes").count() == 2
    assert got(spark, path) == expected(rows)
