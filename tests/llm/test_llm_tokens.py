import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import SCHEMA, edge_docs, edge_rows, no_docs, random_docs
from tokenizers import Tokenizer

from coreline.llm.packing import pack
from coreline.llm.pieces import PieceEncoder
from coreline.llm.token_files import decode_ranks, encode_ranks, read_token_file, write_token_file

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    return PieceEncoder(path, most_chars=500), Tokenizer.from_file(path)


def same(both, texts):
    code, tokenizer = both
    ids, counts = code.encode(pa.array(texts, pa.string()))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, part in zip(texts, parts, strict=True):
        assert part.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_ids_equal_those_of_whole_texts(both):
    rng = random.Random(3)
    letters = list(" \n\t.,'saéÉ1ß́ \x1c\u0085!語 ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(800)]
    same(both, texts + [t for _, t in random_docs(1)] + [r[1] for r in edge_rows()])
    same(both, ["", None, " ", "  ", "<|endoftext|> a<|endoftext|>b", "it's they'll, don't. I'd", "İstanbul ΟΔΟΣ"])


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_ids_of_any_text(both, texts):
    same(both, [t.encode("utf-8", "ignore").decode() for t in texts])


def expected_ids(rows, name, end_id):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]) for i, t, *_ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_is_gapless_and_whole(spark):
    rows = edge_rows() + [(100 + i, t, "s", 1, "p", 2, "b") for i, t in random_docs(5)]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(4), public_tokenizers.path(FILES[0])).collect()
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in expected_ids(rows, FILES[0], 1))
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    last = max(sequences)
    assert sorted(sequences) == list(range(last + 1))
    stream = []
    for s in range(last + 1):
        at = 0
        for r in sorted(sequences[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            stream.append(r)
        assert at == 2048 if s < last else at <= 2048
        full = at if at & (at - 1) == 0 else 2048
        assert {r.padded_length for r in sequences[s]} == {full}
    docs, held = [], []
    for r in stream:
        assert r.start == len(held)
        held += np.frombuffer(r.ids, "<u4").tolist()
        if len(held) == r.doc_tokens:
            docs.append((r.doc_id, held))
            held = []
    order = lambda d: (d[0] is None, d[0] or 0, d[1])
    assert sorted(docs, key=order) == sorted(expected_ids(rows, FILES[0], 1), key=order)


def test_packing_of_no_rows(spark):
    assert pack(no_docs(spark), public_tokenizers.path(FILES[0])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_rank_codes_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = rng.integers(0, 1 << rng.integers(1, 33, n), dtype=np.uint64).astype(np.uint32)
    control, data = encode_ranks(ranks)
    assert len(control) == -(-n // 4)
    assert decode_ranks(control, data, n).tolist() == ranks.tolist()


def test_rank_codes_take_the_bytes_they_need():
    control, data = encode_ranks(np.array([255, 256, 65535, 1 << 16, (1 << 32) - 1], np.uint32))
    assert len(data) == 1 + 2 + 2 + 3 + 4
    assert control == bytes([0b10_01_01_00, 0b11])


def test_token_file_round_trip(spark, tmp_path):
    rows = edge_rows() + [(100 + i, t, "s", 1, "p", 2, "b") for i, t in random_docs(6)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    path = write_token_file(docs, public_tokenizers.path(FILES[1]), path=str(tmp_path / "f"), part_bytes=4000)
    got = sorted(read_token_file(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    want = expected_ids(rows, FILES[1], 2)
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=order) == sorted(((i, crc(x)) for i, x in want), key=order)
    # the most frequent id is rank 0
    counts = np.bincount(np.concatenate([x for _, x in want]))
    assert spark.read.parquet(f"{path}/ranks").where("rank = 0").first().id == counts.argmax()


def test_token_file_of_no_rows(spark):
    path = write_token_file(no_docs(spark), public_tokenizers.path(FILES[1]))
    assert read_token_file(spark, path).collect() == []


def test_edge_rows_keep_their_number(spark):
    got = pack(edge_docs(spark), public_tokenizers.path(FILES[0]))
    assert got.where("start = 0").count() == len(edge_rows())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_end_at_lines_and_signs(name):
    rng = random.Random(8)
    parts = ["end", "été", "e", "don't", "'s", "7", "日本", "́", " ", "‍", "$", "%%%", ".***", "#&", "!?$", "Å", "ß", "I"]
    gaps = ["", "", " ", "\n", "\n\n", " \n", "\n ", "\r\n", "\t", "\u0085", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(30)) for _ in range(300)]
    texts += ["Word.\nNext,\nlast$$$", "\n", "", "\nlead", "trail\n", "a\ńb", "it\n's", "word.%%%"]
    code = PieceEncoder(public_tokenizers.path(name))
    flat, counts = code.encode(pa.array(texts))
    want = [one.ids for one in code.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want]
    assert flat.tolist() == [i for x in want for i in x]
    if not code.spaced:
        # a line end made one piece of two words, which no cache of words knew
        assert not [k for k in code.slot if "\n" in k or k.endswith("$$$") and len(k) > 3]
