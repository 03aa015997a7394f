import collections
import hashlib
import random
import urllib.parse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import SCHEMA, edge_docs, edge_rows, no_docs, random_docs
from tokenizers import Tokenizer

from coreline.llm.alignment import align_tokens, aligned_chunks, byte_letters, merge_ends
from coreline.llm.common import frozen

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens(text, a, b, letters):
    """(id, bytes) of either tokenizer."""
    first = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("\u2581", " ").encode()))
    return first, second


def expected(rows):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        groups, one, two = [], [], []
        if text:
            one, two = tokens(text, a, b, letters)
            raw = (" " + text).encode()
            if any(b"".join(x for _, x in side) != raw for side in (one, two)):
                one, two = [], []
        i = j = at_a = at_b = 0
        ga, gb = [], []
        while i < len(one) or j < len(two):
            if at_a <= at_b:
                ga.append(one[i][0])
                at_a += len(one[i][1])
                i += 1
            else:
                gb.append(two[j][0])
                at_b += len(two[j][1])
                j += 1
            if at_a == at_b:
                groups.append((ga, gb))
                ga, gb = [], []
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        docs.append((doc_id, len(one), len(two), groups, links))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(map(repr, out))


def got(df):
    assert tuple(df.columns) == COLUMNS
    return sorted(repr(tuple(r)) for r in df.collect())


def test_alignment_equals_brute_force(spark):
    rows = random_docs(21, 80) + [
        (900, "\u2581 mark"), (901, " two  spaces "), (902, "<|endoftext|> <s>[INST]</s>"), (903, "\ttab\n\nend\n"),
        (904, "e\u0301 \u00e9 \ufb01 \u2165 \u212b"), (905, "\u0000a\u00a0b"),
    ]
    rows += [(r[0], r[1]) for r in edge_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(align_tokens(docs, A, B)) == expected(rows)
    assert got(align_tokens(docs, A, B, chunk_bytes=2000)) == expected(rows)


def test_alignment_of_odd_tables(spark):
    assert got(align_tokens(edge_docs(spark), A, B)) == expected([(r[0], r[1]) for r in edge_rows()])
    assert got(align_tokens(no_docs(spark), A, B)) == []
    names = ("part", "pair", "n", "best", "links", "pairs", "counts", "found", "e", "n_a")
    docs = spark.createDataFrame([(1, "a text of words", *range(len(names)))], ("doc_id", "text", *names))
    assert got(align_tokens(docs, A, B)) == expected([(1, "a text of words")])


def test_a_long_text_is_cut_into_lanes_without_losing_links(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("ab é語\n.") for _ in range(60_000))
    rows = [(1, text), (2, text), (3, "short")]
    docs = spark.createDataFrame(rows, SCHEMA.split(", source")[0]).coalesce(1)
    assert got(align_tokens(docs, A, B)) == expected(rows)


@settings(max_examples=200, deadline=None)
@given(a=st.sets(st.integers(1, 300)), b=st.sets(st.integers(1, 300)), lane=st.integers(1, 400))
def test_lockstep_finds_every_common_end(a, b, lane):
    ends_a, ends_b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    at_a, at_b = merge_ends(ends_a, ends_b, 300, lane)
    assert ends_a[at_a].tolist() == ends_b[at_b].tolist() == sorted(a & b)


def test_arrow_strings_of_either_kind():
    from coreline.llm.alignment import ByteLevel, Pieces, _aligned

    for kind in (pa.string(), pa.large_string()):
        measures, links = _aligned(pa.array(["some text", None, ""], kind), ByteLevel(A), Pieces(B))
        assert measures["n_groups"].tolist()[1:] == [0, 0] and len(links) == measures["n_groups"][0] > 0


def test_a_chunk_holds_each_link_of_a_text_once(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdenorst") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(20_000))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = aligned_chunks(docs, A, B).select("n_groups", "n_distinct", "links", "times").collect()
    assert sum(len(r.n_groups) for r in found) == len(rows)
    for r in found:
        links, times = np.frombuffer(r.links, "<u4"), np.frombuffer(r.times, "<u4")
        assert len(links) == len(times) == sum(r.n_distinct) < sum(r.n_groups) / 20
        at = 0
        for n, distinct in zip(r.n_groups, r.n_distinct, strict=True):
            own = slice(at, at + distinct)
            assert len(set(links[own].tolist())) == distinct and times[own].sum() == n
            at += distinct
    assert got(align_tokens(docs, A, B)) == expected(rows)


def test_long_tables_give_rows_and_row_groups_of_bounded_size(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeénorst") for _ in range(rng.randrange(2, 8))) for _ in range(9000)]
    texts = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(100)]
    rows = [(i, texts[i % 100]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    most = aligned_chunks(docs, A, B).selectExpr("max(octet_length(links))").first()[0]
    assert most <= 2 << 20
    kept = frozen(spark.range(100).coalesce(1), "rows", group_rows=8)
    assert kept.count() == 100
    files = [pq.ParquetFile(urllib.parse.urlparse(f).path) for f in kept.inputFiles()]
    assert max(f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 8
