import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_data import SCHEMA, edge_docs, edge_rows, no_docs, random_docs, words

from coreline.llm import suffix_dedup
from coreline.llm.components import components
from coreline.llm.jaccard_tree import SignatureTree, jaccard_components, linked, one_of_each_group, tree_pairs
from coreline.llm.line_dedup import dedup_lines, without_repeated_lines
from coreline.llm.suffix_dedup import remove_repeats


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def groups(pairs):
    """Smallest member of the component of every node of these (a, b) pairs."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


def alike(rows, k, percent):
    """Links between row numbers, by comparing all rows that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    found = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                found.add((j, i))
    return sets, found


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_groups_match_all_pairs(spark, k, percent):
    rows = [(i, t) for i, t in random_docs(11, 250)]
    rng = random.Random(4)
    base = [f"t{rng.randrange(5000)}" for _ in range(900)]
    for i in range(12):  # a chain: each is near the next one only
        rows.append((1000 + i, " ".join(base[20 * i : 20 * i + 300])))
    for i in range(6, 12):  # short ones, about the smallest that can link
        rows += [(2000 + 2 * i, " ".join(base[:i])), (2001 + 2 * i, " ".join(base[: i + 1]))]
    rng.shuffle(rows)
    sets, links = alike(rows, k, percent)
    root = groups([(i, i) for i, _ in rows] + [(rows[a][0], rows[b][0]) for a, b in links])
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == {
        (i, len(s), root[i]) for (i, _), s in zip(rows, sets, strict=True)
    }
    assert len(set(root.values())) < len(rows) - 20


def test_jaccard_edges(spark):
    got = jaccard_components(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == [(9, 1), (9, 1)]
    assert by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[4] == [(0, 4)]
    assert by[5] == [(1, 5)]
    assert {c for _, c in by[7] + by[8]} == {7}
    assert {c for _, c in by[None]} == {None}
    assert jaccard_components(no_docs(spark)).collect() == []


def test_large_cluster_in_blocks(spark, monkeypatch):
    from coreline.llm import jaccard_tree

    monkeypatch.setattr(jaccard_tree, "BLOCK_SHINGLES", 600)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(120)] = f"u{i}"
        rows.append((i, " ".join(own)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    _, links = alike(rows, 4, 85)
    root = groups([(i, i) for i, _ in rows] + list(links))
    assert {r.doc_id: r.component_id for r in got.collect()} == root


def test_tree_drops_no_pair_that_passes():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(1, 1 << 63, rng.integers(6, 200), dtype=np.uint64)
        for _ in range(3):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(1, 1 << 63, len(base), dtype=np.uint64), base)))
    tree = SignatureTree(sets, 512)
    left = {tuple(sorted((tree.members[a], tree.members[b]))) for i, j in tree_pairs(tree, tree, 85) for a, b in zip(i, j, strict=True)}
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                want.add((j, i))
    assert want and want <= left
    assert len(left) < len(sets) * (len(sets) - 1) // 8
    assert groups(linked(sets, None, 85)) == {k: v for k, v in groups(want).items()}
    half = linked(sets[:60], sets[60:], 85)
    assert groups(half) == groups((a, b) for a, b in want if a < 60 <= b)


def test_one_of_each_group(spark):
    rows = [(i if i % 7 else None, t) for i, t in random_docs(12, 150)]
    rows += [(500, "x y z w v u t"), (500, "an own text under the same id as another"), (501, ""), (502, None), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, __x string")
    got = one_of_each_group(docs)
    assert got.columns == docs.columns
    sets, links = alike(rows, 5, 80)
    root = groups([(i, i) for i in range(len(rows))] + list(links))
    best = {}
    for n, (i, t) in enumerate(rows):
        if sets[n]:
            key = root[n]
            best[key] = min(best.get(key, (True, 1 << 62)), (i is None, i or 0))
    kept = [(r.doc_id, r.text) for r in got.collect()]
    full = [(i, t) for i, t in kept if words(t)]
    assert len(full) == len(best)
    assert sorted((i is None, i or 0) for i, _ in full) == sorted(best.values())
    assert len(kept) - len(full) == sum(not s for s in sets)


def test_copies_are_compared_once(spark, monkeypatch):
    from coreline.llm import jaccard_tree

    seen, verified = [], jaccard_tree._verified

    def counted(rows, *rest):
        seen.append(rows.count())
        return verified(rows, *rest)

    monkeypatch.setattr(jaccard_tree, "_verified", counted)
    text = " ".join(f"t{i}" for i in range(200))
    rows = [(i, text) for i in range(40)] + [(50, text + " end"), (51, "another text that has seven words")]
    got = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == [0, 51]
    rows = [(7, text) for _ in range(40)] + [(7, "another text that has seven words"), (50, text + " end")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(7, 7), (50, 7)}
    assert seen == [2, 2]


@pytest.mark.parametrize("percent, width", [(85, 8), (80, 1)])
def test_linked_sets_meet_at_a_rare_key(percent, width):
    from coreline.llm.jaccard_tree import _classes, rare_keys

    rng = np.random.default_rng(5)
    passage = rng.integers(1, 1 << 63, 80, dtype=np.uint64)
    sets = []
    for n in range(50):
        base = rng.integers(1, 1 << 63, 5 + 4 * n, dtype=np.uint64)
        for _ in range(3):
            own = np.where(rng.random(len(base)) < 0.03, rng.integers(1, 1 << 63, len(base), dtype=np.uint64), base)
            sets.append(np.unique(np.concatenate([own, passage[: n if n % 2 else 0]])))
    key = np.concatenate(sets) >> np.uint64(64 - 8 * width)
    name = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found, place = np.unique(key, return_inverse=True)
    holders = np.bincount(np.unique(np.stack([place, name]), axis=1)[0])
    keys, names = rare_keys(key, name, _classes(holders)[place], percent)
    rare = [set(keys[names == i].tolist()) for i in range(len(sets))]
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                links += 1
                assert rare[i] & rare[j]
    assert links > 30


def test_shared_passage_makes_no_cluster(spark, monkeypatch):
    from coreline.llm import jaccard_tree

    seen, verified = [], jaccard_tree._verified

    def counted(rows, *rest):
        seen.append(rows.count())
        return verified(rows, *rest)

    monkeypatch.setattr(jaccard_tree, "_verified", counted)
    monkeypatch.setattr(jaccard_tree, "BLOCK_SHINGLES", 1000)
    passage = " ".join(f"p{i}" for i in range(150))
    rows = []
    for k in range(30):  # pairs of near copies, all with one passage in half of their words
        own = " ".join(f"w{k}x{i}" for i in range(150))
        rows += [(2 * k, f"{passage} {own}"), (2 * k + 1, f"{passage} {own} end")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i // 2 * 2) for i, _ in rows}
    # each body travels once; pairs of blocks of one large cluster sent it many times
    assert seen == [len(rows)]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 90)]
    edges += [(3000 + rng.randrange(60), 3000 + rng.randrange(60)) for _ in range(50)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in groups(edges).items() if k != v}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def cut(rows, length=50):
    first, texts = {}, [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - length + 1):
            x = b[k : k + length]
            first[x] = min(first.get(x, i), i)
    out = []
    for (doc_id, _), (i, b) in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest(), left))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeated_bytes_match_brute_force(spark, monkeypatch, small):
    if small:  # many batches, ranges and chunks
        for name, value in (("BATCH_BYTES", 700), ("BUCKET_BYTES", 3000), ("CHUNK_BYTES", 2000)):
            monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(6)
    rows = random_docs(13, 90) + [(200, "a" * 400), (201, "b" + "a" * 170), (202, "a" * 50), (203, "a" * 49), (204, "xy " * 80), (205, "y xy " + "xy " * 30)]
    rows += [(i, t) for i, t, *_ in edge_rows() if not t or len(t) < 5000]
    rng.shuffle(rows)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    have = sorted(((*r[:5], bytes(r[5])) for r in got.collect()), key=order)
    assert have == sorted(cut(rows), key=order)
    assert sum(r[2] for r in have) > 1000


def test_runs_around_one_phrase_are_told_apart(spark):
    # all have one first digit; the runs of each two neighbours agree in the first 40 bits of their hash
    texts = [
        "smnyjykatfkuelhvtpiwooixqesvjibfwrdhqumvmprxpvzxhg",
        "tqoreskkskhsewpvtpiwooixqesvjibfwrdaxlnmeibbjiwamg",
        "dqribpoamgtcdoqvtpiwooixqesvjibfwrdysjenejuonizejg",
        "xhrzlkygsuggpjcvtpiwooixqesvjibfwrdjyyhzefwogbosfj",
    ]
    rows = list(enumerate(texts)) + [(9, texts[3])]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 50}


def test_hot_digit_is_split(spark, monkeypatch):
    for name, value in (("BUCKET_BYTES", 2000), ("CHUNK_BYTES", 2000), ("HOT_RUNS", 20)):
        monkeypatch.setattr(suffix_dedup, name, value, raising=False)
    buckets, third = [], suffix_dedup._third_digit

    def watched(opened, *rest):
        n = rest[2]  # ranges of strings follow those of digits
        buckets.append(opened.where(f"bucket >= {n} and bucket < {2 * n}").select("bucket").distinct().count())
        return third(opened, *rest)

    monkeypatch.setattr(suffix_dedup, "_third_digit", watched)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    ends = [some(30) for _ in range(6)]
    # a phrase of a very small hash; every third text shares what follows it with others
    rows = [(i, some(40) + "vtpiwooixqesvjibfwrd" + (ends[i % 6] if i % 3 == 0 else some(30)) + some(10)) for i in range(90)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((*r[:5], bytes(r[5])) for r in got.collect()) == sorted(cut(rows))
    assert buckets[0] > 1


def test_repeated_bytes_of_edges(spark):
    got = remove_repeats(edge_docs(spark), keep=False).collect()
    assert len(got) == len(edge_rows()) and all(r.kept is None for r in got)
    assert remove_repeats(no_docs(spark)).collect() == []


def kept_lines(rows):
    first, out = {}, {}
    texts = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in texts:
        lines = t.split("\n")
        for k in range(len(lines) - 2):
            if words("".join(lines[k : k + 3])):
                first.setdefault(tuple(lines[k : k + 3]), (i, t, k))
    for i, t in texts:
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            if words("".join(lines[k : k + 3])) and first[tuple(lines[k : k + 3])] != (i, t, k):
                gone |= {k, k + 1, k + 2}
        out[i, t] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_windows_match_brute_force(spark):
    rows = random_docs(14, 120) + [(900, "a\nb\nc\na\nb\nc\na\nb\nc"), (901, "b\nc\na\n\n\n\n\n\n"), (None, "q\nr\ns"), (902, "q\nr\ns\nt"), (903, None), (904, ""), (905, "\n\n\n\n")]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(5)
    want = kept_lines(rows)
    got = dedup_lines(docs).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        have = (r["__n_lines"], r["__n_removed"], r["__kept"])
        assert have == ((0, 0, None) if r.text is None else want[r.doc_id, r.text]), r
    assert sum(n for _, n, _ in want.values()) > 30


def test_line_dedup_keeps_columns(spark):
    docs = edge_docs(spark)
    got = without_repeated_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {r.doc_id: r for r in got.collect() if r.doc_id}
    assert by[10].text == "start" and by[10].n_chars == 5 and by[10].size == 7
    assert by[2].text is None and by[2].n_chars is None
    assert without_repeated_lines(no_docs(spark)).collect() == []


def test_line_dedup_is_native(spark):
    plan = dedup_lines(edge_docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert SCHEMA.split()[0] in plan


def thue_morse(n, one="a", other="b"):
    return "".join((one, other)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1 << 10, 1 << 11, 1 << 12])
def test_words_in_thue_morse_order_are_no_link(spark, n):
    """Such words collide under every polynomial hash modulo a power of two."""
    rows = [(1, "one two three " + thue_morse(n)), (2, "one two three " + thue_morse(n, "b", "a"))]
    rows += [(3, rows[0][1]), (4, rows[1][1].upper())]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 2}
    kept = one_of_each_group(spark.createDataFrame([(i, "x " * 9 + t) for i, t in rows[:2]], "doc_id long, text string"))
    assert kept.count() == 2


@pytest.mark.parametrize("blocks", [1 << 10, 1 << 11, 1 << 12])
def test_runs_in_thue_morse_order_keep_their_bytes(spark, blocks):
    """Documents without a common 50-byte string, though made of one phrase."""
    order = thue_morse(blocks)

    def text(letters):
        return "".join(f"twenty letters phrase{i:04d}{c}" for i, c in enumerate(letters))

    rows = [(1, text(order)), (2, text(order.translate(str.maketrans("ab", "ba"))))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == brute_removed(rows)


def brute_removed(rows, length=50):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = text.encode()
        strings = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        gone = np.zeros(len(raw), bool)
        for i, x in enumerate(strings):
            if x in seen:
                gone[i : i + length] = True
        seen |= set(strings)
        out[doc_id] = int(gone.sum())
    return out


def test_span_hashes_agree_for_equal_spans_only():
    from coreline.llm.rolling import PRIME, prefix_sums, span_hash, window_hash

    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 70_000).astype(np.uint8)
    sums = prefix_sums(data)
    start = rng.integers(0, 60_000, 4000)
    for size in (1, 5, 12, 20):
        h = span_hash(sums, start, start + size)
        spans = [data[a : a + size].tobytes() for a in start]
        assert len(set(h.tolist())) == len(set(spans)) == len(set(zip(h.tolist(), spans)))
        assert (window_hash(sums, size)[start] == h).all()
    assert (span_hash(sums, start, start) == 0).all() and PRIME == 2**31 - 1
    half = data[:1000].copy()
    both = np.concatenate([half, half])
    h = span_hash(prefix_sums(both), np.array([0, 1000]), np.array([1000, 2000]))
    assert h[0] == h[1]


def test_names_that_clash_with_the_operators_own(spark):
    names = ("name", "name2", "doc", "id", "__id", "__text", "__words", "first", "component_id", "node", "hash")
    rows = [(i, t, *range(len(names))) for i, t in random_docs(3, 40)]
    docs = spark.createDataFrame(rows, ("doc_id", "text", *names))
    got = one_of_each_group(docs)
    plain = one_of_each_group(docs.select("doc_id", "text"))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in plain.collect())
    assert all(tuple(r)[2:] == tuple(range(len(names))) for r in got.collect())


def test_mixed_documents_keep_clashing_columns(spark):
    from coreline.llm.mixing import mixed_documents

    names = ("__words", "__size", "__doc", "__taken", "__range", "__text", "__source", "__shard", "first", "size")
    rows = [(i, t, "ab"[i % 2], len(t), *range(len(names))) for i, t in random_docs(3, 40)]
    docs = spark.createDataFrame(rows, ("doc_id", "text", "source", "n_chars", *names))
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    plain = mixed_documents(docs.select("doc_id", "text", "source", "n_chars")).collect()
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(map(tuple, plain)) != []
    assert all(tuple(r)[4:] == tuple(range(len(names))) for r in got.collect())
