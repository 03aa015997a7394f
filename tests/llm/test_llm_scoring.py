import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_data import SCHEMA, edge_docs, edge_rows, no_docs, random_docs, words

import check
from coreline.llm import licenses, toxicity, winnowing
from coreline.llm.mixing import blocks_won, lowest_winner, mix_report, mixed_documents
from coreline.llm.queries import ORACLES, QUERIES
from coreline.llm.repetition import keep_good, measure, quality_measures

FOLDER = "/root/testdata/sf0.001"


def native(df):
    return not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = check.database(FOLDER)
    rows = QUERIES[name](spark, FOLDER)
    theirs = con.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(rows.columns)
    ours = check.canonical([tuple(r) for r in rows.collect()], rows.columns)
    assert ours and ours == check.canonical(theirs.fetchall(), columns)


# --- repetition ----------------------------------------------------------------


def brute_measure(text, window=5):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - window + 1):
        at[tuple(w[i : i + window])].append(i)
    covered, longest = set(), 0
    for places in at.values():
        if len(places) > 1:
            covered |= {i + k for i in places for k in range(window)}
            for n, a in enumerate(places):
                for b in places[n + 1 :]:
                    k = 0
                    while b + k < len(w) and w[a + k] == w[b + k]:
                        k += 1
                    longest = max(longest, k)
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeats += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, repeats, len(covered), sum(len(w[i]) for i in covered), longest


def test_repetition_matches_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "a " * 40, "é ß # *|", "a b c d e f a b c d e"]
    texts += [t for i, t, *_ in edge_rows() if not t or len(t) < 5000]
    for _ in range(300):
        own = "ab cd e f# é g\n".split(" ")[: rng.randrange(1, 7)]
        texts.append("".join(rng.choice(own) + rng.choice([" ", "\n", "\t"]) for _ in range(rng.randrange(60))))
    got = [c.to_pylist() for c in measure(pa.array(texts), 5, 10, 20, 25, 500)]
    for i, text in enumerate(texts):
        want = brute_measure(text)
        assert tuple(c[i] for c in got[:7]) == want, text
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[7][i] == failed
        assert got[8][i] == (not failed and 100 * want[5] <= 25 * want[1] and want[6] <= 500)


def test_quality_keeps_clean_rows_and_columns(spark):
    docs = edge_docs(spark)
    found = quality_measures(docs)
    assert found.count() == len(edge_rows())
    kept = keep_good(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 2 and ids[7] == 1 and ids[8] == 2 and ids[None] == 1
    assert not {2, 3, 4, 5, 6} & set(ids)
    assert keep_good(no_docs(spark)).collect() == []


# --- mixing ----------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        source = rng.choice(["b", "b", "b", "a", "c", None, "ä", "Z"] + ["hot"] * 6)
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), source, 1, "p", 2, "b"))
    rows += [(9000, "tiny source", "zz", 1, "p", 2, "b"), (9001, None, "empty", 1, "p", 2, "b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mix_report(docs, shard_words=2000).collect()
    assert sorted(got) == sorted(mix_report(docs.repartition(3), shard_words=2000).collect())
    sizes, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 16, s
    assert want["zz"] == 6 and want["empty"] == 0


def plain_sainte_lague(shards):
    seats = (sum(int(e * 1_000_000) for e, _, _ in shards) + 500_000) // 1_000_000
    won = [0] * len(shards)
    for _ in range(seats):
        free = [i for i, (e, most, _) in enumerate(shards) if e > 0 and won[i] < most]
        won[min(free, key=lambda i: (-shards[i][0] / (2 * won[i] + 1), shards[i][2]))] += 1
    return won


@pytest.mark.parametrize("most_ranked", [1, 6, 1 << 17])
def test_blocks_go_to_the_highest_quotients(spark, most_ranked):
    from pyspark.sql import functions as F

    rng = random.Random(most_ranked)
    cases = [
        [(rng.choice([0.4, 7.5, 29.99]) * rng.random(), 30) for _ in range(40)],
        [(0.4, 1)] * 25 + [(3.0, 1)] * 2,
        [(2.5, 3)] * 30 + [(0.0, 3)],
        [(57.3, 60), (0.2, 3), (0.49, 3)],
        [(0.1, 3)] * 3,
    ]
    for case in cases:
        shards = [(e, most, f"{rng.getrandbits(128):032x}") for e, most in case]
        df = spark.createDataFrame(shards, "e double, most long, tie string")
        last = lowest_winner(df, most_ranked)
        won = blocks_won(F.col("e"), F.col("most"), F.col("tie"), last).alias("won")
        got = {r.tie: r.won for r in df.select("tie", won).collect()}
        assert [got[t] for _, _, t in shards] == plain_sainte_lague(shards)
    assert lowest_winner(spark.createDataFrame([], "e double, most long, tie string")) is None


def test_mixed_documents_are_what_was_counted(spark):
    docs = spark.createDataFrame(
        [(i, t, f"s{i % 4}", 1, "p", len(t), "b") for i, t in random_docs(21, 200)] + edge_rows(), SCHEMA
    )
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    total = Counter()
    for r in got.collect():
        total[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    counted = Counter()
    for r in mix_report(docs).collect():
        counted[r.doc_id] += r.taken
    assert total == Counter({k: v for k, v in counted.items() if v})
    assert mixed_documents(no_docs(spark)).collect() == [] and mix_report(no_docs(spark)).collect() == []


# --- winnowing -------------------------------------------------------------------


def by_falling_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "PART_BYTES", 6000)
    rows = [(100 + i, t) for i, t in random_docs(31, 80)] + [(i, t or "") for i, t, *_ in edge_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    report = winnowing.fingerprint_report(docs)
    assert native(report)
    got = report.collect()
    ordered = by_falling_id(rows)
    want = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    twice = [r for r in got if r.doc_id == 1]
    assert len({r.fingerprint for r in twice}) == 1 and max(r.near_next for r in twice) == 1
    assert winnowing.fingerprint_report(no_docs(spark)).collect() == []


def test_window_minimum_goes_right_on_ties(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b"]) for _ in range(n)) for n in (0, 1, 4, 5, 9, 10, 11, 60, 200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    out = winnowing.with_fingerprint(rows, "text", "h", "p", gram=2, window=4)
    grams = rows.withColumn(
        "g", winnowing._hashes(winnowing.F.regexp_extract_all("text", winnowing.F.lit("[^ ]+"), winnowing.F.lit(0)), 2)
    )
    hashes = {r.i: r.g for r in grams.collect()}
    for r in out.collect():
        g = hashes[r.i]
        rank = [x & ~((1 << 31) - 1) for x in g]
        spans = [range(k, k + 4) for k in range(len(g) - 3)] or ([range(len(g))] if g else [])
        want = sorted({max(s, key=lambda i: (-rank[i], i)) for s in spans})
        assert r.p == want and r.h == [g[i] for i in want]


# --- licenses ---------------------------------------------------------------------


def test_licenses_are_found(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(300)]
    rows, want = [], set()
    for i in range(60):
        text = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        for name, notice in rng.sample(licenses.TEMPLATES, rng.randrange(3)):
            text += notice.upper().split() if i % 2 else notice.split()
            text += [rng.choice(vocab) for _ in range(100)]
            want.add((i, name))
        rows.append((i, " ".join(text)))
    long = licenses.TEMPLATES[4][1]
    rows += [(100, long.replace("merge", "blend")), (101, " ".join(long.split()[:30])), (None, None), (102, ""), (103, "mit license")]
    want.add((100, "MIT"))
    docs = spark.createDataFrame(rows + rows[:4], "doc_id long, text string").repartition(3)
    found = licenses.scan_licenses(docs)
    assert native(found)
    got = found.collect()
    assert {(r.doc_id, r.license) for r in got} == want
    assert all(0.8 <= r.containment <= 1 and r.start_word < r.end_word for r in got)
    assert licenses.scan_licenses(edge_docs(spark)).collect() == licenses.scan_licenses(no_docs(spark)).collect() == []
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, [("short", "two words")])


def places_by_hand(words, templates):
    """Licenses with a place in a text, by plain Python: every window that holds enough, then the contest."""
    found = []
    for name, notice in templates:
        pattern = re.compile(licenses.TELLING.get(name, ""))
        told = [w.strip('.,;:()"').lower() for w in re.sub(r"and/or", "and or", notice).split()]
        told = [w for w in told if w]
        m = len(told) - 4
        wanted = {tuple(told[i : i + 5]) for i in range(m)}
        for i in range(max(1, len(words) - len(told) + 1)):
            some = words[i : i + len(told)]
            have = wanted & {tuple(some[k : k + 5]) for k in range(len(some) - 4)}
            if 100 * len(have) >= 80 * len(wanted) and pattern.search(" ".join(some)):
                found.append((name, i, i + len(some), len(have), len(have) / len(wanted)))
    best = {name for name, *_ in found}
    for name, a, b, n, share in found:
        for other, c, d, k, closer in found:
            rank, mine = (k, closer), (n, share)
            if other != name and 2 * (min(b, d) - max(a, c)) >= min(b - a, d - c) and rank > mine:
                best.discard(name)
    return best


def test_licenses_of_like_wording_are_told_apart(spark):
    gpl = dict((n, t) for n, t in licenses.TEMPLATES)  # the longer notice of each
    changed = gpl["GPL-3.0"].replace("version 3", "version 1")
    opening = gpl["BSD"]
    cases = [(name, gpl[name]) for name in gpl]
    cases += [
        (None, changed),  # a version that no template has
        (None, gpl["GPL-3.0"].replace("GNU General", "GNU Simple General")),
        (None, gpl["CC-BY-4.0"].replace("4.0", "2.0")),
        (None, gpl["MPL-1.1"].replace("1.1", "1.0")),
        (None, "Licensed under the Academic Free License version 3.0"),
        (None, "This package is distributed under the same terms as the language itself, see the file COPYING for details."),
        ("BSD", opening + " whatever comes next is up to you and your own lawyers"),
    ]
    rows = [(i, " ".join([f"w{i}x{k}" for k in range(30)] + text.split() + ["end"] * 9)) for i, (_, text) in enumerate(cases)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert native(got)
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert found == {i: {name} for i, (name, _) in enumerate(cases) if name}
    # plain Python agrees
    for i, text in rows:
        words = [w for w in (x.strip('.,;:()"').lower() for x in text.replace("and/or", "and or").split()) if w]
        assert places_by_hand(words, licenses.TEMPLATES) == found.get(i, set()), cases[i]


def test_licenses_beside_each_other_are_both_found(spark):
    text = dict(licenses.TEMPLATES)
    both = text["GPL-2.0"] + " " + text["LGPL-3.0"] + " " + text["MIT"] + " " + text["BSD-3-Clause"]
    got = licenses.scan_licenses(spark.createDataFrame([(1, both), (None, both)], "doc_id long, text string")).collect()
    for key in (1, None):
        assert [r.license for r in sorted(got, key=lambda r: r.start_word) if r.doc_id == key] == [
            "GPL-2.0", "LGPL-3.0", "MIT", "BSD-3-Clause",
        ]


# --- toxicity ----------------------------------------------------------------------


def letter_model():
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    for word, n in (("stupid", 9), ("loser", 9), ("moron", 9), ("the", 90), ("and", 50), ("those", 20), ("noble", 9)):
        at = [0, 0, *map(toxicity.symbol, word), 0]
        for a, b, c in zip(at, at[1:], at[2:], strict=False):
            counts[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += n
    return toxicity.LetterModel(counts)


@pytest.mark.parametrize(
    "token, word",
    [("l0s3r", "loser"), ("m0r0n!!", "moron"), ("s.t.u.p.i.d", "stupid"), ("stuuupid", "stupid"), ("$tup1d", "stupid"),
     ("l00000ser", "loser"), ("those,", "those"), ("...", ""), ("", ""), ("stupid", "stupid")],
)
def test_channel_is_undone(token, word):
    assert letter_model().word(token) == word


def test_single_characters_in_a_row_are_one_token():
    coded, owner = toxicity._tokens(pa.array(["a l o s e r b word x y", "q", None, "a b c"]))
    tokens = Counter(zip(owner.tolist(), (coded.dictionary[i].as_py() for i in coded.indices.to_pylist()), strict=True))
    assert tokens[0, "aloserb"] == 1 and tokens[3, "abc"] == 1 and tokens[0, "xy"] == 0


def test_doubled_letters_and_spaced_words_are_read():
    model = letter_model()
    for token, word in (("stuupid", "stupid"), ("mooron", "moron"), ("lloser", "loser")):
        assert model.readings(token) == [token, word]
    assert model.readings("stupid") == ["stupid"]

    def read(text):
        coded, _ = toxicity._tokens(pa.array([text]))
        return {w for x in coded.dictionary.to_pylist() for w in model.readings(x)}

    assert "moron" in read("you are a m o r o n")
    assert "loser" in read("those: l o s e r.")
    assert {"stupid", "moron"} <= read("s t u p i d m o r o n!")


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(got[r.doc_id], r.toxic) for r in labels if got[r.doc_id].held_out]
    assert len(got) == 1000 and len(held) > 80
    assert sum(r.predicted for r, toxic in held if not toxic) <= 1
    assert sum(r.predicted for r, toxic in held if toxic) >= 0.7 * sum(t for _, t in held)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_every_sure_word_of_a_long_tail_is_learned(spark):
    rng = random.Random(8)

    def invented(size):
        return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(size))

    plain, insults = [invented(3) for _ in range(400)], sorted({"qu" + invented(3) for _ in range(150)})
    docs, marks = [], []
    for k, word in enumerate(insults * 24):
        docs.append((2 * k, " ".join(rng.choices(plain, k=12) + [word])))
        docs.append((2 * k + 1, " ".join(rng.choices(plain, k=12))))
        marks += [(2 * k, 1), (2 * k + 1, 0)]
    # an id that many rows repeat counts once
    docs += [(0, docs[0][1])] * 50
    table, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    some = toxicity._labelled(table, labels, 10_000).collect()
    assert len(some) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in marks)
    # each word marks under 1 % of the toxic texts; ten that can be learned from suffice
    ready = [sum(zlib.crc32(str(2 * k).encode()) % 3 != 1 for k in range(w, 24 * len(insults), len(insults))) for w in range(len(insults))]
    got = toxicity.toxicity_scores(table, labels).where("held_out").collect()
    assert not any(r.predicted for r in got if r.doc_id % 2) and len(got) > 2000
    known = [r for r in got if r.doc_id % 2 == 0 and ready[r.doc_id // 2 % len(insults)] >= 10]
    assert len(known) > 1000 and all(r.predicted for r in known)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame(
        [(1, 0, 1), (7, 1, 0), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int"
    )
    got = toxicity.toxicity_scores(edge_docs(spark), labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert toxicity.toxicity_scores(no_docs(spark), labels).collect() == []
    assert toxicity.toxicity_scores(edge_docs(spark), labels.where("false")).where("predicted = 1").count() == 0


# --- pipeline -----------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = [(i, t, f"s{i % 3}", 1, "p", len(t), "b") for i, t in random_docs(41, 200)] + edge_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_copies", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.frozen(stage(spark, docs, ""), f"test-{name}")
        assert docs.columns == columns
    left = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert left and pieces.where("start = 0").count() == left


def test_pipeline_of_no_rows(spark):
    import corpus_pipeline

    docs = no_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.frozen(stage(spark, docs, ""), "test-none")
    assert docs.collect() == []
