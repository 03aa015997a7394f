"""Toxicity scores of texts restored by a noisy-channel decoder.

The channel hides letters: digits and signs for letters (leetspeak), signs or
single spaces between letters, letters repeated.  For every token that shows a
trace of it (a doubled letter is one; such a word also counts as it is), a lattice holds the readings of each character, and Viterbi decoding
finds the likeliest letters under a character trigram model.  That model is
counted over the words of all documents.

Restored words and their beginnings are the features of a text.  Those that mark
toxic texts are chosen by a likelihood ratio on labelled rows, weighted by a
logistic regression, and summed over a whole text; one feature that nearly always
marks a toxic text is enough for a high score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coreline.llm.common import bounded_batches, slices, words_of

BATCH_BYTES = 4 << 20
#: Labelled rows that are learned from, at most (those with the smallest hash of their id).
MOST_LABELLED = 8_000
#: Least likelihood ratio of a feature, as a chi-square.
LEAST_RATIO = 12.0
#: A feature that marks toxic texts alone in this share and so many of them sets a floor.
SURE, SURE_TEXTS = 0.95, 8
BUCKETS = 1 << 20

#: Symbols of the letter model: 0 a word's edge, 1-26 a-z, 27-62 other letters, 63 the rest.
SYMBOLS = 64
_EDGES = ".,;:!?\"'()[]{}<>…«»“”‘’"
#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y",
}
#: Signs that may stand between letters.
SPACING = "._-*~'`^:/\\ ,·•"
_SIGN, _SKIP, _REPEAT, _LITERAL = math.log(0.2), math.log(0.3), math.log(0.3), math.log(0.02)
_THRICE = re.compile(r"(.)\1\1")
_TWICE = re.compile(r"(.)\1")


def symbol(letter: str) -> int:
    if "a" <= letter <= "z":
        return ord(letter) - 96
    return 27 + ord(letter) % 36 if letter.isalpha() else 63


class LetterModel:
    """Log probabilities of a letter behind two others, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        flat = (one + 1) / (one.sum() + SYMBOLS)
        pairs = (two + 2 * flat) / (two.sum(axis=1, keepdims=True) + 2)
        triples = (three + 2 * pairs) / (three.sum(axis=2, keepdims=True) + 2)
        self.log = np.log(triples)
        self.seen: dict[str, str] = {}

    def restore(self, token: str, cut: bool = False) -> str:
        """The likeliest letters behind a lower-case token; "" if there are none.

        With ``cut`` they may be several words, with a space between them.
        """
        best: dict[tuple[int, int], tuple[float, str | None, tuple | None]] = {(0, 0): (0.0, None, None)}
        log = self.log
        for char in token:
            readings = [(x, _SIGN) for x in LEET.get(char, "")]
            if char.isalpha():
                readings.append((char, 0.0))
            elif char not in SPACING:
                readings.append((char, _LITERAL))
            after: dict[tuple[int, int], tuple] = {}
            for (a, b), (score, last, path) in best.items():
                for letter, cost in readings:
                    c = symbol(letter)
                    new = score + cost + log[a, b, c]
                    if (b, c) not in after or after[b, c][0] < new:
                        after[b, c] = (new, letter, (letter, path))
                    if letter == last:
                        new = score + cost + _REPEAT
                        if (a, b) not in after or after[a, b][0] < new:
                            after[a, b] = (new, last, path)
                if char in SPACING:
                    new = score + _SKIP
                    if (a, b) not in after or after[a, b][0] < new:
                        after[a, b] = (new, last, path)
            if cut:
                for (a, b), (score, last, path) in list(after.items()):
                    new = score + log[a, b, 0]
                    if path is not None and last != " " and ((0, 0) not in after or after[0, 0][0] < new):
                        after[0, 0] = (new, " ", (" ", path))
            best = after
        path = max(((score + log[a, b, 0], path) for (a, b), (score, _, path) in best.items()), key=lambda x: x[0])[1]
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def word(self, token: str) -> str:
        """The word that a lower-case token stands for."""
        core = token.strip(_EDGES)
        if core.isalpha() and not _THRICE.search(core):
            return core
        if core not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[core] = self.restore(core)
        return self.seen[core]

    def readings(self, token: str) -> list[str]:
        """Words that a token of :func:`_tokens` may stand for.

        A word with a doubled letter is read as it is and as decoded, a row of single
        characters as the words it can be cut into, and whole without an "a" or "i"
        at its ends.
        """
        if " " in token:
            if token not in self.seen:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                self.seen[token] = self.restore(token.replace(" ", ""), cut=True)
            run = token.replace(" ", "")
            ends = {run[i : len(run) - j] for i in (0, run[0] in "ai") for j in (0, run[-1] in "ai")} - {run}
            words = [*self.seen[token].split(), *(w for x in sorted(ends) for w in self.readings(x))]
        else:
            words = [self.word(token)]
            if words[0].isalpha() and _TWICE.search(words[0]):
                key = f"{words[0]} "
                if key not in self.seen:
                    if len(self.seen) > 200_000:
                        self.seen.clear()
                    self.seen[key] = self.restore(words[0])
                words.append(self.seen[key])
        return list(dict.fromkeys(words))


def features(word: str) -> list[int]:
    """Numbers of a word and of its beginnings of four to six letters."""
    names = [f"={word}"] + [f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n] if word else []
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def _tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Distinct lower-case tokens of some texts, as codes with each code's text.

    Three or more tokens of one character in a row, punctuation at their edges
    aside, also count as one token, and once more with spaces between them.
    """
    words, counts = words_of(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    owner = np.repeat(np.arange(len(texts)), counts)
    core = pc.utf8_trim(words, _EDGES)
    core = pc.if_else(pc.equal(pc.utf8_length(core), 0), words, core)
    single = pc.equal(pc.utf8_length(core), 1).to_numpy(zero_copy_only=False)
    start = single.copy()
    start[1:] &= ~(single[:-1] & (owner[1:] == owner[:-1]))
    run = np.cumsum(start) - 1
    where = np.flatnonzero(single)
    joined, of = [], []
    if len(where):
        sizes = np.bincount(run[where])
        long = sizes[run[where]] >= 3
        letters = core.take(pa.array(where[long])).to_pylist()
        at = 0
        for r in np.unique(run[where[long]]):
            joined += ["".join(letters[at : at + sizes[r]]), " ".join(letters[at : at + sizes[r]])]
            at += sizes[r]
        of = np.repeat(owner[np.flatnonzero(start)[np.unique(run[where[long]])]], 2)
    if joined:
        words = pa.concat_arrays([words, pa.array(joined, pa.large_string())])
        owner = np.concatenate([owner, of])
    return words.dictionary_encode(), owner


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Letter trigrams of the words of all documents; at most ``SYMBOLS`` cubed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3)
        code = np.full(0x110000, 63, np.int64)
        code[97:123] = np.arange(1, 27)
        for point in range(0xAA, 0x2000):
            code[point] = symbol(chr(point))
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                words, _ = words_of(pc.utf8_lower(pc.fill_null(batch.column("text"), "").cast(pa.large_string())))
                found = pc.utf8_trim(words, _EDGES).value_counts()
                word, times = found.field("values"), found.field("counts").to_numpy()
                plain = pc.utf8_is_alpha(word).to_numpy(zero_copy_only=False)
                word, times = word.filter(pa.array(plain)), times[plain]
                if not len(times):
                    continue
                size = pc.utf8_length(word).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                ends = np.cumsum(size)
                points = np.frombuffer("\0".join(word.to_pylist()).encode("utf-32-le") + b"\0\0\0\0", np.uint32)
                letters = np.where(points == 0, 0, code[points])
                begin = np.repeat(ends - size, size)
                at = np.arange(len(letters))
                before = np.where(at - 1 >= begin, letters[at - 1], 0)
                earlier = np.where(at - 2 >= begin, letters[at - 2], 0)
                total += np.bincount((earlier * SYMBOLS + before) * SYMBOLS + letters, np.repeat(times, size), SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, toxic`` of labelled rows that may be learned from, ``most`` at most.

    Of rows that repeat a doc_id, the least text counts, so no id brings more than one.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def learn(labelled: DataFrame, model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Chosen feature numbers in rising order, their weights, their floors, and the base.

    Chosen is what is likelier in toxic texts and whose likelihood ratio, as a
    chi-square, passes ``LEAST_RATIO``; a logistic regression weighs it.  Neither the
    rank nor the share of a feature counts, so a rare word passes once enough texts
    bear it out, however many others there are.  The
    floor of a feature that nearly always marks a toxic text (``SURE``, in
    ``SURE_TEXTS`` of them at least) is the share in which it does; others have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                coded, owner = _tokens(batch.column("text"))
                lists = [[f for w in model.value.readings(x) for f in features(w)] for x in coded.dictionary.to_pylist()]
                codes = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(1, batch.num_rows))
                rows = []
                for part in np.split(codes[order], cuts):
                    rows.append(np.array(sorted({f for c in np.unique(part) for f in lists[c]}), "<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.binary()), batch.column("toxic").cast(pa.int64())], ["features", "toxic"]
                )

    rows = labelled.mapInArrow(run, "features binary, toxic long").toArrow()
    sets = [np.frombuffer(x.as_buffer(), "<u4") for x in rows["features"]]
    toxic = np.array([t.as_py() > 0 for t in rows["toxic"]], bool)
    if not toxic.any() or toxic.all():
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 6.0 if toxic.any() else -6.0
    # texts of the same words are one observation
    _, once = np.unique([zlib.crc32(x.tobytes()) for x in sets], return_index=True)
    sets, toxic = [sets[i] for i in once], toxic[once]
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    bad = np.bincount(flat[toxic[row]], minlength=BUCKETS).astype(float)
    good = np.bincount(flat[~toxic[row]], minlength=BUCKETS).astype(float)
    n_bad, n_good = float(toxic.sum()), float((~toxic).sum())
    rate = (bad + good) / (n_bad + n_good)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(bad * np.log(bad / (n_bad * rate)) + np.where(good > 0, good * np.log(good / (n_good * rate)), 0))
    share = (bad + n_bad / (n_bad + n_good)) / (bad + good + 1)
    chosen = np.flatnonzero((bad / n_bad > good / n_good) & (2 * ratio > LEAST_RATIO))
    inside = np.isin(flat, chosen)
    x, r = np.searchsorted(chosen, flat[inside]), row[inside]
    many = np.maximum(1, np.bincount(x, minlength=len(chosen)))
    weights, base = np.zeros(len(chosen)), math.log(n_bad / n_good)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(base + np.bincount(r, weights[x], len(toxic)), -30, 30)))
        error = toxic - p
        gain = np.bincount(x, error[r], len(chosen)) / many - 2e-3 * weights
        weights = np.maximum(weights + 0.25 * gain, 0)
        base += 0.5 * float(error.mean())
    sure = (share >= SURE) & (bad >= SURE_TEXTS)
    return chosen, weights, np.where(sure, share, 0)[chosen], base


def toxicity_scores(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, limit: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Only the text goes into a score.  Labels are learned from rows of ``labels``
    whose crc32(doc_id as text) mod 3 is not 1, at most ``most_labelled`` of them;
    the letter model counts the words of all documents.  ``predicted`` is 1 from a
    score of ``limit`` on.

    A NULL or empty text has the score of a text without any telling word.  Rows
    are scored alone: repeated rows get the same score, a NULL doc_id is kept and not
    held out.  Where several labels name a document, the highest counts; without
    toxic labels to learn from, every score is low.
    """
    spark = bounded_batches(docs).sparkSession
    model = spark.sparkContext.broadcast(LetterModel(letter_counts(docs)))
    learned = spark.sparkContext.broadcast(learn(_labelled(docs, labels, most_labelled), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights, floors, base = learned.value
        known: dict[str, list[int]] = {}
        number = {int(f): i for i, f in enumerate(chosen)}
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                coded, owner = _tokens(batch.column("text"))
                if len(known) > 1_000_000:
                    known.clear()
                lists = []
                for token in coded.dictionary.to_pylist():
                    found = known.get(token)
                    if found is None:
                        found = [number[f] for w in model.value.readings(token) for f in features(w) if f in number]
                        known[token] = found
                    lists.append(found)
                size = np.array([len(x) for x in lists], np.int64)
                codes = coded.indices.to_numpy(zero_copy_only=False)
                telling = np.flatnonzero(size[codes]) if len(codes) else codes
                pairs = {(int(owner[t]), f) for t in telling for f in lists[codes[t]]}
                total, least = np.full(batch.num_rows, base), np.zeros(batch.num_rows)
                for i, f in sorted(pairs):
                    total[i] += weights[f]
                    least[i] = max(least[i], floors[f])
                score = np.maximum(1 / (1 + np.exp(-np.clip(total, -30, 30))), least)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        _held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )
