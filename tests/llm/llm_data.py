"""Small document tables: random texts with copies, and rows that try the edges."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size long, part string, n_chars long, bucket string"


def words(text):
    return WORD.findall(text or "")


def random_docs(seed, n=120, vocabulary=400):
    """(doc_id, text): random prose, near copies, shared passages, repeated lines."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéßnorst") for _ in range(rng.randrange(1, 8))) for _ in range(vocabulary)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    lines = [" ".join(rng.choice(vocab) for _ in range(9)) for _ in range(5)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.25 and texts:
            own = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own))
            continue
        own = [rng.choice(vocab) for _ in range(rng.choice([2, 4, 8, 20, 60, 150]))]
        text = " ".join(w + rng.choice(["", "", "", ",", ".", "\n"]) for w in own)
        if kind > 0.8:
            text += "\n" + "\n".join(lines) + "\n" + rng.choice(vocab)
        elif kind > 0.6:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        texts.append(text)
    return list(enumerate(texts))


def edge_rows():
    """Missing ids, texts and sources, empty and long texts, repeated rows, one id twice."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(6000))
    rows = [
        (1, "One two three four five six seven eight nine ten eleven twelve.", "b"),
        (1, "One two three four five six seven eight nine ten eleven twelve.", "b"),
        (2, None, "b"),
        (3, "", "a"),
        (4, " \n\t\r ", None),
        (5, "word", "a"),
        (6, "a " * 300, "a"),
        (7, long, "c"),
        (8, long + " tail", None),
        (8, "another text of the same id, with enough words to stand alone here", "b"),
        (None, "a text without an id that has some words of its own to keep", "a"),
        (None, None, None),
        (9, "line one here\nline two here\nline three here\nline four here\nend", "a"),
        (10, "start\nline one here\nline two here\nline three here\nline four here", "a"),
        (11, "日本語のテキスト、これは空白がない長い文です。" * 30, "ä"),
        (12, "\u0000 odd\u000bspaces\u0085 and more of them", "a"),
    ]
    return [(i, t, s, 7, "x", None if t is None else len(t), "y") for i, t, s in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
