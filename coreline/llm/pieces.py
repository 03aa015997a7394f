"""Token ids of whole texts through a cache of word pieces.

Byte-pair vocabularies split a text into words first and never join across
them, so a text's ids are the ids of its words in a row, and a word has to be
tokenized once for each worker.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cutting before a space is safe only behind a character that is no white space.
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
_CUT = re.compile(r"(?<=\S)(?= )")
#: Letters followed by punctuation are two words in either vocabulary.
_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,!?;:#$%&*]*)$"
_JOINED = 500


class PieceEncoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Made for the two usual kinds of byte-pair vocabulary: those where a space
    belongs to the word behind it, and those that drop white space and mark the
    ends of words.  ``most_chars`` bounds the cache; a full cache starts anew.
    """

    def __init__(self, path: str, most_chars: int = 8_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_chars = most_chars
        self.spaced = bool(self.tokenizer.encode(" ", add_special_tokens=False).ids)
        size = self.tokenizer.get_vocab_size()
        self.first = np.zeros(size, bool)
        self.last = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.first[i] = token.startswith("Ġ")
            self.last[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        #: the empty piece is number 0
        self.slot: dict[str, int] = {"": 0}
        self.chars = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _store(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add pieces whose ids lie end to end."""
        n, have = len(keys), len(self.slot)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while have + n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[have : have + n] = self.used + np.cumsum(lengths) - lengths
        self.length[have : have + n] = lengths
        self.slot.update(zip(keys, range(have, have + n), strict=True))
        self.used += len(ids)
        self.chars += sum(map(len, keys))

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters only, many in one call; each is one token group."""
        for at in range(0, len(words), _JOINED):
            some = words[at : at + _JOINED]
            text = "".join(some) if self.spaced else " ".join(some)
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            if self.spaced:
                cuts = np.flatnonzero(self.first[ids])[1:]
            else:
                cuts = np.flatnonzero(self.last[ids])[:-1] + 1
            if len(cuts) + 1 == len(some):
                self._store(some, ids, np.diff(np.concatenate([[0], cuts, [len(ids)]])))
            else:
                self._learn_any(some)

    def _learn_any(self, keys: list[str]) -> None:
        for at in range(0, len(keys), _JOINED):
            some = keys[at : at + _JOINED]
            found = [one.ids for one in self.tokenizer.encode_batch(some, add_special_tokens=False)]
            flat = np.array([i for ids in found for i in ids], np.uint32)
            self._store(some, flat, np.array([len(ids) for ids in found], np.int64))

    def _slots(self, keys: list[str], learn) -> np.ndarray:
        if missing := [k for k in dict.fromkeys(keys) if k not in self.slot]:
            learn(missing)
        return np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))

    def _two_slots(self, pieces: pa.Array) -> np.ndarray:
        """Two numbers for each distinct piece, of its word and of what follows the word."""
        cut = pc.extract_regex(pieces, _PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(pieces), 2), np.int64)
        word = pc.struct_field(cut, "word").filter(cut.is_valid())
        space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        word = pc.binary_join_element_wise(space, word, nothing) if self.spaced else pc.utf8_lower(word)
        for column, values, learn in (
            (0, word, self._learn_words),
            (1, pc.struct_field(cut, "tail").filter(cut.is_valid()), self._learn_any),
        ):
            coded = values.dictionary_encode()
            numbers = self._slots(coded.dictionary.to_pylist(), learn)
            out[plain, column] = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        rest = pieces.filter(pa.array(~plain)).to_pylist()
        out[~plain, 0] = self._slots([" " + x for x in rest] if self.spaced else rest, self._learn_any)
        return out

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, two for each, and how many each text has."""
        if not self.spaced:
            # white space is dropped, so that a line end parts words as a space does
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        slots = self._two_slots(coded.dictionary)[codes]
        if self.spaced:
            # the first piece of a text has no space before it
            heads = np.cumsum(counts) - counts
            slots[heads, 0] = self._slots(coded.dictionary.take(pa.array(codes[heads])).to_pylist(), self._learn_any)
            slots[heads, 1] = 0
        return slots.reshape(-1), 2 * counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text (none for NULL)."""
        if self.chars > self.most_chars:
            self._clear()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = np.zeros(len(texts), bool)
        if self.spaced:
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            slots, counts = self._pieces(texts)
        else:
            rows: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
            if not odd.all():
                plain, sizes = self._pieces(texts.filter(pa.array(~odd)))
                for i, part in zip(np.flatnonzero(~odd), np.split(plain, np.cumsum(sizes)[:-1]), strict=True):
                    rows[i] = part
            for i in np.flatnonzero(odd):
                rows[i] = self._slots(_CUT.split(texts[int(i)].as_py()), self._learn_any)
            slots = np.concatenate(rows)
            counts = np.array([len(r) for r in rows], np.int64)
        start, length = self.start[slots], self.length[slots]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(start - (ends - length), length)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[take], np.diff(edges)


_KEPT: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker and vocabulary, kept between tasks."""
    # Spark runs one task a core; the library's own threads would only compete with them
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _KEPT:
        _KEPT[path] = PieceEncoder(path)
    return _KEPT[path]
