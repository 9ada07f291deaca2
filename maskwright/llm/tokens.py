"""Token ids of whole texts by a `tokenizers` file, with a word cache for the BPE that ends words.

The vocabulary's pre-tokenizer cuts a text into words that are encoded one by one and never hold white space, so the ids of
a text are the ids of its white-space-separated chunks in order. WordIds asks the tokenizer once for each new chunk and
gathers the rest from arrays. Only texts made of characters whose normal form, lower case and class are plain take this
way; any other text goes to the tokenizer whole.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import repeat

import numpy as np

from maskwright.llm.common import worker_cache

#: Characters that the word cache treats itself: printable ASCII, its white space, and Latin letters and signs but for those
#: that a tokenizer's normalizer changes in a way of its own (no-break space, soft hyphen, dotted capital I).
_PLAIN = [chr(c) for c in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC) if c not in (0xAD, 0x130)]
_LETTERS = re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N"))
_ASCII_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f]|<\\|")
_ODD = re.compile("[^" + re.escape("".join(_PLAIN)) + "]|<\\|")  # the latter: special tokens
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class WordIds:
    """encode(texts) -> (ids of all texts in a row, number of ids of each)."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.words_end = bool(self.last.any())
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.seen)
        while at + len(words) > len(self.start):
            self.start, self.size = np.concatenate((self.start, self.start)), np.concatenate((self.size, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at : at + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + len(words)] = sizes
        self.used += len(ids)
        self.seen.update(zip(words, range(at, at + len(words))))

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the coded chunks in a row, size of each)."""
        size = self.size[codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[codes] - (ends - size), size) + np.arange(total)], size

    def _learn(self, words: list[str]) -> None:
        # letters and one sign after them are two words to the pre-tokenizer: only the letters are asked for, once
        stems = {w: (w[:-1], w[-1]) for w in words if len(w) > 1 and not w[-1].isalpha() and w[:-1].isalpha()}
        plain = dict.fromkeys(x for w in words for x in stems.get(w, (w,)) if x not in self.seen)
        if plain:
            asked = list(plain)
            ids = self._whole(" ".join(asked))
            ends = np.nonzero(self.last[ids])[0] + 1  # of the pre-tokenizer's words
            inner = np.cumsum([1 if w.isalpha() else len(_WORD.findall(w)) for w in asked])
            if len(ends) == inner[-1]:
                self._add(asked, ids, np.diff(ends[inner - 1], prepend=0))
            else:  # not the vocabulary this shortcut was made for
                parts = [self._whole(w) for w in asked]
                self._add(asked, np.concatenate(parts), np.array([len(p) for p in parts]))
        if stems:
            ids, sizes = self._gather(np.array([self.seen[x] for w in stems for x in stems[w]]))
            self._add(list(stems), ids, sizes.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        counts, odd = np.zeros(len(texts), np.int64), {}
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.words_end or (_ASCII_ODD if t.isascii() else _ODD).search(t):
                odd[i] = self._whole(t)
                continue
            found = t.lower().split()
            counts[i] = len(found)
            words += found
        if len(self.seen) > self.limit:
            self._clear()
        codes = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        miss = np.nonzero(codes < 0)[0]
        if len(miss):
            new = [words[i] for i in miss.tolist()]
            self._learn(list(dict.fromkeys(new)))
            codes[miss] = [self.seen[w] for w in new]
        flat, size = self._gather(codes)
        ends = np.cumsum(size)
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        lengths = np.diff(at)
        if odd:
            parts = [odd.get(i, flat[at[i] : at[i + 1]]) for i in range(len(texts))]
            flat, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
        return flat, lengths


def coder(path: str) -> WordIds:
    """This process's coder of a file: a Python worker keeps its word cache from task to task."""
    coders = worker_cache("tokens")
    if path not in coders:
        coders[path] = WordIds(path)
    return coders[path]
