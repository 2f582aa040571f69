"""Byte-pair encoding over a ``tokenizers`` vocabulary file, written out.

A word is a doubly linked list of symbols. A heap holds the ranks of adjacent pairs; the lowest rank
(leftmost first) is merged, its two new neighbours are pushed, and entries whose symbols have changed
since are skipped when popped. Each word is worked out once and remembered in a bounded memo.

Folding and cutting into words are done here for Latin letters, digits and marks, whose tables are the same in every version of
Unicode. Runs between white space with any other character are folded and cut by the library's own normaliser and pre-tokeniser; merging is always done here.
"""

from __future__ import annotations

import json
import re
import os
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex

_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Characters whose class, lower case and normal form are the same by every version of the Unicode tables:
#: up to Latin Extended-A, and the marks from hyphen to hyphenation point.
PLAIN = re.compile("[\0-\u017f\u2010-\u2027]*").fullmatch
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """A function's results by argument: two generations of at most ``size`` entries each."""

    def __init__(self, function, size: int = 100_000):
        super().__init__()
        self.function, self.size, self.old = function, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """The vocabulary file's tokenizer: NFC, white space folded, lower case, split into words, merged.

    ``count(text)`` gives the number of tokens without forming ids; ``packed(text)`` the ids as
    little-endian unsigned 32-bit integers; ``decode(ids)`` the text of ids.
    """

    def __init__(self, path: str, memo: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        # by word as it is written here, by the library's word of stand-ins, and by run between white space
        self._count_of_word, self._ids_of_word = Memo(lambda w: self._count_word(self._stand_ins(w)), memo), Memo(lambda w: self._ids_word(self._stand_ins(w)), memo)
        self._count_of_cut, self._ids_of_cut = Memo(self._count_word, memo), Memo(self._ids_word, memo)
        self._count_of_chunk = Memo(lambda c: sum(self._each(c, self._count_of_word, self._count_of_cut)), memo)
        self._ids_of_chunk = Memo(lambda c: b"".join(self._each(c, self._ids_of_word, self._ids_of_cut)), memo)

    def _stand_ins(self, word: str) -> str:
        """A stand-in for each byte; printable ones of ASCII are their own."""
        return word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode("utf-8")])

    def _each(self, chunk: str, of_word: Memo, of_cut: Memo):
        """What a memo has of each word of a run without white space."""
        if chunk.isascii():
            return map(of_word.__getitem__, self.words(chunk.lower()))
        if PLAIN(chunk):
            return map(of_word.__getitem__, self.words(unicodedata.normalize("NFC", chunk).lower()))
        return (of_cut[word] for word, _ in self.cut(self.normalize(chunk)))

    def _chunks(self, text: str) -> list[str]:
        return [c for c in _SPACE.split(text) if c] if _SEPARATORS.search(text) else text.split()

    def _parts(self, text: str) -> list[str]:
        """The text, special strings on their own at odd places."""
        return self.specials.split(text) if self.specials and "<|" in text else [text]

    def start_symbols(self, word: str) -> list[str]:
        symbols = list(word)
        symbols[-1] += self.end
        return symbols

    def merged(self, word: str) -> tuple[list[str], list[int], int]:
        """The linked list after all merges: symbols, next places (the first symbol stands at 0), merges made."""
        symbols = self.start_symbols(word)
        n, rank = len(symbols), self.ranks.get
        following, before, version = [*range(1, n), -1], [*range(-1, n - 1)], [0] * n
        heap = [(r, i, 0, 0) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heappop(heap)
            j = following[i]
            if j < 0 or version[i] != left or version[j] != right:
                continue
            symbols[i] += symbols[j]
            version[i] += 1
            version[j] = -1
            following[i] = k = following[j]
            following[j] = -1
            merges += 1
            if k >= 0:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i, version[i], version[k]))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h, version[h], version[i]))
        return symbols, following, merges

    def _count_word(self, word: str) -> int:
        return len(word) - self.merged(word)[2]

    def _ids_word(self, word: str) -> bytes:
        symbols, following, _ = self.merged(word)
        ids, i = [], 0
        while i >= 0:
            ids.append(self.vocab[symbols[i]])
            i = following[i]
        return np.array(ids, "<u4").tobytes()

    def count(self, text: str) -> int:
        """Initial symbols minus merges; a special string counts one."""
        of = self._count_of_chunk.__getitem__
        return sum(k % 2 or sum(map(of, self._chunks(part))) for k, part in enumerate(self._parts(text)))

    def packed(self, text: str) -> bytes:
        of = self._ids_of_chunk.__getitem__
        return b"".join(np.uint32(self.special[p]).tobytes() if k % 2 else b"".join(map(of, self._chunks(p))) for k, p in enumerate(self._parts(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The ids' vocabulary strings one after the other; the file names no decoder, so the library puts a space between them."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per worker process, with its memo."""
    return WordBpe(path)
