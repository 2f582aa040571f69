"""Token ids by the tokenizers library, each word encoded once and remembered.

The vocabulary file's tokenizer folds white space, lowers, and cuts a text into words that it encodes each by
itself, so a text's ids are its words' ids one after the other. Texts of Latin letters, digits and marks are
lowered and cut here, and a word that is new goes to the library's model by itself, without its slow
normaliser and pre-tokeniser. Of any other text, runs between white space with another character or a special string go through the
whole tokenizer (special strings hold no white space).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

from tracelake.llm.bpe import _SEPARATORS, _SPACE, PLAIN, Memo, byte_symbols

def _in_class(kind: str) -> str:
    """The plain characters of a general category, for use within square brackets."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c)).startswith(kind))


class LibraryIds:
    """``memo_size``: words remembered, in each of two generations; the older one goes as a whole."""

    def __init__(self, path: str, memo_size: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        for name, characters in ((r"\p{L}", _in_class("L")), (r"\p{N}", _in_class("N")), (r"\s", "\t-\r \x85\xa0")):
            pattern = pattern.replace(name, characters)
        letters = f"[{_in_class('L')}]+"
        pattern = "|".join([letters, pattern.replace(f"|{letters}", "", 1)])  # the usual case first; no other branch begins with a letter
        self.words = re.compile(pattern).findall
        self.tokenize = self.tokenizer.model.tokenize
        self.bytes_of = [k.to_bytes(4, "little") for k in range(max(spec["model"]["vocab"].values()) + 1)]
        self.as_symbols = dict(enumerate(byte_symbols()))
        self.memo = Memo(self._ids_of, memo_size)

    @staticmethod
    def _whole(run: str) -> bool:
        """Whether a run between white space has to go through the whole tokenizer."""
        if "<|" in run:
            return True
        if run.isascii():
            return False
        if len(run) > 500 and np.frombuffer(run.encode("utf-32-le"), "<u4").max() < 0x180:  # a long text's usual case, at once
            return False
        return not PLAIN(run)

    def _split(self, text: str) -> list[str]:
        """The text's words, lowered; runs for the whole tokenizer as they are."""
        if not self._whole(text):
            return self.words(text.lower())
        runs = [c for c in _SPACE.split(text) if c] if _SEPARATORS.search(text) else text.split()
        return [w for c in runs for w in ((c,) if self._whole(c) else self.words(c.lower()))]

    def _ids_of(self, word: str) -> bytes:
        if not (word.isascii() and word.isalnum()):
            if self._whole(word):
                return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            word = word.encode("utf-8").decode("latin-1").translate(self.as_symbols)
        of = self.bytes_of
        return b"".join([of[token.id] for token in self.tokenize(word)])

    def packed(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, without added special tokens."""
        of = self.memo.__getitem__
        return [b"".join(map(of, self._split(t))) for t in texts]


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    """One per worker process, with its memo."""
    return LibraryIds(path)
