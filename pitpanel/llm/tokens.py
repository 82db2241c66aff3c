"""Encoding whole texts with the ``tokenizers`` library, word by word.

A byte-level BPE never merges over the edges of its pre-tokens, so the ids of a
text are the ids of its pre-tokens one after another. A worker keeps the ids of
pre-tokens it has met (``CACHE_WORDS`` at most; the memory is emptied when full)
and asks the library's BPE model only for new ones. Texts with characters for
which Python's and the library's classes could differ, texts that hold the string
of an added token, and tokenizers of another kind go to the library whole, which
is left at its defaults: such a string becomes the token's one id.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np

CACHE_WORDS = 1_000_000
#: Letters and white space among the characters that texts without ODD have.
_LETTER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "\t-\r \x85\xa0"
#: The pre-token pattern of byte-level BPE (fixed value), in the dialect of ``re``; exact on texts without ODD.
_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Characters outside Latin letters, ASCII and usual punctuation, or of another class in ``re``.
_ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\u200f\u2028-\u20ab\u20ad-\U0010ffff]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """``encode(text)`` gives the ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_word = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", False)
            and not pre.get("add_prefix_space", True)
            and model.get("type") == "BPE"
            and not model.get("dropout")
        )
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.pack = "H" if self.dtype.itemsize == 2 else "I"
        self.model, self.alphabet, self.known = self.tokenizer.model, byte_alphabet(), {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or _ODD.search(text) or any(t in text for t in self.added):
            return self._whole(text)
        words, known = _WORDS.findall(text), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in set(words).difference(known):
                ids = [t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.alphabet))]
                known[w] = struct.pack(f"<{len(ids)}{self.pack}", *ids)
            return b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each worker process and path."""
    return WordEncoder(path)
