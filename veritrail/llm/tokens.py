"""Exact, fast token ids of the lower-casing word BPE tokenizer.

Words are encoded independently of each other by this kind of tokenizer, so the ids of a word are kept
and a text costs one pattern scan and one join.  Whatever could meet a rule that looks beyond a word
(special strings, characters whose normal form or case mapping is not plain) goes to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np

#: Characters whose handling is the same in the scan below and in the library: no control characters,
#: nothing that composes, nothing whose lower case has another length.
_LOW, _HIGH = 0xA1, 0x17F
_ODD = (0x130,)


def _class_of(prefix: str) -> str:
    points = [*range(0x20, 0x7F), *range(_LOW, _HIGH + 1)]
    return "".join(re.escape(chr(p)) for p in points if unicodedata.category(chr(p)).startswith(prefix))


_LETTER, _NUMBER = _class_of("L"), _class_of("N")
_UNSAFE = re.compile(f"[^\\t\\n\\r\\x20-\\x7e\\u{_LOW:04x}-\\u{_HIGH:04x}]|" + "|".join(f"\\u{p:04x}" for p in _ODD))
# Fixed value: the tokenizer's own splitting rule, with its character classes written out.
# (Letter runs are tried first, which changes nothing as the contractions start with another character.)
_WORD = re.compile(f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^\\t\\n\\r {_LETTER}{_NUMBER}]+")

_MAX_WORDS = 500_000
_MAX_WORD_CHARS = 48


class Encoder:
    """Ids of texts; the ids of words are kept (a bounded number of them)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Encode unseen words in one call; the words stay apart as blanks end a word."""
        if len(self.words) > _MAX_WORDS:
            self.words.clear()
        coded = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        ids = np.asarray(coded.ids, dtype="<u4").tobytes()
        owner = np.asarray(coded.word_ids, dtype=np.int64)
        ends = np.searchsorted(owner, np.arange(len(new)), side="right") * 4
        at = 0
        for word, end in zip(new, ends.tolist(), strict=True):
            self.words[word] = ids[at:end]
            at = end

    def id_bytes(self, text: str) -> bytes:
        """Ids of the whole text, as the library gives them, as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if _UNSAFE.search(text) or (self.special and self.special.search(text)):
            return self._library(text)
        found = _WORD.findall(text.lower())
        if not found:
            return b""
        known = self.words
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            new = [w for w in dict.fromkeys(found) if w not in known]
        if max(map(len, new)) > _MAX_WORD_CHARS:
            return self._library(text)
        if len(known) > _MAX_WORDS:
            new = list(dict.fromkeys(found))
        self._learn(new)
        return b"".join(map(known.__getitem__, found))

    def count(self, text: str) -> int:
        return len(self.id_bytes(text)) // 4


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine (each executor resolves its own copy)."""
    import public_tokenizers

    return public_tokenizers.path(name)
