"""Ids of the lower-casing word BPE, chunk by chunk through caches.

The tokenizer's pre-tokenisation never looks across ASCII white space (it removes white space, and
neither its normaliser nor its split pattern joins characters over it), so the ids of a text are
the concatenated ids of its white-space-separated chunks. A chunk of Latin-1 characters is stable
under NFC and lower-cases character by character; it is split into the pattern's pieces here, and the
library's merge model encodes each distinct piece. Any other chunk goes through the whole library.
"""

from __future__ import annotations

import re
import sys
from array import array

#: Remembered keys per generation and worker (two generations). This bounds memory, not results.
CACHE_ENTRIES = 300_000

_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\s\xa0\x85a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_ODD = re.compile(r"[^\x21-\x7e\xa1-\xff]|<\|")


def byte_characters() -> list[str]:
    """The character by which byte-level BPE writes each byte: printable ones stay, others follow U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def _bytes(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Generations(dict):
    """A cache of two generations: when the newer is full it becomes the older one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = found
        return found


class WordTokens:
    """Ids as little-endian unsigned 32-bit integers, as the tokenizers library gives them without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.byte_map = dict(enumerate(byte_characters()))
        self.pieces = Generations(self._piece)
        self.chunks = Generations(self._chunk)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode("utf-8").decode("latin-1").translate(self.byte_map)
        return _bytes([t.id for t in self.model.tokenize(piece)])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if _ODD.search(text):
            return _bytes(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split()))


_open: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process and vocabulary."""
    if path not in _open:
        _open[path] = WordTokens(path)
    return _open[path]
