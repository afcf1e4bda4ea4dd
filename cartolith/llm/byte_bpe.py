"""Byte-level BPE by ranks: vectorised pre-tokenisation, cached pair merging, exact decoding.

Pre-tokenisation runs over an array of code points, without a regular expression. Each code point gets a
class (letter, number, blank, other white space, symbol; an apostrophe that could begin a contraction
and white space whose successor decides its fate get classes of their own from shifted arrays). A class is
a transition function of a small automaton; function composition is associative, so a blocked scan
composes all prefixes with table look-ups: the finitely many compositions are numbered beforehand. The state
before a code point and its class tell whether a token begins there. Slices of the UTF-8 bytes between
such places are looked up in a cache; a new slice is merged pair by pair, lowest rank first.

Offsets of the tokens are kept, so that a text can be decoded whole or in part.

Defined results: a null text is an empty one (no ids); repeated rows and ids stay as they are; an empty table
gives no rows; other columns are ignored. Texts of any length are taken whole, a batch holding one at
least.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, sliced, utf8
from .word_tokens import Generations

# Classes of a code point in its place
LETTER, NUMBER, SYMBOL, SHORT, LONG, BLANK, SPACE, INNER = range(8)
# States after a code point
FRESH, IN_LETTERS, IN_NUMBERS, IN_SYMBOLS, PENDING, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at the code point."""
    if kind == LETTER:
        if state == ONE_LEFT:
            return FRESH, False
        if state == TWO_LEFT:
            return ONE_LEFT, False
        return IN_LETTERS, state not in (IN_LETTERS, PENDING)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PENDING)
    if kind in (SYMBOL, SHORT, LONG):
        if state in (IN_SYMBOLS, PENDING) or kind == SYMBOL:
            return IN_SYMBOLS, state not in (IN_SYMBOLS, PENDING)
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    if kind == BLANK:  # a blank before something else goes with it
        return PENDING, True
    if kind == SPACE:  # any other white space before something else stands alone
        return FRESH, True
    return IN_SPACE, state != IN_SPACE  # white space before white space or the end


@lru_cache(None)
def _automaton():
    """Numbers of the classes' functions, composition table, functions as rows, and where tokens begin."""
    table = np.array([[_step(s, k)[0] for s in range(8)] for k in range(8)], np.uint8)
    begins = np.array([[_step(s, k)[1] for s in range(8)] for k in range(8)], bool)
    # the same classes for the first code point of a text: whatever came before, as from FRESH
    table = np.concatenate([table, np.repeat(table[:, :1], 8, axis=1)])
    begins = np.concatenate([begins, np.ones((8, 8), bool)])
    identity = bytes(range(8))
    known = {identity: 0}
    todo = [identity]
    while todo:  # the closure of the generators under composition
        f = todo.pop()
        for g in table:
            h = bytes(g[list(f)])
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = np.array([list(f) for f in known], np.uint8)
    compose = np.array([[known[bytes(g[list(f)])] for g in functions] for f in functions], np.uint16)
    return np.array([known[bytes(g)] for g in table], np.uint16), compose.reshape(-1), functions, begins.reshape(-1)


@lru_cache(None)
def _classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, SYMBOL, np.uint8)
    for c in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kinds[c] = LETTER
        elif major == "N":
            kinds[c] = NUMBER
    kinds[_WHITE] = SPACE
    return kinds


def _prefixes(numbers: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive scan of composition: the number of the function that all code points up to each one make."""
    _, compose, functions, _ = _automaton()
    n, k = len(numbers), len(functions)
    if n <= width:
        out = numbers.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) * k + int(numbers[i])]
        return out
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint16)  # 0 is the identity
    padded[:n] = numbers
    lanes = np.ascontiguousarray(padded.reshape(rows, width).T)
    for i in range(1, width):
        lanes[i] = compose[lanes[i - 1].astype(np.intp) * k + lanes[i]]
    ends = _prefixes(lanes[-1], width)  # of whole blocks
    before = np.concatenate([np.zeros(1, np.uint16), ends[:-1]]).astype(np.intp) * k
    for i in range(width):
        lanes[i] = compose[before + lanes[i]]
    return lanes.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices at which tokens begin. ``points``: code points of texts in a row; ``first``: where texts begin."""
    n = len(points)
    if not n:
        return np.empty(0, np.intp)
    own, _, functions, begins = _automaton()
    kinds = _classes()[points]
    last = np.zeros(n, bool)  # of its text
    last[first[1:] - 1] = True
    last[-1] = True
    white = kinds == SPACE
    follows = np.append(~white[1:], False) & ~last  # something else comes next
    kinds[white] = np.where(follows[white], np.where(points[white] == 0x20, BLANK, SPACE), INNER)
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        end_of = np.append(first[1:], n)[np.searchsorted(first, marks, "right") - 1]  # of the text of each mark
        a = np.where(marks + 1 < end_of, points[np.minimum(marks + 1, n - 1)], 0)
        b = np.where(marks + 2 < end_of, points[np.minimum(marks + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        kinds[marks[one]] = SHORT
        kinds[marks[two]] = LONG
    kinds[first] += 8
    states = functions[_prefixes(own[kinds]), FRESH]
    before = np.concatenate([np.zeros(1, np.uint8), states[:-1]])
    return np.flatnonzero(begins[kinds.astype(np.intp) * 8 + before])


class ByteBPE:
    """Encoder and decoder for a file of ranks (``base64 rank`` lines)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cache = Generations(self._encode)

    def _encode(self, piece: bytes) -> bytes:
        return array("I", self.merge(piece)).tobytes()

    def merge(self, piece: bytes) -> list[int]:
        """Merge neighbours of the lowest rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 48:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap and links, in O(n log n)."""
        n, ranks = len(piece), self.ranks
        ends = list(range(1, n + 1))  # of the part that begins at i; 0 if none does
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if ends[i] != mid or mid >= n or ends[mid] != end:
                continue  # one of the two has changed
            ends[i], ends[mid] = end, 0
            if end < n:
                prev[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, end, ends[end]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, i, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def encode_texts(self, texts: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
        """Of each text: ids as little-endian unsigned 32-bit integers, and the byte offsets of its pre-tokens."""
        data = b"".join(texts)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(data, np.uint8)
        place = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte at which each code point begins
        first = np.searchsorted(place, (ends - sizes)[sizes > 0])
        cuts = place[boundaries(points, first)]
        starts = cuts.tolist()
        found = [self.cache[data[a:b]] for a, b in zip(starts, starts[1:] + [len(data)])]
        at = np.searchsorted(cuts, np.concatenate([ends - sizes, ends[-1:]])).tolist()
        out = []
        for i, begin in enumerate((ends - sizes).tolist()):
            ids = b"".join(found[at[i] : at[i + 1]])
            if sys.byteorder == "big":
                ids = np.frombuffer(ids, ">u4").astype("<u4").tobytes()
            out.append((ids, cuts[at[i] : at[i + 1]] - begin))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text.encode("utf-8")])[0][0], "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte offset at which each id's bytes begin, and the end."""
        sizes = np.fromiter((len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()), np.int64, len(ids) // 4)
        return np.concatenate([[0], np.cumsum(sizes)])


_open: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    """One per worker process and file."""
    if path not in _open:
        _open[path] = ByteBPE(path)
    return _open[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, offsets array<int> (byte offset of each id in the UTF-8 text)."""

    def task(batches):
        bpe = byte_bpe(path)
        for batch in sliced(batches):
            found = [ids for ids, _ in bpe.encode_texts(utf8(batch.column(1)))]
            ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32()))
            offsets = pa.array([bpe.offsets(x)[:-1].astype(np.int32) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, offsets], ["doc_id", "ids", "offsets"])

    return id_and_text(docs).mapInArrow(task, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data binary: the bytes of ``ids``. Null ids give no bytes."""

    def task(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            data = [bpe.decode_bytes(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, data binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass over the texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def task(batches):
        bpe = byte_bpe(path)
        for batch in sliced(batches):
            found = [ids for ids, _ in bpe.encode_texts(utf8(batch.column(1)))]
            sha = hashlib.sha256
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in found], pa.int64()),
                pa.array([sha(x).hexdigest() for x in found], pa.string()),
                pa.array([sha(bpe.decode_bytes(x)).hexdigest() for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
