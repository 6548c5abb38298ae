"""Byte-level BPE encoding and decoding without regular expressions.

Texts become arrays of code points, and these arrays of symbols (letter,
number, blank, other, and those whose followers matter).  A finite automaton
over the symbols says where a piece begins.  Its transition functions compose
associatively, so blocks of symbols are run from all states at once, block
functions are combined by doubling, and a second sweep from each block's true
entry state marks the beginnings.  The distinct pieces of a chunk are then
merged by rank, through a cache, and the ids are laid out in text order.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .storage import bounded_batches

CACHE_ENTRIES = 1 << 18  # per Python worker
MAX_VOCABULARY_BYTES = 64 << 20  # what may be sent to every executor
LONG_PIECE = 96  # bytes from which merging uses a heap

LETTER, NUMBER, OTHER, BLANK, LAST_SPACE, LAST_BLANK, SHORT, LONG = range(8)
FIRST = 8  # added to the symbol that begins a text
ENDED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)
#: The code points of Unicode's White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BLOCK = 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by symbol and state."""
    after, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for symbol, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (BLANK, IN_BLANKS)):
        after[symbol] = inside
        begins[symbol, inside] = False
        begins[symbol, AFTER_SPACE] = symbol == BLANK
    after[LETTER, TWO_LEFT], after[LETTER, ONE_LEFT] = ONE_LEFT, ENDED
    begins[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    after[LAST_SPACE], after[LAST_BLANK] = AFTER_SPACE, ENDED
    for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        after[symbol] = left
        after[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    after[FIRST:] = after[:FIRST, :1]
    return after, begins


_AFTER, _BEGINS = _automaton()


@lru_cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.frombuffer(bytes(kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8).copy()
    out[list(WHITE_SPACE)] = BLANK
    return out


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each code point; ``firsts``: where texts begin."""
    kind = _classes()[points]
    n = len(points)
    begin = np.zeros(n + 2, bool)
    begin[firsts] = True
    begin[n:] = True
    following = np.empty(n, np.uint8)
    following[:-1], following[-1:] = kind[1:], BLANK
    last = (kind == BLANK) & (following != BLANK) & ~begin[1 : n + 1]
    out = kind.copy()
    out[last] = np.where(points[last] == 32, LAST_SPACE, LAST_BLANK)
    quote = np.flatnonzero((points == 39) & (following == LETTER) & ~begin[1 : n + 1])
    if len(quote):
        padded = np.r_[points, np.zeros(2, points.dtype)]
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[quote[short]] = SHORT
        out[quote[long & ~begin[quote + 2]]] = LONG
    out[firsts] += FIRST
    return out


def boundaries(symbol: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin, by scans of the transition functions."""
    n = len(symbol)
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // BLOCK)
    laid = np.full(rows * BLOCK, BLANK, np.uint8)
    laid[:n] = symbol
    steps = np.ascontiguousarray(laid.reshape(rows, BLOCK).T).astype(np.intp) * 8
    flat, starts = _AFTER.ravel(), _BEGINS.ravel()
    state = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    for t in range(BLOCK):
        state = flat[steps[t][:, None] + state]
    base = (np.arange(rows, dtype=np.intp) * 8)[:, None]
    d = 1
    while d < rows:
        later = state.ravel()[base[d:] + state[:-d]]
        state = np.concatenate([state[:d], later])
        d *= 2
    entry = np.r_[np.uint8(ENDED), state[:-1, ENDED]]
    marks = np.empty((BLOCK, rows), bool)
    for t in range(BLOCK):
        at = steps[t] + entry
        marks[t] = starts[at]
        entry = flat[at]
    return np.flatnonzero(np.ascontiguousarray(marks.T).ravel()[:n])


class Vocabulary:
    """Ranks of byte strings, read from the lines of a rank file."""

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines() if content else [])}
        self.single = [self.ranks[bytes([k])] for k in range(256)]
        size = max(self.ranks.values()) + 1
        texts = [b""] * size
        for text, rank in self.ranks.items():
            texts[rank] = text
        self.known = np.zeros(size, bool)
        self.known[list(self.ranks.values())] = True
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        ids = self._merge_short(piece) if len(piece) < LONG_PIECE else self._merge_long(piece)
        return np.array(ids, "<u4").tobytes()

    def _merge_short(self, piece: bytes) -> list[int]:
        parts = [piece[k : k + 1] for k in range(len(piece))]
        ranks, none = self.ranks.get, 1 << 40
        pairs = [ranks(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = ranks(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = ranks(parts[k] + parts[k + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        end, nxt, prev, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\x01") * n
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := self.ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            if not alive[k] or (right := nxt[k]) >= n or end[right] != stop or end[k] != right:
                continue
            end[k], nxt[k], alive[right] = stop, nxt[right], 0
            if stop < n:
                prev[stop] = k
                if (r := self.ranks.get(piece[k : end[stop]])) is not None:
                    heapq.heappush(heap, (r, k, end[stop]))
            if (left := prev[k]) >= 0 and (r := self.ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        return [self.ranks[piece[k : end[k]]] for k in range(n) if alive[k]]

    def encode(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and where each row's ids begin (n + 1 positions)."""
        data = np.frombuffer(raw, np.uint8)
        n_rows = len(offsets) - 1
        lead = (data & 0xC0) != 0x80
        at_byte = np.flatnonzero(lead)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        firsts = np.searchsorted(at_byte, filled)
        starts = at_byte[boundaries(symbols(points, firsts))]
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        row = np.searchsorted(offsets, starts, "right") - 1
        _, first, inverse = np.unique(_piece_hashes(data, starts, ends), return_index=True, return_inverse=True)
        cache, found = self.cache, []
        for a, b in zip(starts[first].tolist(), ends[first].tolist()):
            piece = raw[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if len(piece) < LONG_PIECE:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        out = flat[ragged((np.cumsum(sizes) - sizes)[inverse], sizes[inverse])]
        return out, np.r_[0, np.cumsum(np.bincount(row, sizes[inverse], n_rows).astype(np.int64))]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the byte at which each token begins (n + 1 positions)."""
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.lengths[ids]
        return self.bytes[ragged(self.begins[ids], sizes)], np.r_[0, np.cumsum(sizes)]


_PIECE_BYTE = np.random.default_rng(77).integers(0, 1 << 64, 256, dtype=np.uint64)


def _piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ta.word_hashes(data, starts, ends, _PIECE_BYTE)


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions begins[k], ..., begins[k] + sizes[k] - 1 for all k, joined."""
    total = int(sizes.sum())
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(content: bytes) -> Vocabulary:
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content)
    return _loaded[key]


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return content


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, offsets`` of every row.

    ``vocabulary``: path of a rank file on the driver; its content goes to the
    executors.  ``ids``: the token ids as little-endian unsigned 32-bit
    integers; ``offsets``: likewise the byte of the text at which each token
    begins.  Null and empty texts have no tokens; bytes that aren't UTF-8 count
    as U+FFFD.  Special tokens are ordinary text.  Repeated rows and ids stay as they are; other columns are ignored.
    """
    content = docs.sparkSession.sparkContext.broadcast(_content(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(content.value)
        for batch in batches:
            data, offsets = ta.utf8(batch.column(1))
            for low, high in ta.chunks(offsets):
                n, o = high - low, offsets[low : high + 1] - offsets[low]
                ids, at = known.encode(data[offsets[low] : offsets[high]].tobytes(), o)
                begins = np.cumsum(known.lengths[ids]) - known.lengths[ids] - np.repeat(o[:-1], np.diff(at))
                cells = [pa.array([x[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()) for x in (ids, begins)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), pa.array(np.diff(at)), *cells], ["doc_id", "n_tokens", "ids", "offsets"])

    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids binary, offsets binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` (the bytes of the text) of rows made by :func:`encode`."""
    content = encoded.sparkSession.sparkContext.broadcast(_content(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(content.value)
        for batch in batches:
            cells = [known.decode(np.frombuffer(x or b"", "<u4"))[0].tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: :func:`encode` and, from its ids alone, :func:`decode` in one pass.

    One Python worker does both, where the two functions in a row would hold
    two for each task.
    """
    content = docs.sparkSession.sparkContext.broadcast(_content(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(content.value)
        for batch in batches:
            data, offsets = ta.utf8(batch.column(1))
            for low, high in ta.chunks(offsets):
                ids, at = known.encode(data[offsets[low] : offsets[high]].tobytes(), offsets[low : high + 1] - offsets[low])
                back, begins = known.decode(ids)
                packed = ids.astype("<u4").tobytes()
                cells = [packed[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                texts = [back[a:b].tobytes() for a, b in zip(begins[at[:-1]].tolist(), begins[at[1:]].tolist())]
                columns = [batch.column(0).slice(low, high - low), pa.array(np.diff(at)), pa.array(cells, pa.binary()), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
