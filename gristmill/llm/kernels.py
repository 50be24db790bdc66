"""Vectorised text helpers used inside Spark tasks.

Arrow hands a task a column of strings as one byte buffer plus offsets. The
helpers below cut that buffer into words or lines and hash the pieces with a
handful of numpy passes, so no Python object is made per word. Pieces are
limited to `CHUNK` bytes of text at a time (a longer text forms a piece of its
own), which bounds the memory of a task whatever the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_CODES = mix(np.arange(257, 513, dtype=U) * U(0xD1342543DE82EF95))
_powers: dict[object, np.ndarray] = {}

#: Two polynomial hashes modulo the prime 2^31 - 1, each with a base and byte codes of its own.
PRIME = U((1 << 31) - 1)
FIELDS = (1_376_312_589, 1_906_431_877)
_FIELD_CODES = [mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95) + U(i)) % PRIME for i in range(len(FIELDS))]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK) + 1
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(n, base, U)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=U)
    return _powers["up"], _powers["down"]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^63."""
    x = (x & PRIME) + (x >> U(31))
    x = (x & PRIME) + (x >> U(31))
    return np.where(x >= PRIME, x - PRIME, x)


def _field_powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        table, step = np.ones(1, U), base
        while len(table) < max(n, CHUNK + 1):
            table = np.concatenate([table, _reduced(table * U(step))])
            step = step * step % int(PRIME)
        _powers[base] = table
    return _powers[base]


#: Bytes by class. Multi-byte characters only have bytes from 0x80 on, so that
#: a class which holds none or all of these works on UTF-8 bytes directly.
BYTES = np.arange(256)
SPACE = (BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D))
NOT_SPACE = ~SPACE
UPPER = (BYTES >= 0x41) & (BYTES <= 0x5A)
LOWER = (BYTES >= 0x61) & (BYTES <= 0x7A)
DIGIT = (BYTES >= 0x30) & (BYTES <= 0x39)
ALNUM = UPPER | LOWER | DIGIT | (BYTES >= 0x80)
LEAD = (BYTES < 0x80) | (BYTES >= 0xC0)
FOLD = np.where(UPPER, BYTES + 32, BYTES).astype(np.uint8)


class Texts:
    """Some whole texts as one byte array; text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        self._sums: dict[tuple[int, int], np.ndarray] = {}

    def spans(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes in a class, and each text's offsets into them."""
        inside = keep[self.data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        filled = self.offsets[:-1][np.diff(self.offsets) > 0]
        before[filled] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[filled[1:] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As spans, for the lines between newlines; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 0x0A)
        text_starts, text_ends = self.offsets[:-1], self.offsets[1:]
        first = np.searchsorted(breaks, self.offsets) + np.arange(self.n + 1)
        starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        at = np.arange(len(breaks)) + np.searchsorted(text_ends, breaks, side="right")
        starts[first[:-1]], starts[at + 1] = text_starts, breaks + 1
        ends[first[1:] - 1], ends[at] = text_ends, breaks
        return starts, ends, first

    def strip(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans without white space at both ends; those of nothing else become empty."""
        solid = np.flatnonzero(NOT_SPACE[self.data])
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        filled = b > a
        solid = np.append(solid, 0)
        return np.where(filled, solid[np.where(filled, a, -1)], starts), np.where(filled, solid[np.where(filled, b - 1, -1)] + 1, starts)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of spans, A-Z taken as a-z.

        They come from two polynomials modulo a prime. Modulo a power of two, which
        would be cheaper, texts are known that collide under every base.
        """
        return self._prime_hashes(FOLD, starts, ends, seed)

    def exact_hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """The same with case kept."""
        return self._prime_hashes(BYTES, starts, ends, seed)

    def second_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of another kind, modulo 2^64, to stand beside those of `hashes`."""
        up, down = _power_tables(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, U)
        sums[0] = 0
        np.cumsum(_CODES[FOLD][self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA0761D6478BD642F) + U(1))

    def _prime_hashes(self, fold: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
        raw = np.zeros(len(starts), U)
        for i, (base, codes) in enumerate(zip(FIELDS, _FIELD_CODES)):
            sums = self._sums.get((id(fold), i))
            if sums is None:
                sums = self._sums[id(fold), i] = np.zeros(len(self.data) + 1, U)
                np.cumsum(_reduced(codes[fold][self.data] * _field_powers(base, len(self.data) + 1)[: len(self.data)]), out=sums[1:])
            down = _field_powers(pow(base, -1, int(PRIME)), len(self.data) + 1)
            own = _reduced(_reduced(sums[ends] - sums[starts]) * down[starts])
            raw = (raw << U(32)) | own
        return mix(raw + (ends - starts).astype(U) * U(0xA0761D6478BD642F) + U(seed))

    def count(self, members: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many bytes of a class each span has."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(members[self.data], out=sums[1:])
        return sums[ends] - sums[starts]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(column: pa.Array, limit: int = CHUNK):
    """Cuts a string column into `Texts` of at most so many bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, one for each word but the last n - 1 (texts are not told apart here)."""
    if len(words) < n:
        return np.zeros(0, U)
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out *= U(0x9FB21C651E98DF25)
        out += words[i : len(words) - n + 1 + i]
    return mix(out + U(n))


def starts_of_grams(firsts: np.ndarray, n: int) -> np.ndarray:
    """True for the words at which n words of the same text begin; firsts: the texts' offsets into the words."""
    ends = np.repeat(firsts[1:], np.diff(firsts))
    return np.arange(firsts[-1]) + n <= ends


def owner(firsts: np.ndarray) -> np.ndarray:
    """The text that each piece belongs to."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
