"""Words of a batch of texts as numpy arrays: places, hashes, n-grams.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return. These are single bytes in UTF-8, so words are found on
the bytes of a text. Word and n-gram hashes are 64 bits wide; operators whose
result rests on equal hashes across documents use two of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are worked on in pieces of whole documents of about so many bytes, which
# bounds the memory of a task; a longer document is one piece.
CHUNK_BYTES = 1 << 19

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Lower case, and ASCII punctuation as blanks.
_PLAIN = _LOWER.copy()
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others; one to one."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, from 0 on."""
    known = _powers.get(base)
    if known is None or len(known[0]) < count:
        size = max(count, 1 << 16)
        up = np.full(size, base, U64)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), U64)
        down[0] = 1
        known = (np.cumprod(up), np.cumprod(down))
        if size <= 8 * CHUNK_BYTES:
            _powers[base] = known
    return known


class Ranges:
    """Hashes of any range of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        self.up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """The words of some texts.

    ``data`` holds the bytes of all texts, ``edges`` where each text begins (and
    the end), ``starts`` and ``ends`` the words' places in ``data``, ``first`` the
    number of the first word of each text (and the count), ``doc`` the text of
    each word. ``lower`` lowers A-Z; ``plain`` also reads ASCII punctuation as blank.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, plain: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        if lower or plain:
            self.data = (_PLAIN if plain else _LOWER)[self.data]
        self.edges = offsets - offsets[0]
        size = len(self.data)
        self.blank = _SPACE[self.data]
        before = np.ones(size, bool)
        before[1:] = self.blank[:-1]
        before[self.edges[:-1][self.edges[:-1] < size]] = True
        self.starts = np.flatnonzero(~self.blank & before)
        after = np.ones(size, bool)
        after[:-1] = self.blank[1:]
        filled = self.edges[1:] > self.edges[:-1]
        after[self.edges[1:][filled] - 1] = True
        self.ends = np.flatnonzero(~self.blank & after) + 1
        self.first = np.searchsorted(self.starts, self.edges)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self._ranges: Ranges | None = None

    @property
    def ranges(self) -> Ranges:
        """Hashes of any range of bytes."""
        if self._ranges is None:
            self._ranges = Ranges(_BYTE_VALUES[self.data])
        return self._ranges

    def hashes(self) -> np.ndarray:
        return self.ranges.hashes(self.starts, self.ends)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return np.diff(sums[self.edges])


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    count = max(len(hashes) - n + 1, 0)
    out = np.zeros(count, U64)
    for i in range(n):
        out = mix(out) + hashes[i : i + count] * U64(0xC2B2AE3D27D4EB4F)
    return mix(out)


def inside(words: Words, n: int) -> np.ndarray:
    """Whether the n words from each place on belong to one text."""
    count = max(len(words.doc) - n + 1, 0)
    return words.doc[:count] == words.doc[n - 1 : n - 1 + count]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about CHUNK_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(pc.fill_null(batch.column(column), "")).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - 1).clip(0) // CHUNK_BYTES
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed longs."""
    return pa.array(values.astype(U64, copy=False).view(np.int64))
