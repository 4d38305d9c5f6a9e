"""Quality rules on repetition, from the suffix array of each text's words.

The suffixes of the words of every text are sorted by prefix doubling: groups of
suffixes that agree on k words are split by the group of the place k words on, so
only suffixes that still share a group are sorted again. Longest common prefixes
of neighbours follow from the groups kept of each round. A suffix lies in the
LCP interval of its larger neighbour value, which is the longest repeated
sequence that begins at it; the union of these sequences is what repeats of the
text cover.

Rows: one for each input row, null texts as empty ones, any length, no state
between rows. Only the named columns are read. A text without words covers
nothing and fails the base rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.llm.words import U64, Words, mix, pieces

# Repeats of fewer words are everyday phrases and count for nothing.
SHORTEST_REPEAT = 8
# Texts are rejected above these.
MOST_COVERED = 0.45
LONGEST_SHARE = 0.25

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, "
    "longest_repeat long"
)


def dense(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For sorted keys the place where the group of each begins, in key order."""
    ordered = keys[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def longest_repeats(hashes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the number of words of the longest sequence from it on that the
    same text also has elsewhere. ``ends`` is the end of each word's text."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    keys = mix(hashes + mix(doc.astype(U64) + U64(1)))
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = dense(keys, order)
    rounds = [rank.copy()]
    size = np.bincount(rank, minlength=n)
    active = order[size[rank[order]] > 1]
    k = 1
    while len(active):
        head = rank[active].astype(np.int64)
        ahead = active + k
        tail = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)].astype(np.int64), -1)
        pair = head * (n + 1) + tail + 1
        order = np.argsort(pair, kind="stable")
        active, head, starts = active[order], head[order], dense(pair, order)
        group = np.ones(len(head), bool)
        group[1:] = head[1:] != head[:-1]
        begun = np.maximum.accumulate(np.where(group, np.arange(len(head)), 0))
        rank[active] = head + starts - begun
        shared = np.bincount(starts, minlength=len(head))[starts] > 1
        active = active[shared]
        k *= 2
        rounds.append(rank.copy())
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    out = np.zeros(n, np.int64)
    a, b = suffixes[:-1], suffixes[1:]
    near = rounds[0][a] == rounds[0][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for level in range(len(rounds) - 1, -1, -1):
        x, y = a + common, b + common
        open_ = (x < ends[a]) & (y < ends[b])
        same = rounds[level][np.minimum(x, n - 1)] == rounds[level][np.minimum(y, n - 1)]
        common += np.where(open_ & same, 1 << level, 0)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(lengths: np.ndarray, shortest: int, fixed: int | None = None) -> np.ndarray:
    """The words that sequences of at least ``shortest`` words cover, each ``fixed`` or all long."""
    at = np.flatnonzero(lengths >= shortest)
    change = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + (lengths[at] if fixed is None else fixed), -1)
    return np.cumsum(change[:-1]) > 0


def sums(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return np.diff(total[first])


def repeated_lines(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    breaks = np.flatnonzero(words.data == 0x0A)
    edges = words.edges
    starts = np.unique(np.concatenate([edges[:-1], breaks + 1]))
    # Where one text ends with a break the next one may begin, at the same place.
    doc = np.searchsorted(edges, starts, side="right") - 1
    stop = np.minimum(np.searchsorted(breaks, starts), max(len(breaks) - 1, 0))
    ends = np.where(
        (len(breaks) > 0) & (breaks[stop] >= starts) if len(breaks) else np.zeros(len(starts), bool),
        breaks[stop] if len(breaks) else 0,
        len(words.data),
    )
    doc = np.minimum(doc, len(edges) - 2)
    ends = np.minimum(ends, edges[doc + 1])
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[filled], ends[filled], doc[filled]
    if not len(starts):
        return np.zeros(len(edges) - 1, np.int64)
    keys = mix(words.ranges.hashes(starts, ends) + mix(doc.astype(U64) + U64(1)))
    _, seen = np.unique(keys, return_index=True)
    lines = np.bincount(doc, minlength=len(edges) - 1)
    return lines - np.bincount(doc[seen], minlength=len(edges) - 1)


def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = Words(batch.column("text"))
    ends = words.first[1:][words.doc]
    lengths = longest_repeats(words.hashes(), words.doc, ends)
    n = words.counts
    in_words = ~words.blank & ((words.data & 0xC0) != 0x80)
    repeat = sums(covered(lengths, 3, 3), words.first)
    inside = sums(covered(lengths, SHORTEST_REPEAT), words.first)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, words.doc, lengths)
    failed = (n < 50) | (100 * repeat > 50 * n)
    repetitive = (inside > MOST_COVERED * n) | ((longest >= SHORTEST_REPEAT) & (longest > LONGEST_SHARE * n))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)),
            pa.array(words.per_text(in_words)), pa.array(words.per_text(SYMBOLS[words.data])),
            pa.array(repeated_lines(words)), pa.array(repeat), pa.array(failed),
            pa.array(~failed & ~repetitive), pa.array(inside), pa.array(longest),
        ],
        names=[c.split()[0] for c in COLUMNS.split(", ")],
    )


def repetition_report(docs: DataFrame) -> DataFrame:
    """One row for each document with its repetition figures and the verdict ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield judge(piece)

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)


def keep_varied(docs: DataFrame) -> DataFrame:
    """The documents whose text passes, with their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield piece.filter(judge(piece).column("kept"))

    return docs.mapInArrow(run, docs.schema)
