"""Substring dedup on the De Bruijn graph of token k-mers.

An edge is a sequence of ``window`` words, from the node of its first window - 1
words to that of its last. Edges are never shuffled one by one: consecutive edges
of a document that share their anchor, the smallest-hashed ANCHOR_WORDS words in
them, are one strand, a path known from its first edge on. Equal edges have equal
anchors, so only strands of an anchor that two documents have can repeat.

Compaction, by joins on the anchor: if all strands of an anchor are one, nothing
branches there, and the whole path has one smallest document. Where paths branch,
each different strand is opened into edges once, read at one of its source
coordinates; the smallest documents of these edges join back to the strands and
from there to their occurrences. Copies of a path are counted before any shuffle
of its edges, so a passage in very many documents costs one row for each place.

Words of an edge that also starts in a document with a smaller doc_id are spans to
remove; spans of a document that touch are one long repeat. Equality of strands
and edges is held on two hashes of 64 bits each.

Rows: one for each input row. Null texts have no words, texts shorter than the
window keep all. Rows with a null doc_id are neither source nor changed; rows of
one doc_id never repeat each other. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.shared import BitSet, rows_named, stored
from emberlog.llm.words import U64, Ranges, Words, pieces, signed

WINDOW = 50
ANCHOR_WORDS = 16
OTHER_BASE = 0xA24BAED4963EE407
# Places in a piece take so many low bits beside the hash when anchors are chosen.
PLACE_BITS = 28


class Hashes:
    """Two hashes of any range of the words of some texts."""

    def __init__(self, words: Words):
        values = words.hashes()
        self.one, self.two = Ranges(values), Ranges(values, OTHER_BASE)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
        return signed(self.one.hashes(starts, ends)), signed(self.two.hashes(starts, ends))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` consecutive values."""
    held = 1
    while 2 * held <= size:
        values = np.minimum(values[:-held], values[held:])
        held *= 2
    rest = size - held
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def strands_of(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First edge, number of edges and anchor hash of each strand."""
    empty = np.zeros(0, np.int64)
    count = len(words.starts) - window + 1
    if count < 1:
        return empty, empty, empty.view(U64)
    places = np.arange(len(words.starts) - ANCHOR_WORDS + 1)
    anchors = Ranges(words.hashes()).hashes(places, places + ANCHOR_WORDS)
    low = U64((1 << PLACE_BITS) - 1)
    least = sliding_min((anchors & ~low) | places.astype(U64), window - ANCHOR_WORDS + 1)
    edges = np.flatnonzero(words.doc[:count] == words.doc[window - 1 :])
    at = (least[edges] & low).astype(np.int64)
    if not len(edges):
        return empty, empty, empty.view(U64)
    begins = np.ones(len(edges), bool)
    begins[1:] = (at[1:] != at[:-1]) | (edges[1:] != edges[:-1] + 1)
    first = np.flatnonzero(begins)
    return edges[first], np.diff(np.append(first, len(edges))), anchors[at[first]]


def strands(docs: DataFrame, window: int) -> DataFrame:
    """Rows (anchor, path_a, path_b, doc_id, first, edges), one for each strand of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = Words(piece.column("text"))
            first, edges, anchors = strands_of(words, window)
            if len(first):
                doc = words.doc[first]
                a, b = Hashes(words).of(first, first + edges - 1 + window)
                yield pa.RecordBatch.from_arrays(
                    [signed(anchors), a, b, piece.column("doc_id").take(pa.array(doc)),
                     pa.array(first - words.first[doc], pa.int64()), pa.array(edges, pa.int64())],
                    names=["anchor", "path_a", "path_b", "doc_id", "first", "edges"],
                )

    return docs.mapInArrow(
        run, "anchor long, path_a long, path_b long, doc_id long, first long, edges long"
    )


def opened(docs: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """Rows (edge_a, edge_b, path_a, path_b, at, doc_id) of paths (path_a, path_b, doc_id, first, edges)."""
    ids = paths.select("doc_id").distinct()
    listed = paths.groupBy("doc_id").agg(
        F.collect_list(F.struct("path_a", "path_b", "first", "edges")).alias("paths")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = Words(piece.column("text"))
            lists = piece.column("paths")
            owner = np.repeat(np.arange(piece.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            # A path is read only where its place really holds it.
            begin = words.first[owner] + flat.field("first").to_numpy(zero_copy_only=False)
            end = begin + flat.field("edges").to_numpy(zero_copy_only=False) - 1 + window
            within = end <= words.first[owner + 1]
            hashes = Hashes(words)
            a, b = hashes.of(np.where(within, begin, 0), np.where(within, end, 0))
            holds = pc.and_(pc.equal(a, flat.field("path_a")), pc.equal(b, flat.field("path_b")))
            holds = np.flatnonzero(within & holds.to_numpy(zero_copy_only=False))
            flat, owner = flat.take(pa.array(holds)), owner[holds]
            first, edges = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "edges"))
            path = np.repeat(np.arange(len(first)), edges)
            at = np.arange(len(path)) - (np.cumsum(edges) - edges)[path]
            start = words.first[owner[path]] + first[path] + at
            a, b = hashes.of(start, start + window)
            which = pa.array(path)
            yield pa.RecordBatch.from_arrays(
                [a, b, flat.field("path_a").take(which), flat.field("path_b").take(which),
                 pa.array(at, pa.int64()), piece.column("doc_id").take(pa.array(owner[path]))],
                names=["edge_a", "edge_b", "path_a", "path_b", "at", "doc_id"],
            )

    # This join and the one below shuffle, so that no task runs two Python workers at once.
    return rows_named(docs, ids).join(listed.hint("merge"), "doc_id").select("doc_id", "text", "paths").mapInArrow(
        run, "edge_a long, edge_b long, path_a long, path_b long, at long, doc_id long"
    )


def repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and its runs of edges (first, edges) that also start in a smaller doc_id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    paths = stored(strands(docs, window), "strands")
    shared = stored(
        paths.groupBy("anchor").agg(
            F.min("doc_id").alias("source"), F.max("doc_id").alias("last"),
            F.min("path_a").alias("low_a"), F.max("path_a").alias("high_a"),
            F.min("path_b").alias("low_b"), F.max("path_b").alias("high_b"),
        )
        .where("source < last")
        .select("anchor", "source", ((F.col("low_a") != F.col("high_a")) | (F.col("low_b") != F.col("high_b")))
                .alias("branches")),
        "anchors",
    )
    met = stored(paths.join(shared, "anchor"), "met")
    plain = met.where("not branches and source < doc_id").select(
        "doc_id", F.array(F.struct("first", "edges")).alias("runs")
    )
    branching = met.where("branches")
    once = stored(
        branching.groupBy("path_a", "path_b").agg(
            F.min(F.struct("doc_id", "first")).alias("place"), F.first("edges").alias("edges")
        ).select("path_a", "path_b", "place.doc_id", "place.first", "edges"),
        "paths",
    )
    edges = stored(opened(docs, once, window), "edges")
    sources = edges.groupBy("edge_a", "edge_b").agg(F.min("doc_id").alias("source"))
    answered = (
        edges.join(sources, ["edge_a", "edge_b"])
        .groupBy("path_a", "path_b").agg(F.array_sort(F.collect_set(F.struct("at", "source"))).alias("sources"))
    )
    answered = stored(answered, "answers")
    earlier = F.filter("sources", lambda s: s["source"] < F.col("doc_id"))
    branched = branching.join(answered, ["path_a", "path_b"]).select(
        "doc_id",
        F.transform(
            earlier, lambda s: F.struct((F.col("first") + s["at"]).alias("first"), F.lit(1).cast("long").alias("edges"))
        ).alias("runs"),
    ).where(F.size("runs") > 0)
    runs = F.flatten(F.collect_list("runs"))
    return plain.union(branched).groupBy("doc_id").agg(runs.alias("runs"))


def marked(counts: int, runs: list[dict], window: int) -> np.ndarray:
    """Which of so many words the runs of edges cover."""
    change = np.zeros(counts + 1, np.int64)
    first = np.array([r["first"] for r in runs], np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + np.array([r["edges"] for r in runs], np.int64) - 1 + window, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by blanks) for each row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = stored(repeats(documents, window), "spans")
    bits = BitSet(spans.select("doc_id"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            listed = piece.column("runs").to_pylist() if "runs" in piece.schema.names else [None] * len(piece)
            for text, runs in zip(piece.column("text").to_pylist(), listed, strict=True):
                # Bytes split at the same blanks that part words.
                words = (text or "").encode().split()
                gone = marked(len(words), runs, window) if runs else np.zeros(len(words), bool)
                kept = b" ".join(compress(words, (~gone).tolist()) if runs else words)
                rows.append((len(words), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
            counts, removed, kept, digests = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.filter(pa.array(~bits.of(batch.column("doc_id")))) for batch in batches)

    # Most texts have no span; only the others are shuffled to meet theirs.
    touched = rows_named(docs, spans.select("doc_id")).join(spans.hint("merge"), "doc_id", "left")
    return docs.mapInArrow(untouched, kind).union(
        touched.select("doc_id", "text", "runs").mapInArrow(run, kind)
    )
