"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text (sizes, kinds of characters, words, lines, repeats)
are transformed to be roughly normal. Tasks add up counts, sums and products of
the labelled rows for each class; the covariance of a class is drawn towards the
one pooled over classes, and that towards its diagonal. A score is the posterior
of class 1 from the difference of log-densities: Mahalanobis distances by the
inverse Cholesky factors, which are computed once and sent to all tasks.

Rows: one for each input row, null texts as empty ones. Labels that are null or
neither 0 nor 1 are ignored, repeated labels count each time. With labels of one
class only every score is that class; without any it is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.shared import merge_blocks
from emberlog.llm.words import U64, Words, inside, mix, ngrams, pieces

# Shares of the pooled covariance in a class's, and of the diagonal in the pooled one.
TO_POOLED, TO_DIAGONAL = 0.1, 0.05
LEAST_VARIANCE = 1e-4

KINDS = {
    "letters": [*range(65, 91), *range(97, 123)],
    "capitals": [*range(65, 91)],
    "digits": [*range(48, 58)],
    "stops": [ord(c) for c in ".!?"],
    "commas": [ord(c) for c in ",;:"],
    "symbols": [ord(c) for c in "#*$%&|<>"],
    "others": [ord(c) for c in "\"'()[]{}=+-_/\\@~^`"],
    "breaks": [10],
    "vowels": [ord(c) for c in "aeiouAEIOU"],
}
MASKS = {name: np.isin(np.arange(256), codes) for name, codes in KINDS.items()}


def distinct(keys: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """How many different keys each owner has."""
    _, first = np.unique(mix(keys + mix(owner.astype(U64) + U64(1))), return_index=True)
    return np.bincount(owner[first], minlength=count)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    words, lowered = Words(texts), Words(texts, lower=True)
    count, data = len(texts), words.data
    points = np.maximum(words.per_text((data & 0xC0) != 0x80), 1)
    share = {name: words.per_text(mask[data]) / points for name, mask in MASKS.items()}
    wide = words.per_text(data >= 0xC0) / points
    blanks = words.per_text(words.blank) / points
    sizes = words.ends - words.starts
    n = words.counts
    some = np.maximum(n, 1)
    mean = np.bincount(words.doc, sizes, count) / some
    spread = np.sqrt(np.maximum(np.bincount(words.doc, sizes.astype(float) ** 2, count) / some - mean**2, 0))
    longest = np.zeros(count)
    np.maximum.at(longest, words.doc, sizes)
    hashes = lowered.hashes()
    kinds = distinct(hashes, words.doc, count) / some
    pairs = np.flatnonzero(inside(lowered, 3))
    triples = np.bincount(words.doc[pairs], minlength=count)
    varied = distinct(ngrams(hashes, 3)[pairs], words.doc[pairs], count) / np.maximum(triples, 1)
    # Entropy of the bytes of each text.
    owner = np.repeat(np.arange(count), np.diff(words.edges))
    table = np.bincount(owner * 256 + data, minlength=count * 256).reshape(count, 256)
    of = table / np.maximum(table.sum(axis=1), 1)[:, None]
    entropy = -(of * np.log(np.where(of > 0, of, 1))).sum(axis=1)
    first_capital = np.bincount(words.doc, MASKS["capitals"][data[words.starts]], count) / some
    last_stop = np.bincount(words.doc, MASKS["stops"][data[words.ends - 1]], count) / some
    root = np.sqrt
    return np.stack(
        [
            np.log1p(points), np.log1p(n), np.log1p(mean), np.log1p(spread), np.log1p(longest),
            root(share["letters"]), root(share["capitals"]), root(share["digits"]), root(share["stops"]),
            root(share["commas"]), root(share["symbols"]), root(share["others"]), root(share["breaks"]),
            root(share["vowels"]), root(wide), root(blanks), kinds, root(1 - np.minimum(varied, 1) * (triples > 0)),
            entropy, root(first_capital), root(last_stop), np.log1p(n) * kinds,
        ],
        axis=1,
    )


WIDTH = statistics(pa.array(["a"])).shape[1]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = statistics(piece.column("text"))
            edges = np.arange(piece.num_rows + 1, dtype=np.int32) * WIDTH
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()),
                 pa.ListArray.from_arrays(pa.array(edges), pa.array(found.ravel()))],
                names=["doc_id", "stats"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


class Discriminant:
    """Class means, inverse Cholesky factors and log-density constants."""

    def __init__(self, sums: np.ndarray):
        """``sums``: for classes 0 and 1 a row of (count, sums, products)."""
        self.counts = sums[:, 0]
        self.known = [c for c in (0, 1) if self.counts[c] > 0]
        n = np.maximum(self.counts, 1)
        self.means = sums[:, 1 : 1 + WIDTH] / n[:, None]
        products = sums[:, 1 + WIDTH :].reshape(2, WIDTH, WIDTH) / n[:, None, None]
        own = products - self.means[:, :, None] * self.means[:, None, :]
        pooled = (own * self.counts[:, None, None]).sum(axis=0) / max(self.counts.sum(), 1)
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
        drawn = (1 - TO_POOLED) * own + TO_POOLED * pooled + LEAST_VARIANCE * np.eye(WIDTH)
        factors = [np.linalg.cholesky(c) for c in drawn]
        self.whiten = [np.linalg.inv(f) for f in factors]
        self.constants = [
            np.log(max(self.counts[c], 1)) - np.log(np.diag(factors[c])).sum() for c in (0, 1)
        ]

    def score(self, found: np.ndarray) -> np.ndarray:
        if len(self.known) < 2:
            return np.full(len(found), float(self.known[0]) if self.known else 0.5)
        density = [
            self.constants[c] - 0.5 * (((found - self.means[c]) @ self.whiten[c].T) ** 2).sum(axis=1)
            for c in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(labelled: DataFrame) -> Discriminant:
    """The discriminant of rows (stats, label)."""
    size = 1 + WIDTH + WIDTH * WIDTH

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size))
        for batch in batches:
            found = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for label in (0, 1):
                mine = found[labels == label]
                sums[label] += np.concatenate([[len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int64()), pa.array([s.tobytes() for s in sums], pa.binary())],
            names=["block", "body"],
        )

    parts = labelled.select("stats", "label").mapInArrow(add, "block long, body binary")
    sums = np.zeros((2, size))
    for block, body in merge_blocks(parts, "float64", either=False).collect():
        sums[block] = np.frombuffer(body)
    return Discriminant(sums)


def scored(described: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score for each row of ``describe``."""
    sent = described.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sent.value.score(found), pa.float64())],
                names=["doc_id", "score"],
            )

    return described.mapInArrow(run, "doc_id long, score double")


def labelled(described: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Rows (stats, label) of the described documents that have a label of 0 or 1; others teach nothing."""
    value = F.col(column).try_cast("double")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), value.alias("value")).where("value in (0, 1)")
    return described.join(own, "doc_id").select("stats", F.col("value").cast("int").alias("label"))
