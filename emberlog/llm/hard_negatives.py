"""Hard-negative mining by the threshold algorithm.

Vectors are rows of integers, floor(256 * x) of each component; the score of a row
with an anchor is their inner product. An anchor's positives are its best rows of its
own label. For each positive a window of scores is mined: from ``low`` to ``high``
percent of the positive's score, the best rows of other labels.

Candidates are packed into blocks (vector_blocks). Every block has its rows listed in
the order of each dimension. For an anchor the lists are read from the end that its
sign favours, all to the same depth, which doubles each round. Rows met for the first
time are scored at once, on their whole vectors. The sum of the anchor's components
times the last values read bounds the score of all rows not met. Reading stops when
for every window that bound lies strictly below the window's kth score so far (a tie
could still have a smaller id) or below the window. With many dimensions nearly all
rows are met early on; reading then ends with the rows. Blocks answer on their own,
the best of all their answers are the result.

Positives meet only blocks that hold the anchor's label, negatives all but blocks of
that label alone. Work grows with anchors times rows, as the question does.

Rows: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). A
window that no row lies in has none; so has a positive with a score below zero, whose
window is empty. Left out of all: rows with a null id, label or vector, empty vectors,
null or non-finite components, and vectors whose integer square length reaches 2**62,
as their scores may not fit a long. Vectors of different lengths never meet. Of
several rows of one id the least (label, vector) counts. Ties go to the smaller id.
An empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberlog.llm.shared import stored
from emberlog.llm.vector_blocks import GROUP_ROWS, cells, matrix, numbers, one_per_id, packed

SCALE = 256
FIRST_DEPTH = 16
# Products and sums below this are exact as doubles.
EXACT = 2.0**53
OPEN = 1 << 62


class Lists:
    """The rows of a block, and their order in each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels = ids, labels
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T).astype(np.int32)
        self.values = np.ascontiguousarray(np.sort(vectors, axis=0).T).astype(np.float64)
        longest = np.square(vectors.astype(np.float64)).sum(axis=1).max()
        self.exact = longest < EXACT
        self.vectors = vectors.astype(np.float64) if self.exact else vectors

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        # An inner product is at most the product of the lengths.
        if self.exact and np.square(anchor.astype(np.float64)).sum() < EXACT:
            return (self.vectors[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows].astype(np.int64) @ anchor

    def best(
        self, anchor: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores the rows and scores of its k best wanted rows."""
        count = len(self.ids)
        falls = anchor < 0
        rises = np.flatnonzero(~falls)
        falls = np.flatnonzero(falls)
        factors = anchor.astype(np.float64)
        met = np.zeros(count, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, depth = 0, min(FIRST_DEPTH, count)
        least, most = (low.min(), high.max()) if len(low) else (1, 0)
        open_ = least <= most
        while open_:
            now = np.zeros(count, bool)
            now[self.order[rises, count - depth : count - done].ravel()] = True
            now[self.order[falls, done:depth].ravel()] = True
            new = np.flatnonzero(now & ~met & wanted)
            met |= now
            found = self.scores(new, anchor)
            inside = (found >= least) & (found <= most)
            rows, scores = np.concatenate([rows, new[inside]]), np.concatenate([scores, found[inside]])
            if depth == count or met.all():
                break
            bound = self.values[rises, count - depth] @ factors[rises] + self.values[falls, depth - 1] @ factors[falls]
            # A little above, for what doubles lose.
            bound += 1e-9 * (np.abs(factors) @ np.maximum(np.abs(self.values[:, 0]), np.abs(self.values[:, -1])))
            open_ = False
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                if a > b or bound < a:
                    continue
                own = scores[(scores >= a) & (scores <= b)]
                if len(own) < k or bound >= np.partition(own, -k)[-k]:
                    open_ = True
                    break
            done, depth = depth, min(2 * depth, count)
        out = []
        for a, b in zip(low, high, strict=True):
            at = np.flatnonzero((scores >= a) & (scores <= b))
            if len(at) > k:
                at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
            at = at[np.lexsort((self.ids[rows[at]], -scores[at]))][:k]
            out.append((rows[at], scores[at]))
        return out


def integer_rows(rows: DataFrame) -> DataFrame:
    """The rows with whole-number vectors; those too long for whole-number scores left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, parts = [], []
            for at, vector in enumerate(batch.column("vector")):
                whole = np.floor(SCALE * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.square(whole).sum() < OPEN:
                    kept.append(at)
                    parts.append(whole.astype(np.int64))
            edges = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
            flat = pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]))
            rest = batch.select(["vec_id", "label", "anchor"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.ListArray.from_arrays(edges, flat)], names=["vec_id", "label", "anchor", "vector"]
            )

    return rows.mapInArrow(run, "vec_id long, label long, anchor boolean, vector array<long>")


def lists_of(row: dict, known: dict) -> Lists:
    """The lists of a row's block; the last block's are kept."""
    key = (row["b_part"], row["b_piece"])
    if known.get("key") != key:
        known["key"] = key
        known["lists"] = Lists(numbers(row, "b_ids"), numbers(row, "b_labels"), matrix(row, "b", "<i8"))
    return known["lists"]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(name)[at].as_py() for name in batch.schema.names}


def leading(found: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives_of(blocks: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Rows (anchor_id, positive_id, positive_score): each anchor's k best rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        everything = np.array([-OPEN]), np.array([OPEN])
        for row in rows_of(batches):
            lists, out = lists_of(row, known), []
            for anchor, label, vector in zip(
                numbers(row, "g_ids").tolist(), numbers(row, "g_labels").tolist(), matrix(row, "g", "<i8"), strict=True
            ):
                wanted = (lists.labels == label) & (lists.ids != anchor)
                if wanted.any():
                    (at, scores), = lists.best(vector, wanted, *everything, k)
                    out.append((np.full(len(at), anchor), lists.ids[at], scores))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                    names=["anchor_id", "positive_id", "positive_score"],
                )

    meet = (F.col("b_low") <= F.col("g_high")) & (F.col("g_low") <= F.col("b_high"))
    found = cells(blocks, groups, meet).mapInArrow(run, "anchor_id long, positive_id long, positive_score long")
    return leading(found, ["anchor_id"], "positive_score", "positive_id", k).drop("rank")


def windows_of(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores s with low * p <= 100 * s <= high * p, for each positive score p."""
    each = [(-(-low * p // 100), high * p // 100) for p in scores.tolist()]
    return np.array([a for a, _ in each], np.int64), np.array([b for _, b in each], np.int64)


def mine_negatives(
    rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, vector, anchor) that are marked as anchors."""
    named = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", "anchor"
    ).where(F.col("label").isNotNull())
    # The mark goes with the id, so rows of one id are one anchor.
    marks = named.where("anchor").select("vec_id").distinct().withColumn("anchor", F.lit(True))
    whole = stored(
        integer_rows(
            one_per_id(named).join(marks, "vec_id", "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
        )
        .withColumn("kind", F.size("vector").cast("long")),
        "vectors",
    )
    blocks = stored(packed(whole, "<i8"), "blocks")
    anchors = whole.where("anchor")
    first = stored(positives_of(blocks, stored(packed(anchors, "<i8", GROUP_ROWS), "anchors"), positives), "positives")
    asked = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("p")
    )
    again = stored(packed(with_positives(anchors, asked, positives), "<i8", GROUP_ROWS, "found"), "anchors")
    return negatives_of(blocks, again, positives, negatives, low, high)


def with_positives(anchors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The anchors with k pairs (id, score) each, as bytes; unused ones have a score of -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for found in batch.column("p").to_pylist():
                body = np.full((k, 2), -1, "<i8")
                for at, one in enumerate(found):
                    body[at] = one["positive_id"], one["positive_score"]
                bodies.append(body.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["vec_id", "label", "kind", "vector"]).columns, pa.array(bodies, pa.binary())],
                names=["vec_id", "label", "kind", "vector", "found"],
            )

    return anchors.join(asked, "vec_id").mapInArrow(
        run, "vec_id long, label long, kind long, vector array<long>, found binary"
    )


def negatives_of(
    blocks: DataFrame, groups: DataFrame, positives: int, k: int, low: int, high: int
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for row in rows_of(batches):
            lists, out = lists_of(row, known), []
            windows = np.frombuffer(row["g_extra"], "<i8").reshape(row["g_n"], positives, 2)
            for anchor, label, vector, own in zip(
                numbers(row, "g_ids").tolist(), numbers(row, "g_labels").tolist(), matrix(row, "g", "<i8"), windows,
                strict=True,
            ):
                # A score below zero has no window.
                own = own[own[:, 1] >= 0]
                best = lists.best(vector, lists.labels != label, *windows_of(own[:, 1], low, high), k)
                for (positive, score), (at, scores) in zip(own.tolist(), best, strict=True):
                    if len(at):
                        out.append((*[np.full(len(at), x) for x in (anchor, positive, score)], lists.ids[at], scores))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                    names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
                )

    one = (F.col("b_low") == F.col("b_high")) & (F.col("g_low") == F.col("g_high")) & (F.col("b_low") == F.col("g_low"))
    found = cells(blocks, groups, ~one).mapInArrow(
        run, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    return leading(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", k).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
