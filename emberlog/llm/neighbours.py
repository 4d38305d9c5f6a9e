"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (SAMPLE vectors, by the least hash of their ids):

1. The exact neighbour graph of the sample's distinct vectors.
2. A balanced partitioning of that graph into PARTS parts that cuts few edges: halves
   by the graph's second eigenvector, then swaps across the cut that gain most.
3. A small classifier (one hidden layer) that tells from a vector how likely its
   neighbours are in each part. It learns from the shares of a vector's own neighbours.

Index: every row goes to its most probable part. Search: a query goes to its most
probable parts, as many as hold a share ``mass`` of the probability, and all rows of
those parts are ranked by their exact distance. The share is measured, not guessed: the
true neighbours of CHECKS further vectors among all rows are found by brute force, and
``mass`` is the least with which RECALL of them are reached. Data without structure
needs most parts; data with clusters needs few.

A part may hold any share of the rows: it is cut into blocks of bounded size
(vector_blocks), and each meets only the queries sent to its part.

Rows: (query_id, rank, vec_id, score), each query's k nearest found rows, nearest first,
ties by smaller id; fewer if there are fewer rows. A query's own id is no answer. Left
out of all: rows with a null id, null, empty or zero vectors, null or non-finite
components, and vectors of another length than most have (of equally frequent lengths
the larger). Of several rows of one id the least vector counts. An empty table gives
none. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberlog.llm.hard_negatives import rows_of
from emberlog.llm.shared import stored
from emberlog.llm.vector_blocks import GROUP_ROWS, cells, matrix, numbers, one_per_id, packed

SAMPLE, CHECKS, PARTS, NEIGHBOURS = 4096, 256, 16, 10
RECALL = 0.97
HIDDEN, ROUNDS, STEP = 64, 400, 0.01


def nearest(queries: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest other rows of each query, which is the row of the same number."""
    near = np.empty((len(queries), k), np.int64)
    lengths = np.square(rows).sum(axis=1)
    for at in range(0, len(queries), 512):
        part = slice(at, min(at + 512, len(queries)))
        apart = lengths - 2 * queries[part] @ rows.T
        apart[np.arange(part.stop - at), np.arange(at, part.stop)] = np.inf
        near[part] = np.argpartition(apart, k - 1, axis=1)[:, :k]
    return near


class Graph:
    """An undirected graph of numbered points, as both directions of its edges."""

    def __init__(self, near: np.ndarray):
        here = np.repeat(np.arange(len(near)), near.shape[1])
        both = np.unique(np.stack([np.append(here, near.ravel()), np.append(near.ravel(), here)]), axis=1)
        self.a, self.b = both

    def second_vector(self, points: np.ndarray, rounds: int = 60) -> np.ndarray:
        """Close to the second eigenvector of the walk among some points."""
        place = np.full(self.a.max() + 1, -1)
        place[points] = np.arange(len(points))
        a, b = place[self.a], place[self.b]
        inside = (a >= 0) & (b >= 0)
        a, b = a[inside], b[inside]
        degree = np.bincount(a, minlength=len(points)) + 1.0
        root = np.sqrt(degree)
        first = root / np.linalg.norm(root)
        x = np.random.default_rng(1).standard_normal(len(points))
        for _ in range(rounds):
            x -= first * (first @ x)
            y = x / root
            x = 0.5 * x + 0.5 * (np.bincount(a, y[b], minlength=len(points)) + y) / root
            x /= np.linalg.norm(x) or 1.0
        return x / root

    def halves(self, points: np.ndarray, swaps: int = 20) -> np.ndarray:
        """Which of the points are in the second of two equal halves."""
        side = np.zeros(self.a.max() + 1, np.int64)
        order = points[np.argsort(self.second_vector(points), kind="stable")]
        side[order[: len(order) // 2]], side[order[len(order) // 2 :]] = -1, 1
        for _ in range(swaps):
            # How many more neighbours a point has on the other side than on its own.
            pull = -side * np.bincount(self.a, side[self.b], minlength=len(side))
            left, right = (points[side[points] == s] for s in (-1, 1))
            left, right = left[np.argsort(-pull[left])], right[np.argsort(-pull[right])]
            pairs = min(len(left), len(right))
            gain = pull[left[:pairs]] + pull[right[:pairs]]
            # Of those that gain a part is swapped, as the gains of neighbours change together.
            count = int((gain > 0).sum()) // 4
            if not count:
                break
            side[left[:count]], side[right[:count]] = 1, -1
        return side[points] > 0

    def parts(self, count: int, parts: int) -> np.ndarray:
        """The part of each point; parts are a power of two and equally large but for one point."""
        part = np.zeros(count, np.int64)
        size = 1
        while size < parts:
            for p in range(size):
                points = np.flatnonzero(part == p)
                if len(points) > 1:
                    part[points[self.halves(points)]] = p + size
            size *= 2
        return part


class Router:
    """The classifier: a vector's probability for each part."""

    def __init__(self, vectors: np.ndarray, targets: np.ndarray):
        draw = np.random.default_rng(2)
        self.middle, self.scale = vectors.mean(axis=0), vectors.std(axis=0).mean() or 1.0
        sizes = (vectors.shape[1], HIDDEN, targets.shape[1])
        self.weights = []
        for a, b in zip(sizes[:-1], sizes[1:], strict=True):
            self.weights += [draw.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros(b)]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        for step in range(1, ROUNDS + 1):
            at = draw.integers(0, len(vectors), min(len(vectors), 512))
            for w, g, (m, v) in zip(self.weights, self.slopes(vectors[at], targets[at]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def layers(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner, a, outer, b = self.weights
        x = np.clip((vectors - self.middle) / self.scale, -1e6, 1e6)
        hidden = np.maximum(x @ inner + a, 0)
        out = hidden @ outer + b
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return x, hidden, out / out.sum(axis=1, keepdims=True)

    def slopes(self, vectors: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
        x, hidden, out = self.layers(vectors)
        error = (out - targets) / len(x)
        back = (error @ self.weights[2].T) * (hidden > 0)
        decay = 1e-4
        return [x.T @ back + decay * self.weights[0], back.sum(axis=0), hidden.T @ error + decay * self.weights[2],
                error.sum(axis=0)]

    def shares(self, vectors: np.ndarray) -> np.ndarray:
        return self.layers(vectors)[2]

    def before(self, shares: np.ndarray) -> np.ndarray:
        """For each part the probability of all parts that are asked before it."""
        order = np.argsort(-shares, axis=1, kind="stable")
        ranked = np.take_along_axis(shares, order, axis=1)
        out = np.empty_like(shares)
        np.put_along_axis(out, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
        return out


def fitted(sample: np.ndarray, parts: int = PARTS) -> Router:
    """A router for the parts of the neighbour graph of some vectors; needs at least three different ones."""
    points = np.unique(sample, axis=0)
    near = nearest(points, points, min(NEIGHBOURS, len(points) - 1))
    part = Graph(near).parts(len(points), parts)
    targets = np.zeros((len(points), parts))
    # A vector's own part counts as one of its neighbours'.
    for column in (*near.T, np.arange(len(points))):
        np.add.at(targets, (np.arange(len(points)), part[column]), 1)
    return Router(points, targets / targets.sum(axis=1, keepdims=True))


def closest(ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray, own: int, query: np.ndarray, k: int):
    """Numbers and distances of the k nearest rows but the query's own, exactly."""
    rough = lengths - 2 * (rows @ query) + query @ query
    rough[ids == own] = np.inf
    if len(rows) > k:
        # Sums of squares lose some digits; all that could be among the first are looked at again.
        lost = 1e-14 * rows.shape[1] * (lengths.max() + query @ query)
        at = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + 2 * lost)
    else:
        at = np.arange(len(rows))
    at = at[ids[at] != own]
    exact = np.sqrt(np.square(rows[at] - query).sum(axis=1))
    order = np.lexsort((ids[at], exact))[:k]
    return at[order], exact[order]


def ranked(blocks: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score, part): the k nearest rows of each query in blocks of its kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for row in rows_of(batches):
            key = row["b_part"], row["b_piece"]
            if known.get("key") != key:
                rows = matrix(row, "b", "<f8")
                known = {"key": key, "ids": numbers(row, "b_ids"), "parts": numbers(row, "b_labels"), "rows": rows,
                         "lengths": np.square(rows).sum(axis=1)}
            out = []
            for own, query in zip(numbers(row, "g_ids").tolist(), matrix(row, "g", "<f8"), strict=True):
                at, score = closest(known["ids"], known["rows"], known["lengths"], own, query, k)
                out.append((np.full(len(at), own), known["ids"][at], score, known["parts"][at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                names=["query_id", "vec_id", "score", "part"],
            )

    found = cells(blocks, groups, F.lit(True)).mapInArrow(run, "query_id long, vec_id long, score double, part long")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, vector of doubles) of the most frequent length."""
    named = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).alias("label"),
        F.col("vector").cast("array<double>").alias("vector"),
    )
    sound = stored(
        one_per_id(named).where(F.exists("vector", lambda x: x != 0)).select("vec_id", "vector"), "vectors"
    )
    length = F.size("vector").alias("length")
    most = sound.groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return sound.where(F.size("vector") == (most[0]["length"] if most else 0))


def shares_of(rows: DataFrame, router, mass: float | None) -> DataFrame:
    """The rows with their most probable part, or once for each part that a query is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            shares = router.value.shares(vectors)
            if mass is None:
                at, part = np.arange(len(shares)), shares.argmax(axis=1)
            else:
                before = router.value.before(shares)
                at, part = np.nonzero((before <= mass) | (before == 0))
            rest = batch.select(["vec_id", "vector"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(part.astype(np.int64))], names=["vec_id", "vector", "part"]
            )

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>, part long")


def needed(index: DataFrame, ids: list[int], checks: np.ndarray, router: Router, k: int, recall: float) -> float:
    """The probability of parts asked before the last one, with which that share of true neighbours is reached."""
    kind = F.lit(0).cast("long").alias("kind")
    blocks = stored(packed(index.select("vec_id", "vector", F.col("part").alias("label"), kind), "<f8"), "blocks")
    rows = index.sparkSession.createDataFrame(
        [(i, v.tolist()) for i, v in zip(ids, checks, strict=True)], "vec_id long, vector array<double>"
    )
    asked = rows.select("vec_id", "vector", F.lit(0).cast("long").alias("label"), kind)
    truth = ranked(blocks, stored(packed(asked, "<f8", GROUP_ROWS), "checks"), k).select("query_id", "part").collect()
    before = dict(zip(ids, router.before(router.shares(checks)), strict=True))
    found = sorted(before[r["query_id"]][r["part"]] for r in truth)
    return float(found[min(math.ceil(recall * len(found)), len(found)) - 1]) if found else 1.0


def search(rows: DataFrame, k: int = 10, recall: float = RECALL) -> DataFrame:
    """The k nearest rows of the rows (vec_id, vector, query) that are marked as queries."""
    context = rows.sparkSession.sparkContext
    sound = usable(rows)
    marks = rows.where("query").select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    queries = sound.join(marks, "vec_id", "left_semi")
    taken = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE + CHECKS).collect()
    ids = [r["vec_id"] for r in taken]
    sample = np.array([r["vector"] for r in taken] or [[]], np.float64)[: len(taken)]
    checks, learned = sample[:CHECKS], sample[CHECKS:]
    if len(np.unique(learned, axis=0)) < 2 * PARTS:
        # Too few different vectors for parts: all rows are one.
        index, asked = (x.withColumn("part", F.lit(0).cast("long")) for x in (sound, queries))
    else:
        router = context.broadcast(fitted(learned))
        index = stored(shares_of(sound, router, None), "parts")
        asked = shares_of(queries, router, needed(index, ids[:CHECKS], checks, router.value, k, recall))
    columns = ("vec_id", "vector", F.col("part").alias("label"), F.col("part").alias("kind"))
    blocks = stored(packed(index.select(*columns), "<f8"), "blocks")
    groups = stored(packed(asked.select(*columns), "<f8", GROUP_ROWS), "queries")
    return ranked(blocks, groups, k).select("query_id", "rank", "vec_id", "score")
