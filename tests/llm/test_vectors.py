"""Hard negatives and nearest neighbours against plain code over all rows."""

import math

import numpy as np
import pytest

from emberlog.llm import hard_negatives, neighbours, vector_blocks
from emberlog.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
KIND = (
    "vec_id long, label int, vector array<float>, anchor boolean, kind string, part string, ids string, "
    "rank int, extra int, g_ids int"
)


def usable(vector):
    return vector and all(x is not None and math.isfinite(x) for x in vector)


def plain_negatives(rows, low=50, high=95):
    """(anchor, positive, rank, negative, positive score, negative score) of rows (id, label, vector, anchor)."""
    kept = {}
    for i, label, vector, anchor in rows:
        if i is not None and label is not None and usable(vector):
            whole = [math.floor(256 * float(x)) for x in vector]
            old = kept.get(i)
            key = (label, [float(x) for x in vector])
            if old is None or key < old[0]:
                kept[i] = (key, label, whole, anchor or (old is not None and old[3]))
            elif anchor:
                kept[i] = (*old[:3], True)
    kept = {i: r for i, r in kept.items() if sum(x * x for x in r[2]) < 2**62}
    out = []
    for a, (_, label, vector, anchor) in kept.items():
        if not anchor:
            continue
        scores = sorted(
            (-sum(x * y for x, y in zip(vector, v, strict=True)), i, own)
            for i, (_, own, v, _) in kept.items() if i != a and len(v) == len(vector)
        )
        positives = [(i, -s) for s, i, own in scores if own == label][:5]
        others = [(i, -s) for s, i, own in scores if own != label]
        for p, score in positives:
            found = [(i, s) for i, s in others if low * score <= 100 * s <= high * score][:3]
            out += [(a, p, rank, i, score, s) for rank, (i, s) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows):
    padded = [(*r, "k", "p", "i", 1, 2, 3) for r in rows]
    frame = spark.createDataFrame(padded, KIND).repartition(3)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    found = hard_negatives.mine_negatives(frame)
    assert found.columns == list(names)
    return sorted(tuple(r[c] for c in names) for r in found.collect())


def test_negatives_of_a_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    want = plain_negatives([
        (r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"],
         r["vec_id"] % 50 == 0) for r in rows
    ])
    got = QUERIES["op11_hard_negatives"](spark, SMALL).collect()
    assert sorted(tuple(r) for r in got) == want and len(want) > 20


def test_negatives_in_odd_tables(spark, monkeypatch):
    """Small blocks and groups, ties, copies, zero and huge vectors, several lengths, null fields."""
    monkeypatch.setattr(vector_blocks, "BLOCK_BYTES", 7 * 8 * 4)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 3)
    draw = np.random.default_rng(6)
    rows = [
        (i, int(draw.integers(0, 3)), [float(x) for x in draw.integers(-3, 4, 4) / 4], i % 4 == 0) for i in range(60)
    ]
    rows += [(100 + i, i % 2, [0.5, 0.25, 0.5, 0.75], i % 5 == 0) for i in range(30)]
    rows += [(200 + i, i % 2, [0.5, 0.25, 0.5], i % 5 == 0) for i in range(12)]
    rows += [
        (300, 1, [0.0] * 4, True), (301, 0, None, True), (302, None, [1.0] * 4, True), (None, 1, [1.0] * 4, True),
        (303, 1, [1.0, None, 1.0, 1.0], True), (304, 1, [1.0, float("nan"), 1.0, 1.0], True), (305, 1, [], True),
        (306, 1, [float("inf")] * 4, True), (307, 0, [3e38] * 4, True), (308, 0, [1e5, -1e5, 1e5, 1e5], True),
        (309, 1, [1e5, -1e5, 1e5, 9e4], True), (100, 0, [0.5, 0.25, 0.5, 0.75], True), (101, 0, [0.25] * 4, None),
    ]
    want = plain_negatives(rows)
    assert mined(spark, rows) == want and len(want) > 200
    assert mined(spark, [r for r in rows if not r[3]]) == []
    assert mined(spark, []) == []


@pytest.mark.parametrize("shape", [(40, 3), (300, 8), (500, 64)])
def test_threshold_stops_at_the_right_rows(shape):
    draw = np.random.default_rng(shape[0])
    vectors = draw.integers(-40, 41, shape)
    lists = hard_negatives.Lists(np.arange(shape[0]), np.zeros(shape[0], np.int64), vectors)
    for a in range(0, shape[0], 7):
        anchor = vectors[a] if a else np.zeros(shape[1], np.int64)
        wanted = draw.random(shape[0]) < 0.7
        scores = vectors @ anchor
        top = int(scores.max())
        low, high = np.array([top // 2, top // 3, top + 1, 5]), np.array([top, top // 2, 2 * top, 4])
        for (at, found), x, y in zip(lists.best(anchor, wanted, low, high, 3), low, high, strict=True):
            rows = [i for i in np.lexsort((np.arange(shape[0]), -scores)) if wanted[i] and x <= scores[i] <= y][:3]
            assert at.tolist() == rows and found.tolist() == scores[rows].tolist()


# ------------------------------------------------------------------- neighbours


def plain_neighbours(rows, k=10):
    """Query to its k nearest (distance, id) among rows (id, vector, query)."""
    kept = {}
    for i, vector, query in rows:
        if i is not None and usable(vector) and any(vector):
            exact = [float(np.float32(x)) for x in vector]
            old = kept.get(i)
            kept[i] = (min(exact, old[0]) if old else exact, bool(query) or bool(old and old[1]))
    sizes = [len(v) for v, _ in kept.values()]
    most = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    kept = {i: r for i, r in kept.items() if len(r[0]) == most}
    return {
        q: sorted((math.dist(v, w), i) for i, (w, _) in kept.items() if i != q)[:k]
        for q, (v, query) in kept.items() if query
    }


def searched(spark, rows, **settings):
    kind = "vec_id long, vector array<float>, query boolean, kind string, part string, label string, rank string"
    frame = spark.createDataFrame([(*r, "k", "p", "l", "r") for r in rows], kind).repartition(3)
    found = {}
    for r in neighbours.search(frame, **settings).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert all([rank for rank, _, _ in sorted(f)] == list(range(1, len(f) + 1)) for f in found.values())
    return {q: [(score, i) for _, score, i in sorted(f)] for q, f in found.items()}


def recall(found, true):
    hits = sum(len({i for _, i in found.get(q, [])} & {i for _, i in near}) for q, near in true.items())
    return hits / sum(map(len, true.values()))


def test_neighbours_of_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    true = plain_neighbours([(r["vec_id"], r["embedding"], r["vec_id"] % 100 == 0) for r in rows])
    got = QUERIES["op12_neighbours"](spark, "/root/testdata/sf0.1").collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    vectors = {r["vec_id"]: r["embedding"] for r in rows}
    for q, listed in found.items():
        assert [rank for rank, _, _ in sorted(listed)] == list(range(1, 11))
        assert [i for _, _, i in sorted(listed)] == [i for _, i in sorted((s, i) for _, s, i in listed)]
        assert all(s == pytest.approx(math.dist(vectors[q], vectors[i]), rel=1e-13) for _, s, i in listed)
    assert recall({q: [(s, i) for _, s, i in f] for q, f in found.items()}, true) >= 0.93


def test_neighbours_in_clusters_ask_few_parts(spark, monkeypatch):
    """Clusters and many copies: nearly all neighbours are found without reading most rows."""
    monkeypatch.setattr(neighbours, "SAMPLE", 1200)
    draw = np.random.default_rng(9)
    centres = draw.standard_normal((40, 12)) * 4
    rows = [(i, (centres[i % 40] + 0.4 * draw.standard_normal(12)).tolist(), i % 50 == 0) for i in range(4000)]
    rows += [(10_000 + i, centres[3].tolist(), i % 100 == 0) for i in range(900)]
    read = []
    real = neighbours.shares_of
    monkeypatch.setattr(neighbours, "shares_of", lambda r, router, mass: read.append(mass) or real(r, router, mass))
    asked = []
    packer = neighbours.packed
    monkeypatch.setattr(neighbours, "packed", lambda r, *a: asked.append(r) or packer(r, *a))
    true = plain_neighbours(rows)
    found = searched(spark, rows)
    assert recall(found, true) >= 0.9 and len(found) == len(true)
    assert asked[-1].count() < 0.4 * neighbours.PARTS * len(true)
    # Copies are at no distance, and the smallest ids come first.
    assert found[10_100] == [(0.0, 10_000 + i) for i in range(10)]


def test_neighbours_in_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_BYTES", 5 * 8 * 3)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 2)
    rows = [
        (1, [1.0, 0.0, 2.0], True), (2, [1.0, 0.0, 2.0], True), (3, [0.0, 0.0, 0.0], True), (4, None, True),
        (5, [], True), (6, [1.0, None, 1.0], True), (7, [float("nan"), 1.0, 1.0], True), (8, [1.0, 2.0], True),
        (None, [1.0, 1.0, 1.0], True), (9, [1e30, -1e30, 3e38], True), (10, [1e-30, 0.0, 0.0], None),
        (11, [float("inf"), 1.0, 1.0], True), (2, [1.0, 0.0, 2.0], False), (12, [5.0, 5.0, 5.0], True),
        (12, [4.0, 5.0, 5.0], True), *[(20 + i, [0.5, 0.5, 0.25 * (i // 4)], i % 3 == 0) for i in range(16)],
    ]
    true, found = plain_neighbours(rows), searched(spark, rows)
    assert set(found) == set(true)
    for q, near in true.items():
        assert [i for _, i in found[q]] == [i for _, i in near]
        assert [s for s, _ in found[q]] == pytest.approx([s for s, _ in near], rel=1e-12)
    few = searched(spark, rows[:2])
    assert few == {1: [(0.0, 2)], 2: [(0.0, 1)]}
    assert searched(spark, rows[:1]) == {} and searched(spark, []) == {}
    assert searched(spark, [(i, v, False) for i, v, _ in rows]) == {}


def test_parts_are_balanced_and_cut_few_edges():
    draw = np.random.default_rng(3)
    points = np.concatenate([draw.standard_normal((100, 6)) + 9 * c for c in np.eye(6)[[0, 1, 2, 3]]])
    graph = neighbours.Graph(neighbours.nearest(points, points, 8))
    part = graph.parts(len(points), 4)
    assert np.bincount(part).tolist() == [100] * 4
    assert (part[graph.a] != part[graph.b]).mean() < 0.05
    near = neighbours.nearest(points, points, 8)
    for i in (0, 57, 399):
        apart = np.square(points - points[i]).sum(axis=1)
        apart[i] = np.inf
        assert set(near[i]) == set(np.argsort(apart)[:8])
