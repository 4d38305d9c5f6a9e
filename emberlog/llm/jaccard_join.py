"""N-gram Jaccard join of whole texts by set relations.

A text's set are its distinct shingles of ``n`` words with A-Z lowered. Two texts
link when 100 * intersection >= ``percent`` * union.

Index: every set is listed under its prefix, the first shingles in one order for
all sets (rarest first, by counters over the whole corpus, then by hash). Linked
sets share a listed shingle. An index list is laid out in blocks of set sizes
that differ by less than the threshold allows, so a set meets its own block and
the one below and skips the others; inside them the positions of the shared
shingle bound the overlap from above and skip pairs that cannot reach it.

Answers: equal sets are one class. Each list is first answered for one pivot, so
there are never more such pairs than list entries. A set that links to a pivot
takes the pivot's answers: within a connected class nothing more is computed.
Sets of one pivot differ by what their counted intersections with it say: if two
such distances are too far apart the sets cannot link (triangle inequality).
Parities of the sets rule out most other pairs before any text is read again.
What is left, pairs of different classes that pass all bounds, is counted exactly
as well, so no link between classes is lost.

The order of shingles only moves work: counters share cells, results never
depend on them. Class keys and set members are hashes of 128 and 64 bits.

Rows: one for each input row. Null or empty texts have the empty set and link
with nothing, also not with each other; a null doc_id gets a null component. Rows
of the same doc_id are one document with one component. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.shared import BitSet, blocks_of, components, gathered, merge_blocks, stored
from emberlog.llm.words import U64, Words, mix, ngrams, pieces, signed

# Cells of the counters that put rare shingles first; a fixed size.
LOG_CELLS = 20


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts and where those of each text begin.

    A text with fewer than n words has one shingle, its whole sequence.
    """
    hashes = words.hashes()
    grams = ngrams(hashes, n)
    counts, first = words.counts, words.first[:-1]
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    edges = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=edges[1:])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(edges[-1]) - edges[doc] + first[doc]
    out = grams[np.minimum(place, max(len(grams) - 1, 0))] if len(grams) else np.zeros(edges[-1], U64)
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        short = hashes[first[i] : first[i] + counts[i]]
        out[edges[i]] = mix(ngrams(short, int(counts[i])) + U64(int(counts[i])))[0]
    return out, edges


def sets(piece: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    found, edges = shingles(Words(piece.column("text"), lower=True), n)
    return [np.unique(found[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def prefix_size(size: int, percent: int) -> int:
    """So many first shingles of a set hold one of any set it links with."""
    return size - -(-percent * size // 100) + 1


def parities(member: np.ndarray) -> bytes:
    """For each of some places whether an odd number of the set's members falls on it.

    There are about half as many places as members, a power of two. Two sets
    differ in at least as many members as their parities differ in places.
    """
    places = 64
    while 2 * places < len(member):
        places *= 2
    odd = np.bincount((member & U64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Places in which two parities differ; the longer one is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the parities of their sets do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.to_pydict()
            keep = [
                apart(x, y) * (100 + percent) <= (100 - percent) * both
                for x, y, both in zip(of["of_a"], of["of_b"], of["sizes"], strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = classes.groupBy("class_id").agg(F.first("n_shingles").alias("size"), F.first("parities").alias("of"))
    joined = (
        pairs.join(one.select(F.col("class_id").alias("a"), F.col("size").alias("s"), F.col("of").alias("of_a")), "a")
        .join(one.select(F.col("class_id").alias("b"), F.col("size").alias("t"), F.col("of").alias("of_b")), "b")
    )
    return joined.select("a", "b", "of_a", "of_b", (F.col("s") + F.col("t")).alias("sizes")).mapInArrow(
        run, "a long, b long"
    )


def summaries(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: a set's size, class key and parities, and counters of shingles in blocks."""
    cells = 1 << LOG_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(cells, np.uint32)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()),
             ("parities", pa.binary()), ("block", pa.int64()), ("body", pa.binary())]
        )

        def rows(**known):
            size = len(next(iter(known.values())))
            return pa.RecordBatch.from_arrays(
                [known.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema
            )

        for piece in pieces(batches):
            members = sets(piece, n)
            for member in members:
                np.add.at(counters, (member >> U64(64 - LOG_CELLS)).astype(np.int64), np.uint32(1))
            yield rows(
                doc_id=piece.column("doc_id").cast(pa.int64()),
                n_shingles=pa.array([len(m) for m in members], pa.int64()),
                key_a=signed(np.array([m.sum(dtype=U64) for m in members], U64)),
                key_b=signed(np.array([mix(m ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) for m in members], U64)),
                parities=pa.array([parities(m) for m in members], pa.binary()),
            )
        blocks = blocks_of(counters)
        if blocks.num_rows:
            yield rows(block=blocks.column(0), body=blocks.column(1))

    return docs.mapInArrow(
        run, "doc_id long, n_shingles long, key_a long, key_b long, parities binary, block long, body binary"
    )


def least_overlap(a, b, percent: int):
    """The intersection that sets of these sizes need, as a column."""
    return F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent))


def may_link(percent: int):
    """Bounds from sizes and positions for entries x and y of one list."""
    need = least_overlap("x_size", "y_size", percent)
    rest = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    smaller, larger = F.least("x_size", "y_size"), F.greatest("x_size", "y_size")
    return (100 * smaller >= percent * larger) & (rest >= need)


def linked(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) with the sizes of their sets' intersection and union, counted on whole texts."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    bits = BitSet(ids)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(bits.named(batches)):
            found = sets(piece, n)
            edges = np.cumsum([0, *map(len, found)])
            flat = signed(np.concatenate([*found, np.zeros(0, U64)]))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat)],
                names=["doc_id", "members"],
            )

    wanted = (
        docs.mapInArrow(members, "doc_id long, members array<long>")
        .join(ids, "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
    )
    both = pairs.join(
        wanted.select(F.col("doc_id").alias("a"), F.col("members").alias("of_a")), "a"
    ).join(wanted.select(F.col("doc_id").alias("b"), F.col("members").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    counted = both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return counted.select(
        "a", "b", "shared", (F.col("sizes") - F.col("shared")).alias("either"),
        (100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).alias("links"),
    )


def jaccard_components(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for each row."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    summary = stored(summaries(docs, n), "sets")
    sets_of = summary.where(F.col("n_shingles").isNotNull())
    each = sets_of.select("doc_id", "n_shingles", "key_a", "key_b")
    counters = gathered(
        merge_blocks(summary.where(F.col("block").isNotNull()).select("block", "body"), "uint32", either=False),
        1 << LOG_CELLS, "uint32",
    )
    sent = spark.sparkContext.broadcast(counters)
    # A set links with another only if it can lose a shingle and still pass.
    smallest = -(-percent // (100 - percent))
    filled = sets_of.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(
        filled.groupBy("n_shingles", "key_a", "key_b").agg(
            F.min("doc_id").alias("class_id"), F.min("parities").alias("parities")
        ),
        "classes",
    )

    def entries(batches: Iterator[pa.RecordBatch], live: BitSet | None) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            rows = []
            for at, member in enumerate(sets(piece, n)):
                if len(member) < smallest:
                    continue
                count = prefix_size(len(member), percent)
                often = sent.value[(member >> U64(64 - LOG_CELLS)).astype(np.int64)]
                if count < len(member):
                    # All that can be among the first, then in order; ties by hash.
                    bound = np.partition(often, count - 1)[count - 1]
                    near = np.flatnonzero(often <= bound)
                    chosen = near[np.argsort(often[near], kind="stable")][:count]
                else:
                    chosen = np.argsort(often, kind="stable")
                place = np.arange(len(chosen))
                tokens = member[chosen]
                if live is not None:
                    on = live.passes(tokens.view(np.int64))
                    tokens, place = tokens[on], place[on]
                if len(tokens):
                    rows.append((ids[at], len(member), member.sum(dtype=U64), tokens, place))
            if not rows:
                continue
            repeats = [len(r[3]) for r in rows]
            tokens = signed(np.concatenate([r[3] for r in rows]))
            if live is None:
                keys = signed(np.repeat(np.array([r[2] for r in rows], U64), repeats))
                yield pa.RecordBatch.from_arrays([tokens, keys], names=["token", "key_a"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [tokens, pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), repeats)),
                     pa.array(np.repeat(np.array([r[1] for r in rows], np.int64), repeats)),
                     pa.array(np.concatenate([r[4] for r in rows]).astype(np.int64))],
                    names=["token", "doc_id", "size", "place"],
                )

    known = docs.where(F.col("doc_id").isNotNull())
    # Shingles in the prefixes of two different sets; all other lists answer nothing.
    live = stored(
        known.mapInArrow(lambda b: entries(b, None), "token long, key_a long")
        .groupBy("token").agg(F.min("key_a").alias("low"), F.max("key_a").alias("high"))
        .where("low <> high").select("token"),
        "live",
    )
    bits = BitSet(live)
    index = stored(
        known.mapInArrow(lambda b: entries(b, bits), "token long, doc_id long, size long, place long")
        .join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
        .join(live, "token", "left_semi"),
        "index",
    )
    x = index.select("token", *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "size", "place")])
    pivots = (
        index.groupBy("token")
        .agg(F.min(F.struct("doc_id", "size", "place")).alias("y"), F.count("*").alias("entries"))
        .where("entries > 1")
        .select("token", *[F.col(f"y.{c}").alias(f"y_{c}") for c in ("doc_id", "size", "place")])
    )
    first = (
        x.join(pivots, "token")
        .where((F.col("x_doc_id") > F.col("y_doc_id")) & may_link(percent))
        .select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct()
    )
    first = stored(near_enough(first, classes, percent), "pairs")
    stars = stored(linked(docs, first, n, percent), "stars")
    joined = components(stars.where("links").select("a", "b"))
    labels = classes.select(F.col("class_id").alias("id")).join(joined, "id", "left").select(
        F.col("id").alias("doc_id"), F.coalesce("component", "id").alias("component")
    )
    # What is known of each set from its nearest pivot, if it has one.
    near = stars.groupBy(F.col("a").alias("doc_id")).agg(
        F.max_by(F.struct("b", "shared", "either"), F.struct(F.col("shared") / F.col("either"), -F.col("b"))).alias("p")
    ).select(
        "doc_id", F.col("p.b").alias("pivot"), ((F.col("p.either") - F.col("p.shared")) / F.col("p.either")).alias("away")
    )
    placed = index.join(labels, "doc_id").join(near, "doc_id", "left")
    # Blocks of sizes: sets of one list can link only in the same or a neighbouring block.
    block = F.floor(F.log(F.col("size")) / F.log(F.lit(100 / percent)) + 1e-9)
    placed = placed.withColumn("block", block.cast("long"))
    fields = ("doc_id", "size", "place", "component", "pivot", "away")
    open_lists = (
        placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high").select("token")
    )
    placed = stored(placed.join(open_lists, "token", "left_semi"), "open")
    meets = placed.select("token", *[F.col(c).alias(f"x_{c}") for c in fields], F.explode(
        F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    others = placed.select("token", "block", *[F.col(c).alias(f"y_{c}") for c in fields])
    slack = 1 - percent / 100 + 1e-9
    far = F.coalesce(
        (F.col("x_pivot") == F.col("y_pivot")) & (F.abs(F.col("x_away") - F.col("y_away")) > slack), F.lit(False)
    )
    rest = meets.join(others, ["token", "block"]).where(
        (F.col("x_doc_id") > F.col("y_doc_id")) & (F.col("x_component") != F.col("y_component"))
        & may_link(percent) & ~far
    )
    rest = (
        rest.select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct()
        .join(stars.select("a", "b"), ["a", "b"], "left_anti")
    )
    rest = stored(near_enough(rest, classes, percent), "pairs")
    more = linked(docs, rest, n, percent).where("links").select("a", "b")
    edges = reduce(DataFrame.union, [stars.where("links").select("a", "b"), more])
    final = components(edges).select(F.col("id").alias("class_id"), "component")
    named = classes.join(final, "class_id", "left").select(
        "n_shingles", "key_a", "key_b", F.coalesce("component", "class_id").alias("component_id")
    )
    result = each.join(named, ["n_shingles", "key_a", "key_b"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    return result


def one_of_each(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the first of their component, with their columns."""
    kept = jaccard_components(documents, n, percent).where(
        F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )
    ids = kept.select("doc_id").distinct()
    return documents.join(ids, documents["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
