"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared without case (A-Z) and ASCII punctuation. Every sequence of
``SEED_WORDS`` words of a test item is a seed. Training texts are read once for
places of seeds; a bit set of all seeds passes over the rest.

Seeds that few texts or few items have (``FEW``) join texts to items as they are: such
a join has at most a few times as many pairs as the larger side. Seeds of many texts
and many items, everyday phrases or edited copies that are copied often, join only
together with a rare word. An alignment that passes holds a share ``least`` of the
words of the whole item, or of some LONG_RUN words of it in a row. So whichever words
are set aside, if they are fewer than that share, one of the others is in the text:
those set aside are the most frequent of the corpus, and the text must have one of
the others. No pair is lost by that, and a phrase alone makes none.

The passage around the seeds of a pair, of the item's length and as much more on both
sides as a copy can have words put in, is aligned with the item word by word, unless
too few of the item's words are in it for any alignment to pass. A pair counts as
copied if its score reaches ``least`` of what an exact copy scores, which edited and
paraphrased copies still do. A part of an item counts as well: LONG_RUN or more of its
words in a row that are aligned with at least ``least`` of what an exact copy of just
these scores.

Rows: (doc_id, item_id) pairs, once each, with the best score as a share of the
whole item's, which is below ``least`` where only a part is copied. Null texts have no
words; null ids are never matched. An item with fewer than SEED_WORDS words is
too short to be told from chance and is never matched. Repeated rows of either
table change nothing. Passages of very long texts are cut out and aligned one by one; an
alignment keeps one row of numbers as long as the passage. Only the named columns are
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.shared import BitSet, blocks_of, gathered, merge_blocks, rows_named, stored
from emberlog.llm.words import U64, Words, inside, mix, ngrams, pieces, signed

SEED_WORDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SIMILARITY = 0.5
# Words of an item that count as copied however long the item is. Passages that texts
# share with an item by chance are far shorter: 6 words at most in the given tables.
LONG_RUN = 20
# A seed of more texts and more items than this joins only together with a rare word.
FEW = 4
# Counters of words over the corpus, which tell rare ones; they change no result.
LOG_CELLS = 18


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id and the hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = Words(piece.column("text"), plain=True)
            yield pa.RecordBatch.from_arrays(
                [piece.column("item_id").cast(pa.int64()),
                 pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), signed(words.hashes()))],
                names=["item_id", "words"],
            )

    return (
        benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
        .mapInArrow(run, "item_id long, words array<long>").where(F.size("words") >= SEED_WORDS)
    )


def item_seeds(items: DataFrame) -> DataFrame:
    """Rows (seed, item_id, at, size), one for each sequence of SEED_WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("words").offsets.to_numpy())
            flat = batch.column("words").flatten().to_numpy(zero_copy_only=False).view(U64)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            first = np.cumsum(sizes) - sizes
            grams = ngrams(flat, SEED_WORDS)
            whole = np.flatnonzero(owner[: len(grams)] == owner[SEED_WORDS - 1 :][: len(grams)])
            ids = batch.column("item_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [signed(grams[whole]), pa.array(ids[owner[whole]], pa.int64()),
                 pa.array((whole - first[owner[whole]]).astype(np.int64)),
                 pa.array(sizes[owner[whole]].astype(np.int64))],
                names=["seed", "item_id", "at", "size"],
            )

    return items.mapInArrow(run, "seed long, item_id long, at long, size long")


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - LOG_CELLS)).astype(np.int64)


def seed_places(docs: DataFrame, seeds: BitSet) -> DataFrame:
    """Rows (seed, doc_id, place) of sequences that may be seeds, and counters of words in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << LOG_CELLS, np.int64)
        kinds = [("seed", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("block", pa.int64()),
                 ("body", pa.binary())]
        schema = pa.schema(kinds)

        def rows(**known):
            size = len(next(iter(known.values())))
            return pa.RecordBatch.from_arrays([known.get(n, pa.nulls(size, k)) for n, k in kinds], schema=schema)

        for piece in pieces(batches):
            words = Words(piece.column("text"), plain=True)
            hashes = words.hashes()
            counters += np.bincount(cell_of(hashes), minlength=len(counters))
            grams = ngrams(hashes, SEED_WORDS)
            found = np.flatnonzero(inside(words, SEED_WORDS) & seeds.passes(grams.view(np.int64)))
            if len(found):
                doc = words.doc[found]
                yield rows(
                    seed=signed(grams[found]), doc_id=piece.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                    place=pa.array((found - words.first[doc]).astype(np.int64)),
                )
        blocks = blocks_of(counters)
        if blocks.num_rows:
            yield rows(block=blocks.column(0), body=blocks.column(1))

    return docs.mapInArrow(run, "seed long, doc_id long, place long, block long, body binary")


def telling_words(words: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """Distinct words of an item of which every text that copies it, in whole or in part, has one.

    Of the whole item, and of each LONG_RUN words in a row, all words but the most
    frequent ones, which are too few to make a copy without them.
    """

    def rarest(size: int) -> int:
        return size - math.ceil(least * size) + 1

    order = np.lexsort((words, often))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    taken = place < rarest(len(words))
    if len(words) > LONG_RUN:
        near = np.lib.stride_tricks.sliding_window_view(place, LONG_RUN)
        chosen = np.argpartition(near, rarest(LONG_RUN) - 1, axis=1)[:, : rarest(LONG_RUN)]
        taken[np.unique(chosen + np.arange(len(near))[:, None])] = True
    return np.unique(words[taken])


def together(seeds: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One key for a seed and a word."""
    return mix(seeds ^ mix(words))


def item_keys(items: DataFrame, common: DataFrame, counters, least: float) -> DataFrame:
    """Rows (key, item_id): each common seed of an item with each of its telling words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, words, seeds in zip(*[batch.column(c) for c in ("item_id", "words", "seeds")], strict=True):
                hashes = words.values.to_numpy(zero_copy_only=False).view(U64)
                told = telling_words(hashes, counters.value[cell_of(hashes)], least)
                found = seeds.values.to_numpy(zero_copy_only=False).view(U64)
                keys = together(np.repeat(found, len(told)), np.tile(told, len(found)))
                out.append((keys, np.full(len(keys), number.as_py(), np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate([k for k, _ in out])), pa.array(np.concatenate([i for _, i in out]))],
                    names=["key", "item_id"],
                )

    own = item_seeds(items).join(common, "seed", "left_semi").groupBy("item_id").agg(
        F.collect_set("seed").alias("seeds")
    )
    return items.join(own, "item_id").select("item_id", "words", "seeds").mapInArrow(run, "key long, item_id long")


def text_keys(docs: DataFrame, common: BitSet, keys: BitSet) -> DataFrame:
    """Rows (key, doc_id): what may be a common seed and a telling word of one item, both in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = Words(piece.column("text"), plain=True)
            hashes = words.hashes()
            grams = ngrams(hashes, SEED_WORDS)
            found = np.flatnonzero(inside(words, SEED_WORDS) & common.passes(grams.view(np.int64)))
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            doc = words.doc[found]
            for at in np.unique(doc).tolist():
                own = np.unique(hashes[words.first[at] : words.first[at + 1]])
                for seed in np.unique(grams[found[doc == at]]):
                    both = together(np.full(len(own), seed), own)
                    both = both[keys.passes(both.view(np.int64))]
                    if len(both):
                        yield pa.RecordBatch.from_arrays(
                            [signed(both), pa.array(np.full(len(both), ids[at], np.int64))], names=["key", "doc_id"]
                        )

    return docs.mapInArrow(run, "key long, doc_id long")


def candidates(
    docs: DataFrame, items: DataFrame, held: DataFrame, asked: DataFrame, counters: np.ndarray, least: float
) -> DataFrame:
    """Rows (doc_id, item_id) once each: all pairs with a seed in common that can pass."""
    spread = held.groupBy("seed").agg(F.count("*").alias("texts")).join(
        asked.groupBy("seed").agg(F.count("*").alias("items")), "seed"
    )
    spread = stored(spread, "spread")
    rare = spread.where(F.least("texts", "items") <= FEW).select("seed")
    pairs = (
        held.join(rare, "seed", "left_semi").join(asked, "seed").select("doc_id", "item_id")
    )
    common = spread.where(F.least("texts", "items") > FEW).select("seed")
    count = common.count()
    if count:
        sent = docs.sparkSession.sparkContext.broadcast(counters)
        keys = stored(item_keys(items, common, sent, least), "keys")
        bits = BitSet(keys.select("key"), keys.count())
        named = text_keys(docs, BitSet(common, count), bits).join(keys, "key").select("doc_id", "item_id")
        pairs = pairs.union(named)
    return stored(pairs.distinct(), "candidates")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score and the item and passage places just after it."""
    row = np.zeros(len(passage) + 1, np.int64)
    drift = np.arange(1, len(passage) + 1) * GAP
    best, item_end, end = 0, 0, 0
    for i, word in enumerate(item):
        reached = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        np.maximum(reached, row[1:] + GAP, out=reached)
        np.maximum(reached, 0, out=reached)
        # Gaps along the row: the best of all earlier places less one step each.
        row[1:] = np.maximum.accumulate(reached - drift) + drift
        top = int(row.argmax())
        if row[top] > best:
            best, item_end, end = int(row[top]), i + 1, top
    return best, item_end, end


def runs_long(item: np.ndarray, passage: np.ndarray, least: float) -> bool:
    """Whether LONG_RUN item words or more are aligned with ``least`` of their full score.

    Each item word costs ``least`` of a match, so only alignments of that share
    stay above zero; of equal ones the longest is held. A cell is a score in
    thousandths, and in its low bits the number of item words.
    """
    bits = 24
    cost = round(1000 * least * MATCH)
    same, other, skip = (((1000 * score - cost) << bits) + 1 for score in (MATCH, MISMATCH, GAP))
    row = np.zeros(len(passage) + 1, np.int64)
    drift = np.arange(1, len(passage) + 1) * ((1000 * GAP) << bits)
    for word in item:
        match = passage == word
        reached = row[:-1] + np.where(match, same, other)
        if ((reached[match] & ((1 << bits) - 1)) >= LONG_RUN).any():
            return True
        np.maximum(reached, row[1:] + skip, out=reached)
        np.maximum(reached, 0, out=reached)
        row[1:] = np.maximum.accumulate(reached - drift) + drift
    return False


def aligned(rows: DataFrame, least: float) -> DataFrame:
    """Rows (doc_id, item_id, first, passage, words) aligned; those copied in whole or in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("doc_id", "item_id", "first", "passage", "words")]
            for at in range(batch.num_rows):
                doc, number, first = (columns[i][at].as_py() for i in range(3))
                passage, item = (columns[i][at].values.to_numpy(zero_copy_only=False) for i in (3, 4))
                # A score is at most MATCH for each item word that the passage has.
                lowest = least * MATCH * min(len(item), LONG_RUN)
                if MATCH * np.isin(item, passage).sum() < lowest:
                    continue
                score, item_end, end = align(item, passage)
                if score < least * MATCH * len(item) and (score < lowest or not runs_long(item, passage, least)):
                    continue
                # The same from its end backwards gives its beginning.
                _, _, back = align(item[:item_end][::-1], passage[:end][::-1])
                out.append((doc, number, score / (MATCH * len(item)), first + end - back, first + end))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*out, strict=True)],
                    names=["doc_id", "item_id", "similarity", "first_word", "end_word"],
                )

    return rows.mapInArrow(
        run, "doc_id long, item_id long, similarity double, first_word long, end_word long"
    )


def find_copies(documents: DataFrame, benchmark: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, and the words of the document (end exclusive) that copy the item."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    items = stored(item_words(benchmark), "items")
    seeds = stored(item_seeds(items), "seeds")
    read = stored(seed_places(docs, BitSet(seeds.select("seed"), seeds.count())), "places")
    counters = gathered(
        merge_blocks(read.where("block is not null").select("block", "body"), "int64", either=False),
        1 << LOG_CELLS, "int64",
    )
    places = read.where("block is null").join(seeds.select("seed").distinct(), "seed", "left_semi")
    # One row for each seed of a document or an item, however often it is repeated there.
    held = stored(
        places.groupBy("seed", "doc_id").agg(F.min("place").alias("low"), F.max("place").alias("high")), "held"
    )
    asked = stored(
        seeds.groupBy("seed", "item_id", "size").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at")),
        "asked",
    )
    pairs = candidates(docs, items, held, asked, counters, least)
    spans = stored(
        pairs.join(asked, "item_id").join(held, ["doc_id", "seed"]).groupBy("doc_id", "item_id").agg(
            F.min(F.col("low") - F.col("last_at")).alias("low"),
            F.max(F.col("high") - F.col("first_at") + F.col("size")).alias("high"),
            F.max("size").alias("size"),
        ),
        "spans",
    )
    # More words than this put into a copy cost more than all its matches can spare.
    slack = F.ceil(F.col("size") * MATCH * (1 - least) / -GAP).cast("long")
    wanted = spans.groupBy("doc_id").agg(
        F.collect_list(F.struct("item_id", (F.col("low") - slack).alias("low"), (F.col("high") + slack).alias("high")))
        .alias("spans")
    )
    # These joins shuffle, so that no task runs two Python workers at once.
    texts = rows_named(docs, spans.select("doc_id").distinct()).join(wanted.hint("merge"), "doc_id")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = Words(piece.column("text"), plain=True)
            hashes = words.hashes().view(np.int64)
            ids = piece.column("doc_id").to_pylist()
            rows = []
            for at, spans in enumerate(piece.column("spans").to_pylist()):
                own = hashes[words.first[at] : words.first[at + 1]]
                for span in spans:
                    low = max(span["low"], 0)
                    rows.append((ids[at], span["item_id"], low, own[low : max(span["high"], 0)]))
            if rows:
                docs_, items_, firsts, parts = zip(*rows, strict=True)
                edges = np.cumsum([0, *map(len, parts)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array(items_, pa.int64()), pa.array(firsts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(parts)))],
                    names=["doc_id", "item_id", "first", "passage"],
                )

    found = texts.mapInArrow(passages, "doc_id long, item_id long, first long, passage array<long>")
    best = aligned(found.join(items.hint("merge"), "item_id"), least)
    order = F.struct("similarity", -F.col("first_word"), -F.col("end_word"))
    return best.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("similarity", "first_word", "end_word"), order).alias("best")
    ).select("doc_id", "item_id", "best.*")


def keep_clean(documents: DataFrame, benchmark: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """The documents that copy no test item, with their columns."""
    copied = stored(find_copies(documents, benchmark, least).select("doc_id").distinct(), "copied")
    return documents.join(copied, "doc_id", "left_anti").select(*documents.columns)
