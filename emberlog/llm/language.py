"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lowered one by one, everything else is one blank; the n-grams of
GRAM_SIZES characters fall into 2**LOG_BUCKETS buckets. Every task counts the
buckets of its texts for each language, counts are summed over tasks, and the
smoothed log-probabilities, one row for each bucket and one column for each
language, are sent to all tasks. A text is a sparse row of buckets; its product
with that matrix is summed in batches, and the score is the posterior of the best
language. The matrix has a size fixed by the number of languages.

Rows: one for each input row. Null texts and texts without a letter are ``und``
with score 0, as is every text if there is nothing to learn from. Ties go to the
first language by name. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.words import U64, pieces

UNKNOWN = "und"
LOG_BUCKETS = 16
GRAM_SIZES = (1, 2, 3)
SMOOTHING = 0.5
BLANK = 32


def plain_characters() -> np.ndarray:
    """For code points below 0x10000 the lowered letter, or a blank."""
    table = np.full(0x10000, BLANK, np.uint32)
    for point in range(0x10000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


_plain: list[np.ndarray] = []


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Plain characters of all texts, each text after one blank, and where each begins."""
    if not _plain:
        _plain.append(plain_characters())
    listed = pc.fill_null(texts, "").to_pylist()
    points = np.frombuffer((" " + " ".join(listed)).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) + 1 for t in listed], np.int64)
    edges = np.zeros(len(listed) + 1, np.int64)
    np.cumsum(sizes, out=edges[1:])
    out = _plain[0][np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF):
        out[at] = points[at] if chr(points[at]).isalpha() else BLANK
    return out, edges


def buckets(chars: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the ``size`` characters that end at each place from size - 1 on."""
    count = max(len(chars) - size + 1, 0)
    hashed = np.full(count, size, U64)
    for i in range(size):
        hashed = (hashed + chars[i : i + count]) * U64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> U64(29)
    return ((hashed * U64(0xBF58476D1CE4E5B9)) >> U64(64 - LOG_BUCKETS)).astype(np.int64)


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name and the log-probabilities of buckets, one column for each.

    The last row holds the log priors. ``labelled`` has text and lang, both not null.
    """
    width = (1 << LOG_BUCKETS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for piece in pieces(batches):
            chars, edges = characters(piece.column("text"))
            coded = piece.column("lang").dictionary_encode()
            of_text = coded.indices.to_numpy(zero_copy_only=False)
            owner = np.repeat(of_text, np.diff(edges))
            for number, lang in enumerate(coded.dictionary.to_pylist()):
                counts = held.setdefault(lang, np.zeros(width, np.int64))
                counts[-1] += int((of_text == number).sum())
                mine = owner == number
                for size in GRAM_SIZES:
                    counts[:-1] += np.bincount(
                        buckets(chars, size)[mine[size - 1 :]], minlength=width - 1
                    )
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([c.tobytes() for c in held.values()], pa.binary())],
            names=["lang", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang] = held.get(lang, 0) + np.frombuffer(body, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([c.tobytes() for c in held.values()], pa.binary())],
            names=["lang", "counts"],
        )

    kind = "lang string, counts binary"
    # Each text gives one short array for each task, not one for each row: first
    # added up in a few tasks, then in one task for each language.
    parts = labelled.select("text", "lang").mapInArrow(count, kind)
    tasks = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = parts.withColumn("salt", F.spark_partition_id() % 8).repartition(tasks, "lang", "salt")
    summed = spread.select("lang", "counts").mapInArrow(add, kind).repartition(tasks, "lang").mapInArrow(add, kind)
    rows = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in summed.collect())
    if not rows:
        return [], np.zeros((width, 0), np.float32)
    counts = np.stack([c for _, c in rows], axis=1).astype(np.float64)
    seen = counts[:-1] + SMOOTHING
    logs = np.vstack([np.log(seen / seen.sum(axis=0)), np.log(counts[-1:] / counts[-1].sum())])
    return [lang for lang, _ in rows], logs.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score for each row."""
    langs, sent = model[0], docs.sparkSession.sparkContext.broadcast(model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = sent.value
        names = np.array([*langs, UNKNOWN], object)
        for piece in pieces(batches):
            chars, edges = characters(piece.column("text"))
            letters = np.add.reduceat(chars != BLANK, edges[:-1], dtype=np.int64)
            if langs:
                total = np.tile(logs[-1].astype(np.float64), (piece.num_rows, 1))
                for size in GRAM_SIZES:
                    # An n-gram belongs to the text of its last character; the blank
                    # before a text parts it from the one before.
                    found = np.concatenate([np.zeros(size - 1, np.int64), buckets(chars, size)])
                    gained = logs[found]
                    gained[: size - 1] = 0
                    total += np.add.reduceat(gained, edges[:-1], axis=0, dtype=np.float64)
                best = total.argmax(axis=1)
                top = total.max(axis=1)
                score = 1 / np.exp(total - top[:, None]).sum(axis=1)
            else:
                best, score = np.full(piece.num_rows, -1), np.zeros(piece.num_rows)
            best = np.where(letters > 0, best, len(langs))
            score = np.where(letters > 0, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array(names[best].tolist(), pa.string()),
                 pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def remainder(doc_id, by: int):
    """crc32 of the id as text modulo a number, as a column."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by
