"""Token ids of documents as flat binary files that can be memory-mapped.

A folder holds, for each shard of documents in ascending doc_id order:

- ``tokens/kind=ids/part-N…``: the ids of its documents one after the other, each
  with the end id, as little-endian unsigned integers of 16 bits (vocabularies of
  up to 65,536 ids) or 32 bits;
- ``offsets/shard=N/part-…``: for each document the number of ids of all documents
  before it, as little-endian 64-bit integers;
- ``tokens/kind=doc_ids/part-N…``: the doc_ids as decimal text, each ended by a zero byte.

Shards are ranges of doc_id. Their files are written by Spark's own committed
writer, so that a task that is run again replaces its earlier attempt and the
folder may be in any store Spark writes to. That writer ends every record with a
separator; here it is one zero byte, which is also the highest byte of each
record's last number, the small end id or an offset. So records are written
without that byte and the files hold nothing but numbers. Offsets follow from the
lengths of all shards by a prefix sum, one number for each shard.

Rows: one document for each input row; null and empty texts have the end id only.
A null doc_id comes first. Rows of one doc_id keep some order among themselves.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from emberlog.llm.words import pieces

# Words, and parts of words, whose ids a worker keeps, about 200 bytes each.
STORE = 1_000_000
# Runs of letters that are encoded as one text.
TOGETHER = 1000
# Words, and words of letters apart from the marks behind them. A tokenizer that
# marks word ends drops blanks and never joins anything across one, nor across the
# seam of a letter and such a mark.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,;:!?])|[^\x20\x09-\x0D]++")
SEAM = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][.,;:!?]")


class PartEncoder:
    """Ids of texts as bytes; the ids of words and parts seen before are stored until the store is full.

    Words are looked up as UTF-8, as ``bytes.split()`` cuts at the blanks of PARTS and no others.
    """

    def __init__(self, definition: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = dtype
        self.stored: dict[bytes, bytes] = {}
        # Ids that end a run of letters, if the vocabulary marks them.
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for name, i in vocabulary.items() if name.endswith(suffix)]] = True

    def add(self, parts: list[str]) -> None:
        """Store the ids of parts. Runs of letters are encoded many at once, blanks
        between them, and parted where an id ends one; others one by one."""
        runs, rest = [], []
        for part in parts:
            (runs if LETTERS.fullmatch(part) else rest).append(part)
        groups = [runs[i : i + TOGETHER] for i in range(0, len(runs), TOGETHER)]
        coded = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, one in zip(groups, coded, strict=True):
            ids = np.array(one.ids, self.dtype)
            edges = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            if len(edges) == len(group) + 1:
                raw, places = ids.tobytes(), (edges * ids.itemsize).tolist()
                self.stored.update(
                    (part.encode(), raw[a:b]) for part, a, b in zip(group, places[:-1], places[1:], strict=True)
                )
                continue
            rest += group
        self.stored.update(zip(map(str.encode, rest), self.whole(rest), strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, self.dtype).tobytes() for one in coded]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.ends.any():
            # Nothing is known of where this vocabulary parts a text.
            return self.whole(texts)
        words = [t.encode().split() for t in texts]
        wanted = set().union(*words)
        new = wanted.difference(self.stored)
        if len(self.stored) + len(new) > STORE:
            self.stored.clear()
            new = wanted
        self.learn([w.decode() for w in new])
        return [b"".join(map(self.stored.__getitem__, w)) for w in words]

    def learn(self, words: list[str]) -> None:
        """Store the ids of words; those with a seam in them from the ids of their parts."""
        whole, parted = set(), {}
        for word in words:
            if SEAM.search(word):
                parted[word] = PARTS.findall(word)
            else:
                whole.add(word)
        parts = set().union(*parted.values())
        self.add([*whole, *(p for p in parts - whole if p.encode() not in self.stored)])
        for word, found in parted.items():
            self.stored[word.encode()] = b"".join([self.stored[p.encode()] for p in found])


_encoders: dict[tuple[int, str], PartEncoder] = {}


def encoder_for(definition: str, dtype: str) -> PartEncoder:
    """One encoder for each worker process and tokenizer, so that stored parts serve all its tasks."""
    key = (zlib.crc32(definition.encode()), dtype)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PartEncoder(definition, dtype)
    return _encoders[key]


def id_type(tokenizer: Tokenizer) -> str:
    return "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1) -> None:
    """Write the ids of all texts, with the end id behind each, and their offsets."""
    spark = docs.sparkSession
    tokenizer = Tokenizer.from_file(tokenizer_file)
    dtype = id_type(tokenizer)
    end = np.array([end_id], dtype).tobytes()
    if end[-1]:
        raise ValueError("the highest byte of the end id must be zero")
    sent = spark.sparkContext.broadcast(tokenizer.to_str())
    width = len(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done = encoder_for(sent.value, dtype), 0
        for piece in pieces(batches):
            ids = [i + end for i in encoder.encode([t or "" for t in piece.column("text").to_pylist()])]
            count = len(ids)
            names = ["" if d is None else str(d) for d in piece.column("doc_id").to_pylist()]
            sizes = [(len(i) // width).to_bytes(8, "little") for i in ids]
            values = [i[:-1] for i in ids] + [n.encode() for n in names] + [s[:-1] for s in sizes]
            kinds = ["ids"] * count + ["doc_ids"] * count + ["lengths"] * count
            at = np.tile(np.arange(done, done + count), 3)
            done += count
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(at, pa.int64()), pa.array(values, pa.binary())],
                names=["kind", "at", "value"],
            )

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    )
    rows = ordered.mapInArrow(run, "kind string, at long, value binary").sortWithinPartitions("kind", "at")
    rows.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option(
        "lineSep", "\0"
    ).text(f"{folder}/tokens")
    write_offsets(spark, folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and content of the files of a folder; content is read only if used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)


def shard_of(path):
    return F.regexp_extract(path, r"/part-(\d+)", 1).cast("long")


def write_offsets(spark: SparkSession, folder: str) -> None:
    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sizes = np.frombuffer(body, "<i8")
                offsets = bases[shard] + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([offsets.astype("<i8").tobytes()[:-1]], pa.binary())],
                    names=["shard", "value"],
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(b, "<i8").sum()) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["shard", "n"])

    if not any_documents(spark, folder):
        return
    lengths = files(spark, f"{folder}/tokens/kind=lengths").select(shard_of(F.col("path")).alias("shard"), "content")
    totals = sorted(tuple(r) for r in lengths.mapInArrow(total, "shard long, n long").collect())
    ends = np.cumsum([n for _, n in totals])
    bases = {shard: int(end) - n for (shard, n), end in zip(totals, ends, strict=True)}
    rows = lengths.mapInArrow(starts, "shard long, value binary")
    rows.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").option(
        "lineSep", "\0"
    ).text(f"{folder}/offsets")


def any_documents(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tokens/kind=lengths")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The numbers of a file: memory-mapped where the path is mounted, else read from its store."""
    place = urlparse(uri)
    if place.scheme in ("", "file"):
        path = unquote(place.path)
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype)


def read_tokens(spark: SparkSession, folder: str, dtype: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of ids as 32-bit integers) of each document of the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not any_documents(spark, folder):
        return spark.createDataFrame([], schema)

    def paths(part: str, shard, name: str) -> DataFrame:
        return files(spark, f"{folder}/{part}").select(shard.alias("shard"), F.col("path").alias(name))

    offset_shard = F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long")
    shards = (
        paths("tokens/kind=ids", shard_of(F.col("path")), "ids")
        .join(paths("tokens/kind=doc_ids", shard_of(F.col("path")), "doc_ids"), "shard")
        .join(paths("offsets", offset_shard, "offsets"), "shard")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = mapped(row["ids"], dtype)
                starts = np.asarray(mapped(row["offsets"], "<i8"))
                names = mapped(row["doc_ids"], "u1").tobytes().decode().split("\0")[:-1]
                edges = np.append(starts - starts[0], len(ids))
                crcs = [
                    zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(n) if n else None for n in names], pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(np.diff(edges), pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # Paths are spread so that each task maps a few shards.
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(count, "shard").mapInArrow(run, schema)
