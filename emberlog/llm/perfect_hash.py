"""Minimal perfect hashing of distinct 64-bit keys, built in buckets and looked up in numpy.

Keys are dealt to buckets by hash, about BUCKET_KEYS to each. A bucket is a sequence
of bit arrays: a key that alone hashes to a bit of the first sets it, the others go
on to the next, smaller one. The arrays of all buckets lie one after the other, and
a key's number is the count of set bits before its own, so the numbers of n keys are
0 to n - 1. The keys stand in that order beside the bits: a key that was not among
them is told by comparison and never gets another key's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.words import U64, mix

BUCKET_KEYS = 1 << 14
# Bits of an array for each key that reaches it.
SPARE = 2
_STEP = 0x9E3779B97F4A7C15


def spread(keys: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the keys, other ones for each level; level 0 deals keys to buckets."""
    return mix(keys.astype(np.int64, copy=False).view(U64) + U64((level + 1) * _STEP & (1 << 64) - 1))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((spread(keys, 0) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def build_bucket(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of a bucket's arrays (multiples of 64 bits), their bits, and its distinct keys in order."""
    sizes, arrays, ordered = [], [], []
    level = 0
    while len(keys):
        level += 1
        size = -(-SPARE * len(keys) // 64) * 64
        place = (spread(keys, level) % U64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        done = alone[place]
        sizes.append(size)
        arrays.append(alone)
        ordered.append(keys[done][np.argsort(place[done])])
        keys = keys[~done]
    flat = np.concatenate([*arrays, np.zeros(0, bool)])
    return sizes, np.packbits(flat, bitorder="little"), np.concatenate([*ordered, np.zeros(0, np.int64)])


class PerfectHash:
    """The function of all buckets."""

    def __init__(self, buckets: list[tuple[list[int], bytes, bytes]]):
        self.buckets = len(buckets)
        levels = max((len(sizes) for sizes, _, _ in buckets), default=0)
        self.sizes = np.zeros((self.buckets, levels), np.int64)
        for at, (sizes, _, _) in enumerate(buckets):
            self.sizes[at, : len(sizes)] = sizes
        ends = np.cumsum(self.sizes.ravel()).reshape(self.sizes.shape)
        self.starts = ends - self.sizes
        self.bits = np.frombuffer(b"".join(bits for _, bits, _ in buckets), np.uint64)
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.keys = np.frombuffer(b"".join(keys for _, _, keys in buckets), np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for keys that were not among the built ones."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        bucket, left = bucket_of(keys, self.buckets), np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[bucket[left], level]
            left, size = left[size > 0], size[size > 0]
            place = (spread(keys[left], level + 1) % size.astype(U64)).astype(np.int64)
            place += self.starts[bucket[left], level]
            word, bit = self.bits[place >> 6], (place & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            under = word[hit] & ((U64(1) << bit[hit]) - U64(1))
            out[left[hit]] = self.before[place[hit] >> 6] + np.bitwise_count(under)
            left = left[~hit]
        out[self.keys[out] != keys] = -1
        return out


def build(keys: DataFrame, count: int) -> PerfectHash:
    """The function of a frame of ``count`` distinct keys, each bucket built by a task.

    What comes to the driver are the keys themselves and a few bits for each, so the
    caller bounds ``count``.
    """
    buckets = max(-(-count // BUCKET_KEYS), 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket_of(found, buckets)), batch.column(0)], names=["bucket", "key"]
            )

    def one(table: pa.Table) -> pa.Table:
        sizes, bits, ordered = build_bucket(np.sort(table.column("key").to_numpy()))
        return pa.table({
            "bucket": table.column("bucket")[:1], "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bits": pa.array([bits.tobytes()], pa.binary()), "keys": pa.array([ordered.tobytes()], pa.binary()),
        })

    built = (
        keys.toDF("key").mapInArrow(dealt, "bucket long, key long").groupBy("bucket")
        .applyInArrow(one, "bucket long, sizes array<long>, bits binary, keys binary")
    )
    rows = {r["bucket"]: (r["sizes"], bytes(r["bits"]), bytes(r["keys"])) for r in built.collect()}
    return PerfectHash([rows.get(b, ([], b"", b"")) for b in range(buckets)])
