"""Cross-tokenizer alignment: counts of token pairs under a minimal perfect hash.

Two tokenizers read a blank and the text: A, a byte-level BPE of the tokenizers
library, and B, a SentencePiece model that puts that blank in itself. A token covers
the bytes it stands for. Where an A and a B token both end, the texts are cut into
groups; the two tokens that end there are linked.

1. Texts are aligned once; each task adds up how often it meets a pair of ids.
2. The distinct pairs get numbers by a minimal perfect hash. Tasks turn their sums
   into dense vectors indexed by these numbers, in blocks, and the blocks are summed
   by tasks of their own.
3. Texts are aligned again. Each link's pair is looked up by its hash, its key is
   compared, and its corpus count is added to the text's sums.

A table of pairs may be larger than what a worker should hold, so B ids are cut into
ranges of at most SLICE_PAIRS pairs; step 3 goes over the texts once for each range.
Most corpora need one. The hash's size is known before it is sent.

Neither tokenizer joins anything across the seam of a character that is no white
space and a blank, so texts are cut there and parts met before are not aligned again.
Parts are encoded many at once, one after the other in one text, and parted at the
bytes where they end. Where A merges in the order of its ids, as byte-level vocabularies
do, parts of Latin letters and marks go through tiktoken, which gives the same ids. The store of parts keeps what is met most when it is full; it
changes no result. Tokenizers that could join across the seam get whole texts.

Rows: one for each input row, repeated rows each on their own and counted each. Null
and empty texts, and texts whose tokens of either kind don't give their bytes back
(U+2581 comes back as a blank), have no tokens and count for nothing. A null doc_id
stays null. Very long texts without blanks are one part. Only doc_id and text are
read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from emberlog.llm import perfect_hash
from emberlog.llm.shared import BLOCK, gathered, merge_blocks, stored
from emberlog.llm.words import pieces

BLANK = "▁"
# A part starts with a blank behind anything but white space. \s also has the
# separators 1C to 1F, which the tokenizers count as text: not cutting there is safe.
PART = re.compile(r" (?:[^ ]+|(?<=\s) )*")
WHOLE = re.compile(r".+", re.DOTALL)
# Parts that any byte-level pre-tokenizer takes as letters and marks, and how it does.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LATIN = re.compile(rf" [{LETTERS}]{{1,60}}[.,;:!?]{{0,20}}")
LATIN_WORDS = rf" ?[{LETTERS}]+|[.,;:!?]+"
# Parts that a worker keeps, and how many are encoded as one text.
STORE = 500_000
TOGETHER = 500
# Pairs that are looked up at once: 16 bytes and a few bits for each.
SLICE_PAIRS = 1 << 22
# A pair is one number: the A id times this and the B id.
FACTOR = 1 << 32


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level BPE shows for each byte: itself where it is printable."""
    shown = {b: chr(b) for span in ((33, 127), (161, 173), (174, 256)) for b in range(*span)}
    hidden = [b for b in range(256) if b not in shown]
    shown |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {char: b for b, char in shown.items()}


def bytes_of_a(definition: str) -> list[bytes]:
    alphabet = byte_alphabet()
    read = json.loads(definition)
    known = dict(read["model"]["vocab"])
    # Added tokens stand for their text, whatever the byte alphabet.
    added = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
    out = [b""] * (max([*known.values(), *added.values()], default=-1) + 1)
    for name, i in known.items():
        out[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
    for name, i in added.items():
        out[i] = name.encode()
    return out


def bytes_of_b(read: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    names = read.id_to_piece(list(range(read.get_piece_size())))
    return [
        bytes([int(n[3:5], 16)]) if read.is_byte(i) else n.replace(BLANK, " ").encode()
        for i, n in enumerate(names)
    ]


def ranks_of(definition: str, surface: list[bytes]) -> dict[bytes, int] | None:
    """Bytes to ids of a vocabulary of single bytes and merges whose ids grow in their order."""
    model = json.loads(definition)["model"]
    if model.get("type") != "BPE" or any(model.get(c) for c in ("dropout", "end_of_word_suffix", "ignore_merges")):
        return None
    known = model["vocab"]
    made = [known["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    rest = set(known.values()) - set(made)
    single = {i for i in rest if len(surface[i]) == 1}
    if len(single) < 256 or made != sorted(set(made)) or made[:1] < [max(single)]:
        return None
    return {surface[i]: i for i in [*single, *made]}


def separable(definition: str, names: list[str]) -> bool:
    """Whether neither tokenizer joins anything across the seam of a part."""
    first = json.loads(definition)
    before = first.get("pre_tokenizer") or {}
    apart = (
        first.get("normalizer") is None and before.get("type") == "ByteLevel"
        and before.get("use_regex", True) and not before.get("add_prefix_space")
    )
    return apart and not any(BLANK in n.lstrip(BLANK) for n in names)


class Pair:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        self.definition, self.model = Path(a_file).read_text(), Path(b_file).read_bytes()
        read = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.surface = bytes_of_a(self.definition), bytes_of_b(read)
        names = read.id_to_piece(list(range(read.get_piece_size())))
        self.ranks = ranks_of(self.definition, self.surface[0])
        self.part = PART if separable(self.definition, names) else WHOLE
        self.key = zlib.crc32(self.definition.encode()), zlib.crc32(self.model)


class Aligner:
    """Parts of texts and what is known of those met: ids, groups and linked pairs."""

    def __init__(self, pair: Pair, counts: PairCounts | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(pair.definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.model)
        self.latin = pair.ranks and tiktoken.Encoding(
            "latin", pat_str=LATIN_WORDS, mergeable_ranks=pair.ranks, special_tokens={}
        )
        self.surface = [np.array([*one, None], object)[:-1] for one in pair.surface]
        self.length = [np.array([len(x) for x in one], np.int64) for one in pair.surface]
        # How ids are shown, inside their group and at its end.
        self.shown = [
            np.array([[f"{i}{mark}" for i in range(len(one))] for mark in marks], object)
            for one, marks in zip(pair.surface, (",|", ",;"), strict=True)
        ]
        self.part = pair.part
        self.counts = counts
        self.number: dict[str, int] = {}
        self.digest: list[str] = []
        # For each part: whether its bytes come back (-1: they do, but some link was not
        # counted), A ids, B ids, groups, links, links of a highest count, sum of counts.
        # Pairs are kept while counts are not known.
        self.facts = np.zeros((0, 7), np.int64)
        self.pairs: list[np.ndarray] = []
        self.met = np.zeros(0, np.int64)

    def trim(self) -> None:
        """Keep the half of the parts that is met most."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: STORE // 2])
        names = list(self.number)
        self.number = {names[i]: at for at, i in enumerate(keep.tolist())}
        self.digest = [self.digest[i] for i in keep.tolist()]
        if self.counts is None:
            self.pairs = [self.pairs[i] for i in keep.tolist()]
        self.facts, self.met = self.facts[keep], np.zeros(len(keep), np.int64)

    def cut(self, text: str) -> list[str]:
        parts = self.part.findall(" " + text)
        # B puts no blank before nothing: one at the very end stays with its part.
        if parts[-1] == " ":
            parts[-2:] = [parts[-2] + " "]
        return parts

    def look(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of all texts one after the other, and how many each text has."""
        parts = [self.cut(t) if t else [] for t in texts]
        wanted = set().union(*parts)
        self.add([p for p in wanted if p not in self.number])
        sizes = np.array([len(p) for p in parts], np.int64)
        return np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum())), sizes

    def add(self, parts: list[str]) -> None:
        # Those that end in white space or come back changed are encoded alone.
        odd = [p for p in parts if self.part is WHOLE or p[-1].isspace() or BLANK in p]
        left = set(odd)
        self.new_facts: list[np.ndarray] = []
        latin, even = [], []
        for part in parts:
            if part not in left:
                (latin if self.latin and LATIN.fullmatch(part) else even).append(part)
        for kind in (latin, even):
            for at in range(0, len(kind), TOGETHER):
                group = kind[at : at + TOGETHER]
                if not self.aligned(group, kind is latin):
                    odd += group
        for part in odd:
            if not self.aligned([part]):
                self.number[part] = len(self.digest)
                self.digest.append("")
                if self.counts is None:
                    self.pairs.append(np.zeros(0, np.int64))
                self.new_facts.append(np.zeros((1, 7), np.int64))
        self.facts = np.concatenate([self.facts, *self.new_facts])
        self.met = np.concatenate([self.met, np.zeros(len(self.digest) - len(self.met), np.int64)])

    def ids_of_a(self, text: str, latin: bool) -> list[int]:
        if latin:
            return self.latin.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def aligned(self, group: list[str], latin: bool = False) -> bool:
        """Align parts as one text; nothing is stored if the tokens don't give its bytes back."""
        text = "".join(group)
        ids = (
            np.array(self.ids_of_a(text, latin), np.int64),
            np.array(self.b.encode(text[1:]), np.int64),
        )
        raw = text.encode()
        if any(b"".join(s[one].tolist()) != raw for s, one in zip(self.surface, ids, strict=True)):
            return False
        ends = [np.cumsum(length[one]) for length, one in zip(self.length, ids, strict=True)]
        # Tokens of no bytes end where the one before ends; the last of them is linked.
        last = [np.append(e[1:] != e[:-1], True) for e in ends]
        at_a = np.flatnonzero(last[0] & np.isin(ends[0], ends[1]))
        at_b = np.flatnonzero(last[1] & np.isin(ends[1], ends[0]))
        cut = ends[0][at_a]
        edges = np.cumsum([len(p.encode()) for p in group])
        final = np.searchsorted(cut, edges)
        if not np.array_equal(cut[np.minimum(final, len(cut) - 1)], edges):
            return False
        links = ids[0][at_a] * FACTOR + ids[1][at_b]
        bound = np.append(0, final + 1)
        facts = np.zeros((len(group), 7), np.int64)
        facts[:, 0] = 1
        facts[:, 1] = np.diff(np.append(0, at_a[final] + 1))
        facts[:, 2] = np.diff(np.append(0, at_b[final] + 1))
        facts[:, 3] = facts[:, 4] = np.diff(bound)
        if self.counts is not None:
            sums = self.counts.sums(links, bound)
            facts[sums[:, 0] > 0, 0] = -1
            facts[:, 5:] = sums[:, 1:]
            self.digest += self.texts_of(ids, at_a, at_b, facts)
        else:
            self.digest += [""] * len(group)
            self.pairs += [links[low:high] for low, high in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        self.number.update(zip(group, range(len(self.digest) - len(group), len(self.digest)), strict=True))
        self.new_facts.append(facts)
        return True

    def texts_of(
        self, ids: tuple[np.ndarray, np.ndarray], at_a: np.ndarray, at_b: np.ndarray, facts: np.ndarray
    ) -> list[str]:
        """The groups of each part as text; ids come in order with the mark behind each."""
        # Which group a token is in, and so how many of the other kind stand before it.
        groups = [np.zeros(len(one) + 1, np.int64) for one in ids]
        for group, at in zip(groups, (at_a, at_b), strict=True):
            group[at + 1] = 1
            np.cumsum(group, out=group)
        before_a = np.append(0, at_a + 1)[groups[1][:-1] + 1]
        before_b = np.append(0, at_b + 1)[groups[0][:-1]]
        shown = np.empty(len(ids[0]) + len(ids[1]), object)
        for one, before, group, shapes in zip(ids, (before_b, before_a), groups, self.shown, strict=True):
            shown[np.arange(len(one)) + before] = shapes[np.diff(group), one]
        flat, ends = shown.tolist(), np.cumsum(facts[:, 1] + facts[:, 2]).tolist()
        return ["".join(flat[low:high])[:-1] for low, high in zip([0, *ends[:-1]], ends, strict=True)]

    def whole(self, found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which texts have tokens: those of some parts whose bytes all come back."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        lost = np.bincount(owner[self.facts[found, 0] == 0], minlength=len(sizes))
        return (sizes > 0) & (lost == 0)


class PairCounts:
    """Corpus counts of the pairs of one range of B ids, by a perfect hash."""

    def __init__(self, function: perfect_hash.PerfectHash, counts: np.ndarray, low: int, high: int):
        self.function, self.counts, self.low, self.high = function, counts, low, high
        self.best = np.zeros(max(high - low, 0), np.int64)
        np.maximum.at(self.best, function.keys % FACTOR - low, counts)

    def sums(self, links: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each part between bounds: links without a count (of texts that have no
        tokens), links of their B id's highest count, and the sum of counts."""
        piece = links % FACTOR
        here = np.flatnonzero((piece >= self.low) & (piece < self.high))
        number = self.function.numbers(links[here])
        known = here[number >= 0]
        own = self.counts[number[number >= 0]]
        sums = np.zeros((3, len(links) + 1), np.int64)
        sums[0, here + 1] = number < 0
        sums[1, known + 1] = own == self.best[piece[known] - self.low]
        sums[2, known + 1] = own
        return np.diff(np.cumsum(sums, axis=1)[:, bound], axis=1).T


_aligners: dict[tuple, Aligner] = {}


def aligner_for(pair: Pair, name: str, counts: PairCounts | None = None) -> Aligner:
    """One aligner for each worker process, so that stored parts serve all its tasks."""
    key = (*pair.key, name)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(pair, counts)
    return _aligners[key]


def pair_sums(docs: DataFrame, pair: Broadcast[Pair]) -> DataFrame:
    """Rows (pair, n): how often a task's texts have the pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(pair.value, "pairs")

        def sums(times: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(times)
            each = [aligner.pairs[i] for i in at.tolist()]
            pairs, place = np.unique(np.concatenate([*each, np.zeros(0, np.int64)]), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, place, np.repeat(times[at], [len(x) for x in each]))
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n)], names=["pair", "n"])

        times = np.zeros(len(aligner.digest), np.int64)
        for piece in pieces(batches):
            if len(aligner.digest) > STORE:
                yield sums(times)
                aligner.met = times
                aligner.trim()
                times = np.zeros(len(aligner.digest), np.int64)
            found, sizes = aligner.look(piece.column("text").to_pylist())
            kept = np.repeat(aligner.whole(found, sizes), sizes)
            new = np.bincount(found[kept], minlength=len(aligner.digest))
            new[: len(times)] += times
            times = new
        yield sums(times)

    return docs.select("text").mapInArrow(run, "pair long, n long")


def dense_counts(sums: DataFrame, function: perfect_hash.PerfectHash) -> np.ndarray:
    """The summed counts of the function's keys, by number; other pairs are left out."""
    size = len(function.keys)
    sent = sums.sparkSession.sparkContext.broadcast(function)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(size, np.int64)
        for batch in batches:
            number = sent.value.numbers(batch.column(0).to_numpy(zero_copy_only=False))
            known = number >= 0
            np.add.at(dense, number[known], batch.column(1).to_numpy(zero_copy_only=False)[known])
        used = [i for i in range(0, size, BLOCK) if dense[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i // BLOCK for i in used], pa.int64()),
             pa.array([dense[i : i + BLOCK].tobytes() for i in used], pa.binary())],
            names=["block", "body"],
        )

    parts = sums.select("pair", "n").mapInArrow(run, "block long, body binary")
    blocks = merge_blocks(parts, "int64", either=False)
    out = np.zeros(size, np.int64)
    for block, body in blocks.collect():
        part = np.frombuffer(body, np.int64)
        out[block * BLOCK : block * BLOCK + len(part)] = part
    return out


def ranges(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(low, high, pairs): ranges of B ids with at most ``most`` pairs, or a single id's."""
    out: list[tuple[int, int, int]] = []
    low = held = 0
    for i, n in sorted(sizes):
        if held and held + n > most:
            out.append((low, i, held))
            low, held = i, 0
        held += n
    return [*out, (low, max((i for i, _ in sizes), default=0) + 1, held)]


def align_texts(
    documents: DataFrame, a_file: str, b_file: str, slice_pairs: int = SLICE_PAIRS
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (as text, null without tokens).

    ``groups`` lists ``a1,a2|b1`` for each group, separated by semicolons.
    """
    context = documents.sparkSession.sparkContext
    pair = context.broadcast(Pair(a_file, b_file))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = stored(pair_sums(docs, pair), "pairs")
    distinct = stored(sums.select("pair").distinct(), "distinct")
    # One number for each B id: no more than the vocabulary has.
    sizes = distinct.groupBy((F.col("pair") % FACTOR).alias("piece")).count().collect()
    spans = ranges([(r[0], r[1]) for r in sizes], slice_pairs)
    result = docs
    for at, (low, high, held) in enumerate(spans):
        inside = (F.col("pair") % FACTOR >= low) & (F.col("pair") % FACTOR < high)
        function = perfect_hash.build(distinct.where(inside), held)
        counts = PairCounts(function, dense_counts(sums.where(inside), function), low, high)
        sent = context.broadcast(counts)
        result = looked_up(result, pair, sent, first=at == 0)
        if at + 1 < len(spans):
            result = stored(result, "aligned")
    return result.drop("text")


OWN = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def looked_up(docs: DataFrame, pair: Broadcast[Pair], sent: Broadcast[PairCounts], first: bool) -> DataFrame:
    """The documents with their alignment and the sums of one range; further ranges add to them."""

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(pair.value, name, sent.value)
        for piece in pieces(batches):
            if len(aligner.digest) > STORE:
                aligner.trim()
            found, sizes = aligner.look(piece.column("text").to_pylist())
            aligner.met += np.bincount(found, minlength=len(aligner.met))
            edges = np.append(0, np.cumsum(sizes))
            whole = aligner.whole(found, sizes)
            if (aligner.facts[found[np.repeat(whole, sizes)], 0] < 0).any():
                raise ValueError("a link that was not there when pairs were counted: the texts have changed")
            sums = np.zeros((len(found) + 1, 6), np.int64)
            np.cumsum(aligner.facts[found, 1:], axis=0, out=sums[1:])
            facts = np.where(whole[:, None], np.diff(sums[edges], axis=0), 0)
            if not first:
                for i in (4, 5):
                    facts[:, i] += piece.column(OWN[i]).to_numpy(zero_copy_only=False)
            digest, numbers = aligner.digest, found.tolist()
            groups = [
                ";".join([digest[i] for i in numbers[a:b]]) if own else None
                for a, b, own in zip(edges[:-1].tolist(), edges[1:].tolist(), whole.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("text"),
                 *[pa.array(np.ascontiguousarray(facts[:, i])) for i in range(6)], pa.array(groups, pa.string())],
                names=["doc_id", "text", *OWN, "groups"],
            )

    return docs.mapInArrow(
        run, "doc_id long, text string, " + ", ".join(f"{c} long" for c in OWN) + ", groups string"
    )

