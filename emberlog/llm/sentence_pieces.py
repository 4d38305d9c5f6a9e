"""SentencePiece encoding and decoding by streaming Viterbi.

A text is read once. Every boundary between characters keeps the piece that ends
there on its surviving path. A path can only go on from the last boundaries, as
many as the longest piece has characters; as soon as the paths of all of them
come from one boundary, the pieces up to it are settled, leave as ids, and are
forgotten. For unigram models the surviving path has the best sum of scores. For
merge (BPE) models two pieces may follow each other only if merging by rank never
joins them across their seam; there is then exactly one path to each boundary,
and it gives the ids that the merges give.

All paths meet where no piece of the model can lie across a place, as between a
character and a following blank: texts are cut there, and parts seen before are
not run again. The store of parts has two generations: when the new one is full, the
old one is dropped and what is met again comes over; this changes no result.

Characters that no piece has become their bytes. Models that normalise the text
beyond a leading blank are refused. Decoding gives the text back exactly, except
that U+2581, which stands for a blank inside pieces, comes back as a blank.

Rows: one for each input row; null and empty texts have no ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from emberlog.llm.words import pieces

BLANK = "▁"
STORE = 150_000
# Beyond this many open boundaries settled pieces are looked for.
WINDOW = 64
UNIGRAM, MERGES = 1, 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = number() if size is None else size
            yield key >> 3, message[at : at + size]
            at += size


class PieceModel:
    """Pieces of a model file, with what the search needs of them."""

    def __init__(self, model: bytes):
        top = dict(fields(model))
        self.kind = dict(fields(top.get(2, b""))).get(3, UNIGRAM)
        rules = dict(fields(top.get(3, b"")))
        if self.kind not in (UNIGRAM, MERGES) or rules.get(2) or rules.get(4, 1):
            raise ValueError("the model normalises texts or is neither unigram nor BPE")
        self.prefix = BLANK if rules.get(3, 1) else ""
        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        count = read.get_piece_size()
        names = read.id_to_piece(list(range(count)))
        self.ids, self.scores, self.byte_ids = {}, {}, {}
        self.surface = [b""] * count
        for i, name in enumerate(names):
            if read.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.surface[i] = bytes([int(name[3:5], 16)])
            elif not (read.is_control(i) or read.is_unknown(i) or read.is_unused(i)):
                self.ids[name], self.scores[name] = i, read.get_score(i)
                self.surface[i] = name.replace(BLANK, " ").encode()
        self.unknown = read.unk_id()
        self.unknown_score = min(self.scores.values(), default=0.0) - 10
        self.ranks, self.halves = {}, {}
        if self.kind == MERGES:
            order = sorted({-s for s in self.scores.values()})
            place = {s: i for i, s in enumerate(order)}
            self.ranks = {name: place[-s] for name, s in self.scores.items() if len(name) > 1}
            for name in sorted(self.ranks, key=len):
                self.halves[name] = self.last_merge(name)
            # Pieces that merging never makes cannot be on a path.
            self.ids = {n: i for n, i in self.ids.items() if len(n) == 1 or self.halves[n]}
        self.longest = max(map(len, self.ids), default=1)
        self.parts = self.cut()

    def cut(self) -> re.Pattern:
        """Parts of a text between which no piece of this model can lie."""
        held = list(self.ids)
        if any(BLANK in name.lstrip(BLANK) for name in held):
            return re.compile(".+", re.DOTALL)
        apart = "".join(c for c in "\n\t\r" if not any(c in name for name in held))
        single = f"|[{apart}]" if apart else ""
        # Letters, but for those that some piece goes on from with anything else.
        seams = {(a, b) for name in held for a, b in zip(name, name[1:], strict=False)}
        letters = {c for name in held for c in name if re.match(r"[^\W\d_]", c)}
        while bad := {a for a, b in seams if a in letters and b not in letters}:
            letters -= bad
        odd = "".join(c for name in held for c in name if re.match(r"[^\W\d_]", c) and c not in letters)
        odd = re.escape("".join(sorted(set(odd))))
        letter, other = f"[^\\W\\d_{odd}]", f"(?:[\\W\\d_{odd}](?<![{BLANK}{apart}]))"
        return re.compile(f"{BLANK}*{other}*{letter}+|{BLANK}*{other}+|{BLANK}+{single}")

    def merged(self, text: str, least: int = 1) -> list[str]:
        """A text's characters merged by rank, of equal ranks the leftmost, down to ``least`` pieces."""
        held = list(text)
        while len(held) > least:
            pairs = [
                (self.ranks[a + b], i) for i, (a, b) in enumerate(zip(held, held[1:], strict=False))
                if a + b in self.ranks
            ]
            if not pairs:
                break
            _, at = min(pairs)
            held[at : at + 2] = [held[at] + held[at + 1]]
        return held

    def last_merge(self, name: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one, if merging its characters does."""
        held = self.merged(name, 2)
        return (held[0], held[1]) if len(held) == 2 else None


class Store(dict):
    """What ``make`` gives for each key, of the last keys met: half of ``size`` of them in each generation."""

    def __init__(self, make, size: int):
        self.make, self.half = make, size // 2
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers; parts seen before are stored.

    Inside the search a piece is its id, and a character without one a number past all ids.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.stored = Store(self.ids_of, STORE)
        # For each left piece, whether a right one can follow; filled once for each pair.
        self.fit: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.count = len(model.surface)
        self.names = {i: name for name, i in model.ids.items()}
        # Pieces by their characters: {character: (further characters, id or -1, score)}.
        self.tree = self.node(sorted(model.ids), 0, 0, len(model.ids))

    def node(self, names: list[str], depth: int, low: int, high: int) -> dict:
        """The tree of sorted names from ``low`` to ``high``, which have ``depth`` characters in common."""
        out = {}
        while low < high:
            if len(names[low]) == depth:
                low += 1
                continue
            char, end = names[low][depth], low + 1
            while end < high and names[end][depth] == char:
                end += 1
            name = names[low]
            number, score = -1, 0.0
            if len(name) == depth + 1:
                number, score = self.model.ids[name], self.model.scores[name]
            elif not depth:
                number, score = self.count + ord(char), self.model.unknown_score
            out[char] = self.node(names, depth + 1, low, end), number, score
            low = end
        return out

    def name(self, number: int) -> str:
        return self.names[number] if number < self.count else chr(number - self.count)

    def seams(self, left: int) -> dict[int, bool]:
        if self.pairs > 4 * STORE:
            self.fit.clear()
            self.pairs = 0
        return self.fit.setdefault(left, {})

    def follows(self, seams: dict[int, bool], left: int, right: int) -> bool:
        """Whether merging would leave the seam between two pieces open."""
        self.pairs += 1
        known = seams[right] = self.open_seam(self.name(left), self.name(right))
        return known

    def open_seam(self, left: str, right: str) -> bool:
        # Goes back in time along the seam: whichever neighbour was made last is
        # taken apart. A pair that could merge before that would have merged.
        # Of equal merges the leftmost comes first. Runs of blanks, whose merges may
        # all have one rank, are merged outright.
        if not left.strip(BLANK) and not right.strip(BLANK):
            return self.model.merged(left + right) == [left, right]
        ranks, halves = self.model.ranks, self.model.halves
        limit = float("inf")
        while True:
            joined = ranks.get(left + right)
            if joined is not None and joined < limit:
                return False
            made_left, made_right = ranks.get(left, -1), ranks.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                limit, left = made_left, halves[left][1]
            else:
                limit, right = made_right + 0.5, halves[right][0]

    def search(self, part: str) -> list[int]:
        """Ids of one part of a text."""
        if self.model.kind == MERGES and len(part) <= WINDOW:
            return self.merge_path(part)
        size, out, base = len(part), [], 0
        # For each boundary from the settled one on: its last piece (None: no
        # path), where that begins, and the path's score.
        room = min(size, WINDOW) + self.model.longest + 1
        last, begin, total = [None] * room, [0] * room, [0.0] * room
        last[0] = -1
        for start in range(size):
            at = start - base
            if at >= WINDOW:
                settled = self.meeting(last, begin, at)
                out += self.path(last, begin, settled)
                base, at = base + settled, at - settled
                last = last[settled:] + [None] * max(settled, 1)
                begin = [b - settled for b in begin[settled:]] + [0] * max(settled, 1)
                total = total[settled:] + [0.0] * max(settled, 1)
            if last[at] is not None:
                self.reach(part[start : start + self.model.longest], at, last, begin, total)
        return out + self.path(last, begin, size - base)

    def reach(self, ahead: str, at: int, last: list, begin: list, total: list) -> None:
        """Let the path to a boundary go on by every piece that the characters ahead begin with."""
        merges, lost, before = self.model.kind == MERGES, self.model.unknown_score, last[at]
        seams = self.seams(before) if merges and before >= 0 else None
        children, to = self.tree, at
        for char in ahead:
            found = children.get(char)
            if found is None:
                if to > at:
                    break
                found = {}, self.count + ord(char), lost
            children, number, gain = found
            to += 1
            if number < 0:
                continue
            if merges:
                fits = seams is None or seams.get(number)
                if fits or fits is None and self.follows(seams, before, number):
                    last[to], begin[to] = number, at
            elif last[to] is None or total[at] + gain > total[to]:
                last[to], begin[to], total[to] = number, at, total[at] + gain

    def merge_path(self, part: str) -> list[int]:
        """Ids of a part that is shorter than the window, by the only path of a merge model."""
        size, longest, tree, count = len(part), self.model.longest, self.tree, self.count
        last, begin = [None] * (size + 1), [0] * (size + 1)
        last[0] = -1
        for at in range(size):
            before = last[at]
            if before is None:
                continue
            seams = self.fit.get(before)
            if seams is None:
                seams = self.seams(before)
            children, to = tree, at
            for char in part[at : at + longest]:
                found = children.get(char)
                if found is None:
                    if to == at:
                        last[to + 1], begin[to + 1] = count + ord(char), at
                    break
                children, number, _ = found
                to += 1
                if number >= 0:
                    fits = seams.get(number)
                    if fits or fits is None and (before < 0 or self.follows(seams, before, number)):
                        last[to], begin[to] = number, at
                if not children:
                    break
        return self.path(last, begin, size)

    def meeting(self, last: list[int | None], begin: list[int], at: int) -> int:
        """The latest boundary that all paths which can go on from here have in common."""
        open_ = {i for i in range(at, min(at + self.model.longest, len(last))) if last[i] is not None}
        while len(open_) > 1:
            latest = max(open_)
            open_.remove(latest)
            open_.add(begin[latest])
        return open_.pop()

    def path(self, last: list[int | None], begin: list[int], end: int) -> list[int]:
        numbers = []
        while end > 0:
            numbers.append(last[end])
            end = begin[end]
        out = []
        for number in reversed(numbers):
            if number < self.count:
                out.append(number)
            elif self.model.byte_ids:
                out += [self.model.byte_ids[b] for b in chr(number - self.count).encode()]
            else:
                out.append(self.model.unknown)
        return out

    def ids_of(self, part: str) -> bytes:
        return array("I", self.search(part)).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        found = self.model.parts.findall(self.model.prefix + text.replace(" ", BLANK))
        if max(map(len, found)) > WINDOW:
            return b"".join([self.stored[p] if len(p) <= WINDOW else self.ids_of(p) for p in found])
        return b"".join(map(self.stored.__getitem__, found))

    def decode(self, ids: bytes) -> str:
        surface = self.model.surface
        text = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_encoders: dict[bytes, Encoder] = {}


def encoder_for(key: bytes, model: PieceModel) -> Encoder:
    """One encoder for each worker process and model, so that stored parts serve all its tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encode_texts(docs: DataFrame, model_file: str) -> DataFrame:
    """One row for each document: doc_id, ids, and whether decoding them gives the text back."""
    raw = Path(model_file).read_bytes()
    key = zlib.crc32(raw).to_bytes(4, "little")
    sent = docs.sparkSession.sparkContext.broadcast(PieceModel(raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(key, sent.value)
        for piece in pieces(batches):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            ids = [encoder.encode(t) for t in texts]
            back = [encoder.decode(i) == t.replace(BLANK, " ") for i, t in zip(ids, texts, strict=True)]
            edges = np.cumsum([0, *[len(i) // 4 for i in ids]])
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()),
                 pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat)),
                 pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(back)],
                names=["doc_id", "ids", "ids_crc32", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>, ids_crc32 long, round_trip boolean"
    )
