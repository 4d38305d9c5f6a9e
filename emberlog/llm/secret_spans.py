"""Secret scans: keyword automaton, anchored expressions at its hits, checksums.

An Aho-Corasick automaton over all keywords reads every text once; only where a
keyword stands is the expression of its kind tried, anchored there. Runs of hex
digits have no keyword; they are found as runs of bytes. Tokens that carry their
own checksum count only if it fits.

Kinds: ``assign``, ``access`` and ``hex`` as in the base rules; ``github`` and
``npm`` are tokens of 30 characters and a CRC-32 in six base-62 digits. Spans are
in code points, end exclusive. Matches of one kind do not overlap; kinds may.

Rows: one for each input row, null texts as empty ones, no state between rows,
only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from emberlog.llm.words import pieces

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
}
MASK = "[secret]"
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = np.zeros(256, bool)
HEX[[*range(48, 58), *range(97, 103)]] = True


class Span(NamedTuple):
    """Byte places of a match; ``value`` is where the secret itself begins."""

    start: int
    kind: int
    end: int
    value: int


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def base62(number: int, width: int) -> bytes:
    out = bytearray()
    for _ in range(width):
        number, digit = divmod(number, 62)
        out.append(DIGITS[digit])
    return bytes(reversed(out))


def keyword_spans(text: bytes, words: ahocorasick.Automaton) -> list[Span]:
    """Matches of the kinds that have a keyword, by start."""
    # Bytes as code points, so that places in the automaton's text are byte places.
    hits = sorted({(at - size + 1, kind) for at, (size, kind) in words.iter(text.lower().decode("latin-1"))})
    free = dict.fromkeys(KINDS, 0)
    spans = []
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            match = ASSIGN.match(text, start)
            good, value = bool(match) and len(match[2]) >= 6, match.start(2) if match else 0
        elif kind == "access":
            match = ACCESS.match(text, start)
            good, value = bool(match) and len(match[0]) >= 20, start
        else:
            match = CHECKED.match(text, start)
            good, value = bool(match) and base62(zlib.crc32(match[1]), 6) == match[2], start
        if match:
            free[kind] = match.end()
        if good:
            spans.append(Span(start, KINDS.index(kind), match.end(), value))
    return spans


def hex_runs(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least 24 lower-case hex digits; no run goes on into another text."""
    digit = np.zeros(len(data) + 2, np.int8)
    digit[1:-1] = HEX[data]
    change = np.diff(digit)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    inner = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(data))]
    cut = np.unique(inner[(digit[inner] == 1) & (digit[inner + 1] == 1)]) if len(inner) else inner
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    long = ends - starts >= 24
    return starts[long], ends[long]


class Scanned:
    """The spans of some texts, by text, in byte places of the texts together."""

    def __init__(self, texts: pa.Array, words: ahocorasick.Automaton):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        self.bytes = whole.to_pybytes()[offsets[0] : offsets[-1]] if whole is not None else b""
        self.edges = offsets - offsets[0]
        data = np.frombuffer(self.bytes, np.uint8)
        self.points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=self.points[1:])
        starts, ends = hex_runs(data, self.edges)
        owner = np.searchsorted(self.edges, starts, side="right") - 1
        self.spans: list[list[Span]] = []
        runs: dict[int, list[Span]] = {}
        for doc, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
            runs.setdefault(doc, []).append(Span(a, 2, b, a))
        for doc, (a, b) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)):
            found = [Span(s + a, k, e + a, v + a) for s, k, e, v in keyword_spans(self.bytes[a:b], words)]
            self.spans.append(sorted(found + runs.get(doc, [])))

    def places(self, doc: int) -> list[tuple[str, int, int, int]]:
        """(kind, start, end, value start) of a text's spans in code points of that text."""
        before = self.points[self.edges[doc]]
        return [
            (KINDS[s.kind], int(self.points[s.start] - before), int(self.points[s.end] - before),
             int(self.points[s.value] - before))
            for s in self.spans[doc]
        ]

    def masked(self, doc: int) -> str:
        """The text with every secret replaced; overlapping ones by one mask."""
        out, done = [], int(self.edges[doc])
        for a, b in sorted((s.value, s.end) for s in self.spans[doc]):
            if a >= done:
                out += [self.bytes[done:a], MASK.encode()]
            done = max(done, b)
        return b"".join([*out, self.bytes[done : self.edges[doc + 1]]]).decode()


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id and its spans (kind, start, end, value_start)."""
    words = automaton()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            scanned = Scanned(piece.column("text"), words)
            rows = [
                [dict(zip(("kind", "start", "end", "value_start"), p, strict=True)) for p in scanned.places(i)]
                if scanned.spans[i] else []
                for i in range(piece.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(span))],
                names=["doc_id", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind string, start long, end long, value_start long>>"
    )


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All documents; in texts with secrets these are replaced, and n_chars with them where there is one."""
    words = automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            scanned = Scanned(piece.column("text"), words)
            hit = [i for i in range(piece.num_rows) if scanned.spans[i]]
            if hit:
                changed = {"text": piece.column("text").to_pylist()}
                if "n_chars" in piece.schema.names:
                    changed["n_chars"] = piece.column("n_chars").to_pylist()
                for i in hit:
                    changed["text"][i] = scanned.masked(i)
                    if "n_chars" in changed:
                        changed["n_chars"][i] = len(changed["text"][i])
                columns = [
                    pa.array(changed[f.name], f.type) if f.name in changed else piece.column(f.name)
                    for f in piece.schema
                ]
                piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
            yield piece

    return docs.mapInArrow(run, docs.schema)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
