"""Perfect hashing and cross-tokenizer alignment against plain code and the libraries' own ids."""

import collections
import hashlib
import itertools

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from emberlog.llm import perfect_hash, token_pairs
from emberlog.llm.queries import BYTE_TOKENIZER, PIECE_MODEL, QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens(text):
    """(byte ends, ids) of both tokenizers, or None if the bytes don't come back."""
    out = []
    for ids, surface in (
        (A.encode(" " + text, add_special_tokens=False).ids, A_BYTES), (B.encode(text), B_BYTES)
    ):
        if b"".join(surface[i] for i in ids) != (" " + text).encode():
            return None
        out.append((list(itertools.accumulate(len(surface[i]) for i in ids)), ids))
    return out


A = Tokenizer.from_file(BYTE_TOKENIZER)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
# Bytes of single ids, by the libraries' own decoders.
A_BYTES = {i: bytes(token_pairs.byte_alphabet()[c] for c in name) for name, i in A.get_vocab(False).items()}
B_BYTES = {
    i: bytes([int(n[3:5], 16)]) if B.is_byte(i) else n.replace("▁", " ").encode()
    for i in range(B.get_piece_size()) for n in [B.id_to_piece(i)]
}


def plain(texts):
    """The contract's columns for a list of texts."""
    count, found = collections.Counter(), []
    for text in texts:
        both = tokens(text) if text else None
        if both is None:
            found.append(None)
            continue
        (ends_a, a), (ends_b, b) = both
        cuts = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a.index(c)], b[ends_b.index(c)]) for c in cuts]
        groups, low_a, low_b = [], 0, 0
        for c in cuts:
            high_a, high_b = ends_a.index(c) + 1, ends_b.index(c) + 1
            groups.append(",".join(map(str, a[low_a:high_a])) + "|" + ",".join(map(str, b[low_b:high_b])))
            low_a, low_b = high_a, high_b
        count.update(links)
        found.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else (
            *f[:3], len(f[3]), sum(count[x] == best[x[1]] for x in f[3]), sum(count[x] for x in f[3]),
            hashlib.sha256(f[4].encode()).hexdigest(),
        )
        for f in found
    ]


ODD = [
    None, "", " ", "  ", "\n", "a", "A  b\t\tc \n d", "a \n", " a", "  x y", "a▁b c", "▁", "é ß 日本語 😀",
    "don't we'll ' s", "<s> </s> <|endoftext|> <unk> <0x41>", "\x00 \x1c \x85 x", "x\x1cy z", "a" * 5000,
    " " * 3000, "word " * 2000, "same text", "same text", "½ Ⅷ ²", "　wide   space",
]


def test_alignment_of_odd_texts(spark):
    kind = "doc_id long, text string, pair long, n long, groups string, n_a string, block string"
    rows = [(i if i % 7 else None, t, 1, 2, "g", "x", None) for i, t in enumerate(ODD)]
    rows.append((3, "repeated id", 1, 2, "g", "x", None))
    docs = spark.createDataFrame(rows, kind).repartition(3)
    want = sorted(
        (str(r[0]), *w) for r, w in zip(rows, plain([r[1] for r in rows]), strict=True)
    )
    for most in (token_pairs.SLICE_PAIRS, 7):
        got = token_pairs.align_texts(docs, BYTE_TOKENIZER, PIECE_MODEL, most).collect()
        listed = sorted(
            (str(r["doc_id"]), *[r[c] for c in COLUMNS[:-1]],
             hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got
        )
        assert listed == want
    assert token_pairs.align_texts(docs.limit(0), BYTE_TOKENIZER, PIECE_MODEL).collect() == []
    nothing = token_pairs.align_texts(docs.where("text is null"), BYTE_TOKENIZER, PIECE_MODEL).collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, None)]


def test_alignment_of_a_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r[0] for r in rows], plain([r[1] for r in rows]), strict=True))
    got = QUERIES["op13_token_alignment"](spark, SMALL).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", *COLUMNS]
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_store_that_is_always_full(monkeypatch):
    """Keeping few parts changes nothing."""
    pair = token_pairs.Pair(BYTE_TOKENIZER, PIECE_MODEL)
    texts = [t for t in ODD if t] * 2
    roomy, tight = token_pairs.Aligner(pair), token_pairs.Aligner(pair)
    monkeypatch.setattr(token_pairs, "STORE", 6)
    for text in texts:
        if len(tight.digest) > token_pairs.STORE:
            tight.trim()
        (a, n), (b, m) = roomy.look([text]), tight.look([text])
        assert (roomy.facts[a] == tight.facts[b]).all() and n.tolist() == m.tolist()
        assert [roomy.pairs[i].tolist() for i in a] == [tight.pairs[i].tolist() for i in b]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .,'\n\t 　\x1c\x85é日😀▁1½$"), max_size=40))
def test_parts_give_the_ids_of_whole_texts(text):
    aligner = aligner_of()
    found, sizes = aligner.look([text])
    both = tokens(text) if text else None
    assert aligner.whole(found, sizes).tolist() == [both is not None]
    if both:
        assert aligner.facts[found, 1].sum() == len(both[0][1])
        assert aligner.facts[found, 2].sum() == len(both[1][1])


def aligner_of(known=[]):
    if not known:
        known.append(token_pairs.Aligner(token_pairs.Pair(BYTE_TOKENIZER, PIECE_MODEL)))
    return known[0]


def test_hash_is_perfect_and_minimal(spark):
    draw = np.random.default_rng(4)
    for n in (0, 1, 2, 100, 40_000):
        keys = np.unique(draw.integers(-(2**62), 2**62, n))
        frame = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(3)
        function = perfect_hash.build(frame, len(keys))
        numbers = function.numbers(keys)
        assert sorted(numbers.tolist()) == list(range(len(keys)))
        assert (function.keys[numbers] == keys).all()
        others = np.setdiff1d(draw.integers(-(2**62), 2**62, 1000), keys)
        assert (function.numbers(others) == -1).all()


def test_dense_counts(spark):
    keys = [5 * i - 300 for i in range(20_000)]
    function = perfect_hash.build(spark.createDataFrame([(k,) for k in keys], "k long"), len(keys))
    rows = [(k, 1 + i % 3) for i, k in enumerate(keys)] * 2 + [(1, 9)]
    counts = token_pairs.dense_counts(spark.createDataFrame(rows, "pair long, n long").repartition(5), function)
    assert counts[function.numbers(np.array(keys))].tolist() == [2 * (1 + i % 3) for i in range(len(keys))]


def test_ranges_cover_all_ids():
    draw = np.random.default_rng(1)
    sizes = [(i, int(draw.integers(1, 30))) for i in range(200) if i % 3]
    spans = token_pairs.ranges(sizes, 40)
    assert [low for low, _, _ in spans[1:]] == [high for _, high, _ in spans[:-1]] and spans[-1][1] == 200
    assert all(n == sum(c for i, c in sizes if low <= i < high) <= 40 for low, high, n in spans)
    assert token_pairs.ranges([], 40) == [(0, 1, 0)]


@pytest.mark.parametrize("text", ["a▁b", "x ▁ y"])
def test_texts_that_do_not_come_back(text):
    aligner = aligner_of()
    assert aligner.whole(*aligner.look([text, "fine"])).tolist() == [False, True]


@pytest.mark.parametrize("text", [
    "a" * 300_000, "word" * 50_000 + "," * 500, " " * 200_000, "日本語" * 50_000,
    " ".join(f"w{i * 7919 % 100_003}" for i in range(120_000)),
])
def test_very_long_texts(text):
    aligner = aligner_of()
    found, sizes = aligner.look([text])
    (ends_a, a), (ends_b, b) = tokens(text)
    facts = aligner.facts[found].sum(axis=0)
    assert aligner.whole(found, sizes).tolist() == [True]
    assert facts[1:4].tolist() == [len(a), len(b), len(set(ends_a) & set(ends_b))]
    assert facts[4] == sum(len(aligner.pairs[i]) for i in found)
