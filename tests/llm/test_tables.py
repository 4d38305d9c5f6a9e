"""Operators on tables: odd rows, empty tables, clashing names, plain code on small tables."""

import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from emberlog.llm import (
    decontaminate, html_text, jaccard_join, language, quality, repeated_spans, repetition,
    secret_spans, sentence_pieces, shared, token_files,
)
from emberlog.llm.queries import PIECE_MODEL, QUERIES, TOKENIZER
from emberlog.session import scratch_dir

SMALL = "/root/testdata/sf0.001"
# Columns that operators have of their own, here as further columns of the input.
CLASHING = "token long, size long, place string, words string, seed string, anchor string, kept string, spans int"
KIND = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"

PROSE = " ".join(f"word{i}" for i in range(70))
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, PROSE), (4, PROSE), (5, PROSE), (None, PROSE), (None, None),
    (6, PROSE + " and one more thing"), (7, "word"), (8, "a b"), (9, "日本 語é 😀 ß"), (10, "!!! 123 ..."),
    (11, "password=abcdef " + "f" * 30), (12, PROSE.upper()), (13, "a b"), (14, "x " * 3_000), (15, None),
]


def frame(spark, rows):
    padded = [(d, t, None if d == 7 else "en", None, len(t or ""), 0, 1, "p", "w", "s", "a", "k", 2) for d, t in rows]
    return spark.createDataFrame(padded, KIND)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def query(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, SMALL).collect()}


KNOWN = {d: t for d, t in ODD if d is not None}


# ---------------------------------------------------------------- decontamination


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, token string, first string")


def test_copies_in_odd_tables(spark, odd, empty):
    items = benchmark(spark, [
        (1, "word3 word4 word5 word6 word7 word8", "", ""), (1, "word3 word4 word5 word6 word7 word8", "", ""),
        (2, "a b", "", ""), (3, None, "", ""), (None, "word1 word2 word3 word4 word5", "", ""), (4, "", "", ""),
        (5, "WORD20, word21; gone word23 word24 word25 word26 word27!", "", ""), (6, "none of these is here", "", ""),
    ])
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_copies(odd, items).collect()}
    assert set(found) == {(d, i) for d in (4, 5, 6, 12) for i in (1, 5)}
    assert found[4, 1]["similarity"] == 1 and (found[4, 1]["first_word"], found[4, 1]["end_word"]) == (3, 9)
    # Seven of eight words match and one differs.
    assert found[12, 5]["similarity"] == pytest.approx((7 * 2 - 1) / 16)
    assert decontaminate.find_copies(empty, items).collect() == []
    assert decontaminate.find_copies(odd, items.limit(0)).collect() == []
    kept = decontaminate.keep_clean(odd, items)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(
        d or 0 for d, _ in ODD if d not in (4, 5, 6, 12)
    )


def test_copies_equal_plain_code(spark, texts):
    rows = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    want = brute.copies(texts, {r["item_id"]: r["text"] for r in rows})
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in QUERIES["op1_decontamination"](spark, SMALL).collect()}
    assert got == pytest.approx(want) and len(want) > 2


def test_alignment_equals_cell_by_cell():
    draw = np.random.default_rng(2)
    for _ in range(200):
        item, passage = (draw.integers(0, 5, draw.integers(1, 15)) for _ in range(2))
        assert decontaminate.align(item, passage)[0] == brute.best_alignment(item.tolist(), passage.tolist())


# ------------------------------------------------------------------------- pages


def test_pages(spark):
    kind = "page_id long, url string, html string, text string"
    pages = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (None, "u", "<p>x", "t")], kind)
    assert html_text.train(html_text.training_sample(pages)) is None
    assert {r["text"] for r in html_text.extract(pages, None).collect()} == {""}
    got = query(spark, "op2_html_text", "page_id")
    for row in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        blocks = html_text.blocks_of(row["html"])
        main = [b.text for b, keep in zip(blocks, html_text.labels_of(blocks), strict=True) if keep]
        assert got[row["page_id"]]["text"] == " ".join(main)
        assert got[row["page_id"]]["n_chars"] == len(" ".join(main))
    model = html_text.train([r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()])
    again = {r["page_id"]: r["text"] for r in html_text.extract(pages, model).collect()}
    assert again[1] == again[2] == ""


# ---------------------------------------------------------------------- language


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = query(spark, "op3_language")
    assert {d: r["held_out"] for d, r in got.items()} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in got}
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = language.learn(docs.where("lang is not null and text is not null"))
    rows = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()]
    assert len(rows) == len(ODD)
    assert {d for d, lang, _ in rows if lang == "und" and d} == {1, 2, 3, 10, 15}
    assert {s for _, lang, s in rows if lang == "und"} == {0.0}
    nothing = language.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(empty, model).collect() == []


def test_language_scores_equal_plain_sums(spark):
    """Counts and log-probabilities of a few texts, gram by gram."""
    train = [("en", "the then"), ("fr", "le lé")]
    langs, logs = language.learn(spark.createDataFrame(train, "lang string, text string"))
    assert langs == ["en", "fr"]

    def grams(text):
        chars, _ = language.characters(language.pa.array([text]))
        return [b for n in language.GRAM_SIZES for b in language.buckets(chars, n).tolist()]

    for column, (_, text) in enumerate(train):
        counts = np.full(1 << language.LOG_BUCKETS, language.SMOOTHING)
        np.add.at(counts, grams(text), 1)
        assert np.allclose(logs[:-1, column], np.log(counts / counts.sum()), atol=1e-5)
    docs = spark.createDataFrame([(1, "the"), (2, "lé")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(docs, (langs, logs)).collect()}
    for d, text in ((1, "the"), (2, "lé")):
        total = logs[-1] + sum(logs[b] for b in grams(text))
        assert got[d]["lang_pred"] == langs[int(total.argmax())]
        assert got[d]["score"] == pytest.approx(float(1 / np.exp(total - total.max()).sum()), rel=1e-4)


# ------------------------------------------------------------------- token files


def token_rows(spark, docs):
    folder = scratch_dir(spark, "tokens")
    token_files.write_tokens(docs, folder, TOKENIZER)
    return sorted((tuple(r) for r in token_files.read_tokens(spark, folder).collect()), key=lambda r: r[1])


def test_token_files(spark, odd, empty, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def expected(rows):
        out, start = [], 0
        for d, t in rows:
            ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
            out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        return out

    got = sorted((tuple(r) for r in QUERIES["op4_token_files"](spark, SMALL).collect()), key=lambda r: r[1])
    assert got == expected(sorted(texts.items()))
    # Rows without an id come first; both orders of them are right.
    rows = token_rows(spark, odd)
    known = sorted(((d, t) for d, t in ODD if d is not None), key=lambda r: r[0])
    assert rows in [expected(none + known) for none in ([(None, PROSE), (None, None)], [(None, None), (None, PROSE)])]
    assert token_rows(spark, empty) == []


def test_mapped_file(tmp_path):
    path = tmp_path / "a b"
    path.write_bytes(np.arange(5, dtype="<u2").tobytes())
    for uri in (str(path), f"file:{tmp_path}/a%20b"):
        found = token_files.mapped(uri, "<u2")
        assert isinstance(found, np.memmap) and found.tolist() == [0, 1, 2, 3, 4]


# --------------------------------------------------------- repeats and near copies


def test_repeats_equal_plain_code(spark, odd, empty, texts):
    got = query(spark, "op5_substring_dedup")
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == (
        brute.without_repeats(texts, 50)
    )
    rows = repeated_spans.remove_repeats(odd).collect()
    assert len(rows) == len(ODD)
    want = brute.without_repeats(KNOWN, 50)
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in rows if r["doc_id"])
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0, 0]
    assert repeated_spans.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("window", [20, 37])
def test_repeats_of_woven_texts(spark, window):
    """Passages that start, end and branch at other places in every text."""
    draw = np.random.default_rng(window)
    passages = [[f"p{p}w{i}" for i in range(draw.integers(15, 90))] for p in range(6)]
    rows = []
    for d in range(60):
        out = []
        for _ in range(draw.integers(1, 6)):
            own = passages[draw.integers(0, 6)]
            a, b = sorted(draw.integers(0, len(own) + 1, 2))
            out += own[a:b] + [f"d{d}n{i}" for i in range(draw.integers(0, 4))]
        rows.append((d, " ".join(out + ["x"] * int(draw.integers(0, 70)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
           for r in repeated_spans.remove_repeats(docs, window).collect()}
    assert got == brute.without_repeats(dict(rows), window)


def test_near_copies_equal_plain_code(spark, odd, empty, texts):
    got = query(spark, "op8_jaccard_join")
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute.components(texts, 3, 90)
    rows = jaccard_join.jaccard_components(odd).collect()
    want = brute.components(KNOWN, 3, 90)
    assert len(rows) == len(ODD)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in rows if r["doc_id"])
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert jaccard_join.jaccard_components(empty).collect() == []


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 70)])
def test_near_copies_around_the_threshold(spark, n, percent):
    """Groups of edited copies, so that many pairs lie on either side of the threshold."""
    draw = np.random.default_rng(percent)
    rows, d = [], 0
    for size in (8, 12, 30, 60, 120):
        base = [f"s{size}w{i}" for i in range(size)]
        for _ in range(25):
            own = list(base)
            for _ in range(draw.integers(0, 4)):
                own[draw.integers(0, size)] = f"e{draw.integers(0, 9)}"
            rows.append((int(d), " ".join(own[: size - int(draw.integers(0, 2 + size // 20))])))
            d += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard_join.jaccard_components(docs, n, percent).collect()}
    assert got == brute.components(dict(rows), n, percent)


def test_parities_never_rule_out_too_much():
    draw = np.random.default_rng(4)
    for _ in range(300):
        pool = draw.integers(0, 1 << 62, 400).astype(np.uint64)
        a, b = (np.unique(draw.choice(pool, draw.integers(1, 400))) for _ in range(2))
        assert jaccard_join.apart(jaccard_join.parities(a), jaccard_join.parities(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 140), (9, 9)]
    found = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {**dict.fromkeys([*range(100, 141), 5], 5), **dict.fromkeys([*range(200, 260), 7], 7), 9: 9}
    assert {r["id"]: r["component"] for r in found} == want


# ---------------------------------------------------- rules, secrets, quality, pieces


def test_rules_and_secrets_of_tables(spark, odd, empty, texts):
    got = query(spark, "op9_quality_rules")
    for d, t in texts.items():
        row = got[d]
        mine = (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"],
                row["base_failed"])
        assert mine == brute.rules(t)
    found = query(spark, "op6_secrets")
    for d, t in texts.items():
        spans = brute.secrets(t)
        joined = ",".join(f"{secret_spans.BASE_KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)
        assert found[d]["base_sha256"] == secret_spans.digest(joined)
        assert [found[d][f"n_{k}"] for k in secret_spans.BASE_KINDS] == [
            sum(s[1] == i for s in spans) for i in range(3)
        ]
    assert repetition.repetition_report(odd).count() == secret_spans.find_secrets(odd).count() == len(ODD)
    assert repetition.keep_varied(odd).columns == secret_spans.mask_secrets(odd).columns == odd.columns
    kept = [r["doc_id"] for r in repetition.keep_varied(odd).collect()]
    assert sorted(kept, key=str) == sorted([4, 4, 5, None, 6, 12], key=str)
    masked = {r["doc_id"]: r for r in secret_spans.mask_secrets(odd).collect()}
    assert masked[11]["text"] == f"password={secret_spans.MASK} {secret_spans.MASK}"
    assert masked[11]["n_chars"] == len(masked[11]["text"]) and masked[1]["text"] is None
    for run in (repetition.repetition_report, secret_spans.find_secrets, repetition.keep_varied,
                secret_spans.mask_secrets):
        assert run(empty).collect() == []


def test_quality(spark, odd, empty):
    got = query(spark, "op7_quality_classifier")
    assert {d: r["held_out"] for d, r in got.items()} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in got}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    right = [got[d]["predicted"] == q for d, q in labels.items()]
    assert sum(right) >= 0.9 * len(right)
    described = quality.describe(odd).cache()
    kind = "doc_id long, quality int"
    one = spark.createDataFrame([(4, 1), (99, 0), (5, None), (6, 7)], kind)
    model = quality.fit(quality.labelled(described, one, "quality"))
    assert {r["score"] for r in quality.scored(described, model).collect()} == {1.0}
    none = quality.fit(quality.labelled(described, one.limit(0), "quality"))
    assert {r["score"] for r in quality.scored(described, none).collect()} == {0.5}
    both = spark.createDataFrame([(4, 1), (4, 1), (7, 0), (8, 0), (6, 1)], kind)
    scores = quality.scored(described, quality.fit(quality.labelled(described, both, "quality"))).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.scored(quality.describe(empty), model).collect() == []


def test_discriminant_equals_direct_densities():
    draw = np.random.default_rng(3)
    found = draw.normal(size=(60, quality.WIDTH)) * np.linspace(0.5, 2, quality.WIDTH)
    labels = np.arange(60) % 2
    found[labels == 1] += 0.7
    sums = np.stack([
        np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]) for x in (found[labels == 0], found[labels == 1])
    ])
    covariances = [np.cov(found[labels == c].T, bias=True) for c in (0, 1)]
    pooled = (covariances[0] + covariances[1]) / 2
    pooled = (1 - quality.TO_DIAGONAL) * pooled + quality.TO_DIAGONAL * np.diag(np.diag(pooled))
    density = []
    for c in (0, 1):
        drawn = (1 - quality.TO_POOLED) * covariances[c] + quality.TO_POOLED * pooled
        drawn += quality.LEAST_VARIANCE * np.eye(quality.WIDTH)
        away = found - found[labels == c].mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(drawn), away)
        density.append(np.log(30) - 0.5 * np.linalg.slogdet(drawn)[1] - 0.5 * distance)
    want = 1 / (1 + np.exp(density[0] - density[1]))
    assert np.allclose(quality.Discriminant(sums).score(found), want)


def test_pieces_of_tables(spark, odd, empty, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for r in sentence_pieces.encode_texts(odd, PIECE_MODEL).collect():
        text = next(t for d, t in ODD if d == r["doc_id"]) if r["doc_id"] else None
        assert r["round_trip"]
        if r["doc_id"]:
            assert r["ids"] == library.encode(text or "")
    got = query(spark, "op10_sentence_pieces")
    for d, t in texts.items():
        ids = library.encode(t)
        assert got[d]["n_ids"] == len(ids) and got[d]["round_trip"]
        assert got[d]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sentence_pieces.encode_texts(empty, PIECE_MODEL).collect() == []


# -------------------------------------------------------------------------- pipeline


def test_pipeline_equals_plain_code(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}

    def varied(text):
        found, rules = brute.words(text), brute.rules(text)
        size = repetition.SHORTEST_REPEAT
        longest = brute.longest_repeat(found)
        return not rules[-1] and brute.repeated_words(found, size) <= repetition.MOST_COVERED * len(found) and not (
            longest >= size and longest > repetition.LONGEST_SHARE * len(found)
        )

    kept = {d: t for d, t in texts.items() if varied(t)}
    kept = {d: kept[d] for d, (_, lead) in brute.components(kept, 5, 80).items() if d == lead}
    copied = {d for d, _ in brute.copies(kept, items)}
    want = {d: library.encode(brute.masked(t, secret_spans.MASK)) for d, t in kept.items() if d not in copied}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == want and len(got) == len(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_copies", "decontamination", "secrets", "token_ids"
    ]


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            out.collect()
            assert name == "token_ids" or out.columns == docs.columns
