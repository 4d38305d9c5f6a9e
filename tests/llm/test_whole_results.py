"""Cases in which an operator once did less than the whole job."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, html_text


def tables(spark, docs, items):
    return (
        spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(3),
        spark.createDataFrame(sorted(items.items()), "item_id long, text string"),
    )


def similarities(spark, docs, items):
    rows = decontaminate.find_copies(*tables(spark, docs, items)).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in rows}) == len(rows)
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}


# ---------------------------------------------------------------- decontamination


def test_edited_copies_that_are_copied_often(spark):
    """One exact copy beside many copies of an edited text, whose seeds are all frequent."""
    item = [f"w{i}" for i in range(40)]
    edited = [w if i % 5 else f"x{i}" for i, w in enumerate(item)]
    rest = [f"o{i}" for i in range(60)]
    docs = {0: " ".join(rest + item + rest)}
    docs |= {d: " ".join([*rest, f"d{d}", *edited, *rest]) for d in range(1, 21)}
    # A phrase of the item that is common without any copy.
    docs |= {d: " ".join([*rest, f"d{d}", *item[10:14], *rest]) for d in range(21, 60)}
    items = {1: " ".join(item), 2: "none of these words is in any text"}
    got = similarities(spark, docs, items)
    assert got == pytest.approx(brute.copies(docs, items)) and set(got) == {(d, 1) for d in range(21)}
    kept = decontaminate.keep_clean(*tables(spark, docs, items)).collect()
    assert {r["doc_id"] for r in kept} == set(range(21, 60))


def test_copies_with_many_words_put_in(spark):
    """A copy that is drawn out to the most that still passes, with its only seed at one end."""
    item = [f"w{i}" for i in range(40)]
    drawn = [x for i, w in enumerate(item[:36]) for x in (w, f"x{i}")] + item[36:]
    docs = {1: " ".join(["o"] * 50 + drawn + ["o"] * 50), 2: " ".join(item[:4] * 30 + item[4:8] * 30)}
    items = {1: " ".join(item), 2: " ".join(item[:4] * 10)}
    got = similarities(spark, docs, items)
    assert got == pytest.approx(brute.copies(docs, items)) and (1, 1) in got


def test_copies_of_woven_texts_equal_plain_code(spark):
    draw = np.random.default_rng(11)
    items = {i: " ".join(f"i{i % 7}w{k}" for k in range(draw.integers(4, 60))) for i in range(12)}
    docs = {}
    for d in range(80):
        out = []
        for _ in range(draw.integers(1, 3)):
            own = items[int(draw.integers(0, 12))].split()
            change = draw.random() / 2
            out += [w if draw.random() > change else f"e{draw.integers(0, 9)}" for w in own]
            out += [f"d{d}n{k}" for k in range(200)]
        docs[d] = " ".join(out)
    got, want = similarities(spark, docs, items), brute.copies(docs, items)
    assert {k: v for k, v in got.items() if v >= 0.5} == pytest.approx(want) and len(want) > 30


def runs_long(item, passage, least):
    """The same as the operator's by pairs of score and item words, cell by cell."""
    cost = round(1000 * least * 2)
    row = [(0, 0)] * (len(passage) + 1)
    for a in item:
        new = [(0, 0)]
        for j, b in enumerate(passage, 1):
            reached = (row[j - 1][0] + (2000 if a == b else -1000) - cost, row[j - 1][1] + 1)
            if a == b and reached[0] >= 0 and reached[1] >= decontaminate.LONG_RUN:
                return True
            skipped = (row[j][0] - 1000 - cost, row[j][1] + 1)
            new.append(max((0, 0), reached, skipped, (new[-1][0] - 1000, new[-1][1])))
        row = new
    return False


def test_long_runs_equal_cell_by_cell():
    draw = np.random.default_rng(5)
    seen = set()
    for _ in range(300):
        item = draw.integers(0, 30, draw.integers(15, 60))
        copy = np.where(draw.random(len(item)) < draw.random() * 0.6, draw.integers(0, 30, len(item)), item)
        passage = np.concatenate([draw.integers(0, 30, draw.integers(0, 30)), copy[: draw.integers(1, len(item))]])
        least = float(draw.choice([0.3, 0.5, 0.75, 1.0]))
        seen.add(got := decontaminate.runs_long(item, passage, least))
        assert got == runs_long(item.tolist(), passage.tolist(), least)
    assert seen == {True, False}


def test_long_parts_of_long_items_are_copies(spark):
    sizes = {1: 59, 2: 300, 3: 1000}
    words = {i: [f"i{i}w{k}" for k in range(n)] for i, n in sizes.items()}
    rest = [f"o{k}" for k in range(50)]
    edited = [w if k % 5 else "x" for k, w in enumerate(words[3][400:430])]
    parts = {
        1: words[1][:29], 2: words[2][100:245], 3: words[3][500:520], 4: edited,
        # Nineteen words are too few, also where they stand twice.
        5: words[3][500:519], 6: words[2][10:29] + rest + words[2][40:59], 7: words[1][20:24],
    }
    docs = {d: " ".join(rest + part + rest) for d, part in parts.items()}
    items = {i: " ".join(w) for i, w in words.items()}
    got = similarities(spark, docs, items)
    score = {(1, 1): 29 / 59, (2, 2): 145 / 300, (3, 3): 20 / 1000, (4, 3): (24 * 2 - 5) / 2000}
    assert got == pytest.approx(score)
    rows = {r["doc_id"]: r for r in decontaminate.find_copies(*tables(spark, docs, items)).collect()}
    assert (rows[2]["first_word"], rows[2]["end_word"]) == (50, 195)
    kept = decontaminate.keep_clean(*tables(spark, docs, items)).collect()
    assert {r["doc_id"] for r in kept} == {5, 6, 7}


# ------------------------------------------------------------------------- pages


def said(html):
    return [b.text for b in html_text.blocks_of(html)]


@pytest.mark.parametrize("body", ["<body><p>one</p>", "<p>one</p>", "one", "<BODY class=a>one", "<div>one</div></body></html>"])
def test_a_head_ends_without_its_tag(body):
    for end in ("", "</head>"):
        head = "<title>t</title><meta name=a><link href=b><style>p{}</style><script>x</script><noscript><i>n</i></noscript>"
        blocks = html_text.blocks_of(f"<!doctype html><html><head>{head}{end}{body}")
        assert [b.text for b in blocks] == ["one"] and "t:head" not in blocks[0].path
    assert said("<html><head><title>t</title></head><body>a</body></html>") == ["a"]


@pytest.mark.parametrize("tag", ["svg-icon", "select-box", "title-bar", "template-x", "head-line", "script-note", "style-a"])
def test_elements_of_ones_own_are_not_hidden(tag):
    html = f"<body><{tag} a=b>in</{tag}><p>one</p><svg><text>x</text></svg><p>two</p>"
    assert said(html) == ["in", "one", "two"]


@pytest.mark.parametrize("tag", ["svg", "select", "template", "noscript"])
def test_elements_without_an_end_hide_only_their_tag(tag):
    assert said(f"<p>one</p><{tag} a=b><p>two</p>") == ["one", "two"]
    assert all(tag not in name for b in html_text.blocks_of(f"<{tag}><p>two</p>") for name in b.path)
    # Also where another one ends later, and with one inside another.
    assert said(f"<{tag}><p>two</p><{tag.upper()}>no</{tag} ><p>three</p>") == ["two", "three"]
    assert said(f"<p>one</p><{tag}>no<{tag}>no</{tag}>no</{tag}\n><p>two</p>") == ["one", "two"]
    assert said(f"<p>one</p><{tag}>no<!-- </{tag}> -->no</{tag}><{tag}/><p>two</p>") == ["one", "two"]


def test_many_elements_without_an_end_are_read_in_time():
    assert len(said("<svg><p>a" * 20_000)) == 20_000


def test_few_pages_that_can_teach_are_all_found(spark):
    able = [f"<nav>n{i}</nav><article><p>Main text {i}.</p></article><footer>f</footer>" for i in range(6)]
    rest = [f"<div>page {i}</div>" for i in range(300)]
    rows = [(i, "u", h) for i, h in enumerate(rest + able + able[:2])] + [(None, "u", None), (999, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    by_hash = [r["html"] for r in spark.createDataFrame([(h,) for h in able], "html string").orderBy(F.xxhash64("html")).collect()]
    # Other pages have smaller hashes than these.
    first = pages.where("html <> ''").select("html", F.xxhash64("html").alias("order")).orderBy("order").limit(3).collect()
    assert not {r["html"] for r in first} & set(able)
    for most in (1, 3, 6, 100):
        assert html_text.training_sample(pages, most) == by_hash[:most]
    assert html_text.train(html_text.training_sample(pages, 3)) is not None


# ------------------------------------------------------- seeds of many texts and items


def aligned_pairs(monkeypatch):
    """How many pairs come to be aligned."""
    counts = []
    real = decontaminate.candidates
    monkeypatch.setattr(
        decontaminate, "candidates", lambda *a: counts.append(real(*a)) or counts[-1]
    )
    return lambda: counts[-1].count()


def test_a_phrase_of_many_texts_and_items_makes_no_pairs(spark, monkeypatch):
    phrase = "as a matter of fact"
    docs = {d: " ".join([*(f"d{d}x{k}" for k in range(8)), phrase, *(f"e{d}x{k}" for k in range(8))]) for d in range(1200)}
    items = {i: " ".join([*(f"i{i}x{k}" for k in range(6)), phrase, *(f"j{i}x{k}" for k in range(6))]) for i in range(400)}
    # Some copies, whole and edited, of items that have the phrase.
    docs |= {2000 + i: f"before {items[i]} after" for i in range(20)}
    docs |= {3000 + i: " ".join(w if k % 5 else f"x{k}" for k, w in enumerate(items[i].split())) for i in range(20)}
    pairs = aligned_pairs(monkeypatch)
    got = similarities(spark, docs, items)
    assert set(got) >= {(2000 + i, i) for i in range(20)} | {(3000 + i, i) for i in range(20)}
    near = {d: t for d, t in docs.items() if d >= 2000}
    assert got == pytest.approx(brute.copies(near, {i: items[i] for i in range(20)}))
    assert pairs() < 200


def test_common_seeds_lose_no_pair(spark, monkeypatch):
    """Few words, many texts and items: nearly all seeds are common; the results are those of
    joining every seed, and of plain code but for alignments far from any seed."""
    draw = np.random.default_rng(5)

    def text(size, words):
        return " ".join(f"v{x}" for x in draw.zipf(1.6, size).clip(0, words))

    items = {i: text(int(draw.integers(4, 30)), 12) for i in range(40)}
    docs = {d: text(int(draw.integers(4, 60)), 12) for d in range(60)}
    for d in range(60, 90):
        own = items[int(draw.integers(0, 40))].split()
        docs[d] = " ".join([text(9, 40), *(w if draw.random() < 0.8 else "gone" for w in own), text(9, 40)])
    want = brute.copies(docs, items)
    got = similarities(spark, docs, items)
    assert len(set(want) - set(got)) < 0.03 * len(want) and len(want) > 100
    monkeypatch.setattr(decontaminate, "FEW", 10**9)
    assert similarities(spark, docs, items) == got


def test_telling_words_are_in_every_copy():
    draw = np.random.default_rng(8)
    for _ in range(300):
        item = draw.integers(0, 30, draw.integers(4, 70)).astype(np.uint64)
        often = draw.integers(0, 9, 30)[item.astype(np.int64)]
        told = set(decontaminate.telling_words(item, often, 0.5).tolist())
        size = len(item)
        # The most words that can be missing from a whole copy, the telling ones first.
        for low, high in [(0, size), *((i, i + 20) for i in range(size - 19))]:
            part = item[low:high].tolist()
            kept = sorted(part, key=lambda w: w in told)[: -(-len(part) // 2)]
            assert told & set(kept)
