"""Main text of pages written by hand, of broken markup, and of very long pages."""

import resource
import time

import numpy as np
import pytest

from emberlog.llm import html_text
from emberlog.llm.queries import QUERIES

TRAINING = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet(f"{TRAINING}/pages.parquet")
    return html_text.train(html_text.training_sample(pages))


ONE = "The river rose three metres in the night, and by morning the lower road was under water."
TWO = "Nobody was hurt, the council said, but two bridges stay closed until they have been looked at."
THREE = "Work on the new wall is to begin in spring. It will cost more than was planned."

# Layouts that the training pages don't have; the article is the same in each.
WRITTEN = {
    "table": f"""<html><body><table><tr><td><a href=/>Home</a> <a href=/n>News</a></td></tr></table>
        <div class="post"><h1>Flood &amp; wall</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div>
        <div class="footer">Copyright 2024 <a href=/i>Imprint</a></div></body></html>""",
    "cookies": f"""<body><div class="cookie-banner">We use cookies. <button>Accept</button></div>
        <nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>
        <main><h1>Flood &amp; wall</h1>
        <p>{ONE}<p>{TWO}<aside><h3>Read also</h3><p><a href=/x>Other news of the day</a></aside><p>{THREE}</main>
        <section id="comments"><p>Good article, thank you for it.</p></section>""",
    "advert": f"""<body><header><a href=/>The Daily</a></header><article><h1>Flood &amp; wall</h1><p>{ONE}</p>
        <div class="advert"><p>Buy one now and save a lot of money today.</p></div><p>{TWO}</p>
        <form class="newsletter"><label>Your mail</label><input><button>Subscribe</button></form>
        <p>{THREE}</p></article><footer><p>All rights reserved.</p></footer>""",
}
ARTICLE = f"Flood & wall {ONE} {TWO} {THREE}"


@pytest.mark.parametrize("name", WRITTEN)
def test_pages_written_by_hand(model, name):
    assert html_text.main_texts([WRITTEN[name]], model) == [ARTICLE]


def unlisted(i):
    """A page none of whose elements has a name that tells anything."""
    words = [f"w{(i * 7 + k) % 50}" for k in range(14)]
    text = "".join(f"<p>{' '.join(words)} and part {k} of it is told here.</p>" for k in range(3))
    links = "".join(f"<div><a href=/{k}>Link {k}</a></div>" for k in range(5))
    return f"<body><div>{links}</div><div>{text}</div><div>{links}</div>", words


def test_pages_without_any_section_name(spark):
    rows = [(i, "u", unlisted(i)[0]) for i in range(60)] + [(0, "u", unlisted(0)[0]), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    model = html_text.train(html_text.training_sample(pages))
    got = html_text.extract(pages, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            words = " ".join(unlisted(r["page_id"])[1])
            assert r["text"] == " ".join(f"{words} and part {k} of it is told here." for k in range(3))


def test_repeated_pages_and_clashing_names(spark):
    kind = "page_id long, url string, html string, text string, n_chars int, order string, block int"
    rows = [(i % 2, f"u{i}", list(WRITTEN.values())[i % 2], "t", 1, "o", 2) for i in range(4)]
    pages = spark.createDataFrame(rows, kind).repartition(2)
    model = html_text.train(html_text.training_sample(pages))
    got = html_text.extract(pages, model).collect()
    assert sorted((r["page_id"], r["url"]) for r in got) == sorted((r[0], r[1]) for r in rows)
    assert len({(r["page_id"], r["text"]) for r in got}) == 2


BROKEN = {
    "tags": "<a ", "quotes": '<p title="x ', "divs": "<div>", "divs with text": "<div>x ", "classes": '<div class="aa b">',
    "ends": "<div></x>", "scripts": "<script ", "script ends": "</script ", "svg": "<svg>", "rules": "<b><hr>",
    "comments": "<!-- ", "values": "<p a='\">x", "hidden": "<noscript><p>x", "closed": "<b><div/>", "mixed": "<p a=\"'<q b='\"",
}


def seconds(html):
    start = time.thread_time()
    html_text.blocks_of(html)
    return time.thread_time() - start


@pytest.mark.parametrize("name", BROKEN)
def test_broken_markup_is_read_in_proportion_to_its_length(name):
    unit = BROKEN[name]
    short, long = (unit * (size // len(unit)) for size in (50_000, 400_000))
    assert seconds(long) < 24 * max(seconds(short), 0.02)


def test_a_page_of_a_megabyte(model):
    """Deep and long, with text in every element: read and labelled in bounded memory."""
    html = '<div class="a">x y ' * (1_000_000 // 19)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert isinstance(html_text.main_texts([html, "<p>a"], model)[0], str)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 * 1024


def test_stretches_change_nothing(model, monkeypatch):
    html = [unlisted(i)[0] * 3 for i in range(5)] + list(WRITTEN.values())
    blocks = [html_text.blocks_of(h) for h in html]
    whole = model.judge(blocks)
    monkeypatch.setattr(html_text, "BATCH_BLOCKS", 24)
    parts = model.judge(blocks)
    for page, found in enumerate(blocks):
        assert parts[: len(found), page] == pytest.approx(whole[: len(found), page], abs=1e-5)
        x, mask = html_text.padded([html_text.vectors(found)], len(found))
        assert model.probabilities(x, mask)[:, 0] == pytest.approx(whole[: len(found), page], abs=1e-5)


def test_the_articles_of_a_table(spark):
    """Held against the pages' own sections, which the labeller of other pages has not seen."""
    model = html_text.train(html_text.training_sample(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")))
    pages = spark.read.parquet(f"{TRAINING}/pages.parquet").collect()
    right = 0
    for row, text in zip(pages, html_text.main_texts([r["html"] for r in pages], model), strict=True):
        blocks = html_text.blocks_of(row["html"])
        right += text == " ".join(b.text for b, k in zip(blocks, html_text.labels_of(blocks), strict=True) if k)
    assert right >= 0.95 * len(pages)
    assert np.mean([len(t["text"]) > 0 for t in QUERIES["op2_html_text"](spark, TRAINING).collect()]) > 0.9
