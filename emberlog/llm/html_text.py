"""Main text of web pages: a recurrent labeller of text blocks.

A page is read into leaf blocks: runs of text without a block element between
them, each with its tag path, the names, classes, ids and roles of the open
elements. A block's vector is a hashed bag of its path, a hashed bag of its words
and a few measures (length, share of link text, stops, capitals). A bidirectional
LSTM in numpy reads the blocks of a page in order and gives each the probability
of being main text, so a block is judged with the whole page in view.

The labeller is trained on a bounded sample of the pages whose sections say which
blocks are main text (``TRAINING_PAGES``, those with the smallest hashes of their
html, however few of the table's pages have such sections). If no page has one, it
learns from blocks of running text. These blocks are also laid out anew in other
markup, with menus, sidebars, notices, adverts, forms and reader comments made of
other blocks, so that the labeller doesn't rest on the markup of one site.

Scripts, styles, comments and what a head may hold are no blocks; a head ends where
its markup does, as its closing tag may be left out. Of a template, svg, select or
noscript element without an end only its own tag is none. Character references are
decoded, white space becomes one blank, kept blocks are joined by one blank.

Rows: one for each input row, repeated pages too. Null or empty html, and pages
without main text, give an empty text. Broken markup is read as far as it goes: a tag
without its ">" ends at the next "<". Very long pages: reading takes time in
proportion to their length, a block's path is a link to its parent, and vectors are
made in stretches, so beside the page itself only a few numbers for each block are
held. Without any page to learn from no block is kept. Only page_id, url and html are
read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.words import pieces

TRAINING_PAGES = 400
PATH_BUCKETS, WORD_BUCKETS = 384, 64
HIDDEN = 16
EPOCHS = 12
# Blocks whose vectors are held at once, which bounds the memory of a task.
BATCH_BLOCKS = 8192
# Words that make a block running text where no section tells.
LONG_BLOCK = 12

TOKEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/<>]*)")
# What ends or goes on inside a tag.
MARK = re.compile(r"[<>\"']")
# Elements whose content is no markup; nothing of it is text.
RAW = frozenset("script style textarea title iframe noframes".split())
# Elements that hide what they hold, but only if they have an end.
HOLDERS = frozenset("noscript template svg select".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
# Elements inside a line of text; all others part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["t:article", "t:main", "c:article", "c:content", "c:post", "c:entry", "c:main"])
SIDE = frozenset(
    ["t:nav", "t:header", "t:footer", "t:aside", "t:form", "t:button"]
    + [
        f"c:{word}" for word in
        "ad ads advert advertisement banner sponsor promo promotion nav navigation menu breadcrumb header masthead "
        "footer sidebar aside widget related share social notice cookie consent alert popup modal newsletter "
        "subscribe signup login search form comment reply discussion disqus copyright legal".split()
    ]
)


class Path:
    """An open element with those around it, as a link to its parent: what the parent
    has is added up, so a block holds one link however deep it lies."""

    __slots__ = ("tag", "names", "parent", "buckets", "main", "side", "links", "block")

    def __init__(self, tag: str, rest: str, parent: Path | None):
        self.tag, self.parent = tag, parent
        self.names, self.buckets, self.main, self.side = known_element(tag, rest)
        self.links = int(tag == "a")
        # The nearest element that parts blocks.
        self.block = None if tag in INLINE else self
        if parent:
            self.buckets |= parent.buckets
            self.main |= parent.main
            self.side |= parent.side
            self.links += parent.links
            self.block = self.block or parent.block

    def __iter__(self) -> Iterator[str]:
        """The names of all open elements, from the outermost on."""
        out, at = [], self
        while at:
            out.append(at.names)
            at = at.parent
        return (n for names in reversed(out) for n in names)


class Block(NamedTuple):
    text: str
    path: Path | tuple[()]
    linked: int


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """Tokens of an element: its name, and the words of its classes, ids and role."""
    out = [f"t:{tag}"]
    for value in NAMED.findall(attributes):
        for word in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()):
            out.append("c:" + (word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word))
    return tuple(out)


_elements: dict[tuple[str, str], tuple[tuple[str, ...], int, bool, bool]] = {}


def known_element(tag: str, rest: str) -> tuple[tuple[str, ...], int, bool, bool]:
    """Names of an element, their buckets as bits (two for each, so that few names share
    both), and whether they tell of main text or of something beside it."""
    known = _elements.get((tag, rest))
    if known is None:
        names, bits = names_of(tag, rest), 0
        for name in names:
            bits |= 1 << bucket(name, PATH_BUCKETS) | 1 << bucket(name + "'", PATH_BUCKETS)
        known = names, bits, not MAIN.isdisjoint(names), not SIDE.isdisjoint(names)
        if len(_elements) > 20_000:
            _elements.clear()
        if len(rest) < 200:
            _elements[tag, rest] = known
    return known


class Token(NamedTuple):
    """A comment or declaration (no tag), or a tag with its attributes, from start to end.
    The content of a RAW element is part of its opening."""

    start: int
    end: int
    close: bool
    tag: str
    rest: str
    raw: bool


class Markup:
    """The tags of a page, each place read a bounded number of times.

    A tag ends at its ">". Quoted values may hold any character; a quote without its
    second one is none. A tag that another "<" follows before any ">" ends there. If
    the page ends first, it ends at the next ">" in a value, or is text.
    """

    def __init__(self, html: str):
        self.html, self.size = html, len(html)
        # From which place on there is no such character, and places behind values
        # from which a tag goes on to the end of the page.
        self.none: dict[str, int] = {}
        self.lost: set[int] = set()

    def find(self, text: str, at: int) -> int:
        if at >= self.none.get(text, self.size + 1):
            return -1
        found = self.html.find(text, at)
        if found < 0:
            self.none[text] = min(at, self.none.get(text, at))
        return found

    def tag_end(self, at: int) -> int:
        """Where a tag ends that goes on at a place, or -1."""
        start, passed = at, []
        while at not in self.lost and (found := MARK.search(self.html, at)):
            mark, at = found[0], found.end()
            if mark == ">":
                return at
            if mark == "<":
                return at - 1
            second = self.find(mark, at)
            if second >= 0:
                at = second + 1
                passed.append(at)
        self.lost.update(passed)
        return self.find(">", start) + 1 or -1

    def next(self, at: int) -> Token | None:
        found = TOKEN.search(self.html, at)
        if not found:
            return None
        start, after = found.span()
        if not found[2]:
            text = "-->" if found[0] == "<!--" else ">"
            end = self.find(text, after)
            return Token(start, end + len(text) if end >= 0 else self.size, False, "", "", False)
        tag, end = found[2].lower(), self.tag_end(after)
        if end < 0:
            return None
        rest = self.html[after:end].removesuffix(">")
        raw = tag in RAW and not found[1] and not rest.endswith("/")
        if raw:
            last = RAW_END[tag].search(self.html, end)
            end = self.tag_end(last.end()) if last else -1
            end = end if end >= 0 else self.size
        return Token(start, end, bool(found[1]), tag, rest, raw)

    def holder_ends(self) -> dict[int, int]:
        """Where each element of HOLDERS that has an end begins, and the place after its end."""
        ends: dict[int, int] = {}
        begun: dict[str, list[int]] = {}
        at = 0
        while token := self.next(at):
            at = token.end
            if token.tag in HOLDERS:
                own = begun.setdefault(token.tag, [])
                if not token.close and not token.rest.endswith("/"):
                    own.append(token.start)
                elif token.close and own:
                    ends[own.pop()] = token.end
        return ends


# Elements that end an open fellow of theirs.
FELLOWS = frozenset("li td th tr dd dt option".split())


def blocks_of(html: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    path: Path | None = None
    # How many elements of a name are open.
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked, done = 0, 0
    markup = Markup(html)
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, path or (), linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw)
            parts.append(text)
            if path and path.links:
                linked += len(text)

    def leave(last: Path) -> None:
        """Close an open element and all inside it."""
        nonlocal path
        while path is not last:
            open_[path.tag] -= 1
            path = path.parent
        open_[last.tag] -= 1
        path = last.parent

    while token := markup.next(done):
        say(html[done : token.start])
        done = token.end
        tag = token.tag
        if not tag:
            # A comment parts no line of text, a declaration neither.
            continue
        if token.raw:
            flush()
            continue
        if tag in HOLDERS and not token.close:
            flush()
            ends = markup.holder_ends() if ends is None else ends
            done = ends.get(token.start, done)
            continue
        if tag not in INLINE:
            flush()
        if token.close:
            if open_[tag]:
                last = path
                while last.tag != tag:
                    last = last.parent
                leave(last)
        elif tag not in VOID and tag != "head":
            # A new block ends an open paragraph; an item or cell its open fellow.
            around = path.block if path and tag not in INLINE else None
            if around and (around.tag == "p" or around.tag == tag and tag in FELLOWS):
                leave(around)
            if not token.rest.endswith("/"):
                path = Path(tag, token.rest, path)
                open_[tag] += 1
    say(html[done:])
    flush()
    return out


def bucket(token: str, count: int) -> int:
    return zlib.crc32(token.encode()) % count


_paths: dict[int, np.ndarray] = {}
WIDTH = PATH_BUCKETS + WORD_BUCKETS + 7


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row for each block."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    for row, block in zip(out, blocks, strict=True):
        held = block.path.buckets if block.path else 0
        places = _paths.get(held)
        if places is None:
            if len(_paths) > 50_000:
                _paths.clear()
            raw = np.frombuffer(held.to_bytes(PATH_BUCKETS // 8, "little"), np.uint8)
            places = _paths[held] = np.unpackbits(raw, bitorder="little")
        row[:PATH_BUCKETS] = places
        words = block.text.lower().split()
        held = np.bincount([bucket(w, WORD_BUCKETS) for w in words], minlength=WORD_BUCKETS)
        row[PATH_BUCKETS:-7] = held / np.sqrt((held * held).sum())
        size, text = len(block.text), block.text
        row[-7:] = (
            1, min(np.log1p(size), 7) / 7, min(np.log1p(len(words)), 5) / 5, min(block.linked / size, 1),
            min(sum(map(text.count, ".!?")) / len(words), 1), sum(map(str.isupper, text[:1])), float(text[-1] in ".!?"),
        )
    return out


class Labeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        scale = 1 / np.sqrt(HIDDEN)
        self.weights = {}
        for way in ("ahead", "back"):
            self.weights[f"in_{way}"] = draw.uniform(-0.1, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.weights[f"state_{way}"] = draw.uniform(-scale, scale, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.weights[f"bias_{way}"] = np.zeros(4 * HIDDEN, np.float32)
            self.weights[f"bias_{way}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.weights["out"] = draw.uniform(-scale, scale, 2 * HIDDEN).astype(np.float32)
        self.weights["out_bias"] = np.zeros(1, np.float32)
        # What a block itself says also counts directly.
        self.weights["own"] = np.zeros(WIDTH, np.float32)

    def read(self, x: np.ndarray, mask: np.ndarray, way: str, before=None, learn: bool = True):
        """States of one direction for (steps, pages, WIDTH), going on from those ``before``.

        To learn from, it also gives what the way back needs of each step; else where
        the next stretch goes on from.
        """
        w = self.weights
        steps, pages = mask.shape
        gates = x @ w[f"in_{way}"] + w[f"bias_{way}"]
        hidden, cell = before or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        states, kept = np.zeros((steps, pages, HIDDEN), np.float32), [None] * steps
        for t in range(steps) if way == "ahead" else range(steps - 1, -1, -1):
            z = gates[t] + hidden @ w[f"state_{way}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * cell + i * g
            squashed = np.tanh(new)
            if learn:
                kept[t] = (i, f, o, g, cell, hidden, squashed)
            cell = m * new + (1 - m) * cell
            hidden = m * (o * squashed) + (1 - m) * hidden
            states[t] = hidden
        return states, kept if learn else (hidden, cell)

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.read(x, mask, way)[0] for way in ("ahead", "back")], axis=2)
        return self.guess(x, both)

    def judge(self, pages: list[list[Block]]) -> np.ndarray:
        """(blocks, pages): how likely each block is main text; places past a page's end hold anything.

        Pages are read in stretches of blocks, whose vectors are made anew for each
        direction; only the states are kept for the whole length.
        """
        steps = max(map(len, pages))
        size = max(BATCH_BLOCKS // len(pages), 1)
        starts = range(0, steps, size)
        out = np.zeros((steps, len(pages)), np.float32)
        for k, way in enumerate(("ahead", "back")):
            before, last = None, self.weights["out"][k * HIDDEN : (k + 1) * HIDDEN]
            for start in starts if way == "ahead" else reversed(starts):
                part = slice(start, min(start + size, steps))
                x, mask = padded([vectors(p[part]) for p in pages], part.stop - start)
                states, before = self.read(x, mask, way, before, learn=False)
                out[part] += states @ last
                if way == "ahead":
                    out[part] += x @ self.weights["own"] + self.weights["out_bias"]
        return 1 / (1 + np.exp(-out))

    def guess(self, x: np.ndarray, both: np.ndarray) -> np.ndarray:
        w = self.weights
        return 1 / (1 + np.exp(-(both @ w["out"] + x @ w["own"] + w["out_bias"])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        w, grads = self.weights, {}
        read = {way: self.read(x, mask, way) for way in ("ahead", "back")}
        both = np.concatenate([read[way][0] for way in ("ahead", "back")], axis=2)
        error = (self.guess(x, both) - truth) * mask / max(mask.sum(), 1)
        grads["out"] = np.tensordot(error, both, ([0, 1], [0, 1]))
        grads["out_bias"] = np.array([error.sum()])
        grads["own"] = np.tensordot(error, x, ([0, 1], [0, 1]))
        steps = len(mask)
        for k, way in enumerate(("ahead", "back")):
            out = w["out"][k * HIDDEN : (k + 1) * HIDDEN]
            d_hidden = np.zeros((mask.shape[1], HIDDEN), np.float32)
            d_cell = np.zeros_like(d_hidden)
            d_gates = np.zeros((steps, mask.shape[1], 4 * HIDDEN), np.float32)
            d_state = np.zeros_like(w[f"state_{way}"])
            for t in range(steps - 1, -1, -1) if way == "ahead" else range(steps):
                i, f, o, g, cell, hidden, squashed = read[way][1][t]
                m = mask[t][:, None]
                total = d_hidden + error[t][:, None] * out
                d_out, d_hidden = total * m, total * (1 - m)
                inner = d_cell * m + d_out * o * (1 - squashed**2)
                d_cell = d_cell * (1 - m) + inner * f
                z = d_gates[t]
                z[:, :HIDDEN] = inner * g * i * (1 - i)
                z[:, HIDDEN : 2 * HIDDEN] = inner * cell * f * (1 - f)
                z[:, 2 * HIDDEN : 3 * HIDDEN] = d_out * squashed * o * (1 - o)
                z[:, 3 * HIDDEN :] = inner * i * (1 - g**2)
                d_state += hidden.T @ z
                d_hidden = d_hidden + z @ w[f"state_{way}"].T
            grads[f"in_{way}"] = np.tensordot(x, d_gates, ([0, 1], [0, 1]))
            grads[f"bias_{way}"] = d_gates.sum(axis=(0, 1))
            grads[f"state_{way}"] = d_state
        return grads


def padded(rows: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Pages of different lengths as (steps, pages, width), and where they have blocks."""
    x = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(rows)), np.float32)
    for page, row in enumerate(rows):
        x[: len(row), page], mask[: len(row), page] = row, 1
    return x, mask


def labels_of(blocks: list[Block]) -> list[bool]:
    """Whether the sections around each block make it main text."""
    return [bool(b.path and b.path.main and not b.path.side) for b in blocks]


def running_text(blocks: list[Block]) -> list[bool]:
    """Whether each block reads like the text of an article: sentences, and few links."""
    return [
        len(b.text.split()) >= LONG_BLOCK and any(m in b.text for m in ".!?") and 4 * b.linked <= len(b.text)
        and not (b.path and b.path.side) for b in blocks
    ]


ROOMS = ("article", "main", 'div class="content"', 'div id="content"', 'div class="post-content"',
         'div class="article-body"', 'section class="entry"', 'div class="main"', "div")
TOPS = ('header', 'div class="header"', 'div id="masthead"', "nav", 'ul class="menu"', 'div class="cookie-notice"',
        'div class="notice"', 'div class="breadcrumbs"', 'div class="banner"', 'form class="search"',
        'div class="alert"', 'div role="navigation"', "table", "ul", 'table class="top"')
SIDES = ("aside", 'div class="sidebar"', 'div class="ad"', 'div class="advert"', 'div class="promo"',
         'div class="sponsored"', 'div class="related"', 'div class="share"', 'form class="newsletter"',
         'div class="widget"', 'form', 'div class="subscribe"', 'div class="popup"')
ENDS = ("footer", 'div class="footer"', 'div id="comments"', 'section class="comments"', 'div class="comment-list"',
        'ol class="replies"', 'div class="copyright"', 'div class="login"')


def laid_out(main: list[Block], side: list[Block], talk: list[Block], draw: random.Random) -> tuple[str, list[bool]]:
    """A page of main blocks in one layout of many, with other blocks around and between them."""
    html, truth = ["<body>"], []

    def put(block: Block, tag: str, keep: bool) -> None:
        # Texts of all lengths in all places.
        words = block.text.split()
        if draw.random() < (0.3 if keep else 0.6):
            words = words[: draw.randint(1, 12)]
        text = " ".join(words).replace("&", "&amp;").replace("<", "&lt;")
        html.append(f"<{tag}><a href='/'>{text}</a></{tag}>" if block.linked else f"<{tag}>{text}</{tag}>")
        truth.append(keep)

    def group(opening: str) -> None:
        html.append(f"<{opening}>")
        spoken = "comment" in opening or "repl" in opening
        inner = draw.choice(('div class="comment"', "li", "p")) if spoken else draw.choice(("p", "li", "div", "span"))
        inner = draw.choice(("td", "tr", "th")) if opening.startswith("table") else inner
        for _ in range(draw.randint(1, 4)):
            block = draw.choice(talk if spoken or draw.random() < 0.3 else side or talk)
            html.append(f"<{inner}>")
            put(block, draw.choice(("p", "p", "p", "h1", "h2", "h3", "li", "div")), False)
            html.append(f"</{inner.split()[0]}>")
        html.append(f"</{opening.split()[0]}>")

    for opening in draw.sample(TOPS, draw.randint(1, 3)):
        group(opening)
    wraps = draw.choice(("", '<div id="page">', '<div class="wrapper"><div class="row">'))
    room = draw.choice(ROOMS)
    html += [wraps, f"<{room}>"]
    for at, block in enumerate(main):
        put(block, draw.choice(("h1", "h2")) if not at else draw.choice(("p", "p", "p", "blockquote", "h2", "li")), True)
        if draw.random() < 0.15:
            group(draw.choice(SIDES))
    html.append(f"</{room.split()[0]}>")
    for opening in draw.sample(SIDES, draw.randint(0, 2)) + draw.sample(ENDS, draw.randint(1, 3)):
        group(opening)
    return "".join(html), truth


def train(pages: list[str], seed: int = 7) -> Labeller | None:
    """A labeller from some pages, as they are and laid out anew."""
    draw = random.Random(seed)
    read = [b for b in map(blocks_of, pages) if b]
    known: list[tuple[list[Block], list[bool]]] = []
    # Pages whose sections tell their main text teach; if there are none, those with running text.
    for teacher in (labels_of, running_text):
        known = known or [(b, keep) for b in read if any(keep := teacher(b))]
    if not known:
        return None
    side = [b for blocks, keep in known for b, k in zip(blocks, keep, strict=True) if not k]
    talk = [b for blocks, keep in known for b, k in zip(blocks, keep, strict=True) if k]
    rows = [(vectors(blocks), keep) for blocks, keep in known]
    for blocks, keep in known:
        main = [b for b, k in zip(blocks, keep, strict=True) if k]
        for _ in range(2):
            html, truth = laid_out(main, side, talk, draw)
            again = blocks_of(html)
            if len(again) == len(truth):
                rows.append((vectors(again), truth))
    model = Labeller(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = sorted(range(len(rows)), key=lambda i: (len(rows[i][1]) // 8, draw.random()))
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        draw.shuffle(batches)
        for batch in batches:
            steps = max(len(rows[i][1]) for i in batch)
            x, mask = padded([rows[i][0] for i in batch], steps)
            truth, _ = padded([np.array(rows[i][1], np.float32)[:, None] for i in batch], steps)
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, grad in model.gradients(x, mask, truth[:, :, 0]).items():
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.001 * (grad**2 - second[name])
                model.weights[name] -= (rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
    return model


def main_texts(pages: list[str], model: Labeller | None) -> list[str]:
    """The kept blocks of each page, joined."""
    out = [""] * len(pages)
    if model is None:
        return out
    read = [(at, blocks_of(page)) for at, page in enumerate(pages)]
    read = sorted(((at, b) for at, b in read if b), key=lambda x: len(x[1]))
    while read:
        # Pages of like lengths together, longest first.
        count = max(1, min(256, BATCH_BLOCKS // len(read[-1][1])))
        batch, read = read[-count:], read[:-count]
        keep = model.judge([blocks for _, blocks in batch]) >= 0.5
        for page, (at, blocks) in enumerate(batch):
            out[at] = " ".join(b.text for b, k in zip(blocks, keep[:, page], strict=False) if k)
    return out


def teachers(pages: DataFrame, teacher, *columns: str) -> DataFrame:
    """Columns of the pages in which a teacher finds main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            can = [any(teacher(blocks_of(h))) for h in piece.column("html").to_pylist()]
            yield piece.select(columns).filter(pa.array(can, pa.bool_()))

    return pages.mapInArrow(run, pages.select(*columns).schema)


def training_sample(pages: DataFrame, most: int = TRAINING_PAGES) -> list[str]:
    """The html of at most ``most`` different pages that can teach, those with the smallest hashes.

    The hashes are found first, so that no task sends more than the pages taken.
    Pages are read from the smallest hash on, until enough can teach or all are read.
    If no page has a section that tells, pages with running text are taken.
    """
    return taught(pages, most, labels_of) or taught(pages, most, running_text)


def taught(pages: DataFrame, most: int, teacher) -> list[str]:
    known = pages.where("html is not null and html <> ''").select("html", F.xxhash64("html").alias("order"))
    smallest, largest = -(1 << 63), (1 << 63) - 1
    size = max(pages.count(), 1)
    wanted = 2 * most
    while True:
        upto = min(smallest + (wanted << 64) // size, largest)
        able = teachers(known.where(F.col("order") <= F.lit(upto)), teacher, "order")
        order = [r["order"] for r in able.distinct().orderBy("order").limit(most).collect()]
        if len(order) == most or upto == largest:
            break
        wanted *= 8
    if not order:
        return []
    taken = teachers(known.where(F.col("order").isin(order)), teacher, "order", "html")
    return [r["html"] for r in sorted(taken.groupBy("order").agg(F.min("html").alias("html")).collect())]


def extract(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """page_id, url and text of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            html = [h or "" for h in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id").cast(pa.int64()), piece.column("url"),
                 pa.array(main_texts(html, sent.value), pa.string())],
                names=["page_id", "url", "text"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
