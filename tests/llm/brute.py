"""The operators' results by plain code on whole texts, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = {**{i: " " for i in range(33, 127) if not chr(i).isalnum()}, **LOWER}


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    found = words((text or "").translate(LOWER))
    if not found:
        return set()
    return {tuple(found[i:i + n]) for i in range(max(len(found) - n + 1, 1))}


def components(texts, n, percent):
    """doc_id to (set size, smallest doc_id reachable by links)."""
    sets = {d: shingles(t, n) for d, t in texts.items()}
    lead = {d: d for d in texts}

    def head(d):
        while lead[d] != d:
            d = lead[d]
        return d

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((head(a), head(b)))
                lead[y] = x
    return {d: (len(sets[d]), head(d)) for d in ids}


def without_repeats(texts, window):
    """doc_id to (words, removed words, digest of the kept ones)."""
    listed = {d: words(t) for d, t in texts.items()}
    first = {}
    for d, w in listed.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in listed.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def repeated_words(found, n):
    """Words inside sequences of n words that occur twice or more."""
    places = collections.defaultdict(list)
    for i in range(len(found) - n + 1):
        places[tuple(found[i:i + n])].append(i)
    return len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(n)})


def longest_repeat(found):
    size = 0
    while repeated_words(found, size + 1):
        size += 1
    return size


def rules(text):
    """word_chars, symbols, repeated lines, repeated words, base_failed of a text."""
    text = text or ""
    found = words(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeat = repeated_words(found, 3)
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        repeat, len(found) < 50 or 100 * repeat > 50 * len(found),
    )


KEYS = "password|passwd|secret|token|api_?key"
ANY_CASE = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in KEYS)
ASSIGN = re.compile(rf"""({ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """(start, kind, end, start of the value) of the base kinds, by start."""
    text = text or ""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def masked(text, mask):
    out, done = "", 0
    for start, end in sorted((value, end) for _, _, end, value in secrets(text)):
        if start >= done:
            out += text[done:start] + mask
        done = max(done, end)
    return out + text[done:]


def best_alignment(item, passage, match=2, mismatch=-1, gap=-1):
    """Smith-Waterman score, cell by cell."""
    row, best = [0] * (len(passage) + 1), 0
    for a in item:
        new = [0]
        for j, b in enumerate(passage, 1):
            new.append(max(0, row[j - 1] + (match if a == b else mismatch), row[j] + gap, new[-1] + gap))
        row = new
        best = max(best, *row)
    return best


def copies(texts, items, least=0.5, seed=4):
    """(doc_id, item_id) to similarity, for pairs with a sequence of ``seed`` words in common."""
    out = {}
    plain = {i: words((t or "").translate(PLAIN)) for i, t in items.items()}
    grams = {i: {tuple(w[k:k + seed]) for k in range(len(w) - seed + 1)} for i, w in plain.items()}
    for d, t in texts.items():
        found = words((t or "").translate(PLAIN))
        mine = {tuple(found[k:k + seed]) for k in range(len(found) - seed + 1)}
        for i, item in plain.items():
            if mine & grams[i]:
                share = best_alignment(item, found) / (2 * len(item))
                if share >= least:
                    out[d, i] = share
    return out
