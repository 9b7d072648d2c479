"""Plain-Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "the of and to in a is that for it was on with as by this are be from at " * 3


def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, junk, nulls and edges."""
    passage = " ".join(f"shared{i}" for i in range(60))
    base = " ".join(f"w{i * 7 % 97}x{i}" for i in range(120))
    rows = [
        (5, base, "en", "a"),
        (1, base.replace("w7x1 ", "") + " tail", "en", "a"),
        (9, base, "de", "b"),
        (2, f"alpha beta {passage} gamma delta", "en", "b"),
        (3, f"one two three {passage} four", "en", "a"),
        (4, f"start {passage} middle {passage} end", "en", None),
        (6, None, "en", "a"),
        (7, "", "en", "c"),
        (8, " \t\n ", None, "c"),
        (10, "word", "en", "a"),
        (11, "Word", "en", "a"),
        (12, "x " * 200, "en", "a"),
        (13, "y y y y\n" * 20, "fr", "a"),
        (14, "é" * 3000 + " ü\u3000ß\u00a0z", "fr", "b"),
        (15, "A b C d", "en", "b"),
        (16, "a B c D", "en", "b"),
        (17, base.upper(), "en", "c"),
        (18, LONG, "en", "c"),
        (19, "the\x0bof\x0cand\r\nto", "en", "a"),
        (20, "😀 " * 25 + "end", "en", "a"),
    ]
    return rows


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def substring_dedup(rows, size=20):
    first, out = {}, []
    marked = [(i, words(t)) for i, t in rows]
    for i, w in marked:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, (i, s)), (i, s))
    for i, w in marked:
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (i, s):
                gone.update(range(s, s + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def similar(rows, percent=60):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(rows)))
    linked = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                linked[i] += 1
                linked[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(d, len(sets[i]), linked[i], ids[find(i)]) for i, (d, _) in enumerate(rows)]


def base_quality(t):
    t = t or ""
    w = words(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    lines, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)
