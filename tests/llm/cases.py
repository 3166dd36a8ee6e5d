"""Brute-force twins and the odd rows that every operator must take."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sentence(seed, n=60):
    r = random.Random(seed)
    syllables = "ha re on th en in er ou ti ea".split()
    found = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(found))


BASE = sentence(1)
NEAR = BASE.replace(BASE.split()[30], "changed", 1)
LONG = " ".join(sentence(100 + i, 500) for i in range(40))

#: doc_id, text: copies, near copies, a repeated row, nulls, empties, blanks, a long text, odd characters.
ROWS = [
    (5, BASE), (3, BASE), (9, NEAR), (9, NEAR), (12, NEAR + " more"), (20, sentence(2)), (21, sentence(2) + " " + BASE), (22, None), (23, ""), (24, " \t\n "),
    (None, BASE), (None, None), (30, LONG), (31, LONG + " end"), (32, "one"), (33, "one two"), (34, "a<|endoftext|>b  c"), (35, "ÀÉ ½ 日本語 \x1c x"), (36, " ".join(["same"] * 100)), (2**40, sentence(3)),
]

CLASHING = "kept, node, score, digest, matches, key, block, part, comp, n, buckets, first, windows, state, _runs, label, worded"


def odd_docs(spark, rows=None):
    """The odd rows with further columns whose names the operators use inside."""
    extra = [c.strip() for c in CLASHING.split(",")]
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None if t is None else len(t), *(["x"] * len(extra))) for i, t in rows], schema)


def shingle_set(text, width):
    own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    n = min(width, len(own))
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if own else frozenset()


def components(rows, width):
    """doc_id to the smallest id of its component, by comparing all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in rows if i is not None]
    own = {i: i for i, _ in sets}

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((top(i), top(j)))
                own[high] = low
    return {i: top(i) for i in own}


def without_repeats(rows, width=20):
    """doc_id to the kept words; rows in order of id."""
    seen, out = {}, {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: (r[0], r[1] or "")):
        own = words(t)
        gone = [False] * len(own)
        for k in range(len(own) - width + 1):
            first = seen.setdefault(tuple(own[k : k + width]), (i, k))
            if first < (i, k):
                gone[k : k + width] = [True] * width
        out[i] = [w for w, g in zip(own, gone) if not g]
    return out
