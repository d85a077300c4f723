"""Small corpora for the tests: the odd cases, and planted copies among made-up prose."""

import random

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, shingles string, kept string"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, and columns with clashing names."""
    long = prose(5, 30000)
    rows = [(0, None, None), (1, "", "en"), (2, " \t\n", "en"), (3, "one", None), (4, "one two", "en"), (5, prose(1, 120), "en"), (5, prose(1, 120), "en"), (6, prose(1, 120), "fr"), (7, long, "en"), (None, prose(2, 90), "en"), (8, "ça 漢字 ▁x y z", "fr"), (9, "12 34 !!", "en"), (None, None, None)]
    return spark.createDataFrame([(i, t, lang, None, None, 7, 8, "x", "y") for i, t, lang in rows], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def planted(spark, n=60):
    """Prose with exact copies, near copies of several distances, and passages that many documents share."""
    rng = random.Random(3)
    base = [prose(100 + k, rng.randint(30, 260)) for k in range(n)]
    passage = prose(999, 90)
    texts = []
    for k, t in enumerate(base):
        texts.append(t)
        if k % 4 == 0:
            texts.append(t)
        if k % 3 == 0:
            for edits in (1, 2, 4, 8):
                w = t.split(" ")
                for _ in range(edits):
                    w[rng.randrange(len(w))] = prose(rng.random(), 1)
                texts.append(" ".join(w))
        if k % 5 == 0:
            texts.append(prose(500 + k, 40) + "\n" + passage + " " + prose(700 + k, 30))
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def shingle_set(text, width):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(rows, width, num, den):
    """doc_id -> (set size, smallest linked id), over all pairs."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def link_counts(rows, width, num, den):
    """id -> number of other rows linked with it, over all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    out = {i: 0 for i, _ in sets}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            shared = len(x & y)
            if shared and den * shared >= num * (len(x) + len(y) - shared):
                out[a] += 1
                out[b] += 1
    return out
