"""Small inputs and plain-Python versions of the operators."""

import hashlib
import re

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
        ("n_chars", T.LongType()), ("id", T.StringType()), ("node", T.StringType()), ("part", T.StringType()),
        ("tag", T.StringType()), ("benchmark", T.StringType()), ("ids", T.StringType()), ("mark", T.StringType()),
    )]
)


def documents(spark, rows):
    """(doc_id, text[, lang[, source]]) with columns whose names the operators use themselves."""
    full = [(r[0], r[1], *(tuple(r[2:]) + ("en", "src0"))[:2], len(r[1] or ""), *["x"] * 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(n, seed=0, size=900):
    return " ".join(f"w{(i * 7919 + seed * 104729) % size}x{i}{seed}" for i in range(n))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def lettered(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def shingle_set(text):
    w = spaced(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups(ids, linked):
    """Smallest id reachable over the links, by id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def jaccard_groups(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    ids = sorted(sets)
    linked = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    found = groups(ids, linked)
    return sorted((d, len(sets[d]), found[d]) for d in ids)


def repeats_removed(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(rows, items, window=13):
    out = []
    for d, t in rows:
        w = lettered(t)
        hit, held = set(), set()
        for item, text in items:
            v = lettered(text)
            size = min(window, len(v))
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
            for i in range(len(w) - size + 1 if v else 0):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    if item is not None:
                        held.add(str(item))
        out.append((d, len(w), len(hit), sorted(held), bool(hit) and 20 * len(hit) >= len(w)))
    return out
