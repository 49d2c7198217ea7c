"""Runs of repeated words against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import documents

from dueday.llm.periodic import Catchers, find_runs
from dueday.llm.textblocks import U64, mixed


def plain_runs(words):
    """Maximal stretches of each period, those of a smaller period first."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and not any(s <= i and j + q <= s + m and q % p == 0 for s, m, p in found):
                found.append((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def expected(rows):
    out = []
    for d, text in rows:
        words = planted(d, re.findall("[^\x20\x09-\x0d]+", text or ""))
        runs = plain_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        out.append((
            d, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def values(words):
    return mixed(np.array(words, U64) + U64(1))


def sequences(seed):
    draw = random.Random(seed)
    parts = []
    for _ in range(draw.randrange(1, 7)):
        unit = [draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(draw.randrange(1, 40))]
        parts += unit * draw.randrange(1, 9) + unit[: draw.randrange(len(unit))]
    return parts


@pytest.mark.parametrize("step", [None, 1, 7])
def test_catchers(step):
    catchers = Catchers()
    for seed in range(60 if step == 1 else 400):
        words = sequences(seed)
        v = values(words)
        for at in range(0, len(v), step or len(v)):
            catchers.append(v[at : at + (step or len(v))])
        assert catchers.close() == plain_runs(words), seed


def test_thue_morse_is_no_run():
    """Hash windows of such words collide easily; the answer is still exact."""
    words = [bin(i).count("1") % 2 for i in range(5000)]
    catchers = Catchers()
    catchers.append(values(words))
    assert catchers.close() == []


def test_long_text_in_pieces():
    words = [i % 9000 for i in range(150_000)]
    words[70_000] = 9001
    catchers = Catchers()
    catchers.append(values(words))
    assert catchers.close() == [(0, 70_000, 9000), (70_001, 79_999, 9000)]


def test_rows(spark):
    rows = [(i, " ".join(f"w{x}" for x in sequences(i))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n "), (None, "a " * 30), (103, "b\x0bc\x0c" * 20), (103, "b\x0bc\x0c" * 20), (104, "é ü " * 12), (105, "A a " * 11 + "A A")]
    got = find_runs(documents(spark, rows).repartition(3), plant=True).drop("runs")
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
    assert find_runs(documents(spark, []), plant=True).count() == 0


def test_collapsed_text(spark):
    rows = [(1, "x " * 5 + "one two three " * 9 + "end")]
    (row,) = find_runs(documents(spark, rows), with_text=True).collect()
    assert row.collapsed == "x " * 5 + "one two three end" and [tuple(r) for r in row.runs] == [(5, 27, 3)]
