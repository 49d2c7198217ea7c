"""Runs of repeated words, found online by catchers over completed power-of-two blocks.

Words are appended in order. Whenever a block of 2**k words that starts at a multiple of 2**k
is complete, a catcher for it is armed: it compares its block with the suffix of the same length
after every word appended from then on, while that suffix lies 2**k to 2**(k+1) - 1 words further on. Equal
suffixes at distance q are the middle of a square with period q once equality reaches q words; such squares
merge into one run, which grows while appended words keep the period.

The lowest catchers hold ``LEAST_BLOCK`` words and also serve the periods below that. A run of period q and
at least ``max(24, 3 * q)`` words holds a whole aligned block together with its copy q words on,
so no run is missed; a catcher whose block and copy lie in a run of a smaller period is put down. Appending is
vectorised: many words may be appended at once, with the same result as one by one.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import ODD, ODD_INVERSE, SPACED_WORDS, U64, blocks, small_batches, tidy, words

LEAST_BLOCK = 8
LEAST_WORDS, LEAST_POWER = 24, 3  # of a run: words, and length in periods
APPEND_WORDS = 1 << 16


class Catchers:
    """Runs (start, end, period) of a stream of words, given by 64-bit values that stand for them.

    ``append`` takes the next words, one or many; ``close`` ends the text. Block contents are compared by hashes of windows; every run is then confirmed word by word.
    """

    def __init__(self) -> None:
        self.n = 0
        self.x, self.sums = np.zeros(0, U64), np.zeros(1, U64)
        self.open: dict[tuple[int, int], int] = {}  # (period, start) -> end
        self._grow(1 << 10)

    def _grow(self, size: int) -> None:
        self.x = np.concatenate([self.x, np.zeros(size - len(self.x), U64)])
        self.sums = np.concatenate([self.sums, np.zeros(size + 1 - len(self.sums), U64)])
        up, down = np.full(size + 1, ODD, U64), np.full(size + 1, ODD_INVERSE, U64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def append(self, values: np.ndarray) -> None:
        """The next words of the current text."""
        for at in range(0, len(values), APPEND_WORDS):
            self._append(values[at : at + APPEND_WORDS])

    def _append(self, values: np.ndarray) -> None:
        before, now = self.n, self.n + len(values)
        if now > len(self.x):
            self._grow(max(now, 2 * len(self.x)))
        self.x[before:now] = values
        np.cumsum(values * self.up[before:now], out=self.sums[before + 1 : now + 1])
        self.sums[before + 1 : now + 1] += self.sums[before]
        self.n = now
        self._advance(before)
        low = 1
        while LEAST_POWER * low <= now:
            at, period = self._caught(before, low)
            if len(at):
                self._merge(at, period, low)
            low *= 2

    def _window(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of ``size`` words that begin at ``at``."""
        return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def _advance(self, before: int) -> None:
        """Runs that reached the last word go on as far as the new words keep their period; short ones that ended are forgotten."""
        for (period, start), end in list(self.open.items()):
            if end == before:
                self.open[period, start] = end + int(self._same_after(np.array([end - period]), np.array([end]))[0])
            elif not _is_run(end - start, period):
                del self.open[period, start]

    def _same_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on; ``a < b``."""
        same = np.zeros(len(a), np.int64)
        step = 1 << self.n.bit_length()
        while step:
            fits = np.flatnonzero(b + same + step <= self.n)
            i, j = (a + same)[fits], (b + same)[fits]
            same[fits[self._window(i, step) == self._window(j, step)]] += step
            step >>= 1
        return same

    def _same_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words that end before ``a`` equal those that end before ``b``; ``a < b``."""
        same = np.zeros(len(a), np.int64)
        step = 1 << self.n.bit_length()
        while step:
            fits = np.flatnonzero(a - same - step >= 0)
            i, j = (a - same - step)[fits], (b - same - step)[fits]
            same[fits[self._window(i, step) == self._window(j, step)]] += step
            step >>= 1
        return same

    def _caught(self, before: int, low: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, distance) wherever the words from ``before`` on end a copy of a block, ``low`` to ``2 * low - 1`` words after it."""
        size = max(low, LEAST_BLOCK)
        last = self.n - size - low  # the last block that can have a copy by now
        start = max(0, before - 2 * low - size) // size * size
        armed = np.arange(start, last + 1, size)
        if not len(armed):
            return armed, armed
        if low >= self.n - before:  # few blocks wait, and few of their distances are new
            at, period = [], []
            for b in armed.tolist():
                new = np.arange(max(b + low, before - size + 1), min(b + 2 * low - 1, self.n - size) + 1)
                hit = new[self._window(new, size) == self._window(np.array([b]), size)]
                at.append(np.full(len(hit), b))
                period.append(hit - b)
            return np.concatenate(at), np.concatenate(period)
        hashed = self._window(np.arange(start, self.n - size + 1), size)
        padded = np.concatenate([hashed, np.zeros(2 * low, U64)])
        ahead = np.lib.stride_tricks.sliding_window_view(padded, low)[armed - start + low]
        k, d = np.nonzero(ahead == hashed[armed - start][:, None])
        at, period = armed[k], d + low
        end = at + period + size
        new = (end <= self.n) & (end > before)
        return at[new], period[new]

    def _merge(self, at: np.ndarray, period: np.ndarray, low: int) -> None:
        """Extend caught copies both ways and keep each stretch once, unless a run of a smaller period holds the copy."""
        free = ~self._held(at, at + period + max(low, LEAST_BLOCK), low)
        at, period = at[free], period[free]
        begin = at - self._same_before(at, at + period)
        end = at + period + self._same_after(at, at + period)
        for q, s, e in np.unique(np.stack([period, begin, end], axis=1), axis=0).tolist():
            self.open[q, s] = e

    def _held(self, begin: np.ndarray, end: np.ndarray, low: int) -> np.ndarray:
        """Whether one run of a period below ``low`` holds all words from begin to end."""
        known = sorted((s, e) for (q, s), e in self.open.items() if q < low and _is_run(e - s, q))
        if not known:
            return np.zeros(len(begin), bool)
        starts, ends = np.array(known).T
        reach = np.concatenate([[-1], np.maximum.accumulate(ends)])
        return reach[np.searchsorted(starts, begin, "right")] >= end

    def close(self) -> list[tuple[int, int, int]]:
        """End the current text and return its runs as (start, length, period), by start and period."""
        found: dict[int, list[tuple[int, int]]] = {}
        for (q, s), e in sorted(self.open.items()):
            if not _is_run(e - s, q):
                continue
            stretches = [(s, e)]
            same = self.x[s : e - q] == self.x[s + q : e]
            if not same.all():  # different windows with one hash
                edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
                stretches = [(s + a, s + b + q) for a, b in edges.reshape(-1, 2).tolist()]
            found.setdefault(q, []).extend(x for x in stretches if _is_run(x[1] - x[0], q) and not _inside(x, q, found))
        self.open.clear()
        self.n = 0
        return sorted((s, e - s, q) for q, some in found.items() for s, e in some)


def _is_run(length: int, period: int) -> bool:
    return length >= max(LEAST_WORDS, LEAST_POWER * period)


def _inside(stretch: tuple[int, int], period: int, found: dict[int, list[tuple[int, int]]]) -> bool:
    """Whether the stretch lies in a run whose period divides its own. Only periods below twice the
    lowest blocks need the test: longer copies in such a run were not let in."""
    if period >= 2 * LEAST_BLOCK:
        return False
    for p in range(1, period // 2 + 1):
        if period % p == 0 and p in found:
            k = bisect.bisect_right(found[p], (stretch[0], 1 << 62)) - 1
            if k >= 0 and found[p][k][1] >= stretch[1]:
                return True
    return False


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def wrapped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word order of a text with planted periods, or None where the words stay as they are."""
    h = crc_of(doc_id) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""
    best = None
    for run in runs:  # by start and period, so only a greater one takes over
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: those of each run's first period, and those in no run."""
    if not runs:
        return tokens
    drop = np.zeros(len(tokens) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [tokens[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, plant: bool = False, with_text: bool = False) -> DataFrame:
    """Every run of each text, and the text without the repeated words; one row per input row, no shuffle.

    ``plant`` first wraps the texts whose id says so round a period (a test of the detector). ``runs`` lists all runs by start
    and period, ``start`` to ``exponent_milli`` tell the one with the greatest length per period. ``with_text``
    adds the collapsed text itself. Null and empty texts have no words: no runs, and the digest of nothing.
    Repeated rows each give a row, a null id stays null and is never wrapped; an empty table gives an empty one. Other
    columns are not read. A task holds one batch of at most 8 MB, or one longer text.
    """
    small_batches(docs.sparkSession)
    schema = FOUND + (", collapsed string" if with_text else "")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catchers = Catchers()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for block in blocks(batch.column(1)):
                found = words(block, SPACED_WORDS, fold=None)
                for r in range(block.rows):
                    doc_id = ids[block.first + r]
                    tokens = block.data[block.starts[r] : block.starts[r + 1]].tobytes().split()
                    values = found.hashes[found.row_starts[r] : found.row_starts[r + 1]]
                    order = wrapped(doc_id, len(tokens)) if plant else None
                    if order is not None:
                        tokens, values = [tokens[i] for i in order.tolist()], values[order]
                    runs = []
                    if len(values) >= LEAST_WORDS:
                        catchers.append(values)
                        runs = catchers.close()
                    top = best_run(runs)
                    kept = b" ".join(collapsed(tokens, runs))
                    rows.append(
                        (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                         [dict(zip(("start", "length", "period"), run)) for run in runs],
                         hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                         hashlib.sha256(kept).hexdigest(), kept.decode())[: 10 if with_text else 9]
                    )
            if not rows:
                continue
            kinds = [*[pa.int64()] * 6, kind, *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = [c.split()[0] for c in schema.replace("<start:long,length:long,period:long>", "").split(", ")]
    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(tidy(each), schema)
