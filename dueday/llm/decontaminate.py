"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textblocks import LETTER_WORDS, Block, blocks, small_batches, text_buffers, tidy, words

WINDOW = 13
COVERAGE = 20  # one word in so many
ROUND_WORDS = 1 << 18  # item words to an automaton


class SuffixAutomaton:
    """Every sub-sequence of the items' words, and which items hold each window."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        ends = []
        for _, sequence in items:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
            ends.append(last)
        self.items: dict[int, set[str]] = {}  # by state of a window
        self.whole: dict[int, list[tuple[int, str | None]]] = {}  # short items that end in a state
        self._over: dict[int, list[tuple[int, str | None]]] = {-1: [], 0: []}
        for (item, sequence), end in zip(items, ends):
            if 0 < len(sequence) < window:
                self.whole.setdefault(end, []).append((len(sequence), item))
            for i, state, matched in self.stream(sequence):
                if matched >= window:
                    held = self.items.setdefault(self.window_state(state), set())
                    if item is not None:
                        held.add(item)

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            target = self.next[at][word]
            exact = self.length[target] == self.length[at] + 1
            self.link[state] = target if exact else self._split(at, word, target)
        return state

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[target]))
        self.link[copy], self.link[target] = self.link[target], copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def stream(self, sequence) -> Iterator[tuple[int, int, int]]:
        """(position, state, length of the longest match that ends there)."""
        state = matched = 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            yield i, state, matched

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def short_items(self, state: int, matched: int) -> Iterator[tuple[int, str | None]]:
        """Items below the window size that end here."""
        for size, item in self.whole.get(state, ()):
            if size <= matched:
                yield size, item
        above = self.link[state]
        if above not in self._over:
            chain, at = [], above
            while at not in self._over:
                chain.append(at)
                at = self.link[at]
            for s in reversed(chain):
                self._over[s] = self.whole.get(s, []) + self._over[self.link[s]]
        yield from self._over[above]


class Matcher:
    """Finds the items' windows in blocks of text."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        column = pa.array(texts, pa.string())
        data, starts = text_buffers(column)
        found = words(Block(0, len(texts), data, starts), LETTER_WORDS)
        self.vocabulary, codes = np.unique(found.hashes, return_inverse=True)
        cuts = found.row_starts.tolist()
        sequences = [codes[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
        self.automaton = SuffixAutomaton(list(zip(ids, sequences)), window)
        sizes = [len(s) for s in sequences if s]
        self.least = min([window, *sizes])
        rows = found.rows()
        same = rows[1:] == rows[:-1]
        self.pairs = np.unique((codes[:-1] * len(self.vocabulary) + codes[1:])[same])

    def runs(self, found) -> Iterator[tuple[int, np.ndarray]]:
        """Stretches of words in which every two neighbours stand together in an item.

        Anywhere else no match is longer than one word, so the automaton need not go there.
        """
        n = len(found.hashes)
        if not n or not len(self.vocabulary):
            return
        codes = np.minimum(np.searchsorted(self.vocabulary, found.hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[codes] == found.hashes
        joined = known[1:] & known[:-1]
        at = np.flatnonzero(joined)
        if len(self.pairs):
            pair = codes[at] * len(self.vocabulary) + codes[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[at] = self.pairs[place] == pair
        else:
            joined[:] = False
        starts = found.row_starts[(found.row_starts > 0) & (found.row_starts < n)]
        joined[starts - 1] = False
        cuts = np.concatenate([[0], np.flatnonzero(~joined) + 1, [n]])
        sizes = np.diff(cuts)
        for k in np.flatnonzero(sizes >= self.least):
            if known[cuts[k]]:
                yield int(cuts[k]), codes[cuts[k] : cuts[k + 1]]

    def matches(self, found) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, word after the last, items) of every occurrence."""
        automaton = self.automaton
        for start, codes in self.runs(found):
            for i, state, matched in automaton.stream(codes.tolist()):
                end = start + i + 1
                if matched >= automaton.window:
                    yield end - automaton.window, end, automaton.items[automaton.window_state(state)]
                for size, item in automaton.short_items(state, matched):
                    yield end - size, end, {item} - {None}


def _item_rounds(items: DataFrame, limit: int) -> Iterator[tuple[list, list]]:
    """Items in rounds of bounded size; the driver holds one round at a time."""
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        size = len((row["text"] or "").split()) + 1
        if ids and held + size > limit:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["item"])
        texts.append(row["text"] or "")
        held += size
    if ids:
        yield ids, texts


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for first, last, begin, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2], max(end, out[-1][3]))
        else:
            out.append((first, last, begin, end))
    return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    coverage: int = COVERAGE,
    round_words: int = ROUND_WORDS,
) -> DataFrame:
    """All columns of ``docs`` and, in a struct ``benchmark``, what each text holds of the items.

    Fields: n_words, n_hit (words inside any occurrence of a window of ``window``
    item words; a shorter item is one window), item_ids (strings, sorted),
    contaminated (some hit, and at least one word in ``coverage``), and clean_text,
    the text without the spans that were hit.

    Items are read in rounds of bounded size. Each round's automaton goes to the
    tasks, and the texts stream through the rounds one after another without a shuffle.

    Null and empty texts have no words and keep their text. Items without words or
    without any rows hit nothing; items without an id hit, but are not listed.
    Repeated items count once by id. A column named ``benchmark`` is replaced.
    """
    state = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.BinaryType()),
            T.StructField("item_ids", T.ArrayType(T.StringType())),
        ]
    )
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.binary()), ("item_ids", pa.list_(pa.string()))])
    small_batches(docs.sparkSession)
    docs = docs.drop("benchmark")
    at = docs.columns.index(text_col)
    listed = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    rounds = _item_rounds(listed.where("text is not null"), round_words)
    out = docs.withColumn("benchmark", F.lit(None).cast(state))
    between = out.schema

    final = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("item_ids", T.ArrayType(T.StringType())),
            T.StructField("contaminated", T.BooleanType()),
            T.StructField("clean_text", T.StringType()),
        ]
    )

    schema = T.StructType([*docs.schema.fields, T.StructField("benchmark", final)])

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column(len(batch.columns) - 1)
        n_words = found.field("n_words").to_numpy(False)
        texts = batch.column(at)
        n_hit = np.zeros(len(batch), np.int64)
        clean = [None] * len(batch)
        spans = found.field("spans")
        lengths = np.diff(np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1]) if len(spans) else []
        for r in np.flatnonzero(lengths):
            rows = np.frombuffer(spans[int(r)].as_buffer(), np.int64).reshape(-1, 4)
            n_hit[r] = int((rows[:, 1] - rows[:, 0]).sum())
            text, kept, last = texts[int(r)].as_py().encode(), [], 0
            for begin, end in rows[:, 2:].tolist():
                kept.append(text[last:begin])
                last = end
            clean[r] = b"".join([*kept, text[last:]]).decode()
        hit = n_hit > 0
        fields = [
            pa.array(n_words), pa.array(n_hit), found.field("item_ids"),
            pa.array(hit & (coverage * n_hit >= n_words)), pa.array(clean, pa.string()),
        ]
        result = pa.StructArray.from_arrays(fields, ["n_words", "n_hit", "item_ids", "contaminated", "clean_text"])
        return pa.RecordBatch.from_arrays(list(batch.columns[:-1]) + [result], names=batch.schema.names)

    def searched(before: DataFrame, ids: list, texts: list, closing: bool) -> DataFrame:
        sent = before.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*sent.value, window)
            for batch in batches:
                known = batch.column(len(batch.columns) - 1).to_pylist()
                results = []
                for block in blocks(batch.column(at)):
                    found = words(block, LETTER_WORDS)
                    spans: dict[int, list] = {}
                    held: dict[int, set] = {}
                    for first, last, which in matcher.matches(found):
                        row = int(np.searchsorted(found.row_starts, first, "right")) - 1
                        base = int(block.starts[row])
                        skip = int(found.row_starts[row])
                        own = spans.setdefault(row, [])
                        new = (first - skip, last - skip, int(found.begin[first]) - base, int(found.end[last - 1]) - base)
                        if own and new[0] <= own[-1][1] and new[0] >= own[-1][0]:
                            own[-1] = (own[-1][0], max(new[1], own[-1][1]), own[-1][2], max(new[3], own[-1][3]))
                        else:
                            own.append(new)
                        held.setdefault(row, set()).update(which)
                    for r, n in enumerate(found.counts().tolist()):
                        was = known[block.first + r]
                        own, listed = spans.get(r, []), held.get(r, set())
                        if was is not None:
                            own = own + [tuple(x) for x in np.frombuffer(was["spans"], np.int64).reshape(-1, 4).tolist()]
                            listed = listed | set(was["item_ids"])
                        packed = np.array(_merged(own), np.int64).tobytes()
                        results.append({"n_words": n, "spans": packed, "item_ids": sorted(listed)})
                columns = list(batch.columns[:-1]) + [pa.array(results, kind)]
                result = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
                yield finish(result) if closing else result

        return before.mapInArrow(tidy(run), schema if closing else between)

    now = next(rounds, ([], []))
    while now is not None:
        after = next(rounds, None)
        out = searched(out, *now, closing=after is None)
        now = after
    text = F.when(F.col("benchmark.n_hit") > 0, F.col("benchmark.clean_text")).otherwise(F.col(text_col))
    return out.withColumn("benchmark", F.col("benchmark").withField("clean_text", text))
