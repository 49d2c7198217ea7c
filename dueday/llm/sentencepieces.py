"""SentencePiece encoding by streaming Viterbi, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .sent import Sent
from .textblocks import BYTE_VALUES, U64, blocks, mixed, powers, small_batches, tidy
from .vocabulary import MODEL, Vocabulary, by_length, model_file, substring_ids

BLOCK = 1 << 21
SHORT = 24  # bytes of a stretch that is encoded together with others
TOGETHER = 64  # fewer than this of one length go one by one
CACHED = 400_000  # stretches a task remembers


class StreamingViterbi:
    """The best segmentation of a byte stream, with a bounded memory of it.

    Only positions less than the longest piece behind the end can still be
    reached. When the paths to all of them go through one boundary, the ids up to
    it are final: they are handed out and forgotten. Among equal sums the piece
    that starts first wins.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known = {vocabulary.pieces[i]: (int(i), float(vocabulary.scores[i])) for i in vocabulary.normal}
        self.reach = vocabulary.lengths[0]
        self.data = b""  # from the last final boundary on
        self.best, self.back = [0.0], [(0, -1)]

    def feed(self, data: bytes) -> Iterator[int]:
        for k in range(0, len(data), self.reach):
            self.data += data[k : k + self.reach]
            self._extend()
            yield from self._commit(range(max(len(self.data) - self.reach + 1, 0), len(self.data) + 1))

    def finish(self) -> Iterator[int]:
        yield from self._commit([len(self.data)])

    def _extend(self) -> None:
        v = self.vocabulary
        for end in range(len(self.best), len(self.data) + 1):
            score, back = -np.inf, (0, -1)
            for length in v.lengths:
                if length <= end:
                    found = self.known.get(self.data[end - length : end])
                    if found and self.best[end - length] + found[1] > score:
                        score, back = self.best[end - length] + found[1], (end - length, found[0])
            if self.best[end - 1] + v.fallback > score:
                score, back = self.best[end - 1] + v.fallback, (end - 1, int(v.byte_ids[self.data[end - 1]]))
            self.best.append(score)
            self.back.append(back)

    def _commit(self, alive) -> Iterator[int]:
        ends = set(alive)
        while len(ends) > 1:  # step back from the last until all have met
            last = max(ends)
            ends.remove(last)
            ends.add(self.back[last][0])
        at = boundary = ends.pop()
        ids = []
        while at:
            at, piece = self.back[at]
            ids.append(piece)
        yield from reversed(ids)
        base = self.best[boundary]
        self.data = self.data[boundary:]
        self.best = [x - base for x in self.best[boundary:]]
        self.back = [(max(a - boundary, 0), i) for a, i in self.back[boundary:]]


def _viterbi(vocabulary: Vocabulary, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same recursion for many strings of one length: ids laid end to end, and how many each has."""
    m, length = rows.shape
    ids_at = substring_ids(vocabulary, rows)
    best = np.zeros((length + 1, m))
    back, piece = np.zeros((length + 1, m), np.uint8), np.zeros((length + 1, m), np.int32)
    for end in range(1, length + 1):
        score = np.full(m, -np.inf)
        for size in vocabulary.lengths:
            if size > end:
                continue
            ids = ids_at(end - size, end)
            here = best[end - size] + vocabulary.scores[ids]
            better = (ids >= 0) & (here > score)
            np.copyto(score, here, where=better)
            np.copyto(back[end], size, where=better)
            np.copyto(piece[end], ids, where=better)
        here = best[end - 1] + vocabulary.fallback
        better = here > score
        score[better], back[end, better] = here[better], 1
        piece[end, better] = vocabulary.byte_ids[rows[better, end - 1]]
        best[end] = score
    out = np.full((m, length), -1, np.int32)
    at, every = np.full(m, length), np.arange(m)
    for k in range(length - 1, -1, -1):
        some = at > 0
        if not some.any():
            break
        out[some, k] = piece[at[some], every[some]]
        at[some] -= back[at[some], every[some]]
    return out[out >= 0], (out >= 0).sum(axis=1)


class Encoder:
    """Encodes blocks of texts. Where no piece joins two neighbouring bytes every path
    breaks, so a stretch between such places has the same ids wherever it stands."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.stream = StreamingViterbi(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, data, begin, end, hashes) -> None:
        order, ids, sizes = [], [], []
        for length, own in by_length(begin, end, SHORT):
            if length <= SHORT and len(own) >= TOGETHER:
                found, counts = _viterbi(self.vocabulary, data[begin[own][:, None] + np.arange(length)])
            else:
                each = []
                for i in own:
                    each.append([*self.stream.feed(data[begin[i] : end[i]].tobytes()), *self.stream.finish()])
                found, counts = np.array([x for e in each for x in e], np.int32), np.array([len(e) for e in each])
            order.append(own)
            ids.append(found)
            sizes.append(counts)
        order, sizes = np.concatenate(order), np.concatenate(sizes)
        starts = np.cumsum(sizes) - sizes + len(self.pool)
        self.pool = np.concatenate([self.pool, *ids])
        keys = np.concatenate([self.keys, hashes[order]])
        place = np.argsort(keys)
        self.keys = keys[place]
        self.starts = np.concatenate([self.starts, starts])[place]
        self.sizes = np.concatenate([self.sizes, sizes])[place]

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows laid end to end, and where each row's begin."""
        rows = len(starts) - 1
        if self.vocabulary.dummy_prefix:  # a space before every text that is not empty
            full = np.diff(starts) > 0
            data = np.insert(data, starts[:-1][full], 32)
            starts = starts + np.concatenate([[0], np.cumsum(full)])
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        edge = np.ones(n + 1, bool)
        edge[1:n] = ~self.vocabulary.joins[data[:-1].astype(np.int32) << 8 | data[1:]]
        edge[starts] = True
        cuts = np.flatnonzero(edge)
        begin, end = cuts[:-1], cuts[1:]
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
        hashes = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > CACHED:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        at[at == len(self.keys)] = 0
        new = np.ones(len(distinct), bool) if not len(self.keys) else self.keys[at] != distinct
        if new.any():
            self._learn(data, begin[first[new]], end[first[new]], distinct[new])
            at = np.searchsorted(self.keys, distinct)
        at = at[which]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(begin, starts)]


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in schema.fields if f.name != name], T.StructField(name, kind)])


def encode(
    docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL, exact_col: str | None = None
) -> DataFrame:
    """All columns of ``docs`` and the ids of each text, as the model's scores weigh them.

    The segmentation with the highest sum of piece scores wins; among equal sums
    the one whose last differing piece starts first. A text is read with a space in
    front if the model says so. Bytes that no piece covers become byte pieces,
    as does a literal space mark, so decoding gives every text back if the model
    has all byte pieces. Empty texts have no ids, null texts null.
    A column that has the name ``ids_col`` is replaced. With ``exact_col`` the ids are
    decoded in the same pass, and that column says whether they give the text back. Memory is bounded by a block of texts or the longest text.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(ids_col, *([exact_col] if exact_col else []))
    at = docs.columns.index(text_col)
    schema = _with(docs.schema, ids_col, T.ArrayType(T.IntegerType()))
    schema = _with(schema, exact_col, T.BooleanType()) if exact_col else schema
    sent = Sent(docs.sparkSession, Vocabulary, **model_file(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(sent.value), Decoder(sent.value)
        for batch in batches:
            for block in blocks(batch.column(at), BLOCK):
                ids, starts = encoder.encode(block.data, block.starts)
                rows = batch.slice(block.first, block.rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(starts, pa.int32()), pa.array(ids), mask=rows.column(at).is_null()
                )
                columns = [*rows.columns, lists]
                if exact_col:
                    data, cuts = decoder.decode(ids, starts)
                    columns.append(pa.array(same_rows(data, cuts, block)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


class Decoder:
    """The bytes that ids stand for."""

    def __init__(self, vocabulary: Vocabulary):
        self.lengths = np.array([len(p) for p in vocabulary.pieces] + [0], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        self.prefix = vocabulary.dummy_prefix

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows laid end to end, without the space in front, and where each row's begin."""
        ids = np.where((ids < 0) | (ids >= len(self.lengths)), len(self.lengths) - 1, ids)
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.letters[np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[starts]
        if self.prefix and total:
            spaced = cuts[:-1][np.diff(cuts) > 0]
            spaced = spaced[data[spaced] == 32]
            data = np.delete(data, spaced)
            cuts = cuts - np.searchsorted(spaced, cuts)
        return data, cuts


def same_rows(data: np.ndarray, cuts: np.ndarray, block) -> np.ndarray:
    """Whether each row's bytes are those of the block's row."""
    same = np.diff(cuts) == np.diff(block.starts)
    if same.all():
        wrong = np.flatnonzero(data != block.data)
        same[np.searchsorted(cuts, wrong, "right") - 1] = False
        return same
    for r in np.flatnonzero(same):
        same[r] = np.array_equal(data[cuts[r] : cuts[r + 1]], block.data[block.starts[r] : block.starts[r + 1]])
    return same


def decode(docs: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """All columns of ``docs`` and the text of each list of ids.

    The space that encoding puts in front is taken off. No ids give an empty text,
    null ids a null. Null, unknown and control ids stand for no text; bytes that
    are not UTF-8 become the replacement character. A column that has the name ``text_col`` is replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(text_col)
    at = docs.columns.index(ids_col)
    sent = Sent(docs.sparkSession, Vocabulary, **model_file(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            step = max(1, len(batch) * BLOCK // max(batch.column(at).nbytes, 1))
            for k in range(0, max(len(batch), 1), step):
                rows = batch.slice(k, step)
                lists = rows.column(at)
                ids = lists.flatten().fill_null(-1).to_numpy(False)
                counts = lists.value_lengths().fill_null(0).to_numpy(False).astype(np.int64)
                data, cuts = decoder.decode(ids, np.concatenate([[0], np.cumsum(counts)]))
                null = lists.is_null().to_pylist()
                texts = []
                for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    texts.append(None if null[r] else data[a:b].tobytes().decode("utf-8", "replace"))
                columns = [*rows.columns, pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, text_col])

    return docs.mapInArrow(tidy(run), _with(docs.schema, text_col, T.StringType()))
