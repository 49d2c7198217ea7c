"""Numpy columns and texts that travel packed: few rows, many values in each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import U64, mixed, text_buffers, tidy

CODEC = "zstd"
TEXT_PACK_BYTES = 8 << 20


def arrays(table: pa.Table, **kinds) -> list[np.ndarray]:
    """Packed columns of a group, laid end to end."""
    return [
        np.concatenate([np.frombuffer(b.as_buffer(), k) for b in table.column(c)] or [np.zeros(0, k)])
        for c, k in kinds.items()
    ]


def dealt(part: np.ndarray, parts: int, columns: list[np.ndarray]) -> tuple[pa.Array, list[pa.Array]]:
    """Columns cut up by part: the parts that occur, and one packed column per array."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(cuts))
    packed = [
        pa.array([x[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary()) for x in (c[order] for c in columns)
    ]
    return pa.array(some.astype(np.int32)), packed


def row_part(ids: np.ndarray, tags: np.ndarray, parts: int) -> np.ndarray:
    """The part of a row by its id and tag. Where ids repeat or are missing, the tag must tell texts
    apart, so that the rows of one id are spread as well."""
    spread = mixed(tags.astype(U64) + U64(1)) * (tags != 0)
    return (mixed(ids.astype(U64) ^ spread) % U64(parts)).astype(np.int32)


def pack_texts(docs: DataFrame, parts: int) -> DataFrame:
    """(id, tag, text) rows as (part, ids, tags, lengths, missing, data), the texts compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC, 1)
        held: dict[int, list] = {}
        total = 0

        def packed() -> pa.RecordBatch:
            rows = []
            for part, pieces in held.items():
                ids, tags, lengths, missing, data = (np.concatenate(x) for x in zip(*pieces))
                rows.append((part, ids.tobytes(), tags.tobytes(), lengths.tobytes(), missing.tobytes(),
                             codec.compress(data.tobytes(), asbytes=True)))
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 5])],
                ["part", "ids", "tags", "lengths", "missing", "data"],
            )

        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            missing = batch.column(2).is_null().to_numpy(False)
            data, starts = text_buffers(batch.column(2))
            part, lengths = row_part(ids, tags, parts), np.diff(starts)
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                texts = np.concatenate([data[starts[r] : starts[r + 1]] for r in rows])
                held.setdefault(int(p), []).append((ids[rows], tags[rows], lengths[rows], missing[rows], texts))
            total += len(data)
            if total > TEXT_PACK_BYTES:
                yield packed()
                held.clear()
                total = 0
        if held:
            yield packed()

    return docs.mapInArrow(tidy(run), "part int, ids binary, tags binary, lengths binary, missing binary, data binary")


def unpack_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tags, missing, bytes, starts) of a part, ordered by id and tag."""
    ids, tags, lengths, missing = arrays(table, ids=np.int64, tags=np.int64, lengths=np.int64, missing=bool)
    codec = pa.Codec(CODEC)
    pieces = []
    for packed, sizes in zip(table.column("data"), table.column("lengths")):
        size = int(np.frombuffer(sizes.as_buffer(), np.int64).sum())
        pieces.append(np.frombuffer(codec.decompress(packed.as_buffer(), size), np.uint8) if size else np.zeros(0, np.uint8))
    data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    order = np.lexsort((tags, ids))
    data = np.concatenate([data[starts[r] : starts[r + 1]] for r in order] or [data])
    return ids[order], tags[order], missing[order], data, np.concatenate([[0], np.cumsum(lengths[order])])
