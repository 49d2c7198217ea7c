"""Removal of byte strings that occur earlier in the corpus, by suffix sorting and a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .packs import arrays, dealt, pack_texts, row_part, unpack_texts
from .textblocks import BYTE_VALUES, ODD, U64, blocks, mixed, powers, small_batches, tidy

LENGTH = 100
GRAM = 32  # bytes of an anchor
HELD_ANCHORS = 500_000
PART_BYTES = 4 << 20
LONG = 1 << 19  # texts are cut into stretches of this many windows
SORTED = 7  # symbols that the first sort compares
LAST_ID = (1 << 63) - 1

ANCHOR = {"h": U64, "c": U64, "id": np.int64, "tag": np.uint32, "at": np.uint32, "n": np.uint8, "off": np.uint8}
SPAN = {"id": np.int64, "tag": np.uint32, "at": np.uint32, "n": np.uint8}


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations of ``symbols`` (0..256) ordered by at least their first ``depth``
    symbols, by prefix doubling; the order, and each position's rank."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for k in range(SORTED):
        key = (key << 9) | np.roll(symbols, -k)
    done = SORTED
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if done >= depth or fresh[-1] == n - 1:
            return order, rank
        key = rank * n + np.roll(rank, -done)
        done *= 2


def common_prefix_breaks(bwt: np.ndarray, least: int) -> np.ndarray:
    """For each place j of the suffix order, whether suffixes j-1 and j share fewer than ``least`` symbols.

    Breadth-first backward extension: the interval of each string w is extended
    to the intervals of cw for every symbol c that precedes it. An interval of
    strings of length l whose right end is new has there a common prefix of
    l - 1, so values come in increasing order, and intervals whose end is known
    are not followed. It stops before ``least``: ends not reached share at least that much.
    """
    n = len(bwt)
    step = np.empty(n, np.int64)  # where the suffix with the preceding symbol in front stands
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    first = np.sort(bwt, kind="stable")
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lows, highs = np.array([0]), np.array([n])
    for _ in range(least):
        sizes = highs - lows
        total = int(sizes.sum())
        if not total:
            break
        which = np.repeat(np.arange(len(lows)), sizes)
        inside = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lows[which]
        places = step[inside]
        if total > n // 8:
            owner = np.full(n, -1)
            owner[places] = which
            places = np.flatnonzero(owner >= 0)
            which = owner[places]
        else:
            order = np.argsort(places)
            places, which = places[order], which[order]
        symbol = first[places]
        cut = np.flatnonzero((which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1]) | (places[1:] != places[:-1] + 1)) + 1
        lows = places[np.concatenate([[0], cut])]
        highs = places[np.concatenate([cut - 1, [len(places) - 1]])] + 1
        new = ~known[highs]
        lows, highs = lows[new], highs[new]
        known[highs] = True
    return known[:n]


def repeated_windows(contexts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``least`` bytes that occur in more than one place: a group number, context and offset each."""
    lengths = np.array([len(c) for c in contexts])
    symbols = np.zeros(int((lengths + 1).sum()), np.int16)
    starts = np.cumsum(lengths + 1) - lengths - 1
    for at, context in zip(starts, contexts):
        symbols[at : at + len(context)] = context.astype(np.int16) + 1
    order, _ = suffix_order(symbols, least)
    bwt = symbols[order - 1]  # before the first stands the last separator, as in a rotation
    group = np.cumsum(common_prefix_breaks(bwt, least))
    owner = np.searchsorted(starts, order, "right") - 1
    offset = order - starts[owner]
    whole = offset + least <= lengths[owner]
    group, owner, offset = group[whole], owner[whole], offset[whole]
    shared = np.bincount(group, minlength=1)[group] > 1
    return group[shared], owner[shared], offset[shared]


def _stretch(values: np.ndarray, up, down, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that have the same anchor, in a stretch of hashed bytes.

    The anchor of a window is its gram with the smallest hash, the leftmost of
    equal ones, so equal windows anywhere have equal anchors at equal offsets.
    Returns first window, number of windows, anchor offset, anchor hash, context hash.
    """
    m, width = len(values), length - GRAM + 1
    sums = np.empty(m + 1, U64)
    sums[0] = 0
    np.cumsum(values * up[:m], out=sums[1:])
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: m - GRAM + 1])
    low = (1 << 20) - 1
    best = (h & U64(~low & (1 << 64) - 1)) | np.arange(len(h), dtype=U64)
    w = 1
    while 2 * w <= width:
        best = np.minimum(best[:-w], best[w:])
        w *= 2
    if w < width:
        best = np.minimum(best[: len(best) - (width - w)], best[width - w :])
    anchor = (best & U64(low)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    count = np.diff(np.append(first, len(anchor)))
    at = anchor[first]
    end = first + count + length - 1
    context = (sums[end] - sums[first]) * down[first]
    context = mixed(context + ((at - first) * 1000 + count).astype(U64) * U64(ODD))
    return first, count, at - first, h[at], context


def _ordered(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Anchors by hash, context and place, each place once: rows that repeat id and text are no copies of themselves."""
    order = np.lexsort((rows["at"], rows["tag"], rows["id"], rows["c"], rows["h"]))
    rows = {k: x[order] for k, x in rows.items()}
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([rows[k][1:] != rows[k][:-1] for k in ("h", "c", "id", "tag", "at")], axis=0)
    return {k: x[fresh] for k, x in rows.items()}


def _anchors(docs: DataFrame, length: int, parts: int, id_parts: int) -> DataFrame:
    """All anchors by hash, packed; where a task holds equal contexts, only the earliest travels
    and the others are already spans to remove."""
    names = [f"k{i}" for i in range(len(ANCHOR))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, held = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            rows = _ordered({k: np.concatenate(x) for k, x in zip(ANCHOR, zip(*buffer))})
            later = np.zeros(len(rows["h"]), bool)
            later[1:] = (rows["h"][1:] == rows["h"][:-1]) & (rows["c"][1:] == rows["c"][:-1])
            own = {k: x[~later] for k, x in rows.items()}
            some, columns = dealt((own["h"] >> U64(40)).astype(np.int64) % parts, parts, list(own.values()))
            yield pa.record_batch([some, *columns], ["part", *names])
            if later.any():
                yield _span_batch({k: x[later] for k, x in rows.items()}, parts, id_parts, names)

        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in blocks(batch.column(2)):
                values = BYTE_VALUES[block.data]
                up, down = powers(min(len(values), LONG + length) + 1)
                for r in range(block.rows):
                    a, b = int(block.starts[r]), int(block.starts[r + 1])
                    for s in range(a, b - length + 1, LONG):
                        first, n, off, h, c = _stretch(values[s : min(s + LONG + length - 1, b)], up, down, length)
                        k = len(first)
                        buffer.append(
                            (h, c, np.full(k, ids[block.first + r]), np.full(k, tags[block.first + r], np.uint32),
                             (first + (s - a)).astype(np.uint32), n.astype(np.uint8), off.astype(np.uint8))
                        )
                        held += k
                if held > HELD_ANCHORS:
                    yield from packed()
                    buffer, held = [], 0
        if buffer:
            yield from packed()

    return docs.mapInArrow(tidy(run), "part int, " + ", ".join(f"{n} binary" for n in names))


def _span_batch(rows: dict[str, np.ndarray], parts: int, id_parts: int, names: list[str]) -> pa.RecordBatch:
    """Spans to remove, dealt by id into the parts after ``parts``."""
    some, columns = dealt(row_part(rows["id"], rows["tag"], id_parts), id_parts, [rows[k] for k in SPAN])
    none = pa.nulls(len(some), pa.binary())
    some = pa.array(some.to_numpy() + parts, pa.int32())
    return pa.record_batch([some, *columns, *[none] * (len(names) - len(columns))], ["part", *names])


def _judged(anchors: DataFrame, parts: int, id_parts: int) -> DataFrame:
    """By hash: equal contexts leave their earliest; where contexts differ, their owners' texts are wanted."""
    names = [f"k{i}" for i in range(len(ANCHOR))]

    def judge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part >= parts:  # spans, as they came
            columns = arrays(table, **dict(zip(names, SPAN.values())))
            spans = [[x.tobytes()] for x in columns]
            return _out([part - parts], spans, [b""] * 7)
        rows = _ordered(dict(zip(ANCHOR, arrays(table, **dict(zip(names, ANCHOR.values()))))))
        n = len(rows["h"])
        same_h = np.zeros(n, bool)
        same_h[1:] = rows["h"][1:] == rows["h"][:-1]
        later = same_h.copy()
        later[1:] &= rows["c"][1:] == rows["c"][:-1]
        group = np.cumsum(~same_h) - 1
        contexts = np.bincount(group, weights=~later)[group]
        wanted = ~later & (contexts > 1)
        gone, kept = ({k: x[pick] for k, x in rows.items()} for pick in (later, wanted))
        out = []
        for own, columns, place in ((gone, SPAN, 0), (kept, ANCHOR, 1)):
            if len(own["id"]):
                some, packed = dealt(row_part(own["id"], own["tag"], id_parts), id_parts, [own[k] for k in columns])
                empty = [b""] * len(some)
                spans = packed if not place else [empty] * 4
                out.append(_out(some, spans, [empty] * 7 if not place else packed))
        return pa.concat_tables(out) if out else _out([], [[]] * 4, [[]] * 7)

    def _out(part, spans, wanted) -> pa.Table:
        wanted = [[x] if isinstance(x, bytes) else x for x in wanted]
        return pa.table(
            {"part": pa.array(part, pa.int32())}
            | {f"s{i}": pa.array(x, pa.binary()) for i, x in enumerate(spans)}
            | {f"w{i}": pa.array(x, pa.binary()) for i, x in enumerate(wanted)}
        )

    schema = "part int, " + ", ".join([f"s{i} binary" for i in range(4)] + [f"w{i} binary" for i in range(7)])
    return anchors.groupBy("part").applyInArrow(judge, schema)


def _row_keys(ids: np.ndarray, tags: np.ndarray):
    """One ascending number per row of a part, ordered by id and tag, and the same for given ids and tags."""
    known = np.unique(ids)

    def named(some_ids, some_tags) -> np.ndarray:
        return (np.searchsorted(known, some_ids) << 32) + some_tags.astype(np.int64)

    return named(ids, tags), named


def _contexts(texts: DataFrame, wanted: DataFrame, length: int, parts: int) -> DataFrame:
    """The bytes of the wanted contexts, dealt by anchor hash."""
    names = [f"w{i}" for i in range(len(ANCHOR))]
    keep = ("h", "id", "tag", "at", "n")

    def fetch(docs: pa.Table, requests: pa.Table) -> pa.Table:
        rows = dict(zip(ANCHOR, arrays(requests, **dict(zip(names, ANCHOR.values())))))
        found = []
        if len(rows["id"]) and len(docs):
            ids, tags, _, data, starts = unpack_texts(docs)
            keys, named = _row_keys(ids, tags)
            at = np.searchsorted(keys, named(rows["id"], rows["tag"]))
            begin = starts[at] + rows["at"]
            sizes = rows["n"].astype(np.int64) + length - 1
            part = (mixed(rows["h"]) % U64(parts)).astype(np.int32)
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                text = np.concatenate([data[begin[i] : begin[i] + sizes[i]] for i in own])
                found.append((int(p), *(rows[k][own].tobytes() for k in keep), text.tobytes()))
        columns = list(zip(*found)) or [[]] * 7
        return pa.table(
            {"part": pa.array(columns[0], pa.int32())}
            | {k: pa.array(x, pa.binary()) for k, x in zip([*keep, "text"], columns[1:])}
        )

    schema = "part int, " + ", ".join(f"{k} binary" for k in [*keep, "text"])
    return texts.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(fetch, schema)


def _compared(contexts: DataFrame, length: int, id_parts: int) -> DataFrame:
    """Spans of windows that another context holds earlier."""

    def compare(table: pa.Table) -> pa.Table:
        rows = dict(zip(("id", "tag", "at", "n"), arrays(table, id=np.int64, tag=np.uint32, at=np.uint32, n=np.uint8)))
        (data,) = arrays(table, text=np.uint8)
        cuts = np.cumsum(rows["n"].astype(np.int64) + length - 1)[:-1]
        group, owner, offset = repeated_windows(np.split(data, cuts), length)
        at = rows["at"][owner].astype(np.int64) + offset
        order = np.lexsort((at, rows["tag"][owner], rows["id"][owner], group))
        group, owner, at = group[order], owner[order], at[order]
        later = np.zeros(len(order), bool)
        later[1:] = group[1:] == group[:-1]
        owner, at = owner[later], at[later]
        # windows of one context that follow one another become one span
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        begins = np.ones(len(at), bool)
        begins[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(begins)
        n = np.diff(np.append(first, len(at))).astype(np.uint8)
        spans = [rows["id"][owner[first]], rows["tag"][owner[first]], at[first].astype(np.uint32), n]
        some, packed = dealt(row_part(spans[0], spans[1], id_parts), id_parts, spans)
        return pa.table({"part": some} | {f"s{i}": x for i, x in enumerate(packed)})

    return contexts.groupBy("part").applyInArrow(compare, "part int, s0 binary, s1 binary, s2 binary, s3 binary")


def _cut(texts: DataFrame, spans: DataFrame, length: int, with_text: bool) -> DataFrame:
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        ids, tags, missing, data, starts = unpack_texts(docs)
        own, tag, at, n = arrays(found, **dict(zip(("s0", "s1", "s2", "s3"), SPAN.values())))
        keys, named = _row_keys(ids, tags)
        wanted = named(own, tag)
        lows, highs = (np.searchsorted(keys, wanted, side) for side in ("left", "right"))
        edges = np.zeros(len(data) + 1, np.int32)
        for k in range(int((highs - lows).max(initial=0))):  # repeated rows share their spans
            some = lows + k < highs
            begin = starts[lows[some] + k] + at[some]
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + n[some].astype(np.int64) + (length - 1), -1)
        gone = np.cumsum(edges[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[starts[:-1][starts[:-1] < len(data)]] = gone[starts[:-1][starts[:-1] < len(data)]]
        runs = np.concatenate([[0], np.cumsum(opens)])
        digests, kept = [], []
        whole = gone.copy()
        if with_text and len(data):  # a character goes with any of its bytes
            follows = (data & 0xC0) == 0x80
            lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(data))))
            hit = np.zeros(len(data), bool)
            hit[lead[gone]] = True
            whole = hit[lead]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            digests.append(hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest())
            if with_text:
                kept.append(data[a:b][~whole[a:b]].tobytes().decode("utf-8", "replace"))
        out = {
            "doc_id": pa.array(ids, mask=ids == LAST_ID), "tag": tags, "n_bytes": np.diff(starts),
            "n_removed": sums[starts[1:]] - sums[starts[:-1]], "n_spans": runs[starts[1:]] - runs[starts[:-1]],
            "kept_sha256": pa.array(digests, pa.string()),
        }
        if with_text:
            out["kept_text"] = pa.array([None if m else t for m, t in zip(missing, kept)], pa.string())
        return pa.table(out)

    schema = "doc_id long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept_text string" * with_text
    return texts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(cut, schema)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True
) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    A byte goes when a ``length``-byte string that covers it also starts earlier:
    in a smaller id, or in the same text further left. Strings are judged on the
    input. ``kept_sha256`` is taken over the remaining bytes; ``kept_text`` also
    drops the rest of a character that lost a byte.

    * Every window has an anchor, its gram of smallest hash, so equal windows meet
      by anchor hash. Runs of windows with one anchor are one context.
    * Equal contexts are copies: the earliest stays, first within each task, then
      by hash, so passages in very many documents cross the network once per task.
    * The texts of different contexts with one anchor are suffix-sorted together;
      breadth-first backward extension on their Burrows-Wheeler transform, stopped
      at ``length``, gives the windows that several of them share.

    Null and empty texts have no bytes. Rows without an id come last. Rows that
    repeat id and text count once and share the result; different texts under one
    id are ordered by a checksum. Extra columns are ignored. ``length`` is 64 to 255.
    """
    if not 2 * GRAM <= length <= 255:
        raise ValueError(f"length must be {2 * GRAM} to 255")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unclear = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() > 0
    tag = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) if unclear else F.lit(0).cast("long")
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), tag.alias("tag"), "text")
    parts = id_parts = max(16, n_bytes // PART_BYTES)

    judged = materialize(_judged(_anchors(keyed, length, parts, id_parts), parts, id_parts), "anchors")
    wanted = judged.where("length(w0) > 0").select("part", *(f"w{i}" for i in range(len(ANCHOR))))
    contexts = _contexts(pack_texts(keyed, id_parts), wanted, length, parts)
    spans = materialize(_compared(contexts, length, id_parts), "spans")
    columns = ["part", "s0", "s1", "s2", "s3"]
    spans = spans.select(columns).union(judged.where("length(s0) > 0").select(columns))
    return _cut(pack_texts(keyed, id_parts), spans, length, with_text)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is what ``remove_repeats`` keeps.

    Rows that lose all of their text go; rows that had none stay. A column
    ``n_chars`` follows the new text. Rows that lose nothing keep their very text.
    """
    found = remove_repeats(docs, id_col, text_col, length).where("n_removed > 0")
    names = {name: _unused(docs.columns, name) for name in ("cut_id", "cut_tag", "cut_text")}
    found = found.select("doc_id", "tag", "kept_text").distinct().toDF(*names.values())
    found = materialize(found, "cut_texts")
    cut_id, cut_tag, cut_text = (F.col(name) for name in names.values())
    plain = found.where(cut_tag != 0).limit(1).count() == 0  # ids alone tell rows apart
    same = F.col(id_col).cast("long").eqNullSafe(cut_id)
    if not plain:
        same = same & (F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) == cut_tag)
    joined = docs.join(found, same, "left").where(cut_tag.isNull() | (cut_text != ""))
    out = joined.withColumn(text_col, F.when(cut_tag.isNotNull(), cut_text).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        shorter = F.length(text_col).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(cut_tag.isNotNull(), shorter).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _unused(columns: list[str], name: str) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name
