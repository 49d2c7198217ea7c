"""Language-model scores: words learned from the corpus, over a lattice of subword pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .packs import arrays, dealt, pack_texts, unpack_texts
from .sent import Sent
from .textblocks import LOWER, SPACED_WORDS, U64, Block, small_batches, words
from .vocabulary import MODEL, Vocabulary, by_length, model_file, substring_ids

STOP = 0.4  # a word ends after a piece with this probability
RANK_OFFSET = 10.0
TEXT_PART = 8 << 20
SHORT, TOGETHER = 24, 64


def piece_logs(vocabulary: Vocabulary) -> tuple[np.ndarray, float]:
    """Log probability of each piece, from the file's scores, and of a byte without a piece.

    Scores of a merge vocabulary are negated ranks; probabilities fall with the
    rank by Zipf's law. A unigram model's scores are logs already.
    """
    scores = vocabulary.scores[vocabulary.normal]
    used = scores > -1e8
    weights = 1.0 / (RANK_OFFSET - scores) if vocabulary.ranked else np.exp(scores)
    weights = np.where(used, weights, 0.0)
    total = weights.sum() * 1.01
    logs = np.full(len(vocabulary.pieces), -np.inf)
    with np.errstate(divide="ignore"):
        logs[vocabulary.normal] = np.log(weights / total)
    return logs, float(np.log(0.01 / 1.01 / 256))


def lattice_log(vocabulary: Vocabulary, logs: np.ndarray, other: float, rows: np.ndarray) -> np.ndarray:
    """Log probability of strings (m, L), summed over all segmentations.

    Forward recursion in log space: the mass of all paths to a position is the
    log-sum over the pieces that end there of the mass where they begin plus their own.
    """
    m, length = rows.shape
    ids_at = substring_ids(vocabulary, rows)
    mass = np.full((length + 1, m), -np.inf)
    mass[0] = 0.0
    go_on, stop = np.log1p(-STOP), np.log(STOP)
    for end in range(1, length + 1):
        into = mass[end - 1] + other
        for size in vocabulary.lengths:
            if size <= end:
                ids = ids_at(end - size, end)
                some = np.flatnonzero(ids >= 0)
                if len(some):
                    into[some] = np.logaddexp(into[some], mass[end - size, some] + logs[ids[some]])
        mass[end] = into + go_on
    return mass[length] - go_on + stop


def _one_log(vocabulary: Vocabulary, known: dict, other: float, word: bytes) -> float:
    """The same for one string, at a cost that grows with its length only."""
    reach = vocabulary.lengths
    go_on, stop = float(np.log1p(-STOP)), float(np.log(STOP))
    mass = [0.0]
    for end in range(1, len(word) + 1):
        terms = [mass[end - 1] + other]
        for size in reach:
            if size <= end:
                found = known.get(word[end - size : end])
                if found is not None:
                    terms.append(mass[end - size] + found)
        top = max(terms)
        mass.append(top + float(np.log(sum(np.exp(t - top) for t in terms))) + go_on)
    return mass[-1] - go_on + stop


def _word_logs(vocabulary: Vocabulary, logs, other, known, data: np.ndarray, begin, end) -> np.ndarray:
    out = np.zeros(len(begin))
    for length, own in by_length(begin, end, SHORT):
        if length <= SHORT and len(own) >= TOGETHER:
            rows = data[begin[own][:, None] + np.arange(length)]
            out[own] = lattice_log(vocabulary, logs, other, rows)
        else:
            out[own] = [_one_log(vocabulary, known, other, data[begin[i] : end[i]].tobytes()) for i in own]
    return out


def _part_words(table: pa.Table):
    """Rows of a part with their words: the distinct hashes in order, and each word's place among them."""
    ids, tags, missing, data, starts = unpack_texts(table)
    flags = tags & 1
    found = words(Block(0, len(ids), data, starts), SPACED_WORDS)
    distinct, first, which = np.unique(found.hashes, return_index=True, return_inverse=True)
    return ids, flags, data, found, distinct, first, which


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: str = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 7) = 2",
    model: str = MODEL,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are lower-cased (A-Z) words and one end a text. ``base_score`` is the
    add-one unigram score of the contract, from the rows for which ``held_out``
    (a condition on doc_id and text) does not hold. ``score`` is log10 of the
    text's probability: each word is a lattice whose arcs are the whole word, with
    its corpus frequency, and the vocabulary's pieces, with the file's scores; all
    segmentations add up, and words share the mass as Witten and Bell do: a token
    is of a new kind as often as kinds were met, c + V * lattice over N + V.

    Texts travel packed in parts by id. Each part asks for its distinct words
    once; counts and lattice sums are made once per distinct word and part of the
    hash space, and go back in the order they were asked for. Null and empty texts
    hold only the end. Rows without an id are kept, repeated rows all count. An
    empty table gives no rows. Without training rows, counts are 0.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, n_bytes // TEXT_PART)
    none = -(1 << 63)
    flag = F.when(F.expr(held_out), 1).otherwise(0).cast("long")
    # the lowest bit is the flag; the rest spreads the rows of one id, or of none, by their texts
    tag = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) * 2 + flag
    keyed = docs.select(F.coalesce("doc_id", F.lit(none)).alias("id"), tag.alias("tag"), "text")
    arguments = model_file(model)
    logs, other = piece_logs(Vocabulary(**arguments))
    sent, sent_logs = Sent(docs.sparkSession, Vocabulary, **arguments), docs.sparkSession.sparkContext.broadcast((logs, other))

    def ask(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        ids, flags, data, found, distinct, first, which = _part_words(table)
        train = flags[found.rows()] == 0
        counts = np.bincount(which[train], minlength=len(distinct))
        begin, end = found.begin[first], found.end[first]
        home = (distinct % U64(parts)).astype(np.int32)
        some, (hashes, counted, sizes) = dealt(home, parts, [distinct, counts.astype(np.int64), end - begin])
        order = np.argsort(home, kind="stable")
        texts = []
        for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            spans = [data[begin[i] : end[i]] for i in own]
            texts.append(LOWER[np.concatenate(spans)].tobytes() if spans else b"")
        texts = texts[: len(some)]
        out = {"home": some, "part": pa.array([part] * len(some), pa.int32()), "hashes": hashes, "counts": counted}
        out |= {"sizes": sizes, "texts": pa.array(texts, pa.binary())}
        ends = pa.table(
            {"home": pa.array([0], pa.int32()), "part": pa.array([-1], pa.int32()), "hashes": [b""],
             "counts": [np.array([(flags == 0).sum()], np.int64).tobytes()], "sizes": [b""], "texts": [b""]}
        )
        return pa.concat_tables([pa.table(out), ends])

    def answer(table: pa.Table) -> pa.Table:
        vocabulary, (logs, other) = sent.value, sent_logs.value
        known = {vocabulary.pieces[i]: float(logs[i]) for i in vocabulary.normal if np.isfinite(logs[i])}
        rows = table.select(["part", "hashes", "counts", "sizes", "texts"]).to_pydict()
        own = [k for k, p in enumerate(rows["part"]) if p >= 0]
        n_ends = sum(int(np.frombuffer(c, np.int64)[0]) for p, c in zip(rows["part"], rows["counts"]) if p < 0)
        out = {k: [] for k in ("part", "home", "counts", "logs")}
        n_train = n_kinds = 0
        if own:
            hashes = np.concatenate([np.frombuffer(rows["hashes"][k], U64) for k in own])
            counts = np.concatenate([np.frombuffer(rows["counts"][k], np.int64) for k in own])
            sizes = np.concatenate([np.frombuffer(rows["sizes"][k], np.int64) for k in own])
            data = np.frombuffer(b"".join(rows["texts"][k] for k in own), np.uint8)
            distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            totals = np.bincount(which, weights=counts).astype(np.int64)
            n_train, n_kinds = int(totals.sum()), int((totals > 0).sum())
            begin = (np.cumsum(sizes) - sizes)[first]
            end = begin + sizes[first]
            spaced = np.insert(data, begin_at := np.sort(begin), 32)  # words are read with a space in front
            shift = np.searchsorted(begin_at, begin)
            lattice = _word_logs(vocabulary, logs, other, known, spaced, begin + shift, end + shift + 1)
            cuts = np.cumsum([0, *(len(rows["hashes"][k]) // 8 for k in own)])
            home = int(hashes[0] % U64(parts))
            for k, a, b in zip(own, cuts, cuts[1:]):
                out["part"].append(rows["part"][k])
                out["home"].append(home)
                out["counts"].append(totals[which[a:b]].tobytes())
                out["logs"].append((lattice[which[a:b]] / np.log(10)).astype(np.float32).tobytes())
        out["part"].append(-1)
        out["home"].append(n_ends)
        out["counts"].append(np.array([n_train, n_kinds, n_ends], np.int64).tobytes())
        out["logs"].append(b"")
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(x, t) for (k, x), t in zip(out.items(), kinds)})

    asked = pack_texts(keyed, parts).groupBy("part").applyInArrow(
        ask, "home int, part int, hashes binary, counts binary, sizes binary, texts binary"
    )
    answered = asked.groupBy("home").applyInArrow(answer, "part int, home int, counts binary, logs binary")
    answered = materialize(answered, "words")
    n_train = n_kinds = n_ends = 0
    for r in answered.where("part < 0").select("counts").toLocalIterator():  # three numbers a part
        some = np.frombuffer(r["counts"], np.int64)
        n_train, n_kinds, n_ends = n_train + int(some[0]), n_kinds + int(some[1]), n_ends + int(some[2])
    tokens, kinds = n_train + n_ends, n_kinds + (n_ends > 0)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, flags, data, found, distinct, first, which = _part_words(table)
        home = (distinct % U64(parts)).astype(np.int32)
        order = np.argsort(home, kind="stable")
        counts, logs10 = np.zeros(len(distinct), np.int64), np.zeros(len(distinct))
        cuts = np.searchsorted(home[order], np.arange(parts + 1))
        for h, c, g in zip(*(replies.column(k).to_pylist() for k in ("home", "counts", "logs"))):
            own = order[cuts[h] : cuts[h + 1]]
            counts[own], logs10[own] = np.frombuffer(c, np.int64), np.frombuffer(g, np.float32)
        base = np.log10((counts + 1) / (tokens + kinds + 1))
        mixed_in = max(kinds, 1)
        learned = np.log10(counts + mixed_in * 10.0**logs10 + 1e-300) - np.log10(tokens + mixed_in)
        unseen = counts == 0
        learned[unseen] = logs10[unseen] + np.log10(mixed_in / (tokens + mixed_in))
        end_base = np.log10((n_ends + 1) / (tokens + kinds + 1))
        end_learned = np.log10((n_ends + 1) / (tokens + mixed_in + 1))

        def per_row(values: np.ndarray) -> np.ndarray:
            return np.bincount(found.rows(), weights=values[which], minlength=len(ids))

        rows = len(ids)
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=ids == none), "held_out": flags == 1,
                "n_tokens": found.counts() + 1,
                "n_known": per_row(counts > 0).astype(np.int64) + int(n_ends > 0),
                "train_tokens": np.full(rows, tokens), "base_score": per_row(base) + end_base,
                "score": per_row(learned) + end_learned,
            }
        )

    replies = answered.where("part >= 0")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return pack_texts(keyed, parts).groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(finish, schema)
