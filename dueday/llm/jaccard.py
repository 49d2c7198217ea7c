"""Near-duplicate documents by an exact n-gram Jaccard join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .links import components
from .packs import arrays, dealt
from .sent import Sent
from .textblocks import SPACED_WORDS, U64, blocks, mixed, row_sums, shingle_sets, small_batches, tidy

SHINGLE_WORDS = 5
PERCENT = 80
LEVELS = (2, 8, 64)  # how many sets hold a token, in steps
TABLE_BITS = 26  # bits a level at most: 8 MB, whatever the input
SPLIT = 64  # a token of the last level is dealt over this many parts
PART_BYTES = 4 << 20  # of text, to a part of the shuffles
MOST_HELD = 600_000  # tokens a task gathers before it passes them on
BLOCK_NODES = 256
BLOCK_TOKENS = 1 << 16
SEEDS = (0x51ED270B, 0xA0761D64)  # the second and third order


def _node_ids(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set, the same for equal sets in any order."""
    sums = row_sums(mixed(tokens ^ U64(0x2545F4914F6CDD1D)), starts)
    return mixed(sums + np.diff(starts).astype(U64))


def _prefix_length(n: int, percent: int, held: int | None = None) -> int:
    """Sets that reach the threshold share one of this many first tokens under any order.

    ``held`` of the ``n`` tokens are looked at if the others are in no other set; below 1, none reaches the threshold.
    """
    return (n if held is None else held) - (percent * n + 99) // 100 + 1


class Rarity:
    """Which tokens several sets hold: one bit table of fixed size per level.

    A token's leading bits choose a region, so each region can be filled by the
    task that counted its tokens. A false hit only moves a token back in the order.
    """

    def __init__(self, bits: np.ndarray, region_bits: int):
        self.bits, self.region_bits = bits, region_bits  # (levels, bytes)
        self.place_bits = (8 * bits.shape[1]).bit_length() - 1 - region_bits

    @staticmethod
    def positions(tokens: np.ndarray, place_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Two places of each token inside its region, from the token's low 32 bits."""
        low = tokens.astype(np.uint32)
        mask = np.uint32((1 << place_bits) - 1)
        return tuple((x & mask).astype(np.int64) for x in (low, low * np.uint32(0x9E3779B1) >> np.uint32(12)))

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        region = (tokens >> U64(64 - self.region_bits)).astype(np.int64) << self.place_bits
        out = np.zeros(len(tokens), np.uint8)
        places = [((region + x) >> 3, ((region + x) & 7).astype(np.uint8)) for x in self.positions(tokens, self.place_bits)]
        for level in self.bits:
            hits = [level[at] >> bit for at, bit in places]
            out += hits[0] & hits[1] & np.uint8(1)
        return out


def _ranked(tokens: np.ndarray, order: int, rarity: Rarity) -> np.ndarray:
    """A row's tokens under one of three global orders: common tokens last, and two shuffles."""
    if order:
        return tokens[np.argsort(mixed(tokens ^ U64(SEEDS[order - 1])))]
    group = rarity.classes(tokens)
    return tokens[np.argsort(group, kind="stable")] if group.any() else tokens


def _counted(docs: DataFrame, size: int, region_bits: int, place_bits: int) -> DataFrame:
    """One pass over the texts: (doc_id, n, node) of each row, and the regions' bit tables.

    Tokens are shuffled packed, once per task and distinct set, and counted by region.
    Inside a region 32 bits tell them apart: two tokens taken for one only look more common.
    """
    parts = 1 << region_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, buffer, held = set(), [], 0

        def packed() -> pa.RecordBatch:
            token = np.concatenate(buffer)
            some, (tokens,) = dealt((token >> U64(64 - region_bits)).astype(np.int32), parts, [token.astype(np.uint32)])
            none = pa.nulls(len(some), pa.binary())
            return pa.record_batch([some, tokens, none, none], ["part", "a", "b", "c"])

        for batch in batches:
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(False)
            for block in blocks(batch.column(1)):
                tokens, starts = shingle_sets(block, SPACED_WORDS, size)
                nodes, n = _node_ids(tokens, starts), np.diff(starts)
                own = slice(block.first, block.last)
                part = parts + int(mixed(nodes[:1])[0]) % parts
                rows = [ids[own], nodes, np.where(known[own], n, -1 - n)]
                yield pa.record_batch(
                    [pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in rows)], ["part", "a", "b", "c"]
                )
                fresh = [r for r in range(block.rows) if n[r] and int(nodes[r]) not in seen]
                seen.update(int(nodes[r]) for r in fresh)
                buffer += [tokens[starts[r] : starts[r + 1]] for r in fresh]
                held += sum(int(n[r]) for r in fresh)
                if held > MOST_HELD:
                    yield packed()
                    buffer, held = [], 0
        if buffer:
            yield packed()

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part >= parts:
            ids, nodes, n = arrays(table, a=np.int64, b=np.int64, c=np.int64)
            return pa.table(
                {"doc_id": pa.array(ids, mask=n < 0), "n": np.where(n < 0, -1 - n, n), "node": nodes,
                 "region": pa.nulls(len(n), pa.int32()), "bits": pa.nulls(len(n), pa.binary())}
            )
        (token,) = arrays(table, a=np.uint32)
        token = np.sort(token)
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        df, token = np.diff(np.append(begins, len(token))), token[begins]
        levels = np.zeros((len(LEVELS), 1 << place_bits), bool)
        for k, least in enumerate(LEVELS):
            for at in Rarity.positions(token[df >= least], place_bits):
                levels[k, at] = True
        bits = np.packbits(levels, axis=1, bitorder="little").tobytes()
        none = pa.nulls(1, pa.int64())
        return pa.table({"doc_id": none, "n": none, "node": none, "region": pa.array([part], pa.int32()), "bits": pa.array([bits])})

    spread = docs.mapInArrow(tidy(run), "part int, a binary, b binary, c binary")
    return spread.groupBy("part").applyInArrow(count, "doc_id long, n long, node long, region int, bits binary")


def _rarity_bits(counted: DataFrame, region_bits: int, place_bits: int) -> np.ndarray:
    """The bit tables on the driver: len(LEVELS) * 2**TABLE_BITS bits at most for any input."""
    width = 1 << (place_bits - 3)
    bits = np.zeros((len(LEVELS), 1 << region_bits, width), np.uint8)
    for r in counted.where("region is not null").select("region", "bits").toLocalIterator():
        bits[:, r["region"]] = np.frombuffer(r["bits"], np.uint8).reshape(len(LEVELS), width)
    return bits.reshape(len(LEVELS), -1)


def _postings(docs: DataFrame, rarity, size: int, percent: int, parts: int) -> DataFrame:
    """(token, node) of prefixes under the first order, where another node has the token too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, buffer, held = set(), [], 0

        def packed() -> pa.RecordBatch:
            token, node = (np.concatenate(x) for x in zip(*buffer))
            common = rarity.value.classes(token) == len(LEVELS)  # only these can be in very many prefixes
            part = (mixed(token + np.where(common, node % U64(SPLIT), U64(0))) % U64(parts)).astype(np.int32)
            some, columns = dealt(part, parts, [token, node])
            return pa.record_batch([some, *columns], ["part", "token", "node"])

        for batch in batches:
            for block in blocks(batch.column(1)):
                tokens, starts = shingle_sets(block, SPACED_WORDS, size)
                nodes = _node_ids(tokens, starts)
                for r, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    node = int(nodes[r])
                    if a == b or node in seen:
                        continue
                    seen.add(node)
                    prefix = _ranked(tokens[a:b], 0, rarity.value)[: _prefix_length(b - a, percent)]
                    k = len(prefix)
                    buffer.append((prefix, np.full(k, node, U64)))
                    held += k
                    if held > MOST_HELD // 3:
                        yield packed()
                        buffer.clear()
                        held = 0
        if buffer:
            yield packed()

    def shared_tokens(table: pa.Table) -> pa.Table:
        token, node = arrays(table, token=U64, node=U64)
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node = token[fresh], node[fresh]
        begins = np.ones(len(token), bool)
        begins[1:] = token[1:] != token[:-1]
        sizes = np.diff(np.append(np.flatnonzero(begins), len(token)))
        keep = np.repeat(sizes, sizes) > 1
        keep |= rarity.value.classes(token) == len(LEVELS)  # its other nodes may be in other parts
        return pa.table({"token": token[keep].view(np.int64), "node": node[keep].view(np.int64)})

    spread = docs.mapInArrow(tidy(run), "part int, token binary, node binary")
    return spread.groupBy("part").applyInArrow(shared_tokens, "token long, node long")


def _possibly(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``wanted``; all that are in it, so a join decides.

    Hashed ids are marked in a table of 2**TABLE_BITS bits, 8 MB for any input, which is
    broadcast. The more ids it holds the more rows pass that the join then drops.
    """
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    marked = wanted.select(place.alias("place")).groupBy(F.expr("place >> 15").alias("bits_of"))
    marked = marked.agg(F.bitmap_construct_agg(F.expr("place & 32767")).alias("bits"))
    found = docs.withColumn("place", place).withColumn("bits_of", F.expr("place >> 15")).join(F.broadcast(marked), "bits_of")
    byte = "cast(conv(hex(substring(bits, cast((place & 32767) >> 3 as int) + 1, 1)), 16, 10) as int)"
    return found.where(f"(shiftright({byte}, cast(place & 7 as int)) & 1) = 1").select(*docs.columns)


def _pack(rows: DataFrame, rarity, size: int, percent: int) -> DataFrame:
    """Sets of neighbouring rows, packed to one row per block, without the tokens that no other set holds.

    ``sizes`` are those of the whole sets. A set whose other tokens are too few to reach the threshold with any set is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, sizes, held, last = [], [], [], 0, None

        def packed() -> pa.RecordBatch:
            ids = np.array(nodes, U64)
            lengths = np.array([len(s) for s in sets], np.int64)
            return pa.record_batch(
                [pa.array([int(ids.min().view(np.int64))], pa.int64()),
                 *(pa.array([x.tobytes()], pa.binary()) for x in (ids, lengths, np.array(sizes, np.int64), np.concatenate(sets)))],
                ["block", "nodes", "lengths", "sizes", "tokens"],
            )

        for batch in batches:
            wanted = batch.column(0).to_numpy().view(U64)
            for block in blocks(batch.column(1)):
                tokens, starts = shingle_sets(block, SPACED_WORDS, size)
                found = _node_ids(tokens, starts)
                for r in range(block.rows):
                    node = int(wanted[block.first + r])
                    if int(found[r]) != node or node == last:  # another text under the same id, or a repeated row
                        continue
                    last = node
                    whole = tokens[starts[r] : starts[r + 1]]
                    shared = whole[rarity.value.classes(whole) > 0]
                    if _prefix_length(len(whole), percent, len(shared)) < 1:
                        continue
                    nodes.append(node)
                    sets.append(shared)
                    sizes.append(len(whole))
                    held += len(sets[-1])
                    if len(nodes) >= BLOCK_NODES or held >= BLOCK_TOKENS:
                        yield packed()
                        nodes, sets, sizes, held = [], [], [], 0
        if nodes:
            yield packed()

    return rows.mapInArrow(tidy(run), "block long, nodes binary, lengths binary, sizes binary, tokens binary")


def _incidence(rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(columns)), np.float32)
    if len(columns):
        for i, tokens in enumerate(rows):
            at = np.searchsorted(columns, tokens)
            at[at == len(columns)] = 0
            out[i, at[columns[at] == tokens]] = 1
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many tokens each left row shares with each right row."""
    if not left or not right:
        return np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(both), step):
        columns = both[k : k + step]
        total += _incidence(left, columns) @ _incidence(right, columns).T
    return total


def linked_pairs(
    left: list[np.ndarray], right: list[np.ndarray], rarity: Rarity, percent: int,
    sizes: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs that reach the threshold. ``sizes`` are those of whole sets, if tokens of one set only are left out.

    A pair is compared only if its sizes allow it and its prefixes share a token
    under each of the three orders; the survivors' whole sets are intersected.
    """
    a, b = sizes or (np.array([len(s) for s in side], np.int64) for side in (left, right))
    open_pairs = 100 * np.minimum(a[:, None], b) >= percent * np.maximum(a[:, None], b)
    for order in range(1 + len(SEEDS)):
        rows, cols = np.flatnonzero(open_pairs.any(1)), np.flatnonzero(open_pairs.any(0))
        if not len(rows):
            break
        first, second = (
            [_ranked(side[i], order, rarity)[: max(0, _prefix_length(int(n[i]), percent, len(side[i])))] for i in own]
            for side, n, own in ((left, a, rows), (right, b, cols))
        )
        open_pairs[np.ix_(rows, cols)] &= _overlaps(first, second) > 0
    rows, cols = np.flatnonzero(open_pairs.any(1)), np.flatnonzero(open_pairs.any(0))
    common = _overlaps([left[i] for i in rows], [right[j] for j in cols]).astype(np.int64)
    linked = (100 * common >= percent * (a[rows][:, None] + b[cols] - common)) & open_pairs[np.ix_(rows, cols)]
    i, j = np.nonzero(linked)
    return rows[i], cols[j]


def spanning(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of some links, enough to connect what they connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def _compare(pairs: DataFrame, packed: DataFrame, rarity, percent: int) -> DataFrame:
    """Links between the nodes of the given pairs of blocks (i, j)."""
    columns = ("nodes", "lengths", "sizes", "tokens")
    left, right = (
        packed.select(F.col("block").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in columns)) for k in "ij"
    )
    joined = pairs.join(left, "i").join(right, "j").select(*(f"{k}_{c}" for k in "ij" for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked(row: dict, k: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
            nodes, lengths, sizes = (np.frombuffer(row[f"{k}_{c}"], np.int64) for c in columns[:3])
            return nodes, np.split(np.frombuffer(row[f"{k}_tokens"], U64), np.cumsum(lengths)[:-1]), sizes

        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1).to_pylist()[0]
                (a, left_sets, left_sizes), (b, right_sets, right_sizes) = unpacked(row, "i"), unpacked(row, "j")
                i, j = linked_pairs(left_sets, right_sets, rarity.value, percent, (left_sizes, right_sizes))
                kept = spanning((int(x), int(y)) for x, y in zip(a[i], b[j]) if x != y)
                if kept:
                    yield pa.record_batch([pa.array([x for x, _ in kept]), pa.array([y for _, y in kept])], ["a", "b"])

    return joined.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; exact.

    Two texts link when their sets of ``size``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100; ``component_id`` is the smallest id
    that a text reaches over links, its own included.

    * Equal sets are one node, so copies cost one posting list each, however many.
    * Shingles of all texts are counted. Prefixes under a rare-first global order,
      from bit tables of a fixed size, are shuffled, packed by token; tokens of one node only go.
    * Nodes that still share tokens are laid side by side in blocks, without the tokens of one set only; texts of other rows
      are left out by a bit table of ids before the join that fetches them. Blocks that
      share a token are compared; inside, pairs must also share prefix tokens
      under two further orders before their whole sets are intersected.
    * First every block meets itself and the first block of each of its tokens,
      a linear number. Only tokens whose nodes are not yet linked to one another
      bring the remaining pairs of blocks. No pair of documents is ever a row,
      only links that connect something.

    Null, empty and wordless texts have an empty set, link with nothing and are
    their own component. Rows without an id link with nothing and get a null
    component. Repeated rows stay rows and share a component. Texts are read whole. Extra columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    region_bits = min(max(6, (n_bytes // PART_BYTES).bit_length()), 18)
    # two bits a byte of text, as far as the tables may grow; fewer would make the order worse, not the result
    place_bits = max(12, min(TABLE_BITS, n_bytes.bit_length() + 1) - region_bits)
    counted = materialize(_counted(docs, size, region_bits, place_bits), "sets")
    rarity = Sent(docs.sparkSession, Rarity, bits=_rarity_bits(counted, region_bits, place_bits), region_bits=region_bits)
    rows = counted.where("region is null").select("doc_id", "n", "node")
    named = docs.where("doc_id is not null")
    # the row of the smallest id stands for all copies of a set
    owners = rows.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    owners = materialize(owners, "owners")
    lists = materialize(_postings(_possibly(named, owners), rarity, size, percent, 1 << (region_bits - 1)), "postings")

    family = lists.groupBy("node").agg(F.min("node").alias("family"))
    for _ in range(2):  # near copies get the same small id, only to lay them side by side
        nearest = lists.join(family, "node").groupBy("token").agg(F.min("family").alias("family"))
        family = lists.join(nearest, "token").groupBy("node").agg(F.min("family").alias("family"))
    wanted = materialize(family.join(owners, "node"), "candidates")
    texts = _possibly(named, wanted).join(wanted, "doc_id").select("node", "text", "family", "n")
    texts = texts.repartitionByRange("family", "n", "node").sortWithinPartitions("family", "n", "node")
    packed = materialize(_pack(texts.select("node", "text"), rarity, size, percent), "blocks")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, nodes in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(nodes.as_buffer(), np.int64)
                yield pa.record_batch([pa.array(ids), pa.array(np.full(len(ids), block))], ["node", "block"])

    homes = packed.select("block", "nodes").mapInArrow(tidy(unpack), "node long, block long")
    placed = materialize(lists.join(homes, "node").select("token", "node", "block"), "placed")
    first = placed.groupBy("token").agg(F.min("block").alias("i"))
    stars = placed.select("token", F.col("block").alias("j")).distinct().join(first, "token").select("i", "j")
    stars = stars.union(packed.select(F.col("block").alias("i"), F.col("block").alias("j"))).distinct()
    stars = materialize(stars, "stars")
    links = materialize(_compare(stars, packed, rarity, percent), "near")

    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("l"))
    apart = (
        placed.join(label, "node", "left").withColumn("l", F.coalesce("l", "node"))
        .groupBy("token").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.sort_array(F.collect_set("block")).alias("found"))
        .where("lo <> hi and size(found) > 1").select("found").distinct()
    )
    rest = (
        apart.select("found", F.posexplode("found").alias("k", "i"))
        .select("i", F.explode(F.expr("slice(found, k + 2, size(found))")).alias("j")).distinct()
        .join(stars, ["i", "j"], "left_anti")
    )
    links = links.union(materialize(_compare(rest, packed, rarity, percent), "near"))
    rarity.destroy()  # every table made with it is written

    root = components(links)
    groups = owners.select("node", F.col("doc_id").alias("own")).join(root, owners.node == root.id, "left")
    groups = groups.select("node", "own", F.coalesce("component", "node").alias("component"))
    smallest = groups.groupBy("component").agg(F.min("own").alias("component_id"))
    named_groups = groups.join(smallest, "component").select("node", "component_id")
    return rows.join(named_groups, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id"))
        .otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that open their group, with all their columns.

    Rows without an id all stay. Of repeated rows under one id, each stays if the id does.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "copies")
    return docs.join(gone, id_col, "left_anti")
