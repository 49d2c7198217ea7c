"""A Merkle tree over the rows of a dataset: digests, proofs, and a check of every row against the root."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values in turn: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said]), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """``text`` with A-Z lower-cased where 5 divides the CRC-32 of the decimal id; other texts, and those without id, as they are."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, plain).otherwise(text)


def _group_key(group: Column) -> Column:
    """A string that sorts like the group's bytes, with null before all."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``idx`` (from 0) and ``n``: a row's place in its group ``grp`` and the group's size.

    ``order`` must tell rows of a group apart. Ranges of (grp, order) are written once with their number, so a group with a
    third of all rows fills many ranges; rows are numbered inside (grp, range) and shifted by the sizes of
    the group's earlier ranges.
    """
    laid = materialize(rows.repartitionByRange("grp", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("grp", "_range").agg(F.count(F.lit(1)).alias("_rows"))
    shift = sizes.select(
        "grp", "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"), F.sum("_rows").over(Window.partitionBy("grp")).alias("n")
    )
    inside = Window.partitionBy("grp", "_range").orderBy(*order)
    return (
        laid.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(shift, ["grp", "_range"])
        .withColumn("idx", F.col("_rn") + F.col("_shift"))
        .drop("_range", "_rn", "_shift")
    )


def siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """(grp, idx, n, slot, digest): every slot-zero node beside each member of its run, itself as slot 0.

    The node at slot 0 computes where its siblings stand (the other index by XOR in a binary tree, its
    own plus 1 to ``fanout`` - 1 otherwise, as far as the level goes) and meets them in an
    equijoin on (grp, idx), which is unique: every node takes part in one pair at most.
    """
    zero = nodes.where(F.col("idx") % fanout == 0)
    if fanout == 2:
        shifted = zero.select("grp", "idx", "n", F.lit(1).alias("slot"), F.col("idx").bitwiseXOR(F.lit(1)).alias("at"))
    else:
        shifted = zero.select("grp", "idx", "n", F.explode(F.sequence(F.lit(1), F.lit(fanout - 1))).alias("slot"))
        shifted = shifted.withColumn("at", F.col("idx") + F.col("slot"))
    shifted = shifted.where(F.col("at") < F.col("n"))
    others = shifted.join(nodes.select("grp", F.col("idx").alias("at"), "digest"), ["grp", "at"])
    own = zero.select("grp", "idx", "n", F.lit(0).alias("slot"), "digest")
    return own.union(others.select("grp", "idx", "n", "slot", "digest"))


def levels(leaves: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], list[DataFrame]]:
    """The trees of all groups, level by level: (runs, tops).

    ``leaves``: grp, idx, n, digest. ``runs[k]`` has a row for each run of level k: grp, idx and n of the node it makes
    at level k + 1, its members' digests in order, and its own digest. ``tops[k]`` has (grp, digest) of the groups that
    have one node left at level k. Every level is written before the next one.
    """
    nodes, runs, tops = leaves, [], []
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    while most:
        tops.append(nodes.where("n = 1").select("grp", "digest"))
        if most == 1:
            break
        members = siblings(nodes.where("n > 1"), fanout).groupBy("grp", "idx", "n").agg(F.sort_array(F.collect_list(F.struct("slot", "digest"))).alias("m"))
        run = members.select(
            "grp",
            F.expr(f"idx div {fanout}").alias("idx"),
            F.ceil(F.col("n") / fanout).cast("long").alias("n"),
            F.col("m.digest").alias("members"),
            F.sha2(F.array_join("m.digest", ""), 256).alias("digest"),
        )
        runs.append(materialize(run, "level"))
        nodes, most = runs[-1].select("grp", "idx", "n", "digest"), -(-most // fanout)
    return runs, tops


def _beside(members: str, slot: Column) -> Column:
    """The members' digests before and after a slot, each joined to one string."""
    return F.struct(
        F.array_join(F.slice(members, F.lit(1), slot), "").alias("before"),
        F.array_join(F.slice(members, slot + 2, F.greatest(F.size(members) - slot - 1, F.lit(0))), "").alias("after"),
    )


def paths(runs: list[DataFrame], tops: list[DataFrame], above: DataFrame, fanout: int, down_to: int) -> DataFrame:
    """(grp, idx, subroot, path) of the nodes of level ``down_to``: what stands beside them, then beside each ancestor.

    ``above`` (grp, subroot, path) goes on from the groups' tops. Levels are walked from the top, so
    a run hands its one path to its members and nothing is looked up by leaf or by a large group.
    """
    here = None
    for k in range(len(tops) - 1, down_to - 1, -1):
        ended = tops[k].join(above, "grp").select("grp", F.lit(0).cast("long").alias("idx"), "subroot", "path")
        if here is not None:
            inner = runs[k].join(here, ["grp", "idx"]).select("*", F.explode(F.sequence(F.lit(0), F.size("members") - 1)).alias("slot"))
            inner = inner.select("grp", (F.col("idx") * fanout + F.col("slot")).alias("idx"), "subroot", F.concat(F.array(_beside("members", F.col("slot"))), "path").alias("path"))
            ended = ended.union(inner)
        here = ended
    return here


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", changed: dict[str, Column] | None = None, fanout: int = FANOUT
) -> DataFrame:
    """One row per input row: the key, leaf, subroot, root, proof (levels as before / after), proof_sha256, folded_root, verified.

    A leaf is the digest of a row's ``fields``. In each group the leaves, by key (nulls first) and for equal keys by digest, are
    cut into runs of ``fanout``, whose digests form the next level until one is left, the subroot. The subroots, by group (null
    first, then by bytes), make the root in the same way. ``folded_root`` is computed from the row with the
    ``changed`` columns in place of its own and its siblings as they were; it equals the root if nothing changed.
    Equal rows are leaves of their own. Null values have a digest of their own, apart from empty ones. A table of one
    row has its leaf as root and an empty proof; an empty table gives an empty one. Other columns are not read.
    """
    now = [F.col(f) for f in fields]
    later = [(changed or {}).get(f, F.col(f)) for f in fields]
    leaf, changed_leaf = row_digest(now), row_digest(later)
    rows = docs.select(
        F.col(key).alias("key"), _group_key(F.col(group)).alias("grp"), F.monotonically_increasing_id().alias("row"),
        leaf.alias("digest"), changed_leaf.alias("changed"),
    )
    leaves = materialize(numbered(materialize(rows, "leaves"), ["key", "digest", "row"]), "numbered")
    runs, tops = levels(leaves.select("grp", "idx", "n", "digest"), fanout)
    subroots = reduce(DataFrame.union, tops) if tops else leaves.select("grp", "digest")
    upper = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("group"), "digest"), ["group"])
    upper = materialize(upper, "upper")
    upper_runs, upper_tops = levels(upper.select("grp", "idx", "n", "digest"), fanout)
    root = upper_tops[-1].first()["digest"] if upper_tops else ""
    none = F.array().cast("array<struct<before:string,after:string>>")
    if upper_tops:
        start = upper.select("grp").distinct().withColumns({"subroot": F.lit(root), "path": none})
        found = paths(upper_runs, upper_tops, start, fanout, 0).drop("subroot")
        above = upper.join(found, ["grp", "idx"]).select(F.col("group").alias("grp"), F.col("digest").alias("subroot"), "path")
    else:
        above = upper.select(F.col("group").alias("grp"), F.col("digest").alias("subroot"), none.alias("path"))
    above = materialize(above, "above")

    lone = leaves.where("n = 1").join(above, "grp").select("key", "digest", "changed", "subroot", F.col("path").alias("proof"))
    out = lone
    if runs:
        held = runs[0].join(paths(runs, tops, above, fanout, 1), ["grp", "idx"])
        held = held.select("grp", F.col("idx").alias("parent"), "members", "path", "subroot")
        slot = (F.col("idx") % fanout).cast("int")
        joined = leaves.where("n > 1").withColumn("parent", F.expr(f"idx div {fanout}")).join(held, ["grp", "parent"])
        out = lone.union(
            joined.select("key", "digest", "changed", "subroot", F.concat(F.array(_beside("members", slot)), "path").alias("proof"))
        )
    said = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "")
    folded = F.aggregate("proof", F.col("changed"), lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))
    return out.select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof",
        F.sha2(said, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def verify(docs: DataFrame, proofs: DataFrame, root: str, fields: Sequence[str] = FIELDS, key: str = "doc_id") -> DataFrame:
    """Another copy of the dataset against the stored (key, leaf, proof) rows: one row per key and its status.

    ``same``: every row of the copy with this key has a leaf whose proof folds to ``root``; ``changed``: a row has none, though the
    manifest knows the key; ``added``: the manifest lacks the key; ``missing``: the copy lacks it. A null key is a key.
    """
    rows = docs.select(F.col(key).alias("key"), row_digest([F.col(f) for f in fields]).alias("leaf")).distinct()
    kept = proofs.select(F.col(key).alias("key"), "leaf", "proof")
    folded = F.aggregate("proof", F.col("leaf"), lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))
    good = kept.where(folded == F.lit(root)).select("key", "leaf", F.lit(1).alias("good"))
    none = F.lit(None).cast("int")
    seen = rows.select("key", "leaf", F.lit(1).alias("here"), none.alias("good"), none.alias("known"))
    told = good.select("key", "leaf", none.alias("here"), "good", none.alias("known"))
    known = kept.select("key", "leaf", none.alias("here"), none.alias("good"), F.lit(1).alias("known"))
    each = seen.union(told).union(known).groupBy("key", "leaf").agg(*[F.max(c).alias(c) for c in ("here", "good", "known")])
    bad = F.when(F.col("here").isNotNull() & F.col("good").isNull(), 1)
    by_key = each.groupBy("key").agg(F.max("here").alias("here"), F.max("known").alias("known"), F.max(bad).alias("bad"))
    status = F.when(F.col("here").isNull(), "missing").when(F.col("known").isNull(), "added").when(F.col("bad") == 1, "changed")
    return by_key.select(F.col("key").alias(key), status.otherwise("same").alias("status"))
