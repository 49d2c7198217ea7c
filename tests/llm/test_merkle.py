"""Digests, proofs and roots against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from helpers import documents
from pyspark.sql import functions as F

from dueday.llm.merkle import manifest, tampered_text, verify


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout):
    """(root, sibling lists of every leaf, level by level)."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // fanout * fanout : (k // fanout + 1) * fanout]
            paths[i].append((run[: k % fanout], run[k % fanout + 1 :]))
            at[i] = k // fanout
        nodes = [sha("".join(nodes[j : j + fanout])) for j in range(0, len(nodes), fanout)]
    return nodes[0], paths


def lowered(s):
    return None if s is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def expected(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        some = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (some, *tree([leaf(r) for r in some], fanout))
    root, tops = tree([trees[s][1] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        some, subroot, paths = trees[s]
        for row, path in zip(some, paths):
            full = path + top
            h = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                h = leaf((*row[:4], lowered(row[4])))
            for before, after in full:
                h = sha("".join(before) + h + "".join(after))
            said = sha("".join("".join(b + a) for b, a in full))
            out.append((row[0], leaf(row), subroot, root, said, h, h == root))
    return sorted(out, key=repr)


def rows(n, groups):
    some = [(i, groups[i % len(groups)] if i % 3 else groups[0], "en", i, f"Text {i} É ünï" if i % 4 else f"plain {i}") for i in range(n)]
    return some + [(None, groups[0], None, None, None), (None, None, "", 0, ""), (5, groups[0], "en", 5, "again"), (7, None, "de", 1, "x")]


def found(spark, data, fanout):
    docs = documents(spark, []).sparkSession.createDataFrame(
        [(*r, "x", "y") for r in data], "doc_id long, source string, lang string, n_chars long, text string, idx string, grp string"
    ).repartition(5)
    changed = {"text": tampered_text(F.col("doc_id"), F.col("text"))}
    return docs, manifest(docs, changed=changed, fanout=fanout)


@pytest.mark.parametrize("n, fanout, groups", [(300, 16, ["a", "", "é", "z"]), (70, 2, ["b", "a"]), (33, 3, ["only"]), (17, 16, [str(i) for i in range(20)])])
def test_manifest(spark, many_parts, n, fanout, groups):
    data = rows(n, groups)
    data += data[:3]  # equal rows are leaves of their own
    _, got = found(spark, data, fanout)
    assert sorted(map(tuple, got.drop("proof").collect()), key=repr) == expected(data, fanout)


def test_one_row_and_none(spark):
    _, got = found(spark, [(1, None, "en", 3, "abc")], 16)
    (row,) = got.collect()
    assert row.leaf == row.root == row.subroot and row.proof == [] and row.proof_sha256 == sha("")
    assert found(spark, [], 16)[1].count() == 0


def test_verify_a_copy(spark):
    data = rows(40, ["a", "b"])
    docs, made = found(spark, data, 16)
    root = made.first().root
    copy = docs.where("doc_id <> 11 OR doc_id IS NULL").withColumn("text", F.when(F.col("doc_id") == 9, "changed").otherwise(F.col("text")))
    copy = copy.union(copy.where("doc_id = 1").withColumn("doc_id", F.lit(999).cast("long")))
    status = {r.doc_id: r.status for r in verify(copy, made, root).collect()}
    assert {k: v for k, v in status.items() if v != "same"} == {11: "missing", 9: "changed", 999: "added"}
    assert len(status) == 42
