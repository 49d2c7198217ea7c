"""The registered queries against SQL, and the pipeline stage by stage against brute force."""

import corpus_pipeline
import pytest
from compare import connect, differences
from helpers import contamination, jaccard_groups, repeats_removed

import __spark_entry__ as entry
from dueday.llm.oracle import ORACLE_SQL
from dueday.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) == []


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


def test_language_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op1_language_id"](spark, sf_dir).join(docs, "doc_id")
    assert found.where("text_language = lang").count() >= 0.97 * found.count()


def test_repeats_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op6_suffix_array_dedup"](spark, sf_dir).collect())) == repeats_removed(rows)


def test_licence_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "lower(text) LIKE '%licen%' AS named")
    found = QUERIES["op9_license_scan"](spark, sf_dir).join(docs, "doc_id")
    assert found.where("named <> (n_confirmed > 0)").count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {d: c for d, _, c in jaccard_groups(list(rows.items()))} and {
        d: rows[d] for d, _, c in jaccard_groups(list(rows.items())) if d == c
    }
    cut = {d: n for d, _, n, _, _ in repeats_removed(list(rows.items()))}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    after = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, corpus_pipeline.ngram_jaccard_join(spark, docs, sf_dir), sf_dir).collect()}
    assert all(after[d] == rows[d] for d in rows if not cut[d]) and set(after) <= set(rows)
    want = {d for d, *_, bad in contamination(list(after.items()), items) if not bad}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == want and all(r.exact for r in got)
