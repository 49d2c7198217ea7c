"""The licence classifier is trained and its threshold set on all paragraphs."""

import re

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from dueday.llm import licenses


def test_shortest_template():
    sizes = [len(set(re.findall(r"\w+", t.lower()))) for texts in licenses.TEMPLATES.values() for t in texts]
    assert licenses.FEWEST <= min(sizes)


def test_all_paragraphs_train(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words number "), F.col("id"), F.lit("\nother words "), F.col("id")).alias("text"))
    lines = licenses.paragraphs(docs, "doc_id", "text")
    seen = []

    class Watched(Pipeline):
        def fit(self, rows):
            seen.append(rows.where("family = 'unknown'").agg(F.count("*"), F.sum("weight")).first())
            return super().fit(rows)

    monkeypatch.setattr(licenses, "Pipeline", Watched)
    _, _, threshold = licenses.train(lines, fit_paragraphs=40)
    training = lines.where(F.pmod(F.xxhash64(F.concat_ws(" ", "words")), F.lit(4)) > 0).count()
    assert 500 < training < 700 and seen[0][0] == training and abs(seen[0][1] - training / 20) < 1e-6
    assert 0.5 <= threshold <= 0.99


def test_paragraphs_near_a_template_do_not_train(spark):
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts]
    rows = spark.createDataFrame([(t,) for t in [*notices, "plain words", "licensed by hand"]], "line string")
    kept = rows.withColumn("words", licenses.words_of(F.col("line"))).where(licenses._outside(F.col("words")))
    assert {r.line for r in kept.collect()} == {"plain words", "licensed by hand"}


def test_paragraphs_get_their_features_once(spark, monkeypatch):
    text = "Released under the MIT License\nplain words here and there"
    docs = spark.createDataFrame([(1, text), (2, "plain words\n\nother words"), (3, None)], "doc_id long, text string")
    written = []
    monkeypatch.setattr(licenses, "materialize", lambda df, name: written.append(name) or df.localCheckpoint())
    found = licenses.scan(docs).where("confirmed").select("id", "family").distinct().collect()
    assert written == ["paragraphs"] and [tuple(r) for r in found] == [(1, "MIT")]


def test_words_of_templates_are_split_once(spark):
    texts = [t for texts in licenses.TEMPLATES.values() for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "line string").select(licenses.words_of(F.col("line")).alias("words"))
    assert [r.words for r in rows.collect()] == [licenses._fixed(t) for t in texts]
    docs = spark.createDataFrame([(1, "Plain words\n...\nⒶ Ⅷ\n"), (2, None)], "doc_id long, text string")
    lines = licenses.paragraphs(docs, "doc_id", "text")
    assert [tuple(r) for r in lines.select("place", "words").orderBy("place").collect()] == [(0, ["plain", "words"]), (2, ["ⅷ"])]
    plan = lines.select(licenses._outside(F.col("words")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") < 4 and "flatten(" not in plan and plan.count("split(lower(") == 1


def test_tasks_of_the_training_take_many_rows(spark, monkeypatch):
    docs = spark.range(0, 300, 1, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words number "), F.col("id")).alias("text"))
    seen = []

    class Watched(Pipeline):
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return super().fit(rows)

    monkeypatch.setattr(licenses, "Pipeline", Watched)
    monkeypatch.setattr(licenses, "materialize", lambda df, name: df)
    licenses.train(licenses.paragraphs(docs, "doc_id", "text"))
    assert seen[0] <= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(licenses, "FIT_TASK_ROWS", 10)
    licenses.train(licenses.paragraphs(docs, "doc_id", "text"))
    assert seen[1] == 30


def test_paragraphs_are_written_without_their_words(spark, monkeypatch):
    text = "Released under the MIT License\nplain words here and there"
    written = []
    monkeypatch.setattr(licenses, "materialize", lambda df, name: written.append(df.columns) or df.localCheckpoint())
    found = licenses.scan(spark.createDataFrame([(1, text), (2, "plain words\n\nother words")], "doc_id long, text string"))
    assert "words" not in written[0]
    assert found.where("confirmed").agg(F.max("template_share")).first()[0] == 1.0


def test_lines_do_not_carry_their_text(spark):
    docs = spark.createDataFrame([(1, "one line\nanother")], "doc_id long, text string")
    plan = licenses.paragraphs(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate ", 1)
    assert "xxhash64" not in above and "xxhash64" in below
