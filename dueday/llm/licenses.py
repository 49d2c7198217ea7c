"""Licence scans: a paragraph classifier trained here, with DataFrame and MLlib functions only."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

FEATURES = 1 << 13
FIT_PARAGRAPHS = 4_000  # what all unlabelled paragraphs together weigh at most in training
FIT_TASK_ROWS = 500_000  # paragraphs a task of the training takes, beyond one task for each core
CONFIRM = 0.75  # share of a template's words that a paragraph must hold
LEAST = 0.5
STEPS = 1 << 16  # thresholds that are told apart
QUANTILE = 0.99  # of the held-out paragraphs' probabilities; the threshold
SLACK = 1.25  # words a notice may span, as a multiple of its template's
LONG_WORD = 6  # letters of the template words that make a licence vocabulary
UNKNOWN = "unknown"

#: Notices by licence family, as they are commonly written.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software under the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
}
FEWEST = 5  # distinct words of the shortest template, or fewer
FRAMES = ("{}", "{}.", "Note: {}.", "{} unless stated otherwise.", "Copyright 2020 the authors. {}.", "The text below is {}.")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")  # compiled, as a filter with a lambda is not


def _fixed(text: str) -> list[str]:
    """Words of a fixed text in ASCII, as ``words_of`` gives them. Spark would split the text again for every row."""
    return re.findall(r"[a-z0-9]+", text.lower())


def _literal(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, words) of every line that holds a word."""
    # hashed before lines are taken apart: a text needed after would be copied, and hashed, for each of its lines
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.split(text_col, "\n").alias("lines"))
    lines = texts.select("id", "mark", F.posexplode("lines").alias("place", "line"))
    # asks for a first letter or digit only; a condition on the words would split each line twice
    some = lines.where(F.lower("line").rlike(r"[\p{L}\p{N}]"))
    return some.select("id", "mark", "place", words_of(F.col("line")).alias("words"))


def _notices(spark: SparkSession) -> DataFrame:
    rows = [(family, frame.format(t)) for family, texts in TEMPLATES.items() for t in texts for frame in FRAMES]
    literal = F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("line")) for a, b in rows])
    return spark.range(1).select(F.explode(literal).alias("r")).select("r.family", words_of(F.col("r.line")).alias("words"))


def template_match(words: Column, family: Column) -> Column:
    """The largest share of a family's template words that a paragraph holds."""
    out = F.lit(0.0)
    for name, texts in TEMPLATES.items():
        shares = []
        for t in texts:
            own = dict.fromkeys(_fixed(t))
            shares.append(F.size(F.array_intersect(_literal(own), words)) / F.lit(len(own)))
        out = F.when(family == name, F.greatest(*shares)).otherwise(out)
    return out


def notices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, place, words) of stretches of words, over any number of lines, that hold enough of a template.

    Every stretch of SLACK times a template's words that starts with one of them is tried;
    ``place`` is the line of its middle template word. Texts without enough of the words are left out before.
    """
    known = [t for texts in TEMPLATES.values() for t in texts]
    listed = [(sorted(set(words)), math.ceil(SLACK * len(words))) for words in map(_fixed, known)]
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"),
        F.array_intersect(_literal(sorted({w for own, _ in listed for w in own})), words_of(F.col(text_col))).alias("seen"),
    )
    fits = F.array(*[
        F.when(F.size(F.array_intersect(_literal(own), F.col("seen"))) >= CONFIRM * len(own), F.struct(_literal(own).alias("own"), F.lit(span).alias("span")))
        for own, span in listed
    ])
    # exploding, unlike a filter, is not moved below the words of the text, which would split it once for each template
    tried = texts.select("id", "mark", "text", F.explode(F.array_compact(fits)).alias("t"))
    word = lambda line, at: F.transform(words_of(line), lambda w: F.struct(w.alias("word"), at.alias("line")))
    placed = F.flatten(F.transform(F.split("text", "\n"), word))
    tried = tried.select("id", "mark", "t", placed.alias("placed"))
    own, span = F.col("t.own"), F.col("t.span")
    starts = F.filter(F.sequence(F.lit(1), F.size("placed")), lambda i: F.array_contains(own, F.element_at("placed", i)["word"]))
    stretches = F.transform(starts, lambda i: F.slice("placed", i, span))
    shared = lambda x: F.size(F.array_intersect(own, F.transform(x, lambda w: w["word"]))) >= CONFIRM * F.size(own)
    found = tried.select("id", "mark", "t", F.explode(F.filter(stretches, shared)).alias("stretch"))
    hits = F.filter(F.sequence(F.lit(1), F.size("stretch")), lambda i: F.array_contains(own, F.element_at("stretch", i)["word"]))
    found = found.withColumn("hits", hits)
    middle = F.element_at("hits", ((F.size("hits") + 1) / 2).cast("int"))
    words = F.transform(F.slice("stretch", F.lit(1), F.array_max("hits")), lambda w: w["word"])
    held = F.size(F.array_intersect(own, words))
    found = found.select("id", "mark", F.element_at("stretch", middle)["line"].alias("place"), own.alias("own"), words.alias("words"),
                         F.struct(held.alias("held"), (-F.size(words)).alias("length")).alias("rank"))
    return found.groupBy("id", "mark", "place", "own").agg(F.max_by("words", "rank").alias("words")).select("id", "mark", "place", "words")


def _features() -> list:
    return [
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        HashingTF(numFeatures=FEATURES, inputCol="terms", outputCol="features", binary=True),
    ]


def _held(words: Column) -> Column:
    """The words of any template that a paragraph holds, which is all that is asked of its words later."""
    return F.array_intersect(_literal(dict.fromkeys(w for texts in TEMPLATES.values() for t in texts for w in _fixed(t))), words)


def _outside(words: Column) -> Column:
    """Is a paragraph no notice and no part of one: less than CONFIRM of any template, and less than two of its telling words?"""
    telling = lambda k: F.size(F.filter(k, lambda w: F.length(w) >= LONG_WORD))
    near = lambda k: F.greatest(*[template_match(k, F.lit(name)) for name in TEMPLATES])
    # the lambda binds the template words a paragraph holds once; most hold too few for any template
    found = lambda k: (telling(k) < 2) & ((F.size(k) <= CONFIRM * FEWEST) | (near(k) < CONFIRM))
    return F.exists(F.array(_held(words)), found)


def featured(lines: DataFrame) -> DataFrame:
    """``lines`` with features, ``held``, ``outside`` and ``kept_out``, written once without their words: training, threshold and scan all read them."""
    words = F.col("words")
    flagged = lines.withColumns({"held": _held(words), "kept_out": F.pmod(F.xxhash64(F.concat_ws(" ", words)), F.lit(4)) == 0})
    flagged = flagged.withColumn("outside", _outside(F.col("held")))
    return materialize(PipelineModel(_features()).transform(flagged).drop("words", "pairs", "terms"), "paragraphs")


def train(lines: DataFrame, fit_paragraphs: int = FIT_PARAGRAPHS) -> tuple[PipelineModel, list[str], float]:
    """(model, families, threshold) from the templates in a few frames, and all paragraphs.

    Paragraphs count as unknown, except those that hold most words of a
    template or two of its words of LONG_WORD letters, as lines of wrapped notices do:
    those are neither class. All paragraphs together weigh as much as ``fit_paragraphs`` of them, if there are more, so that the few
    templates keep their say in a corpus of any size. Those of one in four hashes are kept out of training; the threshold is the
    QUANTILE of the highest probability of any family among them, rounded up to a multiple of 1 / STEPS, and at least one half, so
    the unknown class keeps what the corpus itself shows to be no licence.
    """
    spark = lines.sparkSession
    families = [UNKNOWN, *sorted(TEMPLATES)]
    if "features" not in lines.columns:
        lines = featured(lines)
    rows = lines.count()
    weight = min(1.0, fit_paragraphs / max(rows, 1))
    unknown = lines.where("outside").select(F.lit(UNKNOWN).alias("family"), "features", "kept_out")
    told = PipelineModel(_features()).transform(_notices(spark)).select("family", "features", F.lit(False).alias("kept_out"))
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    weights = F.when(F.col("family") == UNKNOWN, weight).otherwise(4.0)
    fit = unknown.where("NOT kept_out").union(told).withColumn("label", label).withColumn("weight", weights)
    logistic = LogisticRegression(family="multinomial", maxIter=25, regParam=0.002, elasticNetParam=0.3, weightCol="weight")
    # every task writes a gradient of all coefficients in every iteration, so a task takes many rows
    fit = fit.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FIT_TASK_ROWS)))
    fitted = Pipeline(stages=[logistic]).fit(fit).stages[0]  # which keeps its blocks of rows for all iterations
    model = PipelineModel([*_features(), fitted])
    tested = fitted.transform(unknown.where("kept_out")).select(vector_to_array("probability").alias("p"))
    step = F.ceil(F.array_max(F.slice("p", 2, len(families) - 1)) * STEPS)
    counts = sorted((r.step, r["count"]) for r in tested.groupBy(step.alias("step")).count().collect())  # at most STEPS + 1 rows
    left = QUANTILE * sum(n for _, n in counts)
    worst = 0
    for worst, n in counts:
        left -= n
        if left <= 0:
            break
    return model, families, max(LEAST, min(0.99, worst / STEPS))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_paragraphs: int = FIT_PARAGRAPHS) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share, confirmed) of every line judged to name a licence.

    Lines are judged by their words and word pairs, and so are the stretches of ``notices``: wrapped
    notices and those inside longer lines, each under the line of its middle word. ``confirmed``
    says that the words also hold enough of a template of that family. Empty and null texts have no lines.
    """
    lines = featured(paragraphs(docs, id_col, text_col))
    model, families, threshold = train(lines, fit_paragraphs)
    columns = ["id", "mark", "place", "held", "features"]
    found = PipelineModel(model.stages[:-1]).transform(notices(docs, id_col, text_col).withColumn("held", _held(F.col("words")))).select(*columns)
    judged = model.stages[-1].transform(lines.select(*columns).union(found)).withColumn("p", vector_to_array("probability"))
    judged = judged.withColumn("probability", F.array_max(F.slice("p", 2, len(families) - 1))).where(F.col("probability") > threshold)
    names = F.array(*[F.lit(f) for f in families])
    judged = judged.withColumn("family", F.get(names, F.array_position("p", F.col("probability")).cast("int") - 1))
    share = template_match(F.col("held"), F.col("family"))
    return judged.select("id", "mark", F.col("place").alias("paragraph"), "family", "probability", share.alias("template_share")).withColumn(
        "confirmed", F.col("template_share") >= CONFIRM
    )


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_paragraphs: int = FIT_PARAGRAPHS) -> DataFrame:
    """(doc_id, n_lines, n_predicted, n_confirmed, families, probability) of every row of ``docs``.

    ``families`` are the confirmed ones, sorted; ``probability`` is the highest of a
    confirmed line. Null and empty texts have no licence and no lines. Repeated rows and
    rows without an id are judged like others. Extra columns are ignored.
    """
    found = scan(docs, id_col, text_col, fit_paragraphs)
    sure = F.when(F.col("confirmed"), F.col("family"))
    per_text = found.groupBy(F.coalesce("id", F.lit(-(1 << 63))).alias("key"), "mark").agg(
        F.countDistinct("paragraph").alias("n_predicted"), F.countDistinct(F.when(F.col("confirmed"), F.col("paragraph"))).alias("n_confirmed"),
        F.sort_array(F.collect_set(sure)).alias("families"),
        F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"),
    )
    per_text = materialize(per_text, "licences")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"),
        F.when(F.length(text_col) > 0, F.size(F.split(text_col, "\n"))).otherwise(0).cast("long").alias("n_lines"),
    ).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    return rows.join(per_text, ["key", "mark"], "left").select(
        "doc_id", "n_lines", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"), "probability",
    )
