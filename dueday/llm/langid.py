"""Language identification by fusing text, markup, address and host evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .textblocks import LOWER, blocks, small_batches, tidy

BUCKETS = 1 << 15
FIT_ROWS = 4_000  # labelled rows of each language to learn letters from, in expectation
MOST_LANGUAGES = 256  # the most declared ones are told apart
REST = "other"  # all languages beyond those
VALUES = 256  # values that a declaration or suffix is smoothed over
LETTER = r"(?s)[A-Za-z].|[^\x00-\x7f]"
STRENGTH = 20.0  # pseudo-counts a level of the host prior lends to the next
TEMPER = 1 / 3  # neighbouring trigrams overlap
UNSURE = 0.5  # least posterior of a known language, and least share of the letters that must allow it
LETTER_BYTES = 5  # a known text has a letter trigram for so many bytes at least
STRETCH = 64  # letter trigrams judged together
RULED_OUT = float(np.log(100.0))  # a stretch rules out what is so much less likely than another language or chance
SALTS = 16


def _trigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every lower-cased byte trigram that holds a letter."""
    low = LOWER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] * np.uint32(65599) + low[1:-1]) * np.uint32(65599) + low[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    letter = (low >= 128) | ((low >= 97) & (low <= 122))
    good = letter[1:-1].copy()
    inner = starts[1:-1]
    for back in (1, 2):
        at = inner - back
        good[at[(at >= 0) & (at < len(good))]] = False
    where = np.flatnonzero(good)
    return bucket[where], np.searchsorted(starts, where, "right") - 1


def _declared(rows: DataFrame, fit_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the languages beyond MOST_LANGUAGES declared as REST, and a sample of each language's rows.

    Languages are counted over all rows. Of each, ``fit_rows`` rows are taken in expectation,
    by hash, and always those with the smallest hash, so none stays without a row.
    """
    spread = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    lettered = lambda frame: frame.where(F.col("declared").isNotNull() & F.col("text").rlike(LETTER))
    size = (F.count("*").alias("n"), F.min(spread).alias("least"))
    top = lettered(rows).groupBy("declared").agg(*size).orderBy(F.desc("n"), "declared").limit(MOST_LANGUAGES + 1).collect()
    if len(top) > MOST_LANGUAGES:
        names = [r["declared"] for r in top[:MOST_LANGUAGES]]
        rest = F.when(F.col("declared").isin(*names), F.col("declared")).otherwise(REST)
        rows = rows.withColumn("declared", F.when(F.col("declared").isNotNull(), rest))
        top = lettered(rows).groupBy("declared").agg(*size).collect()  # at most one row more
    if not top:
        return rows, lettered(rows).limit(0)
    bounds = [(r["declared"], max(r["least"] + 1, int(min(1.0, fit_rows / r["n"]) * (1 << 30)))) for r in top]
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in bounds for x in pair]), F.col("declared"))
    return rows, lettered(rows).where(spread < bound)


def _letter_model(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket) from a sample of labelled rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                bucket, row = _trigrams(block.data, block.starts)
                for name in set(names[block.first : block.last]):
                    own = np.array([n == name for n in names[block.first : block.last]])
                    counts = np.bincount(bucket[own[row]], minlength=BUCKETS)
                    sums[name] = sums.get(name, 0) + counts
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["declared", "counts"])

    found: dict[str, np.ndarray] = {}
    sample = sample.select("declared", "text").coalesce(16).mapInArrow(tidy(count), "declared string, counts binary")
    for r in sample.toLocalIterator():  # one row a task and language of a bounded sample
        found[r["declared"]] = found.get(r["declared"], 0) + np.frombuffer(r["counts"], np.int64)
    languages = sorted(name for name in found if found[name].sum())
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    counts = np.stack([found[name] for name in languages], axis=1) + 0.5
    return languages, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _text_logs(rows: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """(key columns, letters, n_bytes, likelihoods, allowed) with the tempered log likelihood of each
    language, and the share of the letters that stand in stretches which do not rule it out."""
    sent = rows.sparkSession.sparkContext.broadcast(logs)
    kept = ["id", "mark", "declared", "host", "domain", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = sent.value
        for batch in batches:
            for block in blocks(batch.column(len(kept))):
                bucket, row = _trigrams(block.data, block.starts)
                letters = np.bincount(row, minlength=block.rows)
                per_row = -(-letters // STRETCH)
                inside = np.arange(len(row)) - (np.cumsum(letters) - letters)[row]
                piece = (np.cumsum(per_row) - per_row)[row] + inside // STRETCH
                owner, pieces = np.repeat(np.arange(block.rows), per_row), int(per_row.sum())
                size = np.bincount(piece, minlength=pieces)
                likely = np.zeros((pieces, logs.shape[1]))
                for k in range(logs.shape[1]):
                    likely[:, k] = np.bincount(piece, weights=logs[bucket, k], minlength=pieces) * TEMPER
                chance = size * (-np.log(BUCKETS) * TEMPER)  # any trigram as likely as any other
                least = np.maximum(likely.max(axis=1, initial=-np.inf), chance) - RULED_OUT
                sums = np.zeros((2, block.rows, logs.shape[1]))
                for k in range(logs.shape[1]):
                    sums[0, :, k] = np.bincount(owner, weights=likely[:, k], minlength=block.rows)
                    sums[1, :, k] = np.bincount(owner, weights=size * (likely[:, k] >= least), minlength=block.rows)
                sums[1] /= np.maximum(letters, 1)[:, None]
                part = batch.slice(block.first, block.rows)
                offsets = pa.array(np.arange(block.rows + 1) * logs.shape[1], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float64())) for x in sums]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(letters, pa.int64()), pa.array(np.diff(block.starts), pa.int64()), *lists],
                    names=[*kept, "letters", "n_bytes", "likelihoods", "allowed"],
                )

    schema = rows.select(*kept).schema.add("letters", T.LongType()).add("n_bytes", T.LongType())
    schema = schema.add("likelihoods", T.ArrayType(T.DoubleType())).add("allowed", T.ArrayType(T.DoubleType()))
    return rows.select(*kept, "text").mapInArrow(tidy(run), schema)


def _with_shares(frame: DataFrame, name: str, scores: Column) -> DataFrame:
    """Log scores as probabilities, step by step so that no step is computed twice."""
    frame = frame.withColumn("_s", scores).withColumn("_top", F.array_max("_s"))
    frame = frame.withColumn("_s", F.transform("_s", lambda x: F.exp(x - F.col("_top"))))
    frame = frame.withColumn("_sum", F.aggregate("_s", F.lit(0.0), lambda a, b: a + b))
    return frame.withColumn(name, F.transform("_s", lambda x: x / F.col("_sum"))).drop("_s", "_top", "_sum")


def _smoothed(parent: Column) -> Column:
    """Shares of a level, with STRENGTH pseudo-counts spread as the level above says."""
    total = F.aggregate("counts", F.lit(0.0), lambda a, b: a + b)
    return F.zip_with("counts", parent, lambda c, p: (c + F.lit(STRENGTH) * p) / (total + F.lit(STRENGTH)))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    address_col: str | None = "source",
    fit_rows: int = FIT_ROWS,
    languages: tuple[str, ...] | None = None,
) -> DataFrame:
    """(doc_id, mark, language, probability, text_language, letters, known) of every row.

    The posterior of a language is the product of four kinds of evidence:

    * the text's letter trigrams, under a model learned from a bounded sample of the
      rows that declare each language (``fit_rows`` of each in expectation, by hash);
    * the declared language (markup), by how often each is declared where the text alone says each language;
    * the suffix of the address, likewise;
    * the host's prior: shares of languages at the host, smoothed by those of its
      domain, those by the suffix's, those by all rows'. Shares are grouped sums of
      the text-only posteriors, so hot hosts meet only in sums that combine early.

    Languages are counted over all rows that declare one; beyond the MOST_LANGUAGES
    most declared, all others together are the language REST.
    ``known`` is false where the language is unsure: the best one has no more than
    half the posterior; or a text with letters has fewer than one letter trigram in
    LETTER_BYTES bytes; or half of its letters or more stand in stretches of STRETCH
    trigrams that rule the best language out, because another language or a uniform
    choice of trigrams is more than 100 times as likely (mixed texts, no language). A null declaration or
    address is no evidence. Null and empty texts have no trigrams; without any labelled
    row, language is null and nothing is known. Repeated rows are judged alike; ``mark`` (a hash of text,
    declaration and address) tells rows of one id apart.
    Extra columns are ignored. Ties go to the language that sorts first.
    """
    small_batches(docs.sparkSession)
    blank = F.lit(None).cast("string")
    address = F.lower(F.col(address_col).cast("string")) if address_col else blank
    host = F.regexp_extract(address, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)
    declared = F.lower(F.trim(F.col(declared_col).cast("string"))) if declared_col else blank
    declared = F.regexp_extract(declared, "^([^-_]+)", 1)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.col(text_col), *(F.col(c) for c in (declared_col, address_col) if c)).alias("mark"),
        F.when(declared != "", declared).alias("declared"),
        F.when(host != "", host).alias("host"),
        F.col(text_col).alias("text"),
    )
    rows = rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"\.([a-z]+)$", 1))
    rows = rows.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("domain", "suffix")})
    if languages:
        rows = rows.withColumn("declared", F.when(F.col("declared").isin(*languages), F.col("declared")))
    rows, sample = _declared(rows, fit_rows)
    known, logs = _letter_model(sample)
    evidence = materialize(_text_logs(rows, known, logs), "evidence")
    n = len(known)
    if not n:
        return evidence.select(
            F.col("id").alias("doc_id"), "mark", blank.alias("language"), F.lit(None).cast("double").alias("probability"),
            blank.alias("text_language"), "letters", F.lit(False).alias("known"),
        )
    told = _with_shares(evidence, "shares", F.col("likelihoods"))
    sums = F.array(*[F.sum(F.when(F.col("letters") > 0, F.col("shares")[k]).otherwise(0.0)) for k in range(n)])

    everything = told.agg(sums.alias("counts")).first()["counts"]
    top = [((c or 0.0) + 1.0) / (sum(x or 0.0 for x in everything) + n) for c in everything]
    overall = F.array(*[F.lit(x) for x in top])
    # one row per host; domains and suffixes are sums over hosts
    hosts = told.where("host is not null").groupBy("host", "domain", "suffix").agg(sums.alias("counts"))
    hosts = materialize(hosts, "hosts")
    again = F.array(*[F.sum(F.col("counts")[k]) for k in range(n)])
    suffixes = hosts.where("suffix is not null").groupBy("suffix").agg(again.alias("counts"))
    suffixes = suffixes.select("suffix", _smoothed(overall).alias("suffix_prior"))
    domains = hosts.where("domain is not null").groupBy("domain", "suffix").agg(again.alias("counts"))
    domains = domains.join(suffixes, "suffix", "left").select(
        "domain", _smoothed(F.coalesce("suffix_prior", overall)).alias("domain_prior")
    )
    hosts = hosts.join(domains, "domain", "left").select(
        "host", _smoothed(F.coalesce("domain_prior", overall)).alias("prior")
    )

    def likelihood(column: str) -> DataFrame:
        """Of each value of a column, the probability under each language."""
        counts = told.where(F.col(column).isNotNull()).groupBy(column).agg(sums.alias("counts"))
        row = told.where(F.col(column).isNotNull()).agg(sums.alias("totals")).first()["totals"]  # one number a language
        totals = F.array(*[F.lit(float(x or 0.0)) for x in row])
        values = F.zip_with("counts", totals, lambda c, t: F.log((c + 0.5) / (t + 0.5 * VALUES)))
        return counts.select(column, values.alias(f"{column}_log"))

    salted = told.withColumn("salt", F.pmod("mark", F.lit(SALTS)))
    for column, frame in (("declared", likelihood("declared")), ("suffix", likelihood("suffix")), ("host", hosts)):
        many = frame.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        salted = salted.join(many, [column, "salt"], "left")
    none = F.array(*[F.lit(0.0)] * n)
    prior = F.transform(F.coalesce("prior", overall), lambda p: F.log(p))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = add(add(F.col("likelihoods"), F.coalesce("declared_log", none)), add(F.coalesce("suffix_log", none), prior))
    names = F.array(*[F.lit(x) for x in known])
    best = lambda a: F.get(names, F.array_position(a, F.array_max(a)).cast("int") - 1)
    fused = _with_shares(salted, "posterior", score).withColumn("probability", F.array_max("posterior"))
    place = F.array_position("posterior", F.col("probability")).cast("int") - 1
    clear = (F.col("letters") * LETTER_BYTES >= F.col("n_bytes")) & (F.get("allowed", place) > UNSURE)
    return fused.select(
        F.col("id").alias("doc_id"), "mark", best(F.col("posterior")).alias("language"), "probability",
        F.when(F.col("letters") > 0, best(F.col("shares"))).alias("text_language"), "letters",
        ((F.col("probability") > UNSURE) & ((F.col("letters") == 0) | clear)).alias("known"),
    )


def keep_known(docs: DataFrame, accepted: tuple[str, ...] | None = None, **columns) -> DataFrame:
    """The rows of ``docs`` with a known language (one of ``accepted``, if given) and some letters."""
    found = identify(docs, **columns)
    wrong = ~F.col("known") | (F.col("letters") == 0)
    if accepted:
        wrong = wrong | ~F.col("language").isin(*accepted)
    names = {"id_col": "doc_id", "text_col": "text", "declared_col": "lang", "address_col": "source"} | columns
    hashed = F.xxhash64(*[docs[names[k]] for k in ("text_col", "declared_col", "address_col") if names[k]])
    gone = materialize(found.where(wrong).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct(), "rejected")
    same = docs[names["id_col"]].cast("long").eqNullSafe(gone["gone_id"]) & (hashed == gone["gone_mark"])
    return docs.join(gone, same, "left_anti")
