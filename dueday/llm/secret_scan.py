"""Secrets in texts, told apart by who owns them, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import materialize


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the secret itself, its least length, and cheap tests:
    every text with a match contains one of the strings in ``hints`` (if any) and matches ``rough``."""

    name: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()
    rough: str = ""

    def may_match(self, text: Column) -> Column:
        tests = [reduce(or_, [F.contains(text, F.lit(h)) for h in self.hints])] if self.hints else []
        return reduce(and_, [*tests, text.rlike(self.rough or self.pattern)])


def either_case(word: str) -> str:
    """A pattern for ``word`` with its letters A-Z in either case and no others."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Looked for everywhere; their spans always stay. Runs of hexadecimal digits and what follows
#: AKIA are maximal, so the least length can stand in the pattern; a short assigned value
#: uses up its place and must be dropped afterwards.
BASE = (
    Kind("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, (":", "=")),
    Kind("access", "AKIA[A-Z0-9]{12,}", 0, 16, ("AKIA",)),
    Kind("hex", "[0-9a-f]{32,}", 0, 32, (), "(?<![0-9a-f])[0-9a-f]{32}"),
)
#: Private keys, signed tokens, vendors' keys and bare runs: only spans that ownership shows to be live are added.
LIVE = Kind(
    "live",
    "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\x09-\\x0D\\x20]*-----END [A-Z ]*PRIVATE KEY-----"
    "|eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"
    "|(?:gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}"
    "|[A-Za-z0-9+/_-]{24,}",
    0,
    20,
    (),
    "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}|-----BEGIN |eyJ",
)
KINDS = (*BASE, LIVE)
WIDELY = 3  # owners that make a secret an example
HOT_SPANS, MOST_HOT = 1_000, 1_000


def _found(text: Column, kind: Kind) -> Column:
    """[(gap, size, value)]: code points before each match since the last, and of it; linear in the text."""
    parts = F.arrays_zip(
        F.transform(F.split(text, kind.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.length).alias("size"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)).alias("value"),
    )
    kinds = F.transform(
        parts, lambda p: F.struct(F.lit(kind.name).alias("kind"), p["gap"].alias("gap"), p["size"].alias("size"), p["value"].alias("value"))
    )
    return F.when(kind.may_match(text), kinds).otherwise(F.array().cast("array<struct<kind:string,gap:int,size:int,value:string>>"))


def looks_live(value: Column) -> Column:
    """Letters and digits mixed, at least 16 characters, 8 different ones, and no word that marks a placeholder."""
    low = F.lower(value)
    different = F.size(F.array_distinct(F.split(value, "")))
    return (
        (F.length(value) >= 16) & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (different >= 8)
        & ~low.rlike("example|sample|placeholder|changeme|dummy|xxxx|test")
    )


def candidates(docs: DataFrame, text: str = "text", repo: str | Column = "source", owner: str | Column | None = None) -> DataFrame:
    """(row, repo, owner, kind, start, end, value) of every match, and one row without kind for each text.

    ``row`` numbers the input rows; the scan is written once, so the numbers hold. ``owner`` is by default what stands
    before the first slash of ``repo``, as in ``owner/name``. Null texts are empty. A null repository
    or owner is one of its own, apart from the empty name.
    """
    repo = F.col(repo) if isinstance(repo, str) else repo
    owner = F.substring_index(repo, "/", 1) if owner is None else F.col(owner) if isinstance(owner, str) else owner
    body = F.coalesce(F.col(text), F.lit(""))
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"),
        F.concat(*[_found(body, k) for k in KINDS]).alias("found"),
    )
    scanned = materialize(scanned, "secrets")
    each = scanned.select("row", "repo", "owner", F.posexplode("found").alias("at", "m")).select("row", "repo", "owner", "at", "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(so_far)
    least = F.expr("CASE kind " + " ".join(f"WHEN '{k.name}' THEN {k.least}" for k in KINDS) + " END")
    spans = each.withColumn("end", end).where(F.col("size").isNotNull() & (F.length("value") >= least))
    spans = spans.select("row", F.lit(None).cast(scanned.schema["doc_id"].dataType).alias("doc_id"), "repo", "owner", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")
    texts = scanned.select("row", "doc_id", "repo", "owner", *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("start", "long"), ("end", "long"), ("value", "string"))])
    return spans.union(texts)


def ownership(found: DataFrame) -> DataFrame:
    """(secret, n_spans, n_repos, n_owners) of every candidate value, over the whole table; ``n_spans`` counts a place once for each kind that finds it.

    Rows are first reduced to one per value, repository and owner, then to one per value and owner,
    so a value that stands everywhere is counted by many tasks.
    """
    by_repo = found.groupBy("secret", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("secret", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("secret").agg(
        F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners")
    )


def _judged(found: DataFrame, widely: int) -> DataFrame:
    spans = materialize(found.where("kind IS NOT NULL").withColumn("secret", F.sha2("value", 256)), "candidates")
    total = spans.count()
    owners = ownership(spans)
    with_owners = lookup(spans, owners, "secret", ["row", "start"], limit=max(HOT_SPANS, total // MOST_HOT))
    verdict = (
        F.when(F.col("n_owners") >= widely, "example")
        .when((F.col("n_owners") == 1) & looks_live(F.col("value")), "live")
        .when(F.col("n_owners") > 1, "shared")
        .otherwise("weak")
    )
    judged = with_owners.withColumn("verdict", verdict)
    base = F.col("kind") != LIVE.name
    rank = F.expr("CASE kind " + " ".join(f"WHEN '{k.name}' THEN {i}" for i, k in enumerate(KINDS)) + " END")
    order = Window.partitionBy("row").orderBy("start", "rank")
    ranked = judged.withColumn("rank", rank)
    covered = (F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")) | (
        F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)) < F.col("end")
    )
    keep = base | ((F.col("verdict") == "live") & ~F.coalesce(F.col("covered"), F.lit(False)))
    return ranked.withColumn("covered", covered).where(keep).drop("covered")


def findings(docs: DataFrame, text: str = "text", repo: str | Column = "source", owner: str | Column | None = None, widely: int = WIDELY) -> DataFrame:
    """One row per span: row, kind, start, end (code points), secret (its SHA-256), n_spans, n_repos, n_owners, verdict.

    ``example``: the value belongs to at least ``widely`` owners. ``live``: it belongs to one owner only and looks
    like a credential. ``shared``: to more owners, but fewer than ``widely``. ``weak``: to one, and looks like none.
    """
    return _judged(candidates(docs, text, repo, owner), widely).select(
        "row", "kind", "start", "end", "secret", "n_spans", "n_repos", "n_owners", "verdict"
    )


def scan(docs: DataFrame, text: str = "text", repo: str | Column = "source", owner: str | Column | None = None, widely: int = WIDELY) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_added.

    Base spans always stay; spans of the kind ``live`` are added where one owner alone has the
    value, it looks like a credential, and no base span overlaps it. ``spans`` lists kind:start:end
    by start, then kind; ``base_sha256`` is the digest of the base ones. Repeated rows each give
    a row; null ids stay null; an empty table gives an empty one; other columns are not read.
    """
    found = materialize(candidates(docs, text, repo, owner), "spans")
    said = F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("span"))
    spans = _judged(found, widely).select("row", F.lit(None).cast(found.schema["doc_id"].dataType).alias("doc_id"), "kind", "verdict", said.alias("said"))
    texts = found.where("kind IS NULL").select("row", "doc_id", "kind", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast(spans.schema["said"].dataType).alias("said"))

    def listed(column: str) -> Column:
        return F.array_join(F.transform(F.array_sort(column), lambda s: s["span"]), ",")

    base = F.col("kind") != LIVE.name
    rows = spans.union(texts).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        *[F.count_if(F.col("kind") == k.name).alias(f"n_{k.name}") for k in BASE],
        F.collect_list(F.when(base, F.col("said"))).alias("base"),
        F.collect_list("said").alias("all"),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
        F.count_if(F.col("kind") == LIVE.name).alias("n_added"),
    )
    return rows.select(
        "doc_id", *[f"n_{k.name}" for k in BASE], F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"),
        "n_live", "n_example", "n_added",
    )
