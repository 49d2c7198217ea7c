"""Chat formatting from an event log, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
#: Control strings of the template: a turn is START role MIDDLE text END.
START, MIDDLE, END = "<s>[", "]", "</s>"
#: Characters that control strings need, and how texts write them. Each code begins
#: with a backslash, and a backslash begins a code, so undoing them in reverse order is exact.
CODES = (("\\", "\\-"), ("[", "\\("), ("]", "\\)"), ("<", "\\{"))


def escaped(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turns_as_events(conversations: DataFrame, pieces: int = 2) -> DataFrame:
    """A table of finished turns as the log that would have led to it.

    Each row is a message: its role is opened, then its text is streamed as
    ``pieces`` deltas. Rows of one conversation and turn are ordered by role and text; repeated rows are messages of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    step = F.ceil(F.length("text") / F.lit(pieces)).cast("int")
    events = F.array(
        F.struct(F.lit(OPEN).alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")),
        *[
            F.struct(F.lit(DELTA).alias("kind"), F.lit(None).cast("string").alias("role"), F.substring("text", step * k + 1, step).alias("text"))
            for k in range(pieces)
        ],
    )
    return rows.select("conv_id", "message", F.posexplode(events).alias("k", "e")).select(
        "conv_id", (F.col("message") * (pieces + 1) + F.col("k")).alias("seq"), "message", "e.kind", "e.role", "e.text"
    )


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): what the events of each message add up to.

    ``log`` has conv_id, seq, message, kind, role, text. Events of a conversation
    count by seq: ``open`` and ``edit`` set the text, ``delta`` appends to it,
    ``regenerate`` empties it (its own text starts the new one) and takes away every
    later message begun before. The last role given holds. Equal events count once;
    of different events with one seq the order is by kind and text. Unknown kinds and events
    without message or seq are left out. Null texts are empty; a message without a role has an empty one.
    """
    known = log.where(F.col("kind").isin(OPEN, DELTA, EDIT, REGENERATE) & F.col("message").isNotNull() & F.col("seq").isNotNull())
    known = known.select("conv_id", "message", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    begins = F.when(F.col("kind") != DELTA, F.col("seq"))
    events = F.struct("seq", "kind", "text")
    folded = known.groupBy("conv_id", "message").agg(
        F.max(begins).alias("start"),
        F.max(F.when(F.col("kind") == REGENERATE, F.col("seq"))).alias("again"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.array_sort(F.collect_set(events)).alias("events"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    alive = folded.withColumn("cut", F.max("again").over(earlier)).where("cut IS NULL OR start > cut")
    held = F.filter("events", lambda e: F.col("start").isNull() | (e["seq"] >= F.col("start")))
    return alive.select(
        "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(held, lambda e: e["text"]), "").alias("text"),
    )


def render(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) from messages: the turns in order, and the
    code-point ranges [begin, end) of escaped text that the loss is taken over.

    A conversation is one row, so its text meets in one place; everything before is by message.
    """
    pieces = turns.select(
        "conv_id", "message", F.col("role") == trained_role,
        F.concat(F.lit(START), escaped(F.col("role")), F.lit(MIDDLE)).alias("head"), escaped(F.col("text")).alias("body"),
    ).toDF("conv_id", "message", "trained", "head", "body")
    pieces = pieces.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.sum("size").over(order) - F.col("size") + F.length("head")
    placed = pieces.withColumn("begin", begin).withColumn("end", F.col("begin") + F.length("body"))
    all_turns = F.array_sort(F.collect_list(F.struct("message", "trained", "begin", "end", F.concat("head", "body", F.lit(END)).alias("t"))))
    return placed.groupBy("conv_id").agg(all_turns.alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["t"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end"))).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """``rendered`` with ``turns`` (role, text) and ``loss_texts``, read from the formatted text alone."""
    marked = F.filter(F.split("formatted", END), lambda t: t != "")
    turn = lambda t: F.struct(
        unescaped(F.substring(F.substring_index(t, MIDDLE, 1), F.lit(len(START) + 1), F.length(t))).alias("role"),
        unescaped(F.substring(t, F.length(F.substring_index(t, MIDDLE, 1)) + F.lit(len(MIDDLE) + 1), F.length(t))).alias("text"),
    )
    cut = lambda s: unescaped(F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))
    return rendered.withColumns({"turns": F.transform(marked, turn), "loss_texts": F.transform("loss_spans", cut)})
