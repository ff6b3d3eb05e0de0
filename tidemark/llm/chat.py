"""Chat formatting by event-sourced reconstruction. DataFrame functions only.

A log holds events of conversations: `message` begins a message, `delta` appends to
it, `edit` replaces its text, `regenerate` does so too and removes every message that came
after it so far. Events of a conversation are folded in the order of seq into final
messages, which are then rendered with a template and a loss mask over assistant texts.

Template: each turn is `### Role: text</turn>` and a line feed. Inside roles and texts the
control characters are escaped: a backslash as `\\\\`, `#` as `\\h`, `<` as `\\l`, and in roles `:` as `\\c`.
So neither `###` nor `</turn>` can appear there, and parsing needs no look-ahead.

Defined cases: null roles and texts are empty; events of equal seq are ordered by kind,
role and text; deltas and edits of a message that never began are one by themselves, with the role they
name; null conversation ids form one conversation; repeated rows of a turn table are turns
each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

END = "</turn>\n"


def escape(s: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def unescape(s: Column) -> Column:
    """Split at escaped backslashes; between them each other escape stands for itself."""
    def between(part: Column) -> Column:
        for a, b in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            part = F.replace(part, F.lit(a), F.lit(b))
        return part

    return F.array_join(F.transform(F.split(s, r"\\\\"), between), "\\")


def turns_as_events(turns: DataFrame) -> DataFrame:
    """conv_id, seq, msg, kind, role, text: each row of a table of turns as a message of its own."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), role.alias("role"), text.alias("text"))
    twin = F.row_number().over(Window.partitionBy("conv_id", "seq").orderBy("role", "text"))
    return rows.withColumn("msg", F.concat_ws("/", F.col("seq").cast("string"), twin.cast("string"))).withColumn("kind", F.lit("message"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, seq, msg, role, text: the final messages, seq being that of their first event."""
    of_message = Window.partitionBy("conv_id", "msg")
    in_order = of_message.orderBy(F.col("seq").asc_nulls_first(), F.col("kind").desc(), "role", "text")
    rows = events.withColumn("n", F.row_number().over(in_order))
    # Only what came from the last event on that sets the whole text counts.
    whole = F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("n"))
    rows = rows.withColumn("from", F.coalesce(F.max(whole).over(of_message), F.lit(0)))
    piece = F.when(F.col("n") >= F.col("from"), F.struct("n", "text"))
    messages = rows.groupBy("conv_id", "msg").agg(
        F.min("seq").alias("seq"),
        F.min_by("role", "n").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "").alias("text"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("seq", "msg").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max("again").over(earlier) > F.col("seq"), F.lit(False))
    return messages.withColumn("gone", gone).where("not gone").select("conv_id", "seq", "msg", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: a text for each conversation, and where (start, length) assistants' escaped texts lie."""
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    rows = messages.select("conv_id", "seq", "msg", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "msg", "head", "body", "learn"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    # Lengths of heads and bodies in turn, then a running sum by one window over the exploded turns would cost a shuffle; sums stay in the row.
    sizes = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["learn"].alias("learn")))
    return turns.withColumns({"formatted": formatted, "sizes": sizes}).select("conv_id", "formatted", _spans(F.col("sizes")).alias("loss_spans"))


def _spans(sizes: Column) -> Column:
    """Offsets by a fold that carries the place and the spans so far."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.array(F.struct((acc["at"] + t["head"]).alias("start"), t["body"].alias("length")))
        return F.struct((acc["at"] + t["head"] + t["body"] + len(END)).alias("at"), F.when(t["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, start, step, lambda acc: acc["spans"])


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, ": ")
        return F.struct(unescape(F.substring(p, F.lit(5), at - 5)).alias("role"), unescape(F.substring(p, at + 2, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def digest(rendered: DataFrame) -> DataFrame:
    """What reading the output back gives, for each conversation."""
    rows = rendered.withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    return rows.withColumn("under", under).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans from a table conv_id, turn, role, text."""
    return render(fold(turns_as_events(turns)))
