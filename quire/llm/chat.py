"""Chat logs to training text: event-sourced reconstruction, then a template.

`reconstruct` folds a log of events (conv_id, seq, kind, msg, role, text) into
final messages, with DataFrame operations only:

    message     opens message `msg` with a role and a text, whole or its beginning
    delta       appends streamed text to a message
    edit        replaces a message's text
    regenerate  discards a message's text for a new one (further deltas append)
                and drops the messages after it that were written before

The log is partitioned by conversation and message and folded in order of seq;
what a message finally says are its pieces since its last message, edit or
regenerate event.  A second step, per conversation, drops what a regeneration
cut off and puts the messages in order of msg.  So a conversation of any length
meets in one task only as its final messages, which one output row has to hold.
Events of one seq are folded in order of kind, then text; seq and msg may be of any
type with an order, structs too.

`render` writes a turn as

    <s>ROLE\\nTEXT\\n</s>

A control string (`CONTROLS`) inside a text gets a backslash before it.  No mark
has one there, and taking one away restores the text; in a role, backslash,
newline and < are written as \\\\, \\n and \\l.  `loss` lists the spans (start and
length in code points) of the assistant's escaped texts, and `read_back` recovers
roles, texts and the text under that mask from the output alone.

Nulls: a null text is empty, a null role is the empty role; events with a null
conversation form one conversation, those with null msg or seq come first.  A
delta, edit or regeneration of a message that was never opened opens it with the
role of the event.  Repeated events are folded each; other columns are ignored,
whatever their names.  Texts of any length are folded and escaped whole, and a
conversation has to fit in the row it becomes.  An empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strings that chat formats use as marks.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
END = "\n</s>"
OPEN = "<s>"
ASSISTANT = "assistant"
#: Code points of a streamed piece.
CHUNK = 48
KINDS = ("message", "edit", "regenerate", "delta")

MARK = "(" + "|".join("".join("\\" + c if c in "[]|" else c for c in x) for x in CONTROLS) + ")"


def escape(text: Column) -> Column:
    """A backslash before every control string."""
    return F.regexp_replace(text, MARK, r"\\$1")


def unescape(text: Column) -> Column:
    """The inverse of `escape`."""
    return F.regexp_replace(text, r"\\" + MARK, "$1")


def escape_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("<", "\\l")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_role(role: Column) -> Column:
    """Reads the two-character forms from the left; an even run of backslashes ends before them."""
    out = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\l", "$1<")
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def streamed(rows: DataFrame, conv_id: str, turn: str) -> DataFrame:
    """The log that a service would have kept of finished turns (role, text).

    Every row is a message of its own; rows of one turn follow each other by role, then
    text.  A message is opened empty and gets a draft; an edit (or a regeneration, if it
    is the assistant's) replaces that by the text's first `CHUNK` code points, and the
    rest streams in as deltas.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy(conv_id, turn).orderBy(role, text)
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("__text", text)
    step = lambda k, kind, said: F.struct(F.lit(k).alias("step") if isinstance(k, int) else k.alias("step"), kind.alias("kind"), said.alias("text"))
    replaced = F.when(role == ASSISTANT, "regenerate").otherwise("edit")
    # one pass over a text, as each substring would begin at its first code point
    pieces = F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    rows = rows.withColumn("__pieces", F.when(F.length("__text") > 0, pieces).otherwise(F.array(F.lit(""))))
    first = F.array(step(0, F.lit("message"), F.lit("")), step(1, F.lit("delta"), F.lit("a draft </s>")))
    rest = F.transform("__pieces", lambda said, k: step(k + 2, F.when(k > 0, F.lit("delta")).otherwise(replaced), said))
    rows = rows.withColumn("__log", F.concat(first, rest))
    log = rows.select(conv_id, turn, "place", role.alias("role"), F.explode("__log").alias("e"))
    msg = [F.col(turn).alias("turn"), F.col("place")]
    return log.select(F.col(conv_id).alias("conv_id"), F.struct(*msg, F.col("e.step").alias("step")).alias("seq"), F.col("e.kind").alias("kind"), F.struct(*msg).alias("msg"), "role", F.col("e.text").alias("text"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the final messages of a log."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    rows = events.where(F.col("kind").isin(*KINDS)).select(
        "conv_id", "msg", "kind", "seq", F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")).alias("e")
    )
    folded = rows.groupBy("conv_id", "msg").agg(
        F.sort_array(F.collect_list("e")).alias("pieces"),
        F.max(F.when(F.col("kind") != "delta", F.col("e"))).alias("reset"),
        F.max(F.when(F.col("kind") == "message", F.col("seq"))).alias("opened"),
        F.min("seq").alias("first"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
    )
    kept = F.filter("pieces", lambda p: F.col("reset").isNull() | (p >= F.col("reset")))
    opening = F.filter("pieces", lambda p: p["rank"] == 1)
    folded = folded.select(
        "conv_id",
        "msg",
        F.coalesce(F.get(opening, F.lit(0))["role"], F.get("pieces", F.lit(0))["role"]).alias("role"),
        F.array_join(F.transform(kept, lambda p: p["text"]), "").alias("text"),
        F.coalesce("opened", "first").alias("opened"),
        "redone",
    )
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    cut = folded.withColumn("cut", F.max("redone").over(before))
    return cut.where("cut is null or opened is null or opened > cut").select("conv_id", "msg", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss): one row per conversation.

    A span of `loss` has the turn (from 0), its place in the turn (`at`) and in
    the whole (`start`), and its length, in code points from 0.
    """
    turns = messages.select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(END))
    by = Window.partitionBy("conv_id").orderBy("msg")
    turns = turns.select(
        "conv_id",
        F.row_number().over(by).alias("turn"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(
            F.col("role") == ASSISTANT,
            F.struct((F.row_number().over(by) - 1).alias("turn"), F.length("head").alias("at"), (F.sum(F.col("size").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.length("head")).alias("start"), F.length("body").alias("length")),
        ).alias("span"),
    )
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.sort_array(F.collect_list("span")).alias("loss"))
    return whole.select("conv_id", "n_turns", F.array_join("pieces.piece", "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, recovered from `formatted` and `loss`."""
    parts = F.split("formatted", END)
    raw = formatted.withColumn("parts", F.slice(parts, F.lit(1), F.size(parts) - 1))

    def turn(p: Column) -> Column:
        line = F.instr(p, "\n")
        return F.struct(unescape_role(F.substring(p, F.lit(len(OPEN) + 1), line - len(OPEN) - 1)).alias("role"), unescape(F.substring(p, line + 1, F.length(p))).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substring(F.get(F.col("parts"), s["turn"]), s["at"] + 1, s["length"])))
    return raw.withColumn("turns", F.transform("parts", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("parts")
