"""Chat formatting by event-sourced reconstruction, natively: a log of events is folded into messages, then rendered.

Events of a conversation are ordered by their sequence number: ``message`` opens a message with its text, ``delta`` adds
text to the message of its id, ``edit`` replaces the text so far, ``regenerate`` drops it (its own text, if any, begins the
new one). Ties in the sequence go by kind of event, role and text; a repeated ``message`` row is a message of its own, and
events for an id that no message has opened make a message too. A message stands where its first event does.

Template: ``<|im_start|>role\\n text <|im_end|>\\n``. Inside texts and roles every ``<|`` gets a backslash between its two
characters, one more if there are some, so no text holds a control string and taking one away restores it; a line break in a
role is ``<|nl|>``. The result has segments (text, loss) whose texts make the formatted string; the loss mask covers exactly
the texts of assistant messages.

Null text and null role are empty. Null conversation ids are one conversation. An empty log gives an empty table. Other
columns are ignored. A conversation is one row of the result, so it must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
KINDS = ("message", "regenerate", "edit", "delta")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, position, message_id, part, role, text) from events (conv_id, seq, event, message_id, role, text)."""
    rank = F.lit(len(KINDS))
    for i, kind in enumerate(KINDS):
        rank = F.when(F.col("event") == kind, i).otherwise(rank)
    rows = log.select("conv_id", "seq", "event", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), rank.alias("rank"))
    own = Window.partitionBy("conv_id", "message_id").orderBy("seq", "rank", "role", "text")
    rows = rows.withColumn("number", F.row_number().over(own)).withColumn("part", F.count(F.when(F.col("event") == "message", 1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("conv_id", "message_id", "part")
    rows = rows.withColumn("fresh", F.max(F.when(F.col("event") != "delta", F.col("number"))).over(whole))
    kept = F.when(F.coalesce(F.col("number") >= F.col("fresh"), F.lit(True)), F.struct("number", "text"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), "")
    return rows.groupBy("conv_id", "message_id", "part").agg(F.min("seq").alias("position"), F.min_by("role", "number").alias("role"), told.alias("text"))


def render(log: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>) of each conversation."""
    turns = F.array_sort(F.collect_list(F.struct("position", "message_id", "part", "role", "text")))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = lambda m: F.array(piece(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")), F.lit(False)), piece(escape(m["text"]), m["role"] == "assistant"), piece(F.lit(END), F.lit(False)))
    made = messages(log).groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"))
    return made.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted) parsed from the rendered strings and the mask."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(START) + 1))
    role = lambda x: F.substring_index(body(x), "\n", 1)
    turn = lambda x: F.struct(unescape_role(role(x)).alias("role"), unescape(F.substr(body(x), F.length(role(x)) + 2)).alias("text"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return rendered.select("conv_id", F.transform(blocks, turn).alias("turns"), loss.alias("loss_text"), "formatted")
