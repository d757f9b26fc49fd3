r"""Chat formatting: grammar round trip, in DataFrame functions only.

A turn is rendered as ``### role: text``, a line feed, ``</turn>`` and a line feed.
The rendered text is parsed back by the same grammar and compared with the source;
turns that come back different hold control strings, and those get one backslash
more before each ``###`` and ``</turn>``.  The parser takes one backslash from each
such run, so the second rendering always comes back identical (``exact``).

Null roles and texts count as empty.  Turns are ordered by turn (null first), then
role and text, so ties and repeated rows have one order.  One conversation is one
row of output, so its turns meet in one group; it must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(\\*)(###|</turn>)"
END = "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)(###|</turn>)", "$1$2")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\:<#\n])", r"\\$1")


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"(?s)\\(.)", "$1")


def render(turns: Column) -> Column:
    """The text of a conversation: an array of (role, body) structs."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": "), t["body"], F.lit(END))), ""
    )


def parse(text: Column) -> Column:
    """The (role, text) structs of a rendered conversation.

    The end mark stands at a line start only where a turn ends, as texts that hold it have a
    backslash there; the first colon after the header that has no backslash ends the role.
    """
    parts = F.split(text, END)
    header = r"(?s)^### ((?:[^\\:]|\\.)*+): "
    return F.transform(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda part: F.struct(
            unescape_role(F.regexp_extract(part, header, 1)).alias("role"),
            unescape(F.regexp_replace(part, header, "")).alias("text"),
        ),
    )


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id`` and ``turns``, (role, text) structs in order."""
    turn = F.struct(
        rows["turn"].alias("turn"),
        F.coalesce(rows["role"], F.lit("")).alias("role"),
        F.coalesce(rows["text"], F.lit("")).alias("text"),
    )
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return found.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def format_chats(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, the ``turns`` parsed back from it, and ``exact``."""
    found = conversations(rows).withColumnRenamed("turns", "source")
    plain = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("body")))
    first = found.withColumn("first", parse(render(plain)))
    # A turn whose text parses alone to something else gets the escapes.
    body = F.transform(
        "source",
        lambda t: F.struct(
            t["role"].alias("role"),
            F.when(alone(t) == F.array(t), t["text"]).otherwise(escape(t["text"])).alias("body"),
        ),
    )
    safe = F.when(F.col("first") == F.col("source"), render(plain)).otherwise(render(body))
    second = first.withColumn("formatted", safe).withColumn("turns", parse(F.col("formatted")))
    return second.select("conv_id", "formatted", "turns", (F.col("turns") == F.col("source")).alias("exact"))


def alone(turn: Column) -> Column:
    """What the parser makes of one turn rendered without escapes."""
    return parse(render(F.array(F.struct(turn["role"].alias("role"), turn["text"].alias("body")))))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: the assistant's texts, one after the other."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
