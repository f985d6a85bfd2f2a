"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is an opening mark, a space, its text, a space, a closing mark and a line
break. A deterministic parser reads the rendered turn back; if it does not
recover the role and text of the source, the text is rendered again with its
control characters escaped. Texts without conflicts stay as they are.

    user         [INST] text [/INST]
    assistant    <s> text </s>
    system       <<SYS>> text <</SYS>>
    other role   <<ROLE name>> text <</ROLE>>

A text with a mark in it does not read back, since a turn ends at the first mark
of any kind. The escape puts a backslash before each backslash, ``<`` and ``[`` of a text, so
no mark can occur in it; the parser undoes exactly these pairs.

Rows: a null text is an empty one; a null role is the empty role; rows with a
null conversation form one conversation; turns that tie are ordered by role and
text, null turns come first, and repeated rows are turns each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing marks of the roles with marks of their own.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<<ROLE ", ">>", "<</ROLE>>")
_NAME = r"[^<>\\\[]*+(?:\\.[^<>\\\[]*+)*+"
#: A turn up to the first mark of any kind that no backslash stands before.
TURN = (
    rf"(?s)\G(\[INST\]|<s>|<<SYS>>|<<ROLE {_NAME}>>) (.*?) ?(?<!\\)"
    r"(\[/?INST\]|</?s>|<</?SYS>>|<</ROLE>>|<<ROLE )\n?"
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<\[>])", "$1")


def _open(role: Column) -> Column:
    other = F.concat(F.lit(OTHER[0]), F.regexp_replace(role, r"([\\<\[>])", r"\\$1"), F.lit(OTHER[1]))
    marks = F.when(F.lit(False), "")
    for name, (first, _) in MARKS.items():
        marks = marks.when(role == name, first)
    return marks.otherwise(other)


def _close(role: Column) -> Column:
    marks = F.when(F.lit(False), "")
    for name, (_, last) in MARKS.items():
        marks = marks.when(role == name, last)
    return marks.otherwise(OTHER[2])


def _render(role: Column, text: Column) -> Column:
    return F.concat(_open(role), F.lit(" "), text, F.lit(" "), _close(role), F.lit("\n"))


def parse_turns(formatted: Column) -> Column:
    """Turns of a formatted text: ``array<struct<role, text, body>>``; ``body`` is the text as it stands there."""

    def turn(mark: Column, body: Column) -> Column:
        role = F.when(F.lit(False), "")
        for name, (first, _) in MARKS.items():
            role = role.when(mark == first, name)
        inner = F.substr(mark, F.lit(len(OTHER[0]) + 1), F.length(mark) - len(OTHER[0]) - len(OTHER[1]))
        return F.struct(role.otherwise(unescape(inner)).alias("role"), unescape(body).alias("text"), body.alias("body"))

    marks = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.transform(F.arrays_zip(marks.alias("mark"), bodies.alias("body")), lambda x: turn(x["mark"], x["body"]))


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``(<conv>, formatted, loss)``.

    ``loss`` has the character spans ``(start, length)`` of the assistants' texts,
    as they stand in ``formatted``. The conversation is parsed once more as a whole; one that
    does not give its turns back stops the job.
    """
    turns = rows.select(
        F.col(conv).alias("_conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    plain = _render(F.col("role"), F.col("text"))
    safe = _render(F.col("role"), escape(F.col("text")))
    turns = turns.withColumn("plain", plain)
    back = parse_turns(F.col("plain"))
    same = (F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))
    whole = F.length("plain") == F.length(back[0]["body"]) + F.length(_render(F.col("role"), F.lit("")))
    turns = turns.withColumn("piece", F.when(F.coalesce(same & whole, F.lit(False)), F.col("plain")).otherwise(safe))
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "piece")))
    conversations = turns.groupBy("_conv").agg(said.alias("said"))
    conversations = conversations.withColumn("formatted", F.array_join(F.col("said.piece"), ""))
    conversations = conversations.withColumn("read", parse_turns(F.col("formatted")))
    expected = F.transform("said", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    found = F.transform("read", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    sure = F.when(expected == found, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back")))
    return conversations.select(F.col("_conv").alias(conv), sure.alias("formatted"), loss_spans(F.col("read")).alias("loss"))


def loss_spans(read: Column) -> Column:
    """Spans of the assistants' bodies in the text that ``read`` was parsed from."""
    outer = lambda x: F.length(_render(x["role"], x["body"]))
    empty = F.array().cast("array<struct<start:int,length:int>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(done: Column, x: Column) -> Column:
        span = F.struct(
            (done["at"] + F.length(_open(x["role"])) + 1).alias("start"), F.length(x["body"]).alias("length")
        )
        spans = F.when(x["role"] == "assistant", F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((done["at"] + outer(x)).alias("at"), spans.alias("spans"))

    return F.aggregate(read, state, step, lambda done: done["spans"])


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped, the spans joined with nothing between."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substr(formatted, x["start"] + 1, x["length"]))), "")
