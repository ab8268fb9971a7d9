"""Chat formatting with DataFrame functions only: a finite-state machine over roles and a declarative template.

The template says, for each role, how a turn's head is spelled and whether its text carries loss. A conversation becomes
segments (head, text, end mark for each turn), each with its loss flag; the formatted text is their concatenation. Control
strings inside texts are escaped, so that the end mark and the head's `###` occur only where the template put them, and
`read_back` restores roles and texts from the formatted text alone.

The machine's table maps state|role to the next state. `valid` says whether the turns end in an accepting state without
a missing transition; `bad_turn` is the index (from 0) of the first turn without one, or null. Invalid conversations are
formatted all the same.

Edge cases: a null text is empty; a null role is written as the role of no letters; unknown roles get a general head and
no loss; turns with equal numbers go by role, then text; null turns come first; a null conv_id is a conversation of its
own; other columns are ignored. A row of the result is one conversation, so a conversation has to fit into one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    heads: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple = ("assistant",)
    mark: str = "###"
    end: str = "</turn>"
    moves: dict = field(
        default_factory=lambda: {
            "start|system": "told",
            "start|user": "asked",
            "told|user": "asked",
            "asked|assistant": "answered",
            "answered|user": "asked",
        }
    )
    accepting: tuple = ("answered",)


DEFAULT = ChatTemplate()


def escape(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    """Every backslash starts one of three pairs, none of which holds a second backslash, so unescape is exact."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit(template.mark), F.lit("\\h"))
    return F.replace(out, F.lit(template.end), F.lit("\\t"))


def unescape(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    out = F.replace(text, F.lit("\\t"), F.lit(template.end))
    out = F.replace(out, F.lit("\\h"), F.lit(template.mark))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _head(role: Column, template: ChatTemplate) -> Column:
    other = F.concat(F.lit("@"), F.replace(F.replace(escape(role, template), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n")))
    named = F.when(F.lit(False), F.lit(""))
    for name, shown in template.heads.items():
        named = named.when(role == name, F.lit(shown))
    return F.concat(F.lit(template.mark + " "), named.otherwise(other), F.lit(": "))


def format_chat(turns: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """One row for each conv_id: conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn."""
    row = F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def segments(t):
        bears = t["role"].isin(*template.loss)
        return F.array(
            F.struct(_head(t["role"], template).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), bears.alias("loss")),
            F.struct(F.lit(template.end + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    moves = F.create_map(*[F.lit(x) for pair in template.moves.items() for x in pair])

    def step(held, role):
        there = F.try_element_at(moves, F.concat(held["state"], F.lit("|"), role))
        lost = held["bad"].isNotNull() | there.isNull()
        return F.struct(
            F.when(lost, held["state"]).otherwise(there).alias("state"),
            F.when(lost, F.coalesce(held["bad"], held["at"])).alias("bad"),
            (held["at"] + 1).alias("at"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at"))
    out = rows.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate(F.transform("turns", lambda t: t["role"]), start, step).alias("end"),
    )
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("end.bad").isNull() & F.col("end.state").isin(*template.accepting)).alias("valid"),
        F.col("end.bad").alias("bad_turn"),
    )


def read_back(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """The turns that a formatted text holds: array<struct<role, text>>."""
    whole = F.split(formatted, _quoted(template.end + "\n"), -1)

    def turn(part):
        said = F.substring_index(part, ": ", 1)
        shown = F.substr(said, F.lit(len(template.mark) + 2))
        role = F.when(F.lit(False), F.lit(""))
        for name, head in template.heads.items():
            role = role.when(shown == head, F.lit(name))
        other = unescape(F.replace(F.replace(F.substr(shown, F.lit(2)), F.lit("\\n"), F.lit("\n")), F.lit("\\c"), F.lit(":")), template)
        return F.struct(role.otherwise(other).alias("role"), unescape(F.substr(part, F.length(said) + 3), template).alias("text"))

    return F.transform(F.slice(whole, 1, F.size(whole) - 1), turn)


def loss_text(segments: Column, template: ChatTemplate = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, in order."""
    held = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(held, lambda s: unescape(s["text"], template)), "")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
