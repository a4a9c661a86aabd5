"""Chat formatting from a declarative template.

A finite-state machine over roles checks the turn order; every turn becomes
three text segments -- opening mark, text, closing mark -- each with a loss
flag.  Marks inside texts are escaped: a backslash is doubled, and a backslash
is put after the first character of every control string, so no control string
of the template survives in a text; :func:`unescape` takes a backslash away
from the character behind it.  :func:`read_back` parses the written segments.

A conversation is one output row, so its turns meet in one row; conversations
are the unit of work.  Only DataFrame functions run.

Defined results: turns are ordered by turn, role, text with nulls first;
repeated rows are turns of their own; a null text is empty; a null role is
marked as nameless and read back as the empty role; other roles than the
template's are written by name and carry no loss; rows with a null ``conv_id``
are one conversation; an invalid order is reported in ``valid`` and
``end_state`` and formatted all the same; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, loss flags and turn order of a chat format."""

    #: role -> (tag, loss)
    roles: dict[str, tuple[str, bool]] = field(default_factory=lambda: {
        "system": ("SYS", False), "user": ("INST", False), "assistant": ("OUT", True)})
    begin: str = "<s>"
    end: str = "</s>"
    #: state -> {role: next state}
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accepted: tuple[str, ...] = ("answered",)

    @property
    def tags(self) -> list[str]:
        return [t for t, _ in self.roles.values()] + ["ANON", "ROLE", "TEXT"]

    @property
    def controls(self) -> list[str]:
        return [self.begin, self.end] + [f"[{x}{t}]" for t in self.tags for x in ("", "/")]


def escape(text: Column, template: Template) -> Column:
    marks = "|".join(re.escape(c) for c in sorted(template.controls, key=len, reverse=True))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?s)(?=(?:{marks}))(.)", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, valid, end_state, segments) of rows (conv_id, turn, role, text);
    segments are (text, loss) and make up the formatted conversation in order."""
    def turn_segments(x):
        body = escape(F.coalesce(x["text"], F.lit("")), template)
        segment = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
        mark = lambda s: F.lit(s)
        other = F.array(
            segment(F.concat(mark(f"{template.begin}[ROLE] "), escape(x["role"], template), mark(" [/ROLE][TEXT] ")), False),
            segment(body, False), segment(mark(f" [/TEXT]{template.end}\n"), False))
        out = F.when(x["role"].isNull(), F.array(segment(mark(f"{template.begin}[ANON] "), False), segment(body, False),
                                                segment(mark(f" [/ANON]{template.end}\n"), False)))
        for role, (tag, loss) in template.roles.items():
            out = out.when(x["role"] == role, F.array(
                segment(mark(f"{template.begin}[{tag}] "), False), segment(body, loss),
                segment(mark(f" [/{tag}]{template.end}\n"), False)))
        return out.otherwise(other)

    steps = F.create_map(*[F.lit(v) for s, by in template.order.items() for r, t in by.items() for v in (f"{s}>{r}", t)])
    state = F.aggregate(F.col("t"), F.lit("start"), lambda s, x: F.coalesce(
        F.try_element_at(steps, F.concat(s, F.lit(">"), F.coalesce(x["role"], F.lit("")))), F.lit("broken")))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return grouped.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), state.isin(*template.accepted).alias("valid"),
        state.alias("end_state"), F.flatten(F.transform("t", turn_segments)).alias("segments"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): the roles and texts parsed from
    the formatted string, and the unescaped text under the loss mask."""
    tags = "|".join([t for t, _ in template.roles.values()] + ["ANON", "ROLE"])
    turn = (f"(?s){re.escape(template.begin)}\\[({tags})\\] (.*?) \\[/\\1\\](?:\\[TEXT\\] (.*?) \\[/TEXT\\])?"
            f"{re.escape(template.end)}\n")
    names = F.create_map(*[F.lit(v) for r, (t, _) in template.roles.items() for v in (t, r)], F.lit("ANON"), F.lit(""))
    group = lambda k: F.regexp_extract_all("formatted", F.lit(turn), F.lit(k))
    parsed = F.transform(F.arrays_zip(group(1).alias("tag"), group(2).alias("a"), group(3).alias("b")), lambda x: F.struct(
        F.when(x["tag"] == "ROLE", unescape(x["a"])).otherwise(F.try_element_at(names, x["tag"])).alias("role"),
        unescape(F.when(x["tag"] == "ROLE", x["b"]).otherwise(x["a"])).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
    whole = F.array_join(F.transform("segments", lambda x: x["text"]), "")
    return (formatted.withColumn("formatted", whole)
            .select("conv_id", "valid", "end_state", "formatted", parsed.alias("turns"), loss.alias("loss_text")))


def digest(parsed: DataFrame) -> DataFrame:
    """One row per conversation with lengths and hashes of what was read back."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "end_state")
