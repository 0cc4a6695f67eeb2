"""Operator 8: chat formatting from a declarative template.

A template names the marks around a turn, the roles that are trained on, the control strings, and the
moves of a finite-state machine over roles. A turn becomes three segments: header, body, footer; only
the bodies of trained roles carry the loss flag. Control strings inside roles and texts are broken by
a backslash after their first character, backslashes are doubled, so the output can be read back.

The machine's state is the last role, so validation is a lag over a conversation's turns; Spark sorts
them and spills, however long a conversation is. Only callers that want a whole conversation as one
string (a contract of the query, not of this operator) gather it into one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks, trained roles, control strings, and which role may follow which ("" is the start)."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    # control strings of public chat formats
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def escape(c: Column, t: Template = DEFAULT) -> Column:
    c = F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for x in t.controls:
        c = F.replace(c, F.lit(x), F.lit(x[0] + ESCAPE + x[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_turns(rows: DataFrame, t: Template = DEFAULT, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, valid, segments) for every row; segments: array of (text, loss).

    Turns are ordered by turn, then role and text; nulls come first. Null roles and texts are empty;
    a null conv_id is a conversation of its own. `valid` says whether the machine allows this role
    after the one before and, on the last turn, whether a conversation may end there. Invalid turns
    are formatted all the same. Repeated rows are turns of their own. Other columns are not carried.
    """
    r = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    moves = F.array(*[F.lit(f"{a}\n{b}") for a, to in t.moves.items() for b in to])
    before = F.coalesce(F.lag("role").over(order), F.lit(""))
    follows = F.array_contains(moves, F.concat_ws("\n", before, F.col("role")))
    ends = F.lead("role").over(order).isNotNull() | F.col("role").isin(*t.last)
    part = lambda c, loss: F.struct(c.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))
    segments = F.array(part(F.concat(F.lit(t.start), escape(F.col("role"), t), F.lit(t.sep)), False), part(escape(F.col("text"), t), F.col("role").isin(*t.trained)), part(F.lit(t.end), False))
    return r.select("conv_id", (F.row_number().over(order) - 1).alias("position"), (follows & ends).alias("valid"), segments.alias("segments"))


def join_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, valid, segments): one row for each conversation, all its segments in order."""
    one = F.array_sort(F.collect_list(F.struct("position", "segments")))
    return turns.groupBy("conv_id").agg(F.min("valid").alias("valid"), F.flatten(F.transform(one, lambda x: x["segments"])).alias("segments"))


def formatted(segments: str | Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: str | Column) -> Column:
    """All text under the loss mask, read back."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(text: Column, t: Template = DEFAULT) -> Column:
    """array of (role, text) parsed from a formatted conversation."""
    turns = F.split(text, re.escape(t.end), -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    halves = F.transform(turns, lambda x: F.split(F.substr(x, F.lit(len(t.start) + 1)), re.escape(t.sep), -1))
    return F.transform(halves, lambda h: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(F.get(h, F.lit(1))).alias("text")))
