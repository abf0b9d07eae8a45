"""Chat formatting as a finite-state machine over roles, in DataFrame functions only.

A template is data: how a turn opens and closes, which roles are trained on,
which strings are control strings, and the machine's transitions.  Texts have
their control strings escaped reversibly, so that what a turn says can never be
read as markup.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``transitions``: (state, role) to the next state; a pair that is missing leads to "error" for
    good.  ``start`` is the first state and ``accepting`` are those in which a conversation may end."""

    open_turn: str = "<|turn|>"
    after_role: str = "\n"
    close_turn: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|turn|>", "<|end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\x10"
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


def _codes(t: Template) -> list[tuple[str, str]]:
    """The escape itself first; codes are one character each, so none is a prefix of another."""
    return [(t.escape, t.escape + "0"), *((c, t.escape + chr(ord("A") + i)) for i, c in enumerate(sorted(t.controls, key=len, reverse=True)))]


def escaped(text: Column, t: Template) -> Column:
    for raw, code in _codes(t):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column, t: Template) -> Column:
    for raw, code in reversed(_codes(t)):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def escaped_role(role: Column, t: Template) -> Column:
    """As a text, and the string that ends a role too."""
    return F.replace(escaped(role, t), F.lit(t.after_role), F.lit(t.escape + "z"))


def unescaped_role(role: Column, t: Template) -> Column:
    return unescaped(F.replace(role, F.lit(t.escape + "z"), F.lit(t.after_role)), t)


def formatted(df: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, n_turns, segments (array of text, loss: the formatted output in
    order, each with its loss flag), state (where the machine ends) and valid (that state accepts).

    Turns are in order of turn number (nulls first); turns that tie go by role, then text.  Null role
    or text counts as empty.  A null id is a conversation of its own.  A role that the machine does
    not know leads to "error"; such conversations are formatted all the same, and ``valid`` is false.
    An empty table gives no rows; other columns are not read.
    """
    t = template or Template()
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    turns = df.select(F.col(f"`{id_col}`").alias("id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = turns.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    trained = [F.lit(r) for r in t.loss_roles]

    def segments(x: Column) -> Column:
        is_trained = x["role"].isin(*trained) if trained else F.lit(False)
        head = F.concat(F.lit(t.open_turn), escaped_role(x["role"], t), F.lit(t.after_role))
        parts = ((head, F.lit(False)), (escaped(x["text"], t), is_trained), (F.lit(t.close_turn), F.lit(False)))
        return F.array(*[F.struct(s.alias("text"), flag.alias("loss")) for s, flag in parts])

    def step(state: Column, x: Column) -> Column:
        after = F.lit("error")
        for (at, role_), to in t.transitions.items():
            after = F.when((state == at) & (x["role"] == role_), F.lit(to)).otherwise(after)
        return after

    out = convs.select(
        "id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", F.lit(t.start), step).alias("state"),
    )
    return out.withColumn("valid", F.col("state").isin(*t.accepting))


def joined(segments: Column) -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parsed(text: Column, t: Template) -> Column:
    """Read a formatted text back: an array of role, text."""
    body = F.filter(F.split(text, _quoted(t.open_turn)), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, t.after_role, 1)
        rest = F.substr(x, F.length(role) + F.lit(len(t.after_role) + 1))
        said = F.substr(rest, F.lit(1), F.length(rest) - F.lit(len(t.close_turn)))
        return F.struct(unescaped_role(role, t).alias("role"), unescaped(said, t).alias("text"))

    return F.transform(body, turn)


def _quoted(x: str) -> str:
    return r"\Q" + x + r"\E"
