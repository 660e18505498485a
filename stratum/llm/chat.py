"""Chat formatting by a finite-state machine and a declarative template.

A template gives, by role, the control strings around a turn and whether the
turn's text counts for the loss. The turns of a conversation become segments of
text with a loss flag each; their concatenation is the formatted conversation.
Inside texts the characters that control strings start with are written as
entities, so no text can hold a control string, and ``unescape`` restores the
text exactly. The machine walks over the roles in order and tells whether the
conversation keeps to the turn order; its verdict is a column, no conversation
is left out.

Only DataFrame functions run. Null texts and roles count as empty; a role
outside the template is written with the template's default turn and makes the
verdict false. Turns are ordered by turn, null first, ties by role and text;
repeated rows are turns of their own. Null conv_id is a conversation of its own.
An empty table gives an empty table; only the four columns are read.
A formatted conversation is one value and has to fit a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``moves`` maps state and role to the next state; ``ends`` are the states a conversation may end in."""

    begin: str = "<s>"
    end: str = "</s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("[OUT]", "[/OUT]", True)})
    other: Turn = Turn("[TURN {role}]", "[/TURN]")
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "asked", ("start", "user"): "user", ("asked", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    ends: tuple[str, ...] = ("assistant",)


#: Written for the characters that control strings start or end with, the entity sign first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))


def escape(text: Column) -> Column:
    for raw, written in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for raw, written in reversed(ENTITIES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def segments(turns: Column, template: Template) -> Column:
    """Array of (text, loss) of an array of (role, text)."""

    def of(x: Column) -> Column:
        role = x["role"]

        def pick(f):
            out = F.concat(F.lit(f(template.other).partition("{role}")[0]), escape(role), F.lit(f(template.other).partition("{role}")[2])) if "{role}" in f(template.other) else F.lit(f(template.other))
            for name, turn in template.turns.items():
                out = F.when(role == name, F.lit(f(turn))).otherwise(out)
            return out

        loss = F.lit(template.other.loss)
        for name, turn in template.turns.items():
            loss = F.when(role == name, F.lit(turn.loss)).otherwise(loss)
        part = lambda text, counts: F.struct(text.alias("text"), counts.alias("loss"))
        return F.array(part(pick(lambda t: t.open), F.lit(False)), part(escape(x["text"]), loss), part(pick(lambda t: t.close), F.lit(False)))

    edge = lambda s: F.array(F.struct(F.lit(s).alias("text"), F.lit(False).alias("loss")))
    return F.concat(edge(template.begin), F.flatten(F.transform(turns, of)), edge(template.end))


def verdict(turns: Column, template: Template) -> Column:
    """Whether the machine accepts the order of the roles."""
    table = F.create_map(*(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)))
    state = F.aggregate(turns, F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("\n"), x["role"])), F.lit("wrong")))
    return state.isin(*template.ends)


def format_chat(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation: conv_id, valid, segments (text, loss), formatted."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", empty("role").alias("role"), empty("text").alias("text")).alias("x"))
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    return one.select("conv_id", verdict(F.col("turns"), template).alias("valid"), segments(F.col("turns"), template).alias("segments")).withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from what was written: turns (role, text) parsed out of the formatted text, and the text under the loss mask."""
    inner = F.expr(f"substring(formatted, {len(template.begin) + 1}, length(formatted) - {len(template.begin) + len(template.end)})")
    # every '[' is one of a control string, as texts have none; an opening one starts a turn
    pieces = F.filter(F.split(inner, r"(?=\[(?!/))", -1), lambda p: p != "")

    def parse(p: Column) -> Column:
        head = F.substring_index(p, "]", 1)
        body = F.element_at(F.split(F.substr(p, F.length(head) + 2), r"\[/", -1), 1)
        role = unescape(F.substr(head, F.lit(len(template.other.open.partition("{role}")[0]) + 1)))
        for name, turn in template.turns.items():
            role = F.when(head == turn.open.rstrip("]"), F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))
    return formatted.select("conv_id", "valid", F.transform(pieces, parse).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def report(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what ``read_back`` finds in the formatted conversations."""
    back = read_back(format_chat(conversations, template), template)
    listed = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "valid")
