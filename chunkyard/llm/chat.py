"""Chat formatting: a finite-state machine over roles and a declarative template, in SQL functions only.

A ``Template`` states how a turn is marked, which roles' text is learned, which strings are control
strings, and the machine's transitions.  Turns are first put together in blocks of neighbouring turn
numbers: each block gives its segments and the machine's end state for every start state, so that the
blocks of a long conversation are made in parallel; a conversation then joins its blocks in order and
composes their transitions.  Within a text, a backslash doubles and one goes inside every control
string, after its first character, so no control string stands in a text and reading back is exact.

Edge cases: null text is empty; a null role is the empty role; rows order by turn (null first), then
role, then text, and repeated rows stay; roles the machine does not know make the conversation
invalid but are formatted all the same (a role that is not a plain word is written in base64); a null
conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESC = "\\"


@dataclass(frozen=True)
class Template:
    """``open`` role newline text ``close`` newline, for each turn."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    #: Kept out of texts besides ``open`` and ``close``, as other templates' readers act on them.
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
    states: tuple[str, ...] = ("start", "system", "user", "assistant", "error")
    accepting: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
    )

    def __post_init__(self):
        for c in (self.open, self.close, *self.controls):
            if len(c) < 2 or ESC in c:
                raise ValueError(f"a control string has two characters or more and no backslash: {c!r}")


def _literal(text: str) -> str:
    """A Java pattern for the text itself."""
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def escaped(text: Column, template: Template) -> Column:
    by_first: dict[str, list[str]] = {}
    for c in (template.open, template.close, *template.controls):
        by_first.setdefault(c[0], []).append(_literal(c[1:]))
    places = "|".join(f"(?<={_literal(first)})(?={'|'.join(sorted(rest))})" for first, rest in sorted(by_first.items()))
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(ESC * 2)), places, "\\\\")


def unescaped(text: Column) -> Column:
    """A backslash and the one after it, if there is one, become the second alone."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _role_written(role: Column) -> Column:
    return F.when(role.rlike("^[A-Za-z0-9_]+$"), role).otherwise(F.concat(F.lit("="), F.regexp_replace(F.base64(F.encode(role, "UTF-8")), r"\s", "")))


def _role_read(role: Column) -> Column:
    return F.when(role.startswith("="), F.decode(F.unbase64(F.substr(role, F.lit(2))), "UTF-8")).otherwise(role)


def _moves(role: Column, template: Template) -> Column:
    """For each start state, in order, the state after a turn of this role."""
    number = {s: i for i, s in enumerate(template.states)}
    error = number["error"]
    out = F.array(*[F.lit(error)] * len(number))
    for r in sorted({r for _, r in template.moves}):
        row = [number[template.moves.get((s, r), "error")] for s in template.states]
        out = F.when(role == r, F.array(*map(F.lit, row))).otherwise(out)
    return out


def _composed(moves: Column, template: Template) -> Column:
    """One array of end states from an array of such arrays, applied in turn."""
    start = F.array(*[F.lit(i) for i in range(len(template.states))])
    return F.aggregate(moves, start, lambda acc, m: F.transform(acc, lambda s: F.element_at(m, s + 1)))


def format_conversations(turns: DataFrame, template: Template | None = None, block_turns: int = 64) -> DataFrame:
    """conv_id, n_turns, valid, end_state, segments (array of text and loss) for every conversation."""
    t = template or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.floor(F.col("turn") / block_turns).alias("block"))
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    segment = lambda what, loss: F.struct(what.alias("text"), loss.alias("loss"))
    parts = F.flatten(
        F.transform(
            "turns",
            lambda r: F.array(
                segment(F.concat(F.lit(t.open), _role_written(r["role"]), F.lit("\n")), F.lit(False)),
                segment(escaped(r["text"], t), r["role"].isin(*t.learned)),
                segment(F.lit(t.close + "\n"), F.lit(False)),
            ),
        )
    )
    moves = _composed(F.transform("turns", lambda r: _moves(r["role"], t)), t)
    made = blocks.select("conv_id", "block", F.size("turns").cast("long").alias("n"), parts.alias("parts"), moves.alias("moves"))
    whole = made.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct(F.coalesce("block", F.lit(-(1 << 62))).alias("block"), "moves", "parts")), _by_block).alias("blocks"))
    end = F.element_at(_composed(F.transform("blocks", lambda b: b["moves"]), t), 1)
    return whole.select(
        "conv_id",
        "n_turns",
        end.isin(*[i for i, s in enumerate(t.states) if s in t.accepting]).alias("valid"),
        F.element_at(F.array(*map(F.lit, t.states)), end + 1).alias("end_state"),
        F.flatten(F.transform("blocks", lambda b: b["parts"])).alias("segments"),
    )


def _by_block(a: Column, b: Column) -> Column:
    return F.when(a["block"] < b["block"], -1).when(a["block"] > b["block"], 1).otherwise(0)


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: Template | None = None) -> Column:
    """The turns of a formatted text: array of role and text."""
    t = template or Template()
    pieces = F.filter(F.split(text, _literal(t.close + "\n"), -1), lambda p: p != "")
    at = len(t.open) + 1
    return F.transform(
        pieces,
        lambda p: F.struct(
            _role_read(F.substr(F.substring_index(p, "\n", 1), F.lit(at))).alias("role"),
            unescaped(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"),
        ),
    )
