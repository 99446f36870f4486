"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template names a turn's opening, the break after the role, its closing, and which roles carry loss. Texts are
escaped, so that no text can spell a control string: the escape character is doubled, the first character
of every control string and the line break of a role become escape pairs. So a formatted
conversation is taken apart again exactly, whatever the texts say.

The machine's table maps (state, role) to the next state; a pair that is missing leads to ``invalid``,
which keeps the place of the first wrong turn. Conversations in a wrong order are formatted all the same and say so
in ``valid`` and ``first_error``; it is up to the caller to drop them.

Defined cases: null texts and roles are empty; rows of equal turn are ordered by role, then text; repeated
rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty result;
other columns are ignored. A conversation is one row, since its digest needs its text in one piece.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "begin"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "system",
            ("begin", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def __post_init__(self):
        # what ``escape`` takes out of texts and roles must be what control strings begin with
        if not (self.open.startswith("<") and self.close.startswith("<") and self.after_role == "\n"):
            raise ValueError("control strings must begin with '<' and a role must end in a line break")


CHATML = Template()


def escape(col: Column) -> Column:
    r"""``\`` to ``\\`` and ``<`` to ``\l``: no control string can begin inside a text."""
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(col: Column) -> Column:
    return F.replace(escape(col), F.lit("\n"), F.lit("\\n"))


def unescape(col: Column) -> Column:
    r"""Inverse of both: every ``\`` opens a pair, so pairs of two are cut out first, from the left."""
    part = lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(col, r"\\\\", -1), part), "\\")


def _literals(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def format_conversations(
    df: DataFrame,
    template: Template = CHATML,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """A row a conversation: id, n_turns, formatted, segments (text, loss), state, valid, first_error.

    The segments joined give ``formatted``; those with ``loss`` are the (escaped) texts to learn.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = df.select(F.col(id_col).alias("_id"), turn.alias("_t")).groupBy("_id").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))

    moves = _literals({f"{a}\x00{b}": c for (a, b), c in template.moves.items()})
    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, t: Column) -> Column:
        to = F.coalesce(F.element_at(moves, F.concat(acc["state"], F.lit("\0"), t["role"])), F.lit("invalid"))
        bad = F.coalesce(acc["bad"], F.when(to == "invalid", acc["n"]))
        return F.struct(to.alias("state"), (acc["n"] + 1).alias("n"), bad.alias("bad"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.open), escape_role(t["role"]), F.lit(template.after_role))
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(seg(head, F.lit(False)), seg(escape(t["text"]), t["role"].isin(*template.loss_roles)), seg(F.lit(template.close), F.lit(False)))

    ran = turns.select("_id", F.size("_turns").cast("long").alias("n_turns"), F.aggregate("_turns", first, step).alias("_end"), F.flatten(F.transform("_turns", segments)).alias("segments"))
    return ran.select(
        F.col("_id").alias(id_col),
        "n_turns",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("_end.state").alias("state"),
        (F.col("_end.bad").isNull() & F.col("_end.state").isin(*template.accept)).alias("valid"),
        F.col("_end.bad").alias("first_error"),
    )


def parse_formatted(col: Column, template: Template = CHATML) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.split(col, "(?s)" + _quoted(template.open), -1)

    def turn(p: Column) -> Column:
        cut = F.instr(p, F.lit(template.after_role))
        n = len(template.after_role)
        body = p.substr(cut + n, F.length(p) - cut - (n - 1) - len(template.close))
        return F.struct(unescape(p.substr(F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
