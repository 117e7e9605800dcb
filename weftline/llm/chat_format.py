"""Chat formatting by a finite-state machine over roles.

A template names, for each role, the strings before and after its text and whether the text bears loss, and for each state
(the role seen last, '' at the start) the roles that may follow. A conversation becomes segments of text with a loss flag;
their texts end to end are the formatted conversation. Control strings inside texts and roles are escaped, and reading back
undoes it: '&' becomes '&amp;', '<|' becomes '&lt;|', and a line break in a role '&#10;'.

DataFrame functions only. Null roles and texts count as empty. Turns of one number are ordered by role, then text, and repeated
rows are turns each. Nothing says that rows without a conv_id belong together: each is a conversation of one turn, with a null
id. An empty table gives an empty result. A turn that the machine doesn't accept is still written (nothing is
lost); ``valid`` is false and ``bad_turn`` says where the first one stands. A conversation of any length is one row, as its formatted text is. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open is followed by the role and by head; close ends a turn."""

    open: str = "<|im_start|>"
    head: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follow: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("user", "assistant")


CHAT = Template()


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def accepts(template: Template, state: Column, role: Column) -> Column:
    """May role follow state?"""
    pairs = [f"{a}>{b}" for a, bs in template.follow.items() for b in bs]
    return F.concat(state, F.lit(">"), role).isin(pairs)


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid, bad_turn (index from 0, null if valid), segments, formatted.

    turns: conv_id, turn, role, text. segments: array<struct<text, loss>>, in order; formatted: their texts end to end.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    chats = rows.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    before = F.concat(F.array(F.lit("")), F.slice(roles, 1, F.greatest(F.size(roles) - 1, F.lit(0))))
    wrong = F.transform(F.arrays_zip(before.alias("a"), roles.alias("b")), lambda p: ~accepts(template, p["a"], p["b"]))
    place = F.array_position(wrong, True)
    ended = F.element_at(roles, -1).isin(list(template.final))
    bad = F.when(place > 0, place - 1).when(~ended, F.size(roles) - 1).cast("long")

    def parts(t: Column) -> Column:
        def part(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(part(F.concat(F.lit(template.open), escape_role(t["role"]), F.lit(template.head)), F.lit(False)), part(escape(t["text"]), t["role"].isin(list(template.loss_roles))), part(F.lit(template.close), F.lit(False)))

    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), bad.isNull().alias("valid"), bad.alias("bad_turn"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(formatted, "\\Q" + template.open + "\\E", -1)
    close, head = len(template.close), len(template.head)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(1), F.length(piece) - close)
        at = F.locate(template.head, body)
        return F.struct(unescape(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + head, F.length(body))).alias("text"))

    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(chats: DataFrame, template: Template = CHAT) -> DataFrame:
    """What is read back from formatted conversations."""
    turns = F.transform(read_turns(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = chats.select("conv_id", "valid", "bad_turn", turns.alias("turns"), read_loss(F.col("segments")).alias("loss"), "formatted")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")
