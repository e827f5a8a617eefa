"""Chat formatting: a finite-state machine over roles and text segments with loss flags, from a declarative template.

Everything is a Spark column expression. The rows of a conversation are put in order of turn (ties by role, then text),
the machine folds the roles into a final state, and each turn gives three segments: header, text and end. A segment
is trained on if its loss flag is set; the template says which roles' texts are. Control strings inside texts and roles are
escaped: ``%`` becomes ``%25``, then ``<|`` becomes ``%3C|`` (in roles also a line feed ``%0A``), so the markers of the template
never occur inside them and ``read_turns`` restores each turn from the formatted string.

Null text is empty, null role is the empty role (no transition leads there: invalid), null turn sorts first, null
conv_id is a conversation of its own. Invalid conversations are formatted too and marked. Extra columns are
ignored. A conversation becomes one row, as its output is one string.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers, trained roles and the machine: (state, role) -> state; a conversation may end in ``final`` states."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    after_role: str = "\n"
    trained: tuple[str, ...] = ("assistant",)
    initial: str = "start"
    final: tuple[str, ...] = ("answered",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "asked",
            ("system", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
            ("answered", "tool"): "asked",
        }
    )


CHATML = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))


def final_state(roles: Column, template: Template = CHATML) -> Column:
    """The machine's state after all roles; ``invalid`` once no transition fits."""
    table = F.create_map(*(F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\0{role}", to)))
    return F.aggregate(
        roles,
        F.lit(template.initial),
        lambda state, role: F.coalesce(F.element_at(table, F.concat(state, F.lit("\0"), role)), F.lit("invalid")),
    )


def segments(turns: Column, template: Template = CHATML) -> Column:
    """``array<struct<text, loss>>`` of ``array<struct<turn, role, text>>``."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.start), escape_role(t.role), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t.text).alias("text"), t.role.isin(*template.trained).alias("loss")),
                F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """``conv_id, valid, state, segments, formatted``: a row per conversation of ``conv_id, turn, role, text`` rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select("conv_id", F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    state = final_state(F.transform("turns", lambda t: t.role), template)
    return (
        grouped.withColumn("state", state)
        .withColumn("valid", F.col("state").isin(*template.final))
        .withColumn("segments", segments(F.col("turns"), template))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))
        .select("conv_id", "valid", "state", "segments", "formatted")
    )


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """``array<struct<role, text>>`` read back from a formatted string."""
    pieces = F.split(formatted, F.lit("\\Q" + template.end + "\\E"))
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(template.start) + 1), F.length(piece))
        at = F.instr(body, template.after_role)
        role = F.substring(body, F.lit(1), at - 1)
        rest = F.substring(body, at + len(template.after_role), F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(rest).alias("text"))

    return F.transform(whole, turn)


def loss_text(segs: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segs, lambda s: s.loss), lambda s: unescape(s.text)), "")
