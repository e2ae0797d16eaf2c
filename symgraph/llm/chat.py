"""Operator 7: chat formatting, DataFrame functions only.

A declarative template gives each role its marks and says whether its text carries loss. A finite-state machine over the
roles judges the order of turns. Control strings inside texts are broken up by a backslash after their first character
(and backslashes doubled), so no text can imitate a mark, and parse() reads the turns back from the formatted string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """Marks before and after a role's text, and whether the text carries loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles by name; `other` frames any other role, whose name stands between its first mark and `named`."""

    roles: tuple[tuple[str, Turn], ...]
    other: Turn
    named: str
    control: tuple[str, ...]
    #: Role states and where each may go; "" is the start. A role that isn't listed is "other".
    order: tuple[tuple[str, tuple[str, ...]], ...]
    last: tuple[str, ...]


#: Bracketed instructions, angled system and answer marks.
TEMPLATE = Template(
    roles=(("system", Turn("<<SYS>> ", " <</SYS>>")), ("user", Turn("[INST] ", " [/INST]")), ("assistant", Turn("<s> ", " </s>", True))),
    other=Turn("[ROLE] ", " [/ROLE]"),
    named=" [AS] ",
    control=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[AS]", "[/ROLE]"),
    order=(("", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",))),
    last=("assistant",),
)


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    """Doubles backslashes and puts one after the first character of every control string."""
    marks = "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in template.control)
    return F.regexp_replace(text, rf"(\\|{marks})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def segments(role: Column, text: Column, template: Template = TEMPLATE) -> Column:
    """The three segments of a turn: (text, loss) of its mark, its escaped text, its closing mark."""

    def of(before: Column, turn: Turn) -> Column:
        part = lambda x, loss: F.struct(x.alias("text"), F.lit(loss).alias("loss"))
        return F.array(part(before, False), part(escape(text, template), turn.loss), part(F.lit(turn.after), False))

    out = of(F.concat(F.lit(template.other.before), escape(role, template), F.lit(template.named)), template.other)
    for name, turn in reversed(template.roles):
        out = F.when(role == name, of(F.lit(turn.before), turn)).otherwise(out)
    return out


def valid_order(roles: Column, template: Template = TEMPLATE) -> Column:
    """True if the machine accepts the roles: every move is allowed and the last state may end. Without turns: false."""
    known = [name for name, _ in template.roles]
    allowed = [f"{a}\t{b}" for a, to in template.order for b in to]

    def move(state: Column, role: Column) -> Column:
        to = F.when(role.isin(known), role).otherwise(F.lit("other"))
        return F.when(F.concat(state, F.lit("\t"), to).isin(allowed), to).otherwise(F.lit("!"))

    return F.aggregate(roles, F.lit(""), move).isin(list(template.last))


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per conv_id: conv_id, segments (array of text, loss; concatenated they are the sample), formatted, valid.

    Turns stand in order of turn, ties by role and text; a null turn comes first, null roles and texts are empty.
    Repeated rows are repeated turns. A null conv_id is one conversation. An empty table gives no rows. Other columns,
    whatever their names, are ignored. A conversation is the unit of output and so is gathered in one row.
    """
    rows = conversations.select(F.col("conv_id").alias("id"), F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    # the text of a turn is formatted before the turns meet, so that work is spread by row
    rows = rows.select("id", F.struct("t.turn", "t.role", "t.text", segments(F.col("t.role"), F.col("t.text"), template).alias("parts")).alias("t"))
    chats = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    flat = F.flatten(F.transform("turns", lambda t: t["parts"]))
    return chats.select(
        F.col("id").alias("conv_id"),
        flat.alias("segments"),
        F.array_join(F.transform(flat, lambda s: s["text"]), "").alias("formatted"),
        valid_order(F.transform("turns", lambda t: t["role"]), template).alias("valid"),
    )


def parse(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) read back from a formatted string."""
    frames = [(re.escape(t.before), re.escape(t.after)) for _, t in template.roles] + [(re.escape(template.other.before), re.escape(template.other.after))]
    turns = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(f"{a}.*?{b}" for a, b in frames)), F.lit(0))

    def body(x: Column, before: str | Column, after: str) -> Column:
        start = F.length(before) if isinstance(before, Column) else F.lit(len(before))
        return unescape(F.substring(x, start + 1, F.length(x) - start - len(after)))

    def one(x: Column) -> Column:
        name = F.substring_index(F.substring(x, F.lit(len(template.other.before) + 1), F.length(x)), template.named, 1)
        head = F.concat(F.lit(template.other.before), name, F.lit(template.named))
        out = F.struct(unescape(name).alias("role"), body(x, head, template.other.after).alias("text"))
        for role, turn in template.roles:
            out = F.when(x.startswith(turn.before), F.struct(F.lit(role).alias("role"), body(x, turn.before, turn.after).alias("text"))).otherwise(out)
        return out

    return F.transform(turns, one)


def chat_digests(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What format_chats wrote, read back from it: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    rows = chats.select("conv_id", "formatted", "valid", parse(F.col("formatted"), template).alias("turns"), F.array_join(loss, "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def oracle_sql(conversations: str, template: Template = TEMPLATE) -> str:
    """chat_digests of format_chats in DuckDB's SQL, over a table expression with conv_id, turn, role and text. The formatted string isn't built: its length follows from what the template and the escapes add."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    added = lambda x: " + ".join(f"(length({x}) - length(replace({x}, {quoted(c)}, ''))) // {len(c)}" for c in ("\\", *template.control))
    marks = " ".join(f"WHEN {quoted(name)} THEN {len(t.before) + len(t.after)}" for name, t in template.roles)
    other = f"{len(template.other.before) + len(template.other.after) + len(template.named)} + length(role) + {added('role')}"
    loss = ", ".join(quoted(name) for name, t in template.roles if t.loss)
    return f"""WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM {conversations}),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said, COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role IN ({loss})), '') AS loss,
  CAST(sum(length(text) + {added('text')} + CASE role {marks} ELSE {other} END) AS BIGINT) AS formatted_chars, string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'o' END, '' ORDER BY turn NULLS FIRST, role, text) AS code FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, regexp_full_match(code, 's?(ua)+') AS valid FROM c"""
