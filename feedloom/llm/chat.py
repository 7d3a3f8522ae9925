r"""Chat formatting in Spark expressions: sorted turn structs, merged same-role turns, reversible control strings.

A formatted conversation is a sequence of blocks::

    <turn>
    ### role: text</turn>

Adjacent turns of a role share a block; their texts are parted by ``<next>``. Inside roles and texts
a backslash becomes ``\s``, the first character of a control string (``<turn>``, ``</turn>``,
``<next>``, ``###``) becomes ``\l`` or ``\h``, and a role's colon ``\c``, so control strings appear
only where the template puts them and reading back undoes exactly that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT, ROLE_END = "<turn>\n### ", "</turn>\n", "<next>", ": "


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    out = F.regexp_replace(out, "<(?=/?turn>|next>)", r"\\l")
    return F.regexp_replace(out, "#(?=##)", r"\\h")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    """Undoes both: every backslash starts one of the four pairs, that of the backslash is read last."""
    for pair, char in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\s", "\\")):
        text = F.replace(text, F.lit(pair), F.lit(char))
    return text


def turn_structs(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id`` and ``turns``, sorted by turn, then role, then text.

    Null role and text count as empty; a null turn comes first; repeated rows are turns of their own.
    A conversation is one row of the result, as its text is one value.
    """
    each = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return conversations.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(each)).alias("turns"))


def blocks(turns: Column) -> Column:
    """Adjacent turns of a role as one block: ``array<struct<role, texts>>``.

    Block starts are found first and every block is one slice, so the work is linear in the turns
    for each block and no list is copied turn by turn.
    """
    starts = F.filter(
        F.sequence(F.lit(1), F.size(turns)),
        lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(turns) + 1))
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.transform(spans, lambda s: F.struct(
        F.element_at(turns, s["a"])["role"].alias("role"),
        F.transform(F.slice(turns, s["a"], s["b"] - s["a"]), lambda t: t["text"]).alias("texts"),
    ))


def render(parts: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(parts, lambda b: F.concat(
        F.lit(OPEN), escape_role(b["role"]), F.lit(ROLE_END),
        F.array_join(F.transform(b["texts"], escape), NEXT), F.lit(CLOSE),
    )), "")


def format_chats(conversations: DataFrame, **columns: str) -> DataFrame:
    """``conv_id, formatted`` for every conversation of a table of turns; see :func:`turn_structs`."""
    grouped = turn_structs(conversations, **columns)
    merged = grouped.select("conv_id", blocks(F.col("turns")).alias("blocks"))
    return merged.select("conv_id", render(F.col("blocks")).alias("formatted"))


def _bodies(formatted: Column) -> Column:
    """The blocks without their closing mark."""
    return F.filter(F.split(formatted, CLOSE), lambda b: b != "")


def _raws(block: Column) -> Column:
    """The texts of a block as they stand in the output."""
    return F.split(F.substring(block, F.instr(block, ROLE_END) + len(ROLE_END), F.length(block)), NEXT)


def read_back(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of all turns, unescaped."""
    def turns(block):
        role = F.substring(block, F.lit(len(OPEN) + 1), F.instr(block, ROLE_END) - 1 - len(OPEN))
        return F.transform(_raws(block), lambda r: F.struct(unescape(role).alias("role"), unescape(r).alias("text")))

    return F.flatten(F.transform(_bodies(formatted), turns))


def _starts(sizes: Column, first: Column, gap: int) -> Column:
    """Start places of pieces of the given sizes, ``gap`` apart."""
    return F.aggregate(sizes, F.array(first.cast("int")), lambda acc, n: F.concat(acc, F.array((F.element_at(acc, -1) + n + gap).cast("int"))))


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """Where the texts of ``role`` stand in the output: ``array<struct<start, end>>``, code points, end exclusive."""
    head = f"{OPEN}{role}{ROLE_END}"
    bodies = _bodies(formatted)
    placed = F.arrays_zip(bodies.alias("b"), F.slice(_starts(F.transform(bodies, F.length), F.lit(0), len(CLOSE)), 1, F.size(bodies)).alias("s"))

    def spans(block):
        sizes = F.transform(_raws(block["b"]), F.length)
        starts = F.slice(_starts(sizes, block["s"] + len(head), len(NEXT)), 1, F.size(sizes))
        return F.transform(F.arrays_zip(starts.alias("s"), sizes.alias("n")), lambda x: F.struct(x["s"].alias("start"), (x["s"] + x["n"]).alias("end")))

    return F.flatten(F.transform(F.filter(placed, lambda p: p["b"].startswith(head)), spans))
