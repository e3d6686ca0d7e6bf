"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, the reply is the only trainable text.  Turns after the last reply have
no target; they are kept as the context of one example without a mask, so the
conversation can be read back whole.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|`` (a line break in a role
``<\\~``), so no control string can come from data and the step is reversible.

Edge cases: NULL role or text is the empty string; rows that tie on ``turn`` are
ordered by role and text and all kept; rows with NULL ``conv_id`` form one
conversation and NULL turns come first; an empty table gives no example; other
columns are ignored.  One conversation is one task's work, because its last
example holds it whole in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\~"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\~"), F.lit("\n")))


def expand(turns: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id, example (0, 1, ...), formatted, loss_start and loss_length
    (code points of ``formatted``; length NULL where nothing is trainable).
    """
    empty = F.lit("")
    role, text = F.coalesce(F.col("role"), empty), F.coalesce(F.col("text"), empty)
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # array_sort puts NULL fields last inside structs of equal rank; NULL turns are moved to the front
    conv = conv.select(
        "conv_id",
        F.concat(F.filter("ts", lambda t: t["turn"].isNull()), F.filter("ts", lambda t: t["turn"].isNotNull())).alias("ts"),
    )
    rendered = F.transform(
        "ts", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    )
    targets = F.filter(
        F.transform("ts", lambda t, i: F.when((t["role"] == reply_role) | (i == F.size("ts") - 1), i)), lambda i: i.isNotNull()
    )
    conv = conv.select("conv_id", "ts", rendered.alias("rs"), targets.alias("targets"))
    one = conv.select("conv_id", "ts", "rs", F.posexplode("targets").alias("example", "at"))
    last = F.element_at("ts", F.col("at") + 1)
    reply = F.length(escape(last["text"]))
    head = F.array_join(F.slice("rs", F.lit(1), F.col("at")), "")
    return one.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.array_join(F.slice("rs", F.lit(1), F.col("at") + 1), "").alias("formatted"),
        (F.length(head) + len(START) + F.length(escape_role(last["role"])) + 1).cast("long").alias("loss_start"),
        F.when(last["role"] == reply_role, reply).cast("long").alias("loss_length"),
    )


def parse(formatted: Column | str) -> Column:
    """Turns of a formatted text, as array of struct(role, text), unescaped."""
    c = F.col(formatted) if isinstance(formatted, str) else formatted
    parts = F.filter(F.split(c, r"\Q" + END + r"\E\n"), lambda x: x != "")
    body = lambda x: F.substring(x, len(START) + 1, 2**31 - 1)
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape_role(F.substring_index(body(x), "\n", 1)).alias("role"),
            unescape(F.regexp_replace(body(x), r"^[^\n]*\n", "")).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, read back from them."""
    reply = F.when(F.col("loss_length").isNotNull(), unescape(F.expr("substring(formatted, cast(loss_start AS int) + 1, cast(loss_length AS int))")))
    conv = examples.select("conv_id", "example", "formatted", reply.alias("reply")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    conv = conv.select(
        "conv_id",
        parse("longest").alias("turns"),
        F.array_join(F.transform(F.filter("replies", lambda r: r["reply"].isNotNull()), lambda r: r["reply"]), "").alias("loss"),
        "formatted_chars",
    )
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return conv.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
