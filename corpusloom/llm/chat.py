r"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted, neighbours of one role become one message, and the
messages are concatenated::

    <|im_start|>ROLE\nTEXT<|im_sep|>TEXT<|im_end|>\n

``<|im_sep|>`` stands between turns of one role that share a message, so that the turns can be read back.
Inside roles and texts a backslash becomes ``\b`` and ``<|`` becomes ``<\p``; in a role a line feed becomes
``\n``. Every backslash of the output therefore begins an escape, no control string can appear inside a text,
and ``parse`` restores the very turns. ``loss_spans`` (start, length in code points, from 0) cover the escaped
text of each turn of the trained role.

Nulls: a null text or role counts as empty, a null turn sorts first, a null conv_id is a conversation of its own.
Equal turn numbers sort by role, then text; repeated rows are all kept. A conversation is one row, of any number of turns and length of
texts that a row holds. An empty table gives no rows, and
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Turns whose places are summed together.
BLOCK = 256


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    return F.replace(_escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    return _unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_chats(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation of df(conv_id, turn, role, text)."""
    rows = df.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # starts: where a run of one role begins. A run is one message, its texts an array.
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    chats = chats.withColumn("starts", starts)
    messages = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.element_at("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s, F.when(k + 1 < F.size("starts"), F.get("starts", k + 1)).otherwise(F.size("turns") + 1) - s),
                lambda t: _escape(t["text"]),
            ).alias("texts"),
        ),
    )
    chats = chats.withColumn("messages", messages)
    formatted = F.array_join(
        F.transform(
            "messages",
            lambda m: F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n"), F.array_join(m["texts"], SEP), F.lit(f"{END}\n")),
        ),
        "",
    )
    # Lengths of what stands before each text since the end of the one before, and of the text itself.
    steps = F.flatten(
        F.transform(
            "messages",
            lambda m, k: F.transform(
                m["texts"],
                lambda x, j: F.struct(
                    F.when(j > 0, F.lit(len(SEP)))
                    .otherwise(F.char_length(_escape_role(m["role"])) + len(START) + 1 + F.when(k > 0, F.lit(len(END) + 1)).otherwise(F.lit(0)))
                    .cast("long")
                    .alias("before"),
                    F.char_length(x).cast("long").alias("length"),
                    (m["role"] == loss_role).alias("loss"),
                ),
            ),
        )
    )
    # Places are sums of what stands before. An array that grows is copied at each step, so it grows within blocks, and the blocks' first
    # places in an array of their own.
    none = F.expr("cast(array() as array<bigint>)")
    chats = chats.select("conv_id", formatted.alias("formatted"), steps.alias("steps"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("steps") - 1) / BLOCK).cast("int")), lambda k: F.slice("steps", k * BLOCK + 1, F.lit(BLOCK)))
    chats = chats.select("conv_id", "formatted", blocks.alias("blocks"))
    size = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, x: n + x["before"] + x["length"])
    firsts = F.aggregate(
        "blocks", F.struct(F.lit(0).cast("long").alias("at"), none.alias("firsts")),
        lambda acc, block: F.struct((acc["at"] + size(block)).alias("at"), F.concat(acc["firsts"], F.array(acc["at"])).alias("firsts")), lambda acc: acc["firsts"],
    )
    places = F.transform(F.arrays_zip(F.col("blocks").alias("block"), firsts.alias("first")), lambda x: _spans(x["block"], x["first"]))
    return chats.select("conv_id", "formatted", F.flatten(places).alias("loss_spans"))


def _spans(block: Column, first: Column) -> Column:
    """The loss spans of the steps of a block that begins at a place."""
    start = F.struct(first.alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))
    return F.aggregate(
        block,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["before"] + x["length"]).alias("at"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["before"]).alias("start"), x["length"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def parse(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, read back from a formatted conversation."""
    messages = F.split(formatted, r"<\|im_start\|>")
    messages = F.slice(messages, F.lit(2), F.size(messages) - 1)
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                F.split(F.regexp_replace(F.substr(m, F.locate("\n", m) + 1), r"<\|im_end\|>\n$", ""), r"<\|im_sep\|>"),
                lambda x: F.struct(
                    _unescape_role(F.substring_index(m, "\n", 1)).alias("role"),
                    _unescape(x).alias("text"),
                ),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: _unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
