r"""Chat formatting as a relation: collected turns, adjacent turns merged, one text a conversation.

The template writes a block for each speaker's run of turns:

    ### role: first turn<sep>second turn of the same role</turn>\n

Inside texts backslash, ``<`` and ``#`` (in roles also ``:``) are written as a backslash and a letter, so
a marker never stands inside a text and the output can be read back exactly. The ``loss`` column lists (start, length) of the
assistant texts inside the formatted text, in code points, without markers.

Defined results: a null text is empty, a null role is "unknown", a null turn comes first; ties of one
turn number go by role, then text; repeated rows are repeated turns; rows without an id form the
conversation with the null id; other columns of the input are left out; an empty table gives no rows.
A conversation is one output text, so its rows meet in one place; conversations are spread by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cascade import let

HEAD, ROLE_END, SEPARATOR, TAIL = "### ", ": ", "<sep>", "</turn>\n"


#: A block's head; the role holds no colon of its own.
ROLE_PATTERN = r"(?s)\A### ([^:]*): "
#: What stands for each character that the markers use. Decoding takes the backslash last.
ESCAPES = {"<": r"\l", "#": r"\h", ":": r"\c", "\\": r"\s"}


def escape(text: Column) -> Column:
    """Text without ``<`` and ``#``; every backslash in it begins an escape."""
    for plain in ("\\", "<", "#"):
        text = F.replace(text, F.lit(plain), F.lit(ESCAPES[plain]))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in ESCAPES.items():
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def block_head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.replace(escape(role), F.lit(":"), F.lit(ESCAPES[":"])), F.lit(ROLE_END))


def collected_turns(conversations: DataFrame) -> DataFrame:
    """One row a conversation: its turns as sorted structs."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def merged_blocks(turns: Column) -> Column:
    """Array of (role, parts): parts are the escaped texts of adjacent turns of one role."""
    empty = F.expr("cast(array() as array<struct<role: string, parts: array<string>>>)")

    def starts(t: Column) -> Column:
        # (index of first turn, index of the next block's first turn) of every run of one role
        first = F.filter(
            F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1)["role"] != x["role"]), i)), lambda i: i.isNotNull()
        )
        return let(
            first,
            lambda f: F.transform(
                f,
                lambda i, j: F.struct(
                    F.get(t, i)["role"].alias("role"),
                    F.transform(
                        F.slice(t, i + 1, F.coalesce(F.get(f, j + 1), F.size(t)) - i), lambda x: escape(x["text"])
                    ).alias("parts"),
                ),
            ),
        )

    return F.when(F.size(turns) == 0, empty).otherwise(starts(turns))


def block_text(block: Column) -> Column:
    return F.concat(block_head(block["role"]), F.array_join(block["parts"], SEPARATOR), F.lit(TAIL))


def loss_spans(blocks: Column) -> Column:
    """(start, length) in code points of every assistant text inside the formatted text."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))

    def step(state: Column, block: Column) -> Column:
        head = state["at"] + F.length(block_head(block["role"]))

        def placed(s: Column, part: Column) -> Column:
            return F.struct(
                (s["at"] + F.length(part) + len(SEPARATOR)).alias("at"),
                F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), F.length(part).alias("length")))).alias("spans"),
            )

        spans = F.when(
            block["role"] == "assistant",
            F.aggregate(block["parts"], F.struct(head.alias("at"), state["spans"].alias("spans")), placed)["spans"],
        ).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(block_text(block))).alias("at"), spans.alias("spans"))

    return F.aggregate(blocks, start, step)["spans"]


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted text and the loss spans of every conversation."""
    blocks = collected_turns(conversations).select("conv_id", merged_blocks(F.col("turns")).alias("blocks"))
    return blocks.select(
        "conv_id",
        F.array_join(F.transform("blocks", block_text), "").alias("formatted"),
        loss_spans(F.col("blocks")).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text), one entry for every turn, read from a formatted text."""
    blocks = F.filter(F.split(formatted, TAIL, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.regexp_extract(block, ROLE_PATTERN, 1))
        body = F.regexp_replace(block, ROLE_PATTERN, "")
        return let(role, lambda r: F.transform(F.split(body, SEPARATOR, -1), lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
