"""Chat formatting with typed content parts (operator 4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strings that chat templates in public use treat as control strings.
CONTROL_STRINGS = (
    "<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<image>", "<audio>", "<document>",
)
OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>\n", "\n"
PARTS_TYPE = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
#: Token prices of attachments: pixels a side of an image tile, tokens a tile, a second, a page.
TILE_SIDE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 25, 800


def escaped(text: Column) -> Column:
    """Put a backslash before each backslash and behind the first character of each control string, so that none is left."""
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(s[0] + "\\" + s[1:])), CONTROL_STRINGS, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def part_tokens(p: Column) -> Column:
    """Tokens to which an attachment expands; zero for text. Missing sizes count as one tile, second or page."""
    side = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) / TILE_SIDE)
    return (
        F.when(p["type"] == "image", side(p["width"]) * side(p["height"]) * TILE_TOKENS)
        .when(p["type"] == "audio", F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(1.0)), F.lit(0.0)) * SECOND_TOKENS))
        .when(p["type"] == "document", F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit_part(p: Column) -> Column:
    """A part as it stands in the turn: escaped text, or the placeholder of its kind (unknown kinds: <|file|>)."""
    kind = F.coalesce(p["type"], F.lit("text"))
    return (
        F.when(kind == "text", escaped(F.coalesce(p["text"], F.lit(""))))
        .when(kind.isin("image", "audio", "document"), F.concat(F.lit("<|"), kind, F.lit("|>")))
        .otherwise(F.lit("<|file|>"))
    )


def format_chats(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: formatted text, loss spans, attachments, token counts.

    A turn is ``<|im_start|>role\\n content <|im_end|>\\n``. Content is the text column, or the
    typed parts of ``parts_col`` (PARTS_TYPE) visited in order: text is escaped, attachments
    become placeholders whose references and expanded token counts are kept in order.

    Columns: conv_id, formatted, loss_spans (start and end in code points of the formatted text,
    the content of each turn of ``loss_role``, without its end mark), attachments (turn, ordinal,
    type, uri, tokens), attachment_tokens, n_turns.

    Null texts and null parts are empty, null roles are the empty role, null turns come first,
    and rows with the same turn follow by role and text. A null conversation id is a conversation
    of its own. No rows give no rows. A conversation is one record, so it must fit a string.
    Other columns are not read.
    """
    parts = (
        F.col(parts_col)
        if parts_col
        else F.array(F.struct(
            F.lit("text").alias("type"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("uri"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        ))
    )
    rows = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.filter(F.coalesce(parts, F.array().cast(PARTS_TYPE)), lambda p: p.isNotNull()).alias("parts"),
    )
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit(BREAK))
    rows = rows.select(
        "conv_id", "turn", "role",
        head.alias("head"),
        F.array_join(F.transform("parts", visit_part), "").alias("body"),
        F.filter(
            F.transform("parts", lambda p, i: F.struct(i.alias("ordinal"), p["type"].alias("type"), p["uri"].alias("uri"), part_tokens(p).alias("tokens"))),
            lambda a: F.coalesce(a["type"], F.lit("text")) != "text",
        ).alias("files"),
    )
    # Offsets are running sums of lengths in the order of turns.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE))).withColumn("ordinal", F.row_number().over(order))
    ends = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("stop", ends - len(CLOSE))
    turn = F.struct(
        "ordinal", "turn", "role", "piece", "files", (F.col("stop") - F.length("body")).alias("start"), "stop"
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: F.transform(t["files"], lambda f: F.struct(
        t["turn"].alias("turn"), f["ordinal"].alias("ordinal"), f["type"].alias("type"), f["uri"].alias("uri"), f["tokens"].alias("tokens")))))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"))
        ).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
        F.size("turns").cast("long").alias("n_turns"),
    )


def parse_chats(chats: DataFrame) -> DataFrame:
    """Read formatted conversations back: adds turns (array of role, text) and loss_text.

    Only the formatted text and the loss spans are read. Placeholders of attachments stay
    as they stand in the text.
    """
    segments = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda s: s != "")
    # A role ends at the first line break without a backslash before it.
    head = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"
    turns = F.transform(
        segments,
        lambda s: F.struct(
            unescaped(F.regexp_extract(s, head, 1)).alias("role"), unescaped(F.regexp_replace(s, head, "")).alias("text")
        ),
    )
    loss = F.array_join(
        F.transform("loss_spans", lambda p: unescaped(F.substring(F.col("formatted"), p["start"].cast("int") + 1, (p["stop"] - p["start"]).cast("int")))),
        "",
    )
    return chats.withColumn("turns", turns).withColumn("loss_text", loss)
