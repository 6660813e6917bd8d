"""Chat formatting with typed content parts, DataFrame functions only.

A turn is a role and an ordered list of parts. A visitor (one ``transform`` over the parts) turns each
part into text: text parts are escaped, image, audio and document parts become numbered placeholders.
Each attachment is recorded with its reference and the tokens that its placeholder stands for: an image
one for each tile of ``TILE`` pixels a side, audio ``AUDIO_RATE`` a second begun, a document
``PAGE_TOKENS`` a page. The template is

    <|turn|>role<|says|>content<|end|>

for each turn in order of turn number. Inside roles and texts each character that opens a control string
(``<`` here, ``[`` in other common templates) and each backslash is followed by an added backslash. So no
text holds a control string, not even across the joint of two parts, and ``unescaped`` restores every
text exactly. The loss mask is a list of spans (code points) of
the formatted string, one for each assistant turn that has content.

Defined cases: null texts, roles, references and part lists count as empty, a null type as text; a part
of unknown type is a placeholder without tokens. Turns sort by number, nulls first, then by role and
content; repeated rows are turns of their own. A null conversation id is one conversation. Only the
named columns are read. A conversation is one string of the result, so it must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    """Put a backslash after every opener of a control string and every backslash."""
    return F.regexp_replace(text, r"[<\[\\]", r"$0\\")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def text_part(text: Column) -> Column:
    """A text as the part list of a turn."""
    null = F.lit(None)
    part = F.struct(
        F.lit("text").alias("type"),
        text.cast("string").alias("text"),
        *[null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height")],
        *[null.cast("double").alias("seconds"), null.cast("int").alias("pages")],
    )
    return F.array(part)


def expanded_tokens(part: Column) -> Column:
    """Tokens that stand for an attachment, from its size; unknown sizes count as 0."""
    size = lambda name: F.greatest(F.coalesce(part[name], F.lit(0)), F.lit(0))
    kind = part["type"]
    tiles = F.ceil(size("width") / TILE) * F.ceil(size("height") / TILE)
    return (
        F.when(kind == "image", tiles)
        .when(kind == "audio", F.ceil(size("seconds")) * AUDIO_RATE)
        .when(kind == "document", size("pages").cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visited(parts: Column, files_before: Column) -> Column:
    """The visitor: a part list as text; attachments are numbered on from ``files_before``."""
    nth = lambda k: F.size(F.filter(F.slice(parts, F.lit(1), k + 1), lambda p: ~is_text(p)))
    placeholder = lambda p, k: F.concat(
        F.lit("<|"),
        F.regexp_replace(p["type"], r"[^A-Za-z0-9_]", "_"),
        F.lit(":"),
        (files_before + nth(k)).cast("string"),
        F.lit("|>"),
    )
    text = lambda p: escaped(F.coalesce(p["text"], F.lit("")))
    return F.array_join(F.transform(parts, lambda p, k: F.when(is_text(p), text(p)).otherwise(placeholder(p, k))), "")


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
) -> DataFrame:
    """One row for each conversation: its id, ``formatted``, ``loss_spans`` and ``attachments``."""
    parts = f"array<{PART}>"
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.filter(F.coalesce(F.col(parts_col).cast(parts), F.array().cast(parts)), lambda p: p.isNotNull()).alias("parts"),
    )
    ordered = Window.partitionBy("conv").orderBy("turn", "role", "parts")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda n: F.coalesce(F.sum(n).over(earlier), F.lit(0))
    attachment = lambda p: F.struct(
        p["type"].alias("type"), F.coalesce(p["ref"], F.lit("")).alias("ref"), expanded_tokens(p).alias("tokens")
    )
    laid = (
        rows.withColumn("files", F.transform(F.filter("parts", lambda p: ~is_text(p)), attachment))
        .withColumn("nth", F.row_number().over(ordered))
        .withColumn("files_before", running(F.size("files")))
        .withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS)))
        .withColumn("content", visited(F.col("parts"), F.col("files_before")))
        .withColumn("start", running(F.length("head") + F.length("content") + len(END)) + F.length("head"))
        .withColumn("end", F.col("start") + F.length("content"))
        .withColumn("loss", (F.col("role") == "assistant") & (F.col("end") > F.col("start")))
    )
    chats = laid.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("nth", "head", "content", "files", "start", "end", "loss"))).alias("turns")
    )
    return chats.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))
        ).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["files"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string as ``array<struct<role, text>>``, unescaped."""
    pieces = F.split(formatted, rf"\Q{END}\E")  # the last piece is empty
    parts = lambda p: F.split(F.substring(p, len(TURN) + 1, 2**31 - 1), rf"\Q{SAYS}\E", 2)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(unescaped(parts(p)[0]).alias("role"), unescaped(parts(p)[1]).alias("text")),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ),
        "",
    )
