"""Chat formatting as a grammar round trip.

A turn is rendered as ``### role: body </turn>`` and a line end. A body may hold the template's own control strings, so it is
escaped only as far as a reparse asks for: the plain body first, then with its control strings broken by a backslash, then
with its backslashes doubled as well. The first form that the deterministic parser reads back unchanged, and in which no
control string stands, is kept; the last form always satisfies both. The parser then reads the whole conversation again and
what it recovers is compared with the source.

Everything is DataFrame expressions. A conversation is one output row, so its turns meet in one task; that is the size of
one text, not of a group of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template. OPEN and CLOSE are the control strings; END is what the parser splits on.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>"
END = f" {CLOSE}\n"


def broken(text: Column) -> Column:
    """``text`` with a backslash inside each control string."""
    return F.replace(F.replace(text, F.lit(CLOSE), F.lit("<\\/turn>")), F.lit(OPEN), F.lit("##\\# "))


def doubled(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("\\\\"))


def unescaped(text: Column) -> Column:
    """Each backslash goes and the character after it stays."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\:/#])", r"\\$1")


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped_role(role), F.lit(SEP), body, F.lit(END))


def parsed(turn: Column) -> Column:
    """struct<role, text> of a rendered turn without its END. The role runs to the first unescaped colon."""
    head = F.regexp_extract(turn, r"(?s)\A### ((?:[^\\:]|\\.)*+): ", 1)
    return F.struct(
        unescaped(head).alias("role"),
        unescaped(F.substr(turn, F.length(head) + len(OPEN) + len(SEP) + 1)).alias("text"),
    )


def reads_back(text: Column, body: Column) -> Column:
    """Whether a parser that meets ``body`` recovers ``text``, with no control string left in it."""
    return (unescaped(body) == text) & ~F.contains(body, F.lit(CLOSE)) & ~F.contains(body, F.lit(OPEN))


def escaped(text: Column) -> Column:
    """The least escaped body that reads back as ``text``."""
    once = broken(text)
    return F.when(reads_back(text, text), text).when(reads_back(text, once), once).otherwise(broken(doubled(text)))


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text) rows: formatted text, turns read back from it, and a loss mask.

    Output: conv_id, formatted, turns array<struct<role, text>>, loss_spans array<struct<turn, start, length>> (code points
    within the rendered turn, 0-based, that hold a ``loss_role`` body), loss_texts array<string> (those bodies, unescaped),
    roundtrip boolean (the turns read back equal the source).

    Turns are ordered by turn, null first, then by role and text, so ties and repeated rows have one defined order and all
    stay. A null role or text counts as empty. A null conv_id is a conversation of its own. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    turns = rows.select(
        F.col("conv_id"),
        F.col("turn").alias("t"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col("text"), F.lit("")).alias("x"),
    ).select("conv_id", F.struct("t", "r", "x", rendered(F.col("r"), escaped(F.col("x"))).alias("out")).alias("row"))
    whole = (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .withColumn("formatted", F.array_join(F.col("rows.out"), ""))
    )
    pieces = F.split("formatted", END, -1)
    read = whole.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).withColumn(
        "turns", F.transform("pieces", parsed)
    )
    is_loss = F.filter(
        F.transform("turns", lambda x, i: F.struct(i.alias("turn"), x["role"].alias("role"), x["text"].alias("text"))),
        lambda x: x["role"] == loss_role,
    )
    start = len(OPEN) + F.length(escaped_role(F.lit(loss_role))) + len(SEP)
    return read.withColumn("loss", is_loss).select(
        "conv_id",
        "formatted",
        "turns",
        F.transform(
            "loss",
            lambda x: F.struct(
                x["turn"].alias("turn"), start.alias("start"), (F.length(F.get("pieces", x["turn"])) - start).alias("length")
            ),
        ).alias("loss_spans"),
        F.col("loss.text").alias("loss_texts"),
        (
            F.col("turns")
            == F.transform("rows", lambda x: F.struct(x["r"].alias("role"), x["x"].alias("text")))
        ).alias("roundtrip"),
    )


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, from what was read back."""
    loss = F.array_join("loss_texts", "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "roundtrip",
    )
