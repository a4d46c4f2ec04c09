"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template. Texts hold none of them: "&", "<" and "[" are escaped there.
BEGIN, ROLE, SAME, END = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    """Reversibly rid a text of the characters that every mark begins with."""
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A formatted text and a loss mask for each conversation.

    Turns are collected as structs and sorted; adjacent turns of a role are merged into a block:
    ``<s>`` role ``[INST]`` text (``[/INST]`` text)* ``</s>``. ``pieces`` cuts ``formatted`` into
    structs (text, loss), of which those under the loss mask are the texts of roles in ``learn``.

    Null texts and roles are empty; turns sort by number (null first), then role and text, so
    ties and repeated rows have one order, and each row is a turn. A null conversation id is a
    conversation. Other columns are not read. An empty table gives an empty table.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    turns = df.select(F.col(f"`{conv_col}`").alias("conv"), turn.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    blocks = turns.withColumn("starts", starts).withColumn("blocks", F.transform("starts", lambda s, k: F.struct(F.get("turns", s)["role"].alias("role"), F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), n) - s), lambda t: t["text"]).alias("texts"))))
    piece = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    none = F.lit(False)

    def of(block: Column) -> Column:
        taught = block["role"].isin(*learn)
        opening = piece(F.concat(F.lit(BEGIN), escape(block["role"]), F.lit(ROLE)), none)
        said = F.flatten(F.transform(block["texts"], lambda x, i: F.when(i == 0, F.array(piece(escape(x), taught))).otherwise(F.array(piece(F.lit(SAME), none), piece(escape(x), taught)))))
        return F.concat(F.array(opening), said, F.array(piece(F.lit(END), none)))

    pieces = blocks.withColumn("pieces", F.flatten(F.transform("blocks", of)))
    return pieces.select(F.col("conv").alias(conv_col), F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def parse_chats(df: DataFrame, formatted_col: str = "formatted", pieces_col: str = "pieces") -> DataFrame:
    """Adds ``turns`` (array of role, text), read from the formatted text, and ``loss_text``, what the mask covers."""
    blocks = F.filter(F.split(formatted_col, END, -1), lambda b: b != "")
    whole = F.transform(blocks, lambda b: F.split(F.substring(b, len(BEGIN) + 1, 1 << 30), r"\[INST\]", 2))
    turns = F.flatten(F.transform(whole, lambda w: F.transform(F.split(F.get(w, F.lit(1)), r"\[/INST\]", -1), lambda x: F.struct(unescape(F.get(w, F.lit(0))).alias("role"), unescape(x).alias("text")))))
    loss = F.array_join(F.transform(F.filter(pieces_col, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
    return df.withColumns({"turns": turns, "loss_text": loss})
