"""Chat formatting with Spark expressions only: turns to one string with a loss mask, and back.

Template: ``<turn:ROLE>TEXT</turn>`` per block; adjacent turns of one role share a block and
are set apart by ``<and>``. Inside roles and texts a backslash becomes ``\\b``, ``<`` becomes
``\\l`` and ``>`` becomes ``\\g``, so a control string's ``<`` never occurs in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import once, running

OPEN, AND, CLOSE = "<turn:", "<and>", "</turn>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, ``formatted``, ``loss_mask``.

    Turns are sorted by number (null first), then role and text, so ties have one order.
    ``loss_mask`` is run-length coded over the code points of ``formatted``: an array of
    (chars, train), where only texts of ``train_role`` train. Null roles and texts count as
    empty. A null conversation id is a conversation of its own; repeated rows are turns like
    others; an empty table gives an empty table; other columns are ignored. A conversation
    is one output value, so its turns meet in one task; conversations are spread by id.
    """
    row = F.struct(F.col(turn_col).alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"))
    conv = turns.groupBy(F.col(conv_col).alias(conv_col)).agg(F.array_sort(F.collect_list(row)).alias("_s"))

    def mark(x: Column, i: Column) -> Column:
        joins = (i > 0) & (F.get("_s", i - 1)["r"] == x["r"])
        head = F.when(joins, F.lit(AND)).otherwise(F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escape(x["r"]), F.lit(">")))
        return F.struct(head.alias("m"), escape(x["x"]).alias("x"), (x["r"] == train_role).alias("train"))

    parts = conv.withColumn("_p", F.transform("_s", mark))
    text = F.concat(F.array_join(F.transform("_p", lambda p: F.concat(p["m"], p["x"])), ""), F.lit(CLOSE))
    runs = F.flatten(F.transform("_p", lambda p: F.array(_run(F.length(p["m"]), F.lit(False)), _run(F.length(p["x"]), p["train"]))))
    return parts.select(conv_col, text.alias("formatted"), F.concat(runs, F.array(_run(F.lit(len(CLOSE)), F.lit(False)))).alias("loss_mask"))


def _run(chars: Column, train: Column) -> Column:
    return F.struct(chars.cast("int").alias("chars"), train.alias("train"))


def parse_chat(chats: DataFrame, text_col: str = "formatted", mask_col: str = "loss_mask") -> DataFrame:
    """``chats`` with ``turns`` (array of role, text) and ``loss_texts`` (the unescaped texts under
    the mask, in order), both read from the formatted string and its mask alone.

    The string is cut before each ``<``. A piece is a control string and the text behind it,
    so it spans two runs of the mask.
    """
    cut = F.filter(F.split(F.col(text_col), "(?=<)"), lambda x: (x != "") & (x != CLOSE))
    # A piece of <and> belongs to the role of the last opening piece: closings stand between blocks.
    opens = lambda c: running(F.transform(c, lambda x, i: F.when(x.startswith(AND), 0).otherwise(i + 1)), lambda a, x: F.greatest(a, x))
    role = lambda x: F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), ">", 1)
    body = lambda x: F.when(x.startswith(AND), F.substring(x, len(AND) + 1, 1 << 30)).otherwise(F.substring(x, F.locate(">", x) + 1, 1 << 30))
    turn = lambda c, x, k: F.struct(unescape(role(F.get(c, k - 1))).alias("role"), unescape(body(x)).alias("text"))
    # Each array is bound in a lambda: a column would be computed anew inside the next one's.
    turns = once(cut, lambda c: once(opens(c), lambda last: F.zip_with(c, last, lambda x, k: turn(c, x, k))))
    inner = F.filter(F.transform(F.col(mask_col), lambda r, i: F.struct(r["chars"].alias("chars"), (r["train"] & (i % 2 == 1)).alias("train"), i.alias("i"))), lambda r: r["i"] % 2 == 1)
    loss = F.filter(F.zip_with(cut, inner, lambda x, r: F.when(r["train"], unescape(F.right(x, r["chars"])))), lambda x: x.isNotNull())
    return chats.withColumns({"turns": turns, "loss_texts": loss})
