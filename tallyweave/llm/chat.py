"""Chat formatting of typed content parts, with DataFrame functions only.

A turn is a role and a list of parts: text, image, audio or document. Parts are visited in order: a text gives
itself, escaped; any other gives one placeholder, and an attachment is recorded with its place, reference and
the tokens it expands to. An assistant's turn reads ``<s>content</s>``, any other ``[INST]role<newline>content[/INST]``.

Control strings inside texts are escaped by a backslash after their first character. One that follows already
is kept and counts, so taking one backslash away gives the text back, whatever it held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that a part expands to where it states none.
TOKENS = {"image": 576, "audio": 300, "document": 1024}
CONTENT = "array<struct<type:string,text:string,ref:string,tokens:int>>"
_CONTROL = r"(/?(?:s>|INST\]|" + "|".join(f"{t}>" for t in TOKENS) + "))"
_TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _role_in(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _visit(part: Column) -> Column:
    """What a part puts into the output; one of an unknown type counts as text."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind in TOKENS:
        out = F.when(part["type"] == kind, F.lit(f"<{kind}>")).otherwise(out)
    return out


def _tokens(part: Column) -> Column:
    out = F.lit(0)
    for kind, n in TOKENS.items():
        out = F.when(part["type"] == kind, F.coalesce(part["tokens"], F.lit(n))).otherwise(out)
    return out


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """One row for each conversation: its id, n_turns, formatted, loss_spans, attachments, attachment_tokens.

    ``content`` is an array of parts (``CONTENT``). Turns are ordered by ``turn``, then role and texts, nulls
    first; repeated rows are turns of their own. Null roles count as empty, null contents and null parts as
    nothing. Each row with a null id is a conversation of its own, so such rows never meet in one task. ``loss_spans`` are (start from 0, length) in
    code points of ``formatted``, one for each assistant turn. No rows give no rows. A conversation's turns
    are brought together, as they end in one string.
    """
    parts = F.filter(F.coalesce(F.col(content), F.array().cast(CONTENT)), lambda p: p.isNotNull())
    # a row without an id is a conversation of its own
    alone = F.when(F.col(conv).isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(conv).alias("_conv"), alone.alias("_alone"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), parts.cast(CONTENT).alias("_parts"))
    body = F.array_join(F.transform("_parts", _visit), "")
    rows = rows.withColumn("_body", body).withColumn("_mine", F.col("_role") == "assistant")
    text = F.when(F.col("_mine"), F.concat(F.lit("<s>"), "_body", F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), _role_in(F.col("_role")), F.lit("\n"), "_body", F.lit("[/INST]")))
    said = F.array_join(F.transform("_parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    order = Window.partitionBy("_conv", "_alone").orderBy(F.asc_nulls_first("_turn"), "_role", said, F.to_json("_parts"))
    rows = rows.withColumn("_text", text).withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("_at", F.sum(F.length("_text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("_text"))
    placed = F.filter(F.transform("_parts", lambda p, i: F.struct((F.col("_n") - 1).alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))), lambda a: a["type"].isin(*TOKENS))
    one = F.struct(F.col("_n"), F.col("_text").alias("text"), F.when(F.col("_mine"), F.struct((F.col("_at") + 3).alias("start"), F.length("_body").cast("long").alias("length"))).alias("span"), placed.alias("placed"))
    all_turns = rows.groupBy("_conv", "_alone").agg(F.sort_array(F.collect_list(one)).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: x["placed"]))
    return all_turns.select(
        F.col("_conv").alias(conv),
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["text"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation; placeholders stay in the text."""

    def one(turn: Column) -> Column:
        mine = turn.startswith("<s>")
        inner = F.when(mine, turn.substr(F.lit(4), F.length(turn) - 7)).otherwise(turn.substr(F.lit(7), F.length(turn) - 13))
        cut = F.locate("\n", inner)
        role = F.when(mine, F.lit("assistant")).otherwise(_role_out(inner.substr(F.lit(1), cut - 1)))
        text = F.when(mine, inner).otherwise(inner.substr(cut + 1, F.length(inner)))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def text_parts(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the output of :func:`format_chats` holds, read back from it: turns, and the text under the loss mask."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    rows = formatted.withColumn("turns", turns).withColumn("loss", under)
    return rows.select(conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
