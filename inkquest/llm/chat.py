"""Chat formatting of typed content parts with built-in functions only.

A turn is a role and an ordered array of parts (kind, text, ref, units).  Text parts are
escaped and written out; every other part becomes one placeholder, and its reference and
expanded token count are recorded beside the text.  Each turn is

    <|im_start|>role\\nbody<|im_end|>\\n

No control string survives inside a role or text: after escaping, a backslash stands behind
the first character of each, and backslashes of the input are doubled, so that removing one
backslash before every character gives the input back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
#: Openers of control strings; each is broken behind its first character.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]"]
#: Tokens that one unit (tile, second, page) of an attachment takes when it is expanded.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def text_part(text: Column) -> Column:
    """A text column as a content of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("units"))).cast(PARTS)


def _visit(p: Column) -> Column:
    """What a part leaves in the text, and what is recorded of it."""
    is_text = F.coalesce(p["kind"], F.lit("text")) == "text"
    kind = F.when(p["kind"].isin(*TOKENS_PER_UNIT), p["kind"]).otherwise(F.lit("attachment"))
    rate = F.lit(1)
    for k, n in TOKENS_PER_UNIT.items():
        rate = F.when(p["kind"] == k, F.lit(n)).otherwise(rate)
    return F.struct(
        F.when(is_text, escape(p["text"])).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>"))).alias("out"),
        is_text.alias("is_text"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        F.when(is_text, F.lit(0)).otherwise(rate * F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1))).cast("long").alias("tokens"))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns, attachments, attachment_tokens.

    ``turns`` holds for each turn its start and length (code points) in ``formatted`` and the
    loss spans relative to that start: the text parts of the loss roles.  Null text or parts
    are empty text, a null role is the empty role, a null conversation is one of its own.
    Turns of one number are ordered by role and then by their text; repeated rows all stay.
    Further columns are ignored; an empty table gives an empty result.
    A conversation is one value of the output, so its turns do meet in one row.
    """
    empty = F.array().cast(PARTS)
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                     F.transform(F.coalesce(F.col(parts).cast(PARTS), empty), _visit).alias("seen"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    t = t.select("conv_id", "turn", "role", "seen", head.alias("head"), F.array_join(F.transform("seen", lambda x: x["out"]), "").alias("body"))
    offset = lambda i: F.aggregate(F.slice("seen", 1, i), F.lit(0), lambda n, x: n + F.char_length(x["out"]))
    spans = F.filter(F.transform("seen", lambda x, i: F.struct(
        (F.char_length("head") + offset(i)).alias("start"), F.char_length(x["out"]).alias("length"), x["is_text"].alias("ok"))),
        lambda x: x["ok"] & (x["length"] > 0))
    t = t.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
        F.when(F.col("role").isin(*loss_roles), F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))))
        .otherwise(F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        F.transform(F.filter("seen", lambda x: ~x["is_text"]), lambda x: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))).alias("attached"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    t = t.withColumn("ord", F.row_number().over(w)).withColumn(
        "start", F.sum(F.char_length("piece")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("piece"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "piece", "spans", "attached"))).alias("all"))
    attachments = F.flatten(F.transform("all", lambda x: x["attached"]))
    return g.select(
        "conv_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("all", lambda x: F.struct(x["start"].alias("start"), F.char_length(x["piece"]).alias("length"), x["spans"].alias("loss"))).alias("turns"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("attachment_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns read from ``formatted`` (role, text with placeholders), and the text under the loss mask."""
    pieces = F.filter(F.split("formatted", r"(?<=<\|im_end\|>\n)"), lambda x: x != "")
    turn = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)<\|im_end\|>\n$"
    c = chats.select("conv_id", "formatted", "turns", pieces.alias("pieces"))
    loss = F.zip_with("pieces", "turns", lambda p, t: F.array_join(F.transform(
        t["loss"], lambda s: unescape(F.substring(p, s["start"] + 1, s["length"]))), ""))
    return c.select(
        "conv_id", "formatted",
        F.transform("pieces", lambda p: F.struct(unescape(F.regexp_extract(p, turn, 1)).alias("role"),
                                                 unescape(F.regexp_extract(p, turn, 2)).alias("text"))).alias("said"),
        F.array_join(loss, "").alias("loss_text"))


def chat_digest(chats: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, all taken from the formatted text and its mask."""
    r = read_back(chats)
    said = F.array_join(F.transform("said", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
