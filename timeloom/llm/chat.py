"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, placed

ESC = "\x1b"
#: Control strings of common chat templates that texts must not contain as such; the first character of each is set apart.
CONTROL = r"(<(?=\|)|\|(?=>)|<(?=/?s>)|<(?=<SYS>>)|<(?=</SYS>>)|\[(?=/?INST\]))"
OPEN, MID, NEXT, CLOSE = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"


def escaped(text: Column) -> Column:
    """text without control strings: ESC is doubled, and ESC - is put behind the first character of a control string."""
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(ESC + ESC)), CONTROL, "$1" + ESC + "-")


def unescaped(text: Column) -> Column:
    """The inverse of escaped(), read from left to right."""
    return F.regexp_replace(text, f"{ESC}(?:-|({ESC}))", "$1")


def format_chat(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, mask: one row for each conversation.

    Turns are sorted by turn (ties by role, then text); adjacent turns of one role make one block
    ``OPEN role MID text (NEXT text)* CLOSE``, so merging is reversible. ``mask`` lists (start, length) in code points of
    the texts to learn, those of the roles in ``learn``; markers are outside. Null roles and texts count as empty, null
    turns come first, null conv_ids are one conversation, repeated rows stay, an empty table gives no rows. A
    conversation is one output row, so its turns meet in one row; no other rows do.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    x = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    n = F.size("turns")
    at = lambda i: F.get("turns", i)
    fresh = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    x = once(x, first=fresh)
    block = lambda i, k: F.struct(
        at(i)["role"].alias("role"), F.transform(F.slice("turns", i + 1, F.coalesce(F.get("first", k + 1), n) - i), lambda t: escaped(t["text"])).alias("parts")
    )
    x = once(x, blocks=F.transform("first", block)).select("conv_id", "blocks")
    learned = lambda b: b["role"].isin(*learn)
    head = lambda b: F.concat(F.lit(OPEN), escaped(b["role"]), F.lit(MID))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["parts"], NEXT), F.lit(CLOSE))), "")
    # before each text: what its block puts there; after the last text of a block: its closing marker
    lengths = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(b["parts"], lambda p, i: F.struct(F.when(i == 0, F.length(head(b))).otherwise(len(NEXT)).alias("gap"), F.length(p).alias("len"), F.when(i == F.size(b["parts"]) - 1, len(CLOSE)).otherwise(0).alias("tail"), learned(b).alias("learn"))),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + p["len"] + p["tail"]).alias("at"),
        F.when(p["learn"], F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["len"].alias("length"))))).otherwise(acc["out"]).alias("out"),
    )
    moved = lambda s, by: F.struct((s["start"] + by).alias("start"), s["length"].alias("length"))
    return x.select("conv_id", formatted.alias("formatted"), placed(lengths, start, step, moved).alias("mask"))


def parse_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), learned (the texts under the mask): read back from ``formatted`` and ``mask`` alone."""
    blocks = F.split(F.expr(f"substring(formatted, {len(OPEN) + 1})"), r"<\|end\|>(?:<\|turn\|>|$)")
    whole = F.filter(blocks, lambda b: F.contains(b, F.lit(MID)))
    pair = lambda b: F.split(b, r"<\|text\|>", 2)
    turns = F.flatten(F.transform(whole, lambda b: F.transform(F.split(F.get(pair(b), F.lit(1)), r"<\|part\|>"), lambda t: F.struct(unescaped(F.get(pair(b), F.lit(0))).alias("role"), unescaped(t).alias("text")))))
    learned = F.transform("mask", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
