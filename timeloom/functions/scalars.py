"""Scalar expressions of plans and candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much an expression tag counts towards "cute". Fixed values.
CUTE = {
    "blush": 1.0, "full-face_blush": 1.0, "light_blush": 0.6, "nose_blush": 0.6, "embarrassed": 0.9, "one_eye_closed": 0.9, "pout": 0.9, ":t": 0.8, ">_<": 0.9,
    "smile": 0.7, ":d": 0.8, "^_^": 0.8, "laughing": 0.6, "heart": 0.7, "spoken_heart": 0.7, "wavy_mouth": 0.6, ":3": 0.6, ":p": 0.6, "tongue_out": 0.6, "smug": 0.5,
    "grin": 0.4, "surprised": 0.3, ":o": 0.3, "tears": 0.3, "flying_sweatdrops": 0.3, "closed_eyes": 0.1,
}


def cuteness(scores: Column, weights: dict[str, float] | None = None, boost: dict[str, float] | None = None) -> Column:
    """Sum of weight * boost * score over a map of tags to scores."""
    weights, boost = weights or CUTE, boost or {}
    known = F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, w * boost.get(t, 1.0))])
    return F.aggregate(F.map_entries(scores), F.lit(0.0), lambda acc, e: acc + F.coalesce(F.try_element_at(known, e["key"]), F.lit(0.0)) * e["value"])


def framing(height: Column) -> Column:
    return F.when(height >= 0.35, "close-up").when(height >= 0.15, "medium").otherwise("wide")


def section_score(section: Column, cute: Column, size: Column, presence: Column, tears: Column, talking: Column, frame: Column) -> Column:
    """How well a shot suits a section of a song."""
    return (
        F.when(section == "chorus", cute + 0.8 * size + 0.3 * presence)
        .when(section.isin("pre-chorus", "bridge"), 0.7 * cute + 0.5 * presence + 0.3 * tears)
        .when(section == "intro", 0.6 * presence + F.when(frame != "close-up", 0.3).otherwise(0.0) + 0.3 * (1 - F.least(cute, F.lit(1.0))))
        .otherwise(0.5 * cute + 0.5 * presence + F.when(talking, 0.2).otherwise(0.0))
    )


def centred_window(start: Column, end: Column, seconds: Column, slowest: float = 0.9) -> Column:
    """struct (start, length, speed): the middle of [start, end) for a slot, slowed at most to ``slowest`` if it is short."""
    speed = F.least(F.lit(1.0), F.greatest(F.lit(slowest), (end - start) / seconds))
    length = F.least(seconds * speed, end - start)
    return F.struct((start + (end - start - length) / 2).alias("start"), length.alias("length"), speed.alias("speed"))


def good_name(name: Column) -> Column:
    return F.coalesce((name != "") & ~name.startswith(".") & ~name.rlike(r"[/\\]"), F.lit(False))


def song_id(text: Column) -> Column:
    """A slug of up to 40 characters and eight digits of a hash."""
    slug = F.left(F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), "-"), F.lit(40))
    return F.concat_ws("-", F.nullif(slug, F.lit("")), F.left(F.sha1(text.cast("binary")), F.lit(8)))


def even_size(width: Column, height: Column, most: int) -> Column:
    """struct (width, height): scaled to a height of at most ``most``, both even."""
    scale = F.least(F.lit(1.0), F.lit(most) / height)
    return F.struct((F.bround(width * scale / 2) * 2).cast("int").alias("width"), (F.bround(height * scale / 2) * 2).cast("int").alias("height"))


def still(moving: Column, pan: Column) -> Column:
    return (moving <= 0.15) & (pan <= 0.003)


def clip_key(params: Column) -> Column:
    """24 digits of a hash of a struct's JSON."""
    return F.left(F.sha2(F.to_json(params), 256), F.lit(24))
