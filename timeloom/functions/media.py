"""Expressions and small operators around media files: probes, streams, labels, boxes, sizes, paths and detector outputs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a source may be called and coded as, and the order of text encodings. Fixed values.
VIDEO_SUFFIXES = ("mkv", "mp4", "m4v", "avi", "mov", "webm")
CODECS = ("h264", "hevc", "av1", "vp9", "vp8", "mpeg2video", "mpeg4", "vc1")
H264_FORMATS = ("yuv420p", "yuvj420p")
SCRIPT_ENCODINGS, LYRIC_ENCODINGS, CUE_ENCODINGS = ("utf-8-sig", "utf-16", "gb18030"), ("utf-8-sig", "gb18030", "shift_jis"), ("utf-8-sig", "shift_jis", "gb18030")


def find_episodes(files: DataFrame, path: str = "path") -> DataFrame:
    """Of relative paths those of videos outside of hidden folders, in order."""
    suffix = F.lower(F.regexp_extract(path, r"[^/.]\.([^./]+)$", 1))
    return files.filter(suffix.isin(*VIDEO_SUFFIXES) & ~F.col(path).rlike(r"(^|/)\.")).orderBy(path)


PROBE = "streams array<struct<codec_name:string,pix_fmt:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string>>, format struct<duration:string>"


def probed(probes: DataFrame, text: str = "probe") -> DataFrame:
    """probes (with the JSON that a prober gives) with width, height, fps_num, fps_den, duration, codec, pix_fmt and problem."""
    d = F.from_json(text, PROBE)
    s = F.get(d["streams"], 0)
    rate = lambda name: F.nullif(F.coalesce(s[name], F.lit("0/1")), F.lit("0/0"))
    whole = lambda r, k: F.coalesce(F.try_element_at(F.split(r, "/"), F.lit(k)).try_cast("long"), F.lit(1 if k == 2 else 0))
    fps = F.when(whole(rate("avg_frame_rate"), 1) > 0, rate("avg_frame_rate")).otherwise(rate("r_frame_rate"))
    problem = F.when(s.isNull(), "no video stream").when(whole(fps, 1) == 0, "cannot tell the frame rate")
    return probes.withColumns({"width": s["width"], "height": s["height"], "fps_num": whole(fps, 1), "fps_den": whole(fps, 2), "duration": F.coalesce(d["format"]["duration"].try_cast("double"), F.lit(0.0)), "codec": F.coalesce(s["codec_name"], F.lit("")), "pix_fmt": F.coalesce(s["pix_fmt"], F.lit("")), "problem": problem})


def decodable(codec: Column, pix_fmt: Column) -> Column:
    """Whether hardware decoders take a stream: a known codec, and H.264 in eight bits."""
    return codec.isin(*CODECS) & ((codec != "h264") | pix_fmt.isin(*H264_FORMATS))


def require_decodable(videos: DataFrame) -> DataFrame:
    """videos (codec, pix_fmt); an error for the first one that cannot be decoded."""
    return videos.withColumn("codec", F.when(decodable(F.col("codec"), F.col("pix_fmt")), F.col("codec")).otherwise(F.raise_error(F.concat(F.lit("cannot decode "), "codec", F.lit(" "), "pix_fmt"))))


STREAMS = "streams array<struct<index:int,codec_name:string,tags:struct<language:string,title:string>,disposition:struct<default:int,comment:int>>>"


def audio_streams(probes: DataFrame, keys: Sequence[str], text: str = "probe") -> DataFrame:
    """keys, index, codec, language, title, default, commentary: a row for each audio stream of a prober's JSON."""
    x = probes.select(*keys, F.explode(F.from_json(text, STREAMS)["streams"]).alias("s"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    title = blank(F.col("s.tags.title"))
    comment = (F.coalesce("s.disposition.comment", F.lit(0)) != 0) | F.contains(F.lower(title), F.lit("comment"))
    return x.select(*keys, "s.index", blank(F.col("s.codec_name")).alias("codec"), blank(F.col("s.tags.language")).alias("language"), title.alias("title"), (F.coalesce("s.disposition.default", F.lit(0)) != 0).alias("default"), comment.alias("commentary"))


def main_audio(streams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, index: the programme's stream: no commentary, the default one if it is marked, else the first."""
    return streams.filter("not commentary").groupBy(*keys).agg(F.min_by("index", F.struct(~F.col("default"), F.col("index"))).alias("index"))


def decoded_text(files: DataFrame, encodings: Sequence[str], content: str = "content") -> DataFrame:
    """files with ``text``: the bytes by the first of the encodings that takes them, null if none does."""

    def ladder(blobs: pd.Series) -> pd.Series:
        def one(data):
            for name in encodings:
                try:
                    return bytes(data).decode(name)
                except UnicodeError:
                    continue
            return None

        return blobs.map(lambda b: None if b is None else one(b))

    return files.withColumn("text", F.pandas_udf(ladder, "string")(F.col(content)))


def lyric_source(spec: Column) -> Column:
    """struct (path, styles, lang) of PATH[#STYLE,STYLE][@LANG]; # and @ count behind the last slash only."""
    behind = lambda text, mark: F.regexp_extract(text, rf"^(.*){mark}([^/{mark}]*)$", 2)
    ahead = lambda text, mark: F.when(text.rlike(rf"{mark}[^/]*$"), F.regexp_replace(text, rf"{mark}[^/{mark}]*$", "")).otherwise(text)
    rest = ahead(spec, "@")
    styles = F.filter(F.transform(F.split(behind(rest, "#"), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.struct(ahead(rest, "#").alias("path"), styles.alias("styles"), F.trim(behind(spec, "@")).alias("lang"))


def lyrics_of_styles(events: DataFrame, styles: Sequence[str] = (), offset: float = 0.0, lang: str = "") -> DataFrame:
    """start, end, text, lang of script events of some styles (all without any), moved from the media's clock to the song's."""
    style = F.lower(F.regexp_replace("style", r"^\*+", ""))
    own = events.filter(style.isin(*[s.lower() for s in styles])) if styles else events
    return own.filter("text <> ''").select((F.col("start") - offset).alias("start"), (F.col("end") - offset).alias("end"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), F.lit(lang).alias("lang")).orderBy("start")


def labels(rows: DataFrame) -> DataFrame:
    """place (from 0), name, kind (rating, general, character) of a tagger's label file (place, name, category)."""
    kind = F.when(F.col("category") == 9, "rating").when(F.col("category") == 0, "general").when(F.col("category") == 4, "character")
    return rows.select("place", "name", kind.alias("kind"))


def tags_of(scores: DataFrame, names: DataFrame, keys: Sequence[str], general: float = 0.35, character: float = 0.85) -> DataFrame:
    """keys, rating, general, character: maps of label to score; general and character labels from their thresholds on.

    scores: keys, scores (array, in the order of labels). names: labels(), a bounded table.
    """
    x = scores.select(*keys, F.posexplode("scores").alias("place", "score")).join(F.broadcast(names), "place")
    take = lambda kind, least: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when((F.col("kind") == kind) & (F.col("score") >= least), F.struct("name", "score"))), lambda e: e.isNotNull())))
    return x.groupBy(*keys).agg(take("rating", float("-inf")).alias("rating"), take("general", general).alias("general"), take("character", character).alias("character"))


def boxes_of(anchors: DataFrame, keys: Sequence[str], width: float, height: float, threshold: float) -> DataFrame:
    """keys, x0, y0, x1, y1 (shares, inside the picture), score of a detector's anchors (cx, cy, w, h, scores) above a threshold."""
    score = F.array_max("scores")
    unit = lambda v, size: F.least(F.greatest(v / size, F.lit(0.0)), F.lit(1.0))
    side = lambda c, d, sign: F.col(c) + sign * F.col(d) / 2
    return anchors.filter(score > threshold).select(*keys, unit(side("cx", "w", -1), width).alias("x0"), unit(side("cy", "h", -1), height).alias("y0"), unit(side("cx", "w", 1), width).alias("x1"), unit(side("cy", "h", 1), height).alias("y1"), score.alias("score"))


def tall_enough(boxes: DataFrame, least: float = 0.06) -> DataFrame:
    """Detections whose boxes are at least so high, as a share of the picture."""
    return boxes.filter(F.col("y1") - F.col("y0") >= least)


def square_around(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, scale: float, lift: float = 0.0) -> Column:
    """struct (left, top, right, bottom) in pixels: a square of ``scale`` times the larger side of a box, inside the picture.

    ``lift`` moves it up by that share of its side.
    """
    side = F.least(F.greatest((x1 - x0) * width, (y1 - y0) * height) * scale, width, height)
    inside = lambda centre, size: F.least(F.greatest(centre - side / 2, F.lit(0.0)), size - side)
    left, top = inside((x0 + x1) / 2 * width, width), inside((y0 + y1) / 2 * height - lift * side, height)
    whole = lambda v: F.bround(v).cast("int")
    return F.struct(whole(left).alias("left"), whole(top).alias("top"), whole(left + side).alias("right"), whole(top + side).alias("bottom"))


def head_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """The square around a face and its hair."""
    return square_around(x0, y0, x1, y1, width, height, 1.8, 0.1)


def input_size(width: Column, height: Column, long_side: int = 640, stride: int = 32) -> Column:
    """struct (width, height) of a detector's input: the long side scaled, both sides whole strides."""
    scale = F.lit(long_side) / F.greatest(width, height)
    whole = lambda v: (F.ceil(v * scale / stride) * stride).cast("int")
    return F.struct(whole(width).alias("width"), whole(height).alias("height"))


def halvings(width: Column, height: Column, to_width: Column, to_height: Column, most: int = 12) -> Column:
    """Array of structs (width, height): a picture halved, to even sizes, while it stays large enough, then brought to size."""
    even = lambda v: (F.bround(v / 2) * 2).cast("int")
    start = F.struct(width.cast("int").alias("w"), height.cast("int").alias("h"), F.array().cast("array<struct<width:int,height:int>>").alias("steps"))

    def step(acc: Column, _: Column) -> Column:
        w, h = even(acc["w"] / 2), even(acc["h"] / 2)
        more = (F.floor(acc["w"] / 2) >= to_width) & (F.floor(acc["h"] / 2) >= to_height)
        return F.when(more, F.struct(w.alias("w"), h.alias("h"), F.concat(acc["steps"], F.array(F.struct(w.alias("width"), h.alias("height")))).alias("steps"))).otherwise(acc)

    last = F.struct(to_width.cast("int").alias("width"), to_height.cast("int").alias("height"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: F.concat(acc["steps"], F.array(last)))


def stored_path(path: Column, root: str) -> Column:
    """A path as documents keep it: relative to the data root where it is under it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def stored_paths(text: Column, root: str) -> Column:
    """A text without the data root in front of its paths."""
    return F.replace(text, F.lit(root.rstrip("/") + "/"), F.lit(""))


def resolved_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def subtitle_file(path: Column) -> Column:
    """The script beside a video."""
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".ass"))


def changed_share(frames: DataFrame, keys: Sequence[str], at: str, pixels: str, least: float = 0.04) -> DataFrame:
    """keys, at, mean, changed: mean difference of a frame's grey values (0 to 1) to the frame before, and share of those that
    differ by more than ``least``; the first frame of a key has 0."""
    was = F.lag(pixels).over(Window.partitionBy(*keys).orderBy(at))
    apart = F.zip_with(pixels, "_was", lambda a, b: F.abs(a - b))
    x = frames.withColumn("_was", was).withColumn("_d", F.when(F.col("_was").isNotNull(), apart))
    total = F.aggregate("_d", F.lit(0.0), lambda s, v: s + v)
    return x.select(*keys, at, F.coalesce(total / F.size(pixels), F.lit(0.0)).alias("mean"), F.coalesce(F.when(F.col("_d").isNotNull(), F.size(F.filter("_d", lambda v: v > least)) / F.size(pixels)), F.lit(0.0)).alias("changed"))


def in_indices(value: Column, indices: Sequence[int]) -> Column:
    """Membership in a list of indices, as a set that the optimizer looks up."""
    return value.isin(*sorted(set(indices))) if indices else F.lit(False)


def in_ranges(value: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Membership in sorted disjoint ranges [start, end): a balanced tree of comparisons, logarithmic in their number."""
    if not ranges:
        return F.lit(False)
    if len(ranges) == 1:
        return (value >= ranges[0][0]) & (value < ranges[0][1])
    middle = len(ranges) // 2
    return F.when(value < ranges[middle][0], in_ranges(value, ranges[:middle])).otherwise(in_ranges(value, ranges[middle:]))


def frame_blocks(audio: DataFrame, keys: Sequence[str], samples: str, frame: int = 512, context: int = 64) -> DataFrame:
    """keys, i, block: an array of samples in frames, zeros behind the end, each behind the last ``context`` samples before it."""
    n = F.ceil(F.size(samples) / F.lit(frame)).cast("int")
    padded = F.concat(F.array_repeat(F.lit(0.0), context), samples, F.array_repeat(F.lit(0.0), frame))
    x = audio.withColumn("_p", padded).filter(F.size(samples) > 0)
    return x.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(F.col("_p"), k * frame + 1, F.lit(context + frame)))).alias("i", "block"))


def chunk_starts(length: Column, chunk: int = 1500, border: int = 6) -> Column:
    """Where windows of a model begin: overlapping by ``border`` at either side, the last one at the end of what there is."""
    step = chunk - 2 * border
    last = F.greatest(F.floor((length - 1) / F.lit(step)), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda k: k * step - border)
    clamped = F.concat(F.slice(starts, F.lit(1), F.size(starts) - 1), F.array((length - (chunk - border)).cast("int")))
    return F.when(length <= 0, F.array().cast("array<int>")).when(length > step, clamped).otherwise(starts)


def sample_span(samples: Column, rate: int, start: Column, end: Column) -> Column:
    """The samples between two times."""
    at = lambda t: F.least(F.bround(t * rate).cast("int"), F.size(samples))
    return F.slice(samples, at(start) + 1, F.greatest(at(end) - at(start), F.lit(0)))
