"""Subtitle scripts, lyrics and cue sheets: read from whole-file texts as rows, written as text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: each file in one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def numbered_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, with its lines (n from 0); a byte-order mark goes."""
    clean = F.regexp_replace(F.col(text), "^\\x{FEFF}+", "")
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(clean, r"\r\n|\n|\r")).alias("n", "line"))


def clock_seconds(text: Column) -> Column:
    """h:m:s, m:s or s as seconds; null if it is none of them."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)


def time_range(text: Column) -> Column:
    """A text a-b as a struct (start, end)."""
    return F.struct(clock_seconds(F.split_part(text, F.lit("-"), F.lit(1))).alias("start"), clock_seconds(F.split_part(text, F.lit("-"), F.lit(2))).alias("end"))


def read_script(files: DataFrame) -> DataFrame:
    """path, n, start, end, style, text: the dialogue events of scripts (path, text), by the fields of their Format line.

    Comments go; override tags in braces are removed, \\N and \\n become line ends, \\h a blank.
    """
    x = numbered_lines(files)
    section = F.when(F.col("line").rlike(r"^\s*\[.*\]\s*$"), F.lower(F.trim("line")))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("section", F.last(section, True).over(w)).filter("section = '[events]'")
    named = F.when(F.col("line").startswith("Format:"), F.transform(F.split(F.expr("substring(line, 8)"), ","), lambda c: F.lower(F.trim(c))))
    x = x.withColumn("format", F.last(named, True).over(w)).filter(F.col("line").startswith("Dialogue:") & F.col("format").isNotNull())
    x = x.withColumn("values", F.split(F.regexp_replace("line", r"^Dialogue:\s*", ""), ",", -1))
    # the last field is the text and may hold commas
    last = F.array_join(F.slice("values", F.size("format"), F.greatest(F.size("values") - F.size("format") + 1, F.lit(0))), ",")
    at = lambda name: F.when(F.array_position("format", name) == F.size("format"), last).otherwise(F.trim(F.try_element_at("values", F.array_position("format", name).cast("int"))))
    text = F.regexp_replace(at("text"), r"\{[^}]*\}", "")
    text = F.trim(F.replace(F.regexp_replace(text, r"\\[Nn]", "\n"), F.lit("\\h"), F.lit(" ")))
    return x.select("path", "n", clock_seconds(at("start")).alias("start"), clock_seconds(at("end")).alias("end"), at("style").alias("style"), text.alias("text"))


def classified(events: DataFrame) -> DataFrame:
    """events with kind (lyrics, dialogue, other) and part (op, ed or null) by style; empty and zero-length ones go."""
    style = F.lower(F.regexp_replace("style", r"^\*+", ""))
    song = F.regexp_extract(style, "^(op|ed)", 1)
    kind = F.when(song != "", "lyrics").when(style.isin("default", "dialogue", "main"), "dialogue").otherwise("other")
    return events.filter("text <> '' and end > start").withColumns({"kind": kind, "part": F.nullif(song, F.lit(""))})


def parts(lines: DataFrame, key: str, pad: float = 2.0, offset: float = 0.0) -> DataFrame:
    """key, kind, start, end: from the first to the last lyric line of each part, widened by pad, moved by offset."""
    return lines.filter("part is not null").groupBy(key, F.col("part").alias("kind")).agg((F.min("start") - pad + offset).alias("start"), (F.max("end") + pad + offset).alias("end"))


def read_lyrics(files: DataFrame, longest: float = 10.0, tail: float = 5.0) -> DataFrame:
    """path, start, end, text: lines of LRC texts (path, text), which end where the next one begins, at most ``longest`` later.

    A line with several stamps repeats; an empty one only ends the one before; offset:ms moves all of them earlier.
    """
    x = numbered_lines(files)
    offset = F.regexp_extract("line", r"\[offset:\s*([+-]?\d+)\s*\]", 1)
    w = Window.partitionBy("path")
    x = x.withColumn("shift", F.coalesce(F.max_by(F.when(offset != "", offset.cast("double") / 1000), F.when(offset != "", F.col("n"))).over(w), F.lit(0.0))).filter(offset == "")
    stamp = r"\[(\d+):(\d+(?:[.:]\d+)?)\]"
    x = x.withColumn("stamp", F.explode(F.regexp_extract_all("line", F.lit(stamp), F.lit(0))))
    seconds = F.regexp_extract("stamp", stamp, 1).cast("double") * 60 + F.replace(F.regexp_extract("stamp", stamp, 2), F.lit(":"), F.lit(".")).cast("double")
    text = F.trim(F.regexp_replace(F.regexp_replace("line", stamp, ""), r"<\d+:\d+(?:[.:]\d+)?>", ""))
    x = x.select("path", "n", "shift", seconds.alias("start"), text.alias("text"))
    following = F.lead("start").over(Window.partitionBy("path").orderBy("start", "n"))
    end = F.least(F.coalesce(following, F.col("start") + tail), F.col("start") + longest)
    return x.withColumn("end", end).filter("text <> ''").select("path", (F.col("start") - F.col("shift")).alias("start"), (F.col("end") - F.col("shift")).alias("end"), "text")


def read_cue(files: DataFrame) -> DataFrame:
    """path, file, number, title, performer, start, end: the tracks of cue sheets (path, text).

    A track begins at INDEX 01 and ends where the next one's pregap (INDEX 00), else its INDEX 01, begins; times are in
    seconds of 75 frames. An unnamed performer is the album's.
    """
    x = numbered_lines(files).withColumn("line", F.trim("line"))
    command = F.upper(F.split_part(F.col("line"), F.lit(" "), F.lit(1)))
    rest = F.trim(F.regexp_replace("line", r"^\S+\s*", ""))
    quoted = F.regexp_extract("line", '"(.*)"', 1)
    value = F.when(F.col("line").rlike('".*"'), quoted).otherwise(rest)
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"c": command, "v": value, "rest": rest})
    x = x.withColumn("track", F.sum(F.when(F.col("c") == "TRACK", 1).otherwise(0)).over(w))
    pieces = F.transform(F.split(F.split_part(F.col("rest"), F.lit(" "), F.lit(2)), ":"), lambda p: p.try_cast("double"))
    time = F.get(pieces, 0) * 60 + F.get(pieces, 1) + F.get(pieces, 2) / 75
    first = lambda c, what: F.max(F.when(F.col("c") == c, what))
    index = lambda k: F.max(F.when((F.col("c") == "INDEX") & (F.split_part(F.col("rest"), F.lit(" "), F.lit(1)).try_cast("int") == k), time))
    tracks = x.groupBy("path", "track").agg(first("FILE", F.when(F.col("line").rlike('".*"'), quoted).otherwise(F.regexp_replace("rest", r"\s+\S+$", ""))).alias("file"), first("TRACK", F.split_part(F.col("rest"), F.lit(" "), F.lit(1)).try_cast("int")).alias("number"), first("TITLE", F.col("v")).alias("title"), first("PERFORMER", F.col("v")).alias("performer"), index(0).alias("gap"), index(1).alias("start"))
    o = Window.partitionBy("path").orderBy("track")
    album = Window.partitionBy("path")
    tracks = tracks.withColumns({"end": F.lead(F.coalesce("gap", "start")).over(o), "file": F.max(F.when(F.col("track") == 0, F.col("file"))).over(album), "album": F.max(F.when(F.col("track") == 0, F.col("performer"))).over(album)})
    return tracks.filter("track > 0").select("path", "file", "number", "title", F.coalesce("performer", "album").alias("performer"), "start", "end")


def srt_clock(seconds: Column) -> Column:
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def script_clock(seconds: Column) -> Column:
    cs = F.greatest(F.lit(0), F.bround(seconds * 100)).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def script_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for a, b in (("{", "("), ("}", ")"), ("\n", "\\N")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clipped(lines: DataFrame, start: float, end: float, shortest: float = 0.2) -> DataFrame:
    """lines within [start, end], on a clock that begins at start; what is left of them is longer than ``shortest``."""
    a, b = F.greatest(F.col("start"), F.lit(start)) - start, F.least(F.col("end"), F.lit(end)) - start
    return lines.withColumns({"start": a, "end": b}).filter(F.col("end") - F.col("start") > shortest)


def srt(lines: DataFrame, key: str) -> DataFrame:
    """key, value: one SRT text for each key, its lines by start."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "text"))
    block = F.concat(n.cast("string"), F.lit("\n"), srt_clock(F.col("start")), F.lit(" --> "), srt_clock(F.col("end")), F.lit("\n"), "text", F.lit("\n"))
    return lines.select(key, n.alias("_n"), block.alias("_b")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_b"))), lambda r: r["_b"]), "\n").alias("value"))
