"""Where lines are heard, which of them can be used, and what speaks for a speaker's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import contained, merged, overlap, overlap_join
from .scenes import shots_in_parts
from .speakers import duration_status
from .vectors import cosine_distance

#: Seconds searched beyond a line's times; kept before and behind what is heard; that lines may overlap at a handover.
SEARCH, LEAD, TAIL, HANDOVER = 0.3, 0.06, 0.12, 0.15
LONGEST = 8.0


def kept_ranges(shots: DataFrame) -> DataFrame:
    """episode_id, start, end: kept shots (start, end in seconds) as ranges, those that meet as one."""
    return merged(shots.filter("status = 'kept'").select("episode_id", "start", "end"), ["episode_id"], "start", "end", 1e-6)


def search_windows(lines: DataFrame, kept: DataFrame, search: float = SEARCH, width: float = 60.0) -> DataFrame:
    """lines (episode_id, id, start, end) that begin in a kept range, with lo and hi: where to look for the voice.

    A line is widened by ``search``, neither into the lines before and behind it nor out of its range.
    """
    starts = lines.groupBy("episode_id", "start").agg(F.max("end").alias("_last"), F.count("*").alias("_n"))
    w = Window.partitionBy("episode_id").orderBy("start")
    before = F.coalesce(F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.when(F.col("_n") > 1, F.col("start")).otherwise(F.coalesce(F.lead("start").over(w), F.lit(float("inf"))))
    around = starts.select("episode_id", "start", before.alias("_before"), behind.alias("_behind"))
    point = lines.join(around, ["episode_id", "start"]).withColumn("_next", F.col("start") + 1e-9)
    ranges = kept.select("episode_id", F.col("start").alias("_ks"), F.col("end").alias("_ke"))
    x = overlap_join(point, ranges, ["episode_id"], ("start", "_next", "_ks", "_ke"), width).filter("_ks <= start and start < _ke")
    lo = F.greatest(F.col("start") - search, F.least("_before", "start"), "_ks")
    hi = F.least(F.col("end") + search, F.greatest("_behind", "end"), "_ke")
    return x.select(*lines.columns, lo.alias("lo"), hi.alias("hi"))


def heard(found: Column, lo: Column, hi: Column) -> Column:
    """struct (start, end): a voice found at (start, end) behind lo, with some room around it but inside of lo and hi."""
    return F.when(found.isNotNull(), F.struct(F.greatest(lo, lo + found["start"] - LEAD).alias("start"), F.least(hi, lo + found["end"] + TAIL).alias("end")))


def overlapped(lines: DataFrame, most: float = HANDOVER, width: float = 10.0) -> DataFrame:
    """id of lines (episode_id, id, start, end) that share more than ``most`` seconds with another one."""
    other = lines.select("episode_id", F.col("id").alias("_o"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    pairs = overlap_join(lines.select("episode_id", "id", "start", "end"), other, ["episode_id"], ("start", "end", "_s", "_e"), width)
    return pairs.filter((F.col("_o") != F.col("id")) & (overlap(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")) > most)).select("id").distinct()


def cut_lines(lines: DataFrame, kept: DataFrame, parts: DataFrame, found: DataFrame, width: float = 60.0) -> DataFrame:
    """line_id, episode_id, start, end, status of dialogue lines inside kept ranges and outside of parts.

    found: line_id, voice (struct start, end in seconds behind lo, null where nothing is heard). A line is silent, else
    overlapped by another, else short, long or clean by the length of its voice.
    """
    inside = contained(lines, kept.select("episode_id", F.col("start").alias("k_start"), F.col("end").alias("k_end")), ["episode_id"], ("start", "end", "k_start", "k_end"), width)
    over = overlap_join(inside.select("episode_id", "id", "start", "end"), parts.select("episode_id", F.col("start").alias("_s"), F.col("end").alias("_e")), ["episode_id"], ("start", "end", "_s", "_e"), width)
    free = inside.join(over.select("id"), "id", "left_anti").select("id")
    x = search_windows(lines, kept).join(free, "id", "left_semi").join(found.select(F.col("line_id").alias("id"), "voice"), "id", "left")
    x = x.withColumn("at", heard(F.col("voice"), F.col("lo"), F.col("hi"))).join(overlapped(lines).withColumn("both", F.lit(True)), "id", "left")
    status = F.when(F.col("at").isNull(), "silent").when(F.col("both"), "overlap").otherwise(duration_status(F.col("at.end") - F.col("at.start")))
    return x.select(F.col("id").alias("line_id"), "episode_id", F.coalesce("at.start", "start").alias("start"), F.coalesce("at.end", "end").alias("end"), status.alias("status"))


def voice_bounds(lines: DataFrame, kept: DataFrame, found: DataFrame) -> DataFrame:
    """id, start, end: where each line is heard; its subtitle times where it is not, or where nothing was looked for."""
    x = search_windows(lines, kept).join(found.select(F.col("line_id").alias("id"), "voice"), "id", "left")
    at = x.select("id", heard(F.col("voice"), F.col("lo"), F.col("hi")).alias("at"))
    return lines.join(at, "id", "left").select("id", F.coalesce("at.start", "start").alias("start"), F.coalesce("at.end", "end").alias("end"))


def mixed(voices: DataFrame, most: float = 0.8, shortest: float = 2.4) -> DataFrame:
    """voices (line_id, start, end, status, first, second: embeddings of their halves) with status mixed where a clean voice of
    at least ``shortest`` seconds has halves that differ."""
    two = (F.col("status") == "clean") & (F.col("end") - F.col("start") >= shortest) & (cosine_distance(F.col("first"), F.col("second")) > most)
    return voices.withColumn("status", F.when(F.coalesce(two, F.lit(False)), "mixed").otherwise(F.col("status")))


def usable_lines(lines: DataFrame, shots: DataFrame, parts: DataFrame, again: DataFrame, named: DataFrame, longest: float = LONGEST, width: float = 60.0) -> DataFrame:
    """line_id, shots, on_screen: dialogue lines that a plan may use: short, in one kept range, outside of parts and recurring shots.

    shots: id, episode_id, start, end, status. again: shot_id. named: shot_id, name. The kept shots outside of parts that a line
    is said over, and the names seen in them, sorted.
    """
    talk = lines.filter((F.col("kind") == "dialogue") & (F.col("end") - F.col("start") <= longest))
    kept = shots.filter("status = 'kept'")
    inside = contained(talk, kept_ranges(shots).select("episode_id", F.col("start").alias("k_start"), F.col("end").alias("k_end")), ["episode_id"], ("start", "end", "k_start", "k_end"), width)
    spans = parts.select("episode_id", "start", "end").unionByName(kept.join(again, kept["id"] == again["shot_id"], "left_semi").select("episode_id", "start", "end"))
    hit = overlap_join(inside.select("episode_id", "id", "start", "end"), spans.select("episode_id", F.col("start").alias("_s"), F.col("end").alias("_e")), ["episode_id"], ("start", "end", "_s", "_e"), width)
    free = inside.join(hit.select("id").distinct(), "id", "left_anti")
    open_ = kept.join(shots_in_parts(kept, parts).select("shot_id"), F.col("id") == F.col("shot_id"), "left_anti")
    over = overlap_join(free.select("episode_id", F.col("id").alias("line_id"), "start", "end"), open_.select("episode_id", F.col("id").alias("shot_id"), F.col("start").alias("_s"), F.col("end").alias("_e")), ["episode_id"], ("start", "end", "_s", "_e"), width)
    seen = over.select("line_id", "shot_id").join(named.select("shot_id", "name"), "shot_id", "left").groupBy("line_id").agg(F.array_sort(F.collect_set("shot_id")).alias("shots"), F.array_sort(F.collect_set("name")).alias("on_screen"))
    none = lambda kind: F.array().cast(kind)
    out = free.select(F.col("id").alias("line_id")).join(seen, "line_id", "left")
    return out.select("line_id", F.coalesce("shots", none("array<bigint>")).alias("shots"), F.coalesce("on_screen", none("array<string>")).alias("on_screen"))


def evidence(members: DataFrame, seeds: DataFrame, found: DataFrame) -> DataFrame:
    """speaker, lines, votes (name, n; most first), matches (name, share, lift; best first): what is known of each speaker.

    members: line_id, speaker. seeds: line_id, name. found: speakers.matches(). Shares count to three digits and lifts to two
    before they are ranked by share * ln(lift); of equal ones the greater name is first.
    """
    lines = members.filter("speaker is not null").groupBy("speaker").agg(F.count("*").alias("lines"))
    votes = seeds.join(members, "line_id").groupBy("speaker", "name").agg(F.count("*").alias("n"))
    votes = votes.groupBy("speaker").agg(F.sort_array(F.collect_list(F.struct(F.col("n"), F.col("name"))), asc=False).alias("_v"))
    x = found.select("speaker", "name", F.bround("share", 3).alias("share"), F.bround("lift", 2).alias("lift")).filter("share > 0")
    worth = F.col("share") * F.log(F.greatest("lift", F.lit(1e-6)))
    best = x.groupBy("speaker").agg(F.sort_array(F.collect_list(F.struct(worth.alias("w"), "name", "share", "lift")), asc=False).alias("_m"))
    out = lines.join(votes, "speaker", "left").join(best, "speaker", "left")
    return out.select("speaker", "lines", F.transform("_v", lambda v: F.struct(v["name"], v["n"])).alias("votes"), F.transform("_m", lambda m: F.struct(m["name"], m["share"], m["lift"])).alias("matches"))


def review(voices: DataFrame, typical: int = 3, doubtful: int = 3) -> DataFrame:
    """speaker_id, lines, seconds, typical, doubtful: the clean lines nearest to a speaker's mean voice and farthest from it."""
    x = clips(voices.filter("status = 'clean' and speaker_id is not null"), "speaker_id")
    w = Window.partitionBy("speaker_id")
    x = x.withColumns({"_near": F.row_number().over(w.orderBy("distance", "line_id")), "_far": F.row_number().over(w.orderBy(F.desc("distance"), "line_id"))})
    few = lambda rank, n: F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col(rank) <= n, F.struct(F.col(rank).alias("r"), F.col("line_id")))), lambda s: s.isNotNull())), lambda s: s["line_id"])
    return x.groupBy("speaker_id").agg(F.count("*").alias("lines"), F.sum(F.col("end") - F.col("start")).alias("seconds"), few("_near", typical).alias("typical"), few("_far", doubtful).alias("doubtful"))


def clips(voices: DataFrame, key: str) -> DataFrame:
    """voices (with embedding) and their distance, to three digits, from the mean embedding of their key."""
    mean = voices.select(key, F.posexplode("embedding").alias("p", "v")).groupBy(key, "p").agg(F.avg("v").alias("v"))
    mean = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("_mean"))
    return voices.join(mean, key).withColumn("distance", F.bround(cosine_distance(F.col("embedding"), F.col("_mean")), 3)).drop("_mean")


def unassigned(voices: DataFrame, most: int = 20) -> DataFrame:
    """The longest clean voices that nobody has."""
    free = voices.filter("status = 'clean' and speaker_id is null")
    return free.withColumn("seconds", F.col("end") - F.col("start")).orderBy(F.desc("seconds"), "line_id").limit(most)


def clip_name(line_id: Column, start: Column, end: Column) -> Column:
    """The file name of a voice's clip, from its line and milliseconds."""
    ms = lambda t: F.bround(t * 1000).cast("long").cast("string")
    return F.concat(F.lit("clips/"), line_id.cast("string"), F.lit("-"), ms(start), F.lit("-"), ms(end), F.lit(".m4a"))


def missing_clips(voices: DataFrame, present: DataFrame) -> DataFrame:
    """episode_id, clips: names of the clips of voices (episode_id, line_id, start, end) that are not present (name), by episode."""
    x = voices.select("episode_id", clip_name(F.col("line_id"), F.col("start"), F.col("end")).alias("name")).join(present.select("name"), "name", "left_anti")
    return x.groupBy("episode_id").agg(F.array_sort(F.collect_list("name")).alias("clips"))


def kept_gain(times: DataFrame, ranges: DataFrame, rate: int, key: str = "episode_id", ramp: float = 0.01) -> DataFrame:
    """times (key, i: numbers of samples) with gain: 1 inside of disjoint ranges (key, start, end in seconds) and 0 outside, with a
    straight ramp inside of each edge."""
    whole = lambda c: F.greatest(F.bround(F.col(c) * rate), F.lit(0)).cast("long")
    r = ranges.select(key, whole("start").alias("_a"), whole("end").alias("_b")).filter("_b > _a")
    x = overlap_join(times.withColumn("_n", F.col("i") + 1), r, [key], ("i", "_n", "_a", "_b"), 10 * rate, "left").drop("_n")
    n = F.least(F.lit(max(1, round(ramp * rate))), F.floor((F.col("_b") - F.col("_a")) / 2))
    edge = F.least(F.col("i") - F.col("_a"), F.col("_b") - 1 - F.col("i"))
    gain = F.when(F.col("_a").isNull(), 0.0).when(edge < n, edge / n).otherwise(1.0)
    return x.withColumn("gain", gain).drop("_a", "_b")
