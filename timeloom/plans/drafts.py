"""First drafts of plans: reasons and scores, alternating framings, windows on frames, and voices."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import framing, section_score
from .plans import FASTEST, SLOWEST, assign, snapped

# How much a tag counts as a smile. Fixed values.
SMILES = {"smile": 1.0, ":d": 0.9, "^_^": 0.9, "laughing": 0.8, "grin": 0.5}
EDGE_FRAMES, SLACK = 2, 0.01


def smile(tags: Column) -> Column:
    """Weighted smile tags of a map of tags to scores."""
    total = F.lit(0.0)
    for tag, weight in SMILES.items():
        total = total + weight * F.coalesce(F.try_element_at(tags, F.lit(tag)), F.lit(0.0))
    return total


def top_tags(tags: Column, count: int = 3) -> Column:
    """The strongest tags of a map as a text; neutral without any."""
    ranked = F.slice(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("t")))), 1, count)
    text = F.array_join(F.transform(ranked, lambda r: F.concat(r["t"], F.lit(" "), F.format_string("%.2f", F.bround(-r["o"], 2)))), ", ")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("neutral"))


def score(section: Column, closing: Column, cute: Column, face: Column, peak_face: Column, presence: Column, tags: Column, talking: Column) -> Column:
    """How well a shot suits a slot; the closing slot wants the best smile."""
    size, tears = F.greatest(face, peak_face), F.coalesce(F.try_element_at(tags, F.lit("tears")), F.lit(0.0))
    return F.when(closing, 1.5 * smile(tags) + size + 0.3 * cute).otherwise(section_score(section, cute, size, presence, tears, talking, framing(face)))


def reason(section: Column, closing: Column, face: Column, tags: Column) -> Column:
    look = F.concat(framing(face), F.lit(", "), top_tags(tags))
    why = F.when(closing, "closing on her best smile: ").when(section == "chorus", "chorus wants the cutest: ").when(section.isin("pre-chorus", "bridge"), F.concat(section, F.lit(" builds up: ")))
    why = why.when(section == "intro", "intro sets the scene: ").otherwise(F.concat(section, F.lit(": an everyday moment, ")))
    return F.concat(why, look)


def described(face: Column, presence: Column, others: Column, expressions: Column) -> Column:
    """A candidate in a few words; expressions: array of struct (tag, peak)."""
    tags = F.array_join(F.transform(F.slice(expressions, 1, 5), lambda t: F.concat(t["tag"], F.lit(" "), F.format_string("%.2f", F.bround(t["peak"], 2)))), ", ")
    with_ = F.when(F.size(others) > 0, F.concat(F.lit("; with "), F.array_join(others, ", "))).otherwise("")
    return F.concat(framing(face), F.lit(", "), F.bround(presence * 100).cast("int").cast("string"), F.lit("% on screen"), with_, F.lit("; "), F.coalesce(F.nullif(tags, F.lit("")), F.lit("neutral")))


def peaks(frames: DataFrame) -> DataFrame:
    """shot, time, cuteness, face, tags: the cutest frame (shot, time, cuteness, face, tags) that shows the face, else of all."""
    best = F.max_by(F.struct("time", "cuteness", "face", "tags"), F.struct(F.col("face") > 0, F.col("cuteness"), F.col("face"), -F.col("time")))
    return frames.groupBy("shot").agg(best.alias("_b")).select("shot", "_b.*")


def usable(start: Column, end: Column, fps: Column) -> tuple[Column, Column]:
    """What a clip may show of a shot: all but two frames at either end."""
    return start + EDGE_FRAMES / fps, end - EDGE_FRAMES / fps


def fits(start: Column, end: Column, fps: Column, seconds: Column) -> Column:
    first, last = usable(start, end, fps)
    return last - first >= seconds * SLOWEST


def alternated(picks: DataFrame, fitting: DataFrame, plan: str = "plan") -> DataFrame:
    """plan, slot, shot: picks put into story order inside of each stretch of one section, with framings that change.

    picks: plan, slot, run (the stretch), shot, order (of the story), frame (framing); the closing slot is a stretch of its own.
    fitting: plan, slot, shot. Each slot takes the earliest shot of its stretch that fits; if that leaves a slot empty the picks
    stay as they are. Where three framings in a row are equal, the third changes places with the next later pick of another
    framing if both fit. A plan's slots meet in one row.
    """
    rows = picks.groupBy(plan).agg(F.collect_list(F.struct("slot", "run", "shot", "order", "frame")).alias("picks"))
    may = fitting.groupBy(plan).agg(F.collect_list(F.struct("slot", "shot")).alias("fits"))
    return _alternated(rows.join(may, plan, "left"), plan)


def _alternated(plans: DataFrame, plan: str) -> DataFrame:
    """alternated() of rows that hold a plan's picks and what fits, of which only the shots that are picked matter."""
    last = lambda v: (v is None or v != v, v)

    def run(picks: list[dict], may: set) -> list:
        look, out = {p["shot"]: p["frame"] for p in picks}, []
        places, waiting = [p["slot"] for p in picks], [p["shot"] for p in sorted(picks, key=lambda p: (last(p["order"]), p["shot"]))]
        for place in places:
            at = next((i for i, s in enumerate(waiting) if (place, s) in may), None)
            if at is None:
                return [p["shot"] for p in picks]
            out.append(waiting.pop(at))
        for i in range(2, len(out)):
            if len({look[s] for s in out[i - 2 : i + 1]}) == 1:
                swap = next((j for j in range(i + 1, len(out)) if look[out[j]] != look[out[i]] and (places[i], out[j]) in may and (places[j], out[i]) in may), None)
                if swap is not None:
                    out[i], out[swap] = out[swap], out[i]
        return out

    def whole(batches):
        for batch in batches:
            keys, slots, shots = [], [], []
            for row, (picks, fits) in enumerate(zip(batch.column("picks").to_pylist(), batch.column("fits").to_pylist())):
                may, runs = {(f["slot"], f["shot"]) for f in fits or ()}, {}
                for p in sorted(picks, key=lambda p: p["slot"]):
                    runs.setdefault(p["run"], []).append(p)
                for own in runs.values():
                    keys += [row] * len(own)
                    slots += [p["slot"] for p in own]
                    shots += run(own, may)
            yield pa.record_batch([batch.column(plan).take(pa.array(keys, pa.int64())), pa.array(slots, pa.int64()), pa.array(shots, pa.int64())], [plan, "slot", "shot"])

    taken = F.transform("picks", lambda p: p["shot"])
    x = plans.select(plan, "picks", F.filter("fits", lambda f: F.array_contains(taken, f["shot"])).alias("fits"))
    return x.mapInArrow(whole, f"{plan} {dict(plans.dtypes)[plan]}, slot long, shot long")


def arranged(pairs: DataFrame, plan: str = "plan") -> DataFrame:
    """plan, slot, shot: assign() and then alternated(). pairs: plan, slot, section, closing, shot, score, order, frame of all that fit.

    Pairs are gone through once: assign() carries them along, so a plan's pairs meet in one row and are not joined again.
    """
    x = assign(pairs, plan, ("section", "closing", "order", "frame"))
    # a pick with what its pair says, in the order of slots
    picks = F.array_sort(F.filter("_pairs", lambda p: F.exists("_taken", lambda t: (t["slot"] == p["slot"]) & (t["shot"] == p["shot"]))))
    kind = lambda p: F.struct(p["section"], p["closing"])
    x = x.filter("_taken is not null").select(plan, picks.alias("_picks"), "_pairs")
    before = lambda i: F.get("_picks", i - 1)
    new = F.transform("_picks", lambda p, i: F.when((i > 0) & (kind(before(i)) == kind(p)), 0).otherwise(1))
    x = x.withColumn("_new", new)
    run = lambda i: F.aggregate(F.slice("_new", F.lit(1), i + 1), F.lit(0), lambda n, v: n + v)
    own = F.transform("_picks", lambda p, i: F.struct(p["slot"].alias("slot"), run(i).alias("run"), p["shot"].alias("shot"), p["order"].alias("order"), p["frame"].alias("frame")))
    return _alternated(x.select(plan, own.alias("picks"), F.transform("_pairs", lambda p: F.struct(p["slot"], p["shot"])).alias("fits")), plan)


def drafted(slots: DataFrame, picks: DataFrame, candidates: DataFrame, plan: str = "plan") -> DataFrame:
    """plan, slot, start, end, section, shot, episode, why: every slot with its shot and the reason for it; windows are open."""
    c = candidates.select("shot", "path", "face", "tags")
    x = slots.join(picks, [plan, "slot"]).join(c, "shot")
    return x.select(plan, "slot", "start", "end", "section", "shot", F.col("path").alias("episode"), reason(F.col("section"), F.col("closing"), F.col("face"), F.col("tags")).alias("why"))


def floor_frame(t: Column, fps: Column) -> Column:
    return F.floor(t * fps + SLACK) / fps


def ceil_frame(t: Column, fps: Column) -> Column:
    return F.ceil(t * fps - SLACK) / fps


def refined(slots: DataFrame, candidates: DataFrame, beats: DataFrame, sections: DataFrame, plan: str = "plan") -> DataFrame:
    """plan, slot, start, end, in, out, speed, section, episode, moved, filled: slots on beats, with a window of whole frames.

    slots: plan, song, slot, start, end, shot, in, out, speed, section, episode. candidates: shot, path, start, end, fps, peak.
    beats: song, beat (with 0 and the song's end). sections: song, label, start, end. A window that is there keeps its length; one
    with a beginning only gets a length at its speed; a missing one is centred on the peak, inside of the usable shot, slowed to
    SLOWEST at most. Slots without a known shot keep what they have.
    """
    x = snapped(slots.withColumns({"_s0": F.col("start"), "_e0": F.col("end")}), beats, "song", own=[plan, "slot"])
    moved = (F.abs(F.col("start") - F.col("_s0")) > 1e-3) | (F.abs(F.col("end") - F.col("_e0")) > 1e-3)
    c = candidates.select(F.col("shot").alias("_shot"), "path", F.col("start").alias("c_start"), F.col("end").alias("c_end"), "fps", "peak")
    x = x.withColumn("moved", moved).join(c, F.col("shot") == F.col("_shot"), "left")
    first, last = usable(F.col("c_start"), F.col("c_end"), F.col("fps"))
    seconds, room = F.col("end") - F.col("start"), last - first
    speed = F.when(room >= seconds, 1.0).otherwise(F.greatest(F.lit(SLOWEST), room / F.when(seconds > 0, seconds)))
    length = seconds * speed
    begin = F.least(F.greatest(F.col("peak") - length / 2, first), F.greatest(first, last - length))
    whole = F.when(floor_frame(begin, F.col("fps")) < first - 1e-6, ceil_frame(begin, F.col("fps"))).otherwise(floor_frame(begin, F.col("fps")))
    given = F.col("in").isNotNull()
    at = F.when(given, floor_frame(F.col("in"), F.col("fps"))).otherwise(whole)
    own = F.least(F.lit(FASTEST), F.greatest(F.lit(SLOWEST), F.coalesce("speed", F.lit(1.0))))
    lasts = F.when(given & F.col("out").isNotNull(), F.col("out") - F.col("in")).when(given, seconds * own).otherwise(length)
    able = F.col("_shot").isNotNull() & (seconds > 0)
    x = x.withColumns({"_at": at, "_len": lasts, "_able": able})
    x = section_at(x.withColumn("t", F.col("start")), sections, [plan, "slot"])
    put = lambda new, old: F.when(F.col("_able"), new).otherwise(F.col(old)).alias(old)
    return x.select(
        plan, "slot", "start", "end", put(F.bround("_at", 4), "in"), put(F.bround(F.col("_at") + F.col("_len"), 4), "out"), put(F.bround(F.col("_len") / F.when(seconds > 0, seconds), 4), "speed"),
        F.when(F.col("_able"), F.coalesce(F.nullif("section", F.lit("")), "_label", F.lit(""))).otherwise(F.col("section")).alias("section"), F.when(F.col("_able"), F.coalesce(F.nullif("episode", F.lit("")), "path")).otherwise(F.col("episode")).alias("episode"),
        "moved", (F.col("_able") & ~given).alias("filled"),
    )


def section_at(points: DataFrame, sections: DataFrame, keys: list[str], song: str = "song", width: float = 30.0) -> DataFrame:
    """points, told apart by keys, with _label: the section that a time t of each is in, null if none. Points are gone through once."""
    bucket = lambda c: F.floor(c / width).cast("long")
    p = points.withColumn("_p", F.col("t") + 1e-6).withColumn("_w", bucket(F.col("_p")))
    s = sections.select(F.col(song).alias("_song"), F.col("label").alias("_l"), F.col("start").alias("_a"), F.col("end").alias("_b")).filter("_a < _b")
    s = s.withColumn("_v", F.explode(F.sequence(bucket(F.col("_a")), bucket(F.col("_b")))))
    x = p.join(s, (F.col(song) == F.col("_song")) & (F.col("_w") == F.col("_v")) & (F.col("_a") <= F.col("_p")) & (F.col("_p") < F.col("_b")), "left")
    by = [song, "_w", *[k for k in keys if k != song]]
    return x.groupBy(*by).agg(*[F.first(c).alias(c) for c in points.columns if c not in by], F.min_by("_l", "_a").alias("_label")).drop("_w")


def slot_frames(start: Column, end: Column, plan_start: Column, fps: Column) -> Column:
    """Frames of a slot, counted from the plan's start, so that each cut is on the frame nearest to it."""
    return (F.bround((end - plan_start) * fps) - F.bround((start - plan_start) * fps)).cast("long")


def duration(slots: DataFrame, plan: str = "plan") -> DataFrame:
    """plan, frames, seconds of all slots (plan, start, end, fps)."""
    first = F.min("start").over(Window.partitionBy(plan))
    x = slots.withColumn("_n", slot_frames(F.col("start"), F.col("end"), first, F.col("fps")))
    return x.groupBy(plan).agg(F.sum("_n").alias("frames"), (F.sum("_n") / F.max("fps")).alias("seconds"))


def refined_voices(voices: DataFrame, lines: DataFrame, bounds: DataFrame, plan: str = "plan") -> DataFrame:
    """voices (plan, voice, line, episode, in, out, text, ...) with what they lack from their line (line, path, text) and from where
    it is heard (id, start, end); unknown lines change nothing."""
    known = lines.select(F.col("line").alias("_line"), F.col("path").alias("_path"), F.col("text").alias("_text"))
    at = bounds.select(F.col("id").alias("_id"), F.bround("start", 3).alias("_from"), F.bround("end", 3).alias("_to"))
    x = voices.join(known, F.col("line") == F.col("_line"), "left").join(at, F.col("line") == F.col("_id"), "left")
    open_ = F.col("_line").isNotNull() & (F.col("in").isNull() | F.col("out").isNull())
    words = F.trim(F.regexp_replace("_text", r"\s+", " "))
    changed = {"in": F.when(open_, F.col("_from")).otherwise(F.col("in")), "out": F.when(open_, F.col("_to")).otherwise(F.col("out")), "episode": F.coalesce(F.nullif("episode", F.lit("")), "_path"), "text": F.coalesce(F.nullif("text", F.lit("")), words)}
    return x.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in voices.columns])


def motion_summary(onsets: Column, moving: Column, still: Column, most: int = 3) -> Column:
    """struct (still, moving, onsets): the strongest movements of a shot, in the order of time."""
    best = F.slice(F.array_sort(F.transform(onsets, lambda o: F.struct((-o["strength"]).alias("o"), o["time"].alias("time")))), 1, most)
    return F.struct(still.alias("still"), F.bround(moving, 2).alias("moving"), F.array_sort(F.transform(best, lambda b: F.struct(F.bround(b["time"], 2).alias("time"), F.bround(-b["o"], 3).alias("strength")))).alias("onsets"))


def excerpt_between(edges: DataFrame, spans: DataFrame, song: str = "song", width: float = 10.0) -> DataFrame:
    """spans (song, start, end) moved to the nearest edge (song, edge), the earlier one on a tie; an error where nothing is left.

    A song may have any number of spans: they are dealt by time too, in buckets of ``width``.
    """
    x = snapped(spans, edges.select(song, F.col("edge").alias("beat")), song, width)
    return x.withColumn("end", F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.raise_error(F.lit("the excerpt is shorter than a bar"))))


def clipped_sections(sections: DataFrame, spans: DataFrame, song: str = "song") -> DataFrame:
    """The sections of a song inside of its excerpt (song, start, end), cut at its edges."""
    e = spans.select(song, F.col("start").alias("_a"), F.col("end").alias("_b"))
    x = sections.join(e, song).filter((F.col("end") > F.col("_a")) & (F.col("start") < F.col("_b")))
    return x.withColumns({"start": F.greatest("start", "_a"), "end": F.least("end", "_b")}).drop("_a", "_b")


def beat_grid(beats: DataFrame, songs: DataFrame, song: str = "song") -> DataFrame:
    """song, beat: a song's beats, its beginning and its end, once each."""
    ends = songs.select(song, F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("beat"))
    return beats.select(song, "beat").unionByName(ends).distinct()
