"""Effects of an edit plan: what a draft adds, what is filled in, what is checked, and how a clip shows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import nearest, overlap_join
from .plans import BEAT_TOLERANCE, _issues

# Sizes and limits of effects. Fixed values.
FLASH_FRAMES, FLASH_STRENGTH, PUNCH_ZOOM, DRIFT_ZOOM = 3, 0.85, 1.12, 1.08
STRONG, AUTO_PUNCH = 0.7, 0.8
PUNCH_MARGIN, AUTO_MARGIN = 0.1, 0.5
DRIFT_SLOT, AUTO_DRIFT_SLOT = 1.0, 1.5
WEAKEST_ONSET = 0.03
FOCUS_X, FOCUS_Y = 0.5, 0.45
KINDS = ("flash", "punch", "drift")
USES = {"flash": ("frames", "strength"), "punch": ("at", "zoom", "focus"), "drift": ("zoom", "focus")}


def strong_accents(slots: DataFrame, beats: DataFrame, least: float = STRONG, margin: float = 0.0, song: str = "song", width: float = 10.0) -> DataFrame:
    """slots (song, start, end, ...) with each beat (song, beat, strength) of at least ``least`` inside of them, ``margin`` off the cuts."""
    hard = beats.filter(F.col("strength") >= least).select(song, F.col("beat").alias("accent_at"), F.col("strength").alias("accent_strength"))
    inside = slots.withColumns({"_lo": F.col("start") + margin - 1e-6, "_hi": F.col("end") - margin + 2e-6}).filter("_lo < _hi")
    marks = hard.withColumn("_next", F.col("accent_at") + 1e-9)
    out = overlap_join(inside, marks, [song], ("_lo", "_hi", "accent_at", "_next"), width)
    return out.filter((F.col("accent_at") >= F.col("_lo")) & (F.col("accent_at") <= F.col("_hi") - 1e-6)).drop("_lo", "_hi", "_next")


def strongest(slots: DataFrame, beats: DataFrame, keys: list[str], least: float = STRONG, margin: float = PUNCH_MARGIN) -> DataFrame:
    """keys, at, strength: the strongest accent that a punch may land on in each slot, the first of equal ones."""
    best = F.max_by(F.struct("accent_at", "accent_strength"), F.struct(F.col("accent_strength"), -F.col("accent_at")))
    return strong_accents(slots, beats, least, margin).groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.accent_at").alias("at"), F.col("_b.accent_strength").alias("strength"))


def at_beat(slots: DataFrame, beats: DataFrame, at: str, name: str, song: str = "song") -> DataFrame:
    """slots with the strength of the beat at a time of theirs, 0 if there is none within BEAT_TOLERANCE, and ``name``_beat."""
    x = nearest(slots, beats.select(song, F.col("beat").alias("_beat"), "strength"), [song], at, "_beat", f"{name}_beat", carry=("strength", "_strength"))
    close = F.abs(F.col(f"{name}_beat") - F.col(at)) <= BEAT_TOLERANCE
    return x.withColumn(name, F.when(close, F.coalesce("_strength", F.lit(0.0))).otherwise(0.0)).drop("_strength")


def on_bar(slots: DataFrame, bars: DataFrame, at: str, name: str, song: str = "song") -> DataFrame:
    """slots with whether a bar line (song, bar) is within BEAT_TOLERANCE of a time of theirs."""
    x = nearest(slots, bars.select(song, F.col("bar").alias("_bar")), [song], at, "_bar", "_line")
    return x.withColumn(name, F.coalesce(F.abs(F.col("_line") - F.col(at)) <= BEAT_TOLERANCE, F.lit(False))).drop("_line")


def calm(slots: DataFrame, motion: DataFrame) -> DataFrame:
    """slots (shot, in, out) with ``calm``: a still shot (shot, still, onsets: array of time, strength) in whose window nothing
    starts to move."""
    m = motion.select(F.col("shot").alias("_shot"), "still", "onsets")
    moved = F.exists("onsets", lambda o: (o["time"] >= F.col("in")) & (o["time"] <= F.col("out")) & (o["strength"] >= WEAKEST_ONSET))
    x = slots.join(m, F.col("shot") == F.col("_shot"), "left")
    return x.withColumn("calm", F.coalesce(F.col("still") & F.col("in").isNotNull() & F.col("out").isNotNull() & ~moved, F.lit(False))).drop("_shot", "still", "onsets")


def source_time(start: Column, source_in: Column, source_out: Column, slot_start: Column, slot_end: Column) -> Column:
    """The episode second that is shown at song second ``start`` of a slot; null without a window."""
    length = slot_end - slot_start
    return source_in + (start - slot_start) * (source_out - source_in) / F.when(length > 0, length)


def suggested(slots: DataFrame, beats: DataFrame, bars: DataFrame, motion: DataFrame, plan: str = "plan") -> DataFrame:
    """plan, slot, kind, at, note: the effects that a draft adds to slots (plan, song, slot, start, end, section, shot, in, out, fx:
    array of kinds that are there).

    A flash on the first cut of a chorus and on its downbeats that hit hard; a punch on the strongest accent well inside; a drift
    where nothing moves, never behind another one: in a row of calm slots every other one drifts, from what stood before it.
    """
    w = Window.partitionBy(plan).orderBy("slot")
    x = calm(on_bar(at_beat(slots, beats, "start", "_hit"), bars, "start", "_bar_line"), motion)
    entry = (F.col("section") == "chorus") & ~(F.lag("section").over(w).eqNullSafe(F.lit("chorus")))
    x = x.withColumns({"_entry": entry, "_down": (F.col("section") == "chorus") & F.col("_bar_line") & (F.col("_hit") >= STRONG)})
    best = strongest(slots, beats, [plan, "slot"], AUTO_PUNCH, AUTO_MARGIN)
    x = x.join(best, [plan, "slot"], "left")
    has = lambda kind: F.array_contains("fx", kind)
    free = F.col("calm") & (F.col("end") - F.col("start") >= AUTO_DRIFT_SLOT) & ~has("drift")
    x = x.withColumns({"_n": F.row_number().over(w), "_free": free})
    fixed = F.when(~F.col("_free"), F.struct(F.col("_n").alias("n"), has("drift").cast("int").alias("d")))
    x = x.withColumn("_anchor", F.last(fixed, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since, was = F.col("_n") - F.coalesce("_anchor.n", F.lit(0)), F.coalesce("_anchor.d", F.lit(0))
    x = x.withColumn("_drift", F.col("_free") & ((was + since) % 2 == 1))
    none = F.lit(None).cast("double")
    rows = F.array(
        F.when(~has("flash") & (F.col("_entry") | F.col("_down")), F.struct(F.lit("flash").alias("kind"), none.alias("at"), F.when(F.col("_entry"), "flash on the chorus entry").otherwise("flash on the chorus downbeat").alias("note"))),
        F.when(~has("punch") & F.col("at").isNotNull(), F.struct(F.lit("punch").alias("kind"), F.col("at"), F.format_string("punch on the accent at %.2fs (%.2f)", F.bround("at", 2), F.bround("strength", 2)).alias("note"))),
        F.when(F.col("_drift"), F.struct(F.lit("drift").alias("kind"), none.alias("at"), F.lit("drift, nothing moves in the shot").alias("note"))),
    )
    return x.select(plan, "slot", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("_e")).select(plan, "slot", "_e.*")


def focus(frames: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y: where the face is that is nearest to the middle of a span (keys, shot, from, to); frames: shot, time, x, y.

    The earlier frame wins a tie; without a face it is a little above the middle.
    """
    seen = frames.filter("x is not null").select(F.col("shot").alias("_shot"), "time", "x", "y")
    middle = (F.col("from") + F.col("to")) / 2
    x = spans.join(seen, F.col("shot") == F.col("_shot"), "left")
    near = F.struct(F.abs(F.col("time") - middle).alias("d"), F.col("time"), F.col("x"), F.col("y"))
    out = x.groupBy(*keys).agg(F.min(F.when(F.col("time").isNotNull() & middle.isNotNull(), near)).alias("_b"))
    return out.select(*keys, F.coalesce(F.bround("_b.x", 3), F.lit(FOCUS_X)).alias("x"), F.coalesce(F.bround("_b.y", 3), F.lit(FOCUS_Y)).alias("y"))


def resolved(fx: DataFrame, slots: DataFrame, beats: DataFrame, frames: DataFrame, plan: str = "plan") -> DataFrame:
    """plan, slot, kind, at, zoom, frames, strength, x, y: effects with what they leave out filled in.

    fx: plan, slot, kind, at, zoom, frames, strength, x, y. A punch lands on the slot's accent, else on its strongest one; zooms go
    toward the face in the slot's window, a punch's at its moment; sizes are the usual ones.
    """
    s = slots.select(plan, "slot", "song", "start", "end", "accent", "shot", "in", "out")
    best = strongest(s, beats, [plan, "slot"]).select(plan, "slot", F.col("at").alias("_best"))
    x = fx.join(s, [plan, "slot"]).join(best, [plan, "slot"], "left")
    kind = F.col("kind")
    x = x.withColumn("at", F.when(kind == "punch", F.coalesce("at", "accent", "_best")).otherwise(F.col("at")))
    moment = source_time(F.col("at"), F.col("in"), F.col("out"), F.col("start"), F.col("end"))
    spans = x.filter("kind <> 'flash'").select(plan, "slot", "kind", "shot", F.when(kind == "punch", moment).otherwise(F.col("in")).alias("from"), F.when(kind == "punch", moment).otherwise(F.col("out")).alias("to"))
    face = focus(frames, spans, [plan, "slot", "kind"]).select(plan, "slot", "kind", F.col("x").alias("_x"), F.col("y").alias("_y"))
    x = x.join(face, [plan, "slot", "kind"], "left")
    zooms = (kind == "drift") | ((kind == "punch") & F.col("at").isNotNull())
    size = F.when(kind == "punch", PUNCH_ZOOM).when(kind == "drift", DRIFT_ZOOM)
    flash = lambda c, v: F.when(kind == "flash", F.coalesce(c, F.lit(v))).otherwise(F.col(c))
    # a focus is given as a whole or not at all
    aim = lambda c: F.coalesce(c, F.when(zooms, F.col(f"_{c}")))
    return x.select(plan, "slot", "kind", "at", F.coalesce("zoom", size).alias("zoom"), flash("frames", FLASH_FRAMES).alias("frames"), flash("strength", FLASH_STRENGTH).alias("strength"), aim("x").alias("x"), aim("y").alias("y"))


def clip_effects(fx: DataFrame, slots: DataFrame, plan: str = "plan") -> DataFrame:
    """plan, slot, flash (frames, strength), drift (zoom, x, y), punch (zoom, x, y, frame): a slot's effects in frames of its clip.

    slots: plan, slot, start, plan_start, fps. Slots without effects have no row.
    """
    frame = lambda t: F.bround((t - F.col("plan_start")) * F.col("fps")).cast("long")
    x = fx.join(slots.select(plan, "slot", "start", "plan_start", "fps"), [plan, "slot"])
    place = [F.coalesce("x", F.lit(FOCUS_X)).alias("x"), F.coalesce("y", F.lit(FOCUS_Y)).alias("y")]
    of = lambda k, s, more=F.lit(True): F.max(F.when((F.col("kind") == k) & more, s)).alias(k)
    out = x.groupBy(plan, "slot").agg(
        of("flash", F.struct(F.coalesce("frames", F.lit(FLASH_FRAMES)).alias("frames"), F.coalesce("strength", F.lit(FLASH_STRENGTH)).alias("strength"))),
        of("drift", F.struct(F.coalesce("zoom", F.lit(DRIFT_ZOOM)).alias("zoom"), *place)),
        of("punch", F.struct(F.coalesce("zoom", F.lit(PUNCH_ZOOM)).alias("zoom"), *place, (frame(F.col("at")) - frame(F.col("start"))).alias("frame")), F.col("at").isNotNull()),
    )
    return out.filter("flash is not null or drift is not null or punch is not null")


def described(fx: DataFrame, keys: list[str]) -> DataFrame:
    """keys, words: a slot's effects (kind, at, zoom) in a few words, in the order of place."""
    words = F.when((F.col("kind") == "punch") & F.col("at").isNotNull(), F.format_string("punch %.2fx at %.2fs", F.bround(F.coalesce("zoom", F.lit(PUNCH_ZOOM)), 2), F.bround("at", 2)))
    words = words.when(F.col("kind") == "drift", F.format_string("drift to %.2fx", F.bround(F.coalesce("zoom", F.lit(DRIFT_ZOOM)), 2))).otherwise(F.col("kind"))
    return fx.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", words.alias("w")))), lambda s: s["w"]), ", ").alias("words"))


def zoom_at(frame: Column, frames: Column, drift_zoom: Column, punch_zoom: Column, punch_frame: Column, fps: Column, attack: int = 2, release: float = 0.4) -> Column:
    """How far a clip is zoomed in at a frame (from 0): a drift grows evenly, a punch rises to its frame and eases back."""
    drift = F.coalesce(F.pow(drift_zoom, frame / F.greatest(F.lit(1), frames - 1)), F.lit(1.0))
    back = F.greatest(F.lit(1.0), F.bround(fps * release))
    rise = F.when(frame <= punch_frame - attack, 0.0).when(frame <= punch_frame, 1 - F.pow(1 - (frame - punch_frame + attack) / attack, 2)).otherwise(F.pow(F.greatest(F.lit(0.0), 1 - (frame - punch_frame) / back), 2))
    return drift * F.coalesce(1 + (punch_zoom - 1) * rise, F.lit(1.0))


def flash_at(frame: Column, frames: Column, strength: Column) -> Column:
    """How white a clip is at a frame (from 0): fading to nothing over the flash's frames."""
    return F.greatest(F.lit(0.0), F.coalesce(strength * (1 - frame / frames), F.lit(0.0)))


def effect_issues(fx: DataFrame, slots: DataFrame, beats: DataFrame, plan: str = "plan") -> DataFrame:
    """plan, slot, level, code. fx: plan, slot, place, kind, at, zoom, frames, strength, x, y. slots: plan, slot, song, start, end,
    accent, fps. beats: song, beat, strength (null: not measured)."""
    s = slots.select(plan, "slot", "song", "start", "end", "accent", "fps")
    best = strongest(s, beats, [plan, "slot"]).select(plan, "slot", F.col("at").alias("_best"))
    x = fx.join(s, [plan, "slot"]).join(best, [plan, "slot"], "left")
    x = x.withColumn("_use", F.row_number().over(Window.partitionBy(plan, "slot", "kind").orderBy("place")))
    x = nearest(x, beats.select("song", F.col("beat").alias("_beat"), F.col("strength").alias("_of")), ["song"], "at", "_beat", "_near", carry=("_of", "_hits"))
    kind, known = F.col("kind"), F.col("kind").isin(*KINDS)
    given = {"at": F.col("at").isNotNull(), "zoom": F.col("zoom").isNotNull(), "frames": F.col("frames").isNotNull(), "strength": F.col("strength").isNotNull(), "focus": F.col("x").isNotNull()}
    ignored = [("warning", "fx.ignored", (kind == k) & given[name]) for k, own in USES.items() for name in given if name not in own]
    length, at = F.col("end") - F.col("start"), F.col("at")
    punch, placed = kind == "punch", (kind == "punch") & F.col("at").isNotNull()
    inside = placed & (at >= F.col("start") + 2 / F.col("fps")) & (at < F.col("end") - 1 / F.col("fps"))
    beat = inside & F.coalesce(F.abs(F.col("_near") - at) <= BEAT_TOLERANCE, F.lit(False))
    marked = F.coalesce(F.abs(F.col("accent") - at) <= BEAT_TOLERANCE, F.lit(False))
    nothing = F.col("accent").isNull() & F.col("_best").isNull()
    rules = [
        ("error", "fx.unknown", ~known), ("error", "fx.repeat", known & (F.col("_use") > 1)), *ignored,
        ("error", "fx.zoom", known & (kind != "flash") & ~((F.col("zoom") > 1.0) & (F.col("zoom") <= 1.3))), ("error", "fx.frames", (kind == "flash") & ~F.col("frames").between(1, 4)),
        ("error", "fx.strength", (kind == "flash") & ~((F.col("strength") > 0) & (F.col("strength") <= 1))), ("error", "fx.focus", known & (kind != "flash") & ~(F.col("x").between(0, 1) & F.col("y").between(0, 1))),
        ("warning", "fx.short", (kind == "drift") & (length < DRIFT_SLOT)),
        ("error", "fx.accent", punch & at.isNull() & nothing), ("warning", "fx.at", punch & at.isNull() & ~nothing), ("error", "fx.at", placed & ~inside),
        ("error", "fx.accent", inside & ~beat), ("error", "fx.accent", beat & (F.col("_hits") < STRONG) & ~marked),
    ]
    return _issues(x, [plan, "slot"], rules)
