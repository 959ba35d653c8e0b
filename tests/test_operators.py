import datetime
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom import schema
from timeloom.functions import scalars
from timeloom.operators import intervals as iv
from timeloom.operators import library as lib
from timeloom.operators import overrides, speakers, stages
from timeloom.operators import sequences as seq
from timeloom.operators import vectors as vec
from timeloom.plans import effects, plans


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_overlap_is_half_open_and_pairs_come_once(spark):
    a = spark.createDataFrame([("k", 0.0, 10.0), ("k", 10.0, 30.0), ("other", 0.0, 100.0), ("k", 40.0, 41.0)], "k string, s double, e double")
    b = spark.createDataFrame([("k", 9.0, 10.0, 1), ("k", 10.0, 10.5, 2), ("k", 5.0, 25.0, 3)], "k string, t double, u double, id int")
    for width in (1.0, 7.0, 1000.0):
        assert rows(iv.overlap_join(a, b, ["k"], ("s", "e", "t", "u"), width), "s", "id") == [(0.0, 1), (0.0, 3), (10.0, 2), (10.0, 3)]
    left = iv.overlap_join(a, b, ["k"], ("s", "e", "t", "u"), 7.0, "left")
    assert left.filter("id is null").count() == 2 and left.count() == 6


def test_containment_needs_one_range(spark):
    a = spark.createDataFrame([("k", 1.0, 3.0), ("k", 3.0, 6.0)], "k string, s double, e double")
    r = spark.createDataFrame([("k", 0.0, 4.0), ("k", 4.0, 8.0)], "k string, t double, u double")
    assert rows(iv.contained(a, r, ["k"], ("s", "e", "t", "u"), 2.0), "s") == [(1.0,)]
    assert rows(iv.contained(a, iv.merged(r, ["k"], "t", "u", 0, True), ["k"], ("s", "e", "t", "u"), 2.0), "s") == [(1.0,), (3.0,)]


def test_merge_complement_and_nearest(spark):
    x = spark.createDataFrame([("k", 1.0, 9.0), ("k", 2.0, 3.0), ("k", 9.04, 10.0), ("k", 12.0, 13.0)], "k string, s double, e double")
    merged = iv.merged(x, ["k"], "s", "e", 0.05)
    assert rows(merged, "s", "e") == [(1.0, 10.0), (12.0, 13.0)]
    bounds = spark.createDataFrame([("k", 0.0, 20.0), ("none", 0.0, 2.0)], "k string, lo double, hi double")
    free = iv.complement(merged, bounds, ["k"], "s", "e", 0.8)
    assert rows(free) == [("k", 0.0, 1.0, "intro"), ("k", 10.0, 12.0, "between"), ("k", 13.0, 20.0, "outro"), ("none", 0.0, 2.0, "whole")]
    points = spark.createDataFrame([("k", 0.0), ("k", 1.5), ("k", 1.6), ("k", 9.0), ("z", 1.0)], "k string, t double")
    grid = spark.createDataFrame([("k", 1.0), ("k", 2.0)], "k string, g double")
    assert [r["nearest"] for r in iv.nearest(points, grid, ["k"], "t", "g").orderBy("k", "t").collect()] == [1.0, 1.0, 2.0, 2.0, None]


def test_scene_cap_looks_at_the_current_scene(spark):
    x = spark.createDataFrame([("e", float(t), float(t + 40), t) for t in (0, 40, 80, 120, 160)], "k string, s double, e double, id int")
    out = seq.capped_sessions(x, ["k"], "s", "e", 1000.0, 90.0, "id")
    assert [r["n"] for r in out.orderBy("s").collect()] == [2, 2, 1]


def test_threshold_segments(spark):
    p = [0.0] * 20
    for i, v in ((4, 0.9), (10, 0.8), (11, 0.9), (12, 0.7)):
        p[i] = v
    frames = lambda v: spark.createDataFrame([("e", i, float(x)) for i, x in enumerate(v)], "k string, i int, v double")
    cut = lambda v: rows(seq.threshold_segments(frames(v), ["k"], "i", "v", 0.5), "start", "end")
    assert cut(p) == [(0, 5), (5, 11), (13, 20)]
    assert cut([0.9, 0.9, 0.1, 0.1]) == [(2, 4)] and cut([0.9] * 3) == [(0, 3)] and cut([0.1] * 3) == [(0, 3)]


def test_peaks_edges_onsets_runs(spark):
    logit = [-1.0] * 200
    for i in (10, 11, 60, 110, 160):
        logit[i] = 2.0
    x = spark.createDataFrame([("s", i, v) for i, v in enumerate(logit)], "k string, i int, v double")
    assert [r["i"] for r in seq.peaks(x, ["k"], "i", "v").orderBy("i").collect()] == [10.5, 60.0, 110.0, 160.0]
    assert rows(seq.rising_edges(x, ["k"], "i", "v", 0.0), "i") == [(10,), (60,), (110,), (160,)]
    changed = [0.0] * 60
    for i in (1, 2, 3, 10, 12, 14, 30, 31, 32):
        changed[i] = 0.02 + i / 1000
    y = spark.createDataFrame([("s", i, v) for i, v in enumerate(changed)], "k string, i int, v double")
    got = rows(seq.onsets(y, ["k"], "i", "v", 0.015), "i", "strength")
    assert got == [(10, pytest.approx(0.034)), (30, pytest.approx(0.052))]
    assert rows(seq.loud_runs(y, ["k"], "i", "v", 0.06, 6), "start", "end") == [(0, 60)]


def test_samples(spark):
    n = spark.createDataFrame([("a", i) for i in range(23)] + [("b", i) for i in range(4)], "k string, i int")
    out = seq.evenly_spaced(n, ["k"], ["i"], 7)
    assert rows(out.filter("k = 'a'"), "i") == [(int(k * 23 / 7),) for k in range(7)] and out.filter("k = 'b'").count() == 4
    spans = spark.createDataFrame([(0, 48), (100, 101), (5, 5)], "s long, e long")
    assert rows(seq.sample_frames(spans, "s", "e", 24.0), "s", "frame") == [(0, 6), (0, 18), (0, 30), (0, 42), (100, 100)]


def test_fill_merge_and_means(spark):
    x = spark.createDataFrame([("e", i, m) for i, m in enumerate(["op", None, "op", None, "ed", None, None, "ed"])], "k string, i int, m string")
    assert [r["filled"] for r in seq.neighbour_fill(x, ["k"], ["i"], "m").orderBy("i").collect()] == ["op", "op", "op", None, "ed", None, None, "ed"]
    s = spark.createDataFrame([("s", 0, "verse", 4.0, 1.0), ("s", 4, "verse", 12.0, 3.0), ("s", 16, "chorus", 8.0, 5.0)], "k string, bar int, label string, bars double, loud double")
    assert rows(seq.merge_runs(s, ["k"], "bar", "label", "bars", ["loud"]), "bar", "bars", "loud") == [(0, 16.0, 2.5), (16, 8.0, 5.0)]
    frames = spark.createDataFrame([("s", float(i), float(i)) for i in range(10)], "k string, t double, v double")
    bars = spark.createDataFrame([("s", 0, 0.0, 4.0), ("s", 1, 4.0, 8.0)], "k string, bar int, start double, end double")
    assert rows(seq.bucketed_mean(frames, bars, ["k"], "t", "v"), "bar", "v", "n") == [(0, 1.5, 4), (1, 5.5, 4)]
    lag = seq.best_lag(seq.lag_products(frames.withColumn("v", (F.col("t") == 3).cast("double")).withColumn("t", F.col("t").cast("int")), frames.withColumn("v", (F.col("t") == 5).cast("double")).withColumn("t", F.col("t").cast("int")), ["k"], "t", "v", 4), ["k"])
    assert lag.first()["lag"] == 2


def test_cast_and_tags(spark):
    frames = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)], "shot int, frame_id int")
    faces = spark.createDataFrame([(1, 1, 7, 0.1, 0.3, 0.1, 0.5), (1, 1, 7, 0.1, 0.2, 0.1, 0.3), (1, 2, 7, 0.5, 0.6, 0.5, 0.6), (1, 2, None, 0.0, 1.0, 0.0, 1.0)], "shot int, frame_id int, cluster_id int, x0 double, x1 double, y0 double, y1 double")
    r = lib.shot_cast(faces, frames, ["shot"]).first()
    assert (r["cluster_id"], r["presence"]) == (7, 0.5) and r["height"] == pytest.approx(0.4) and r["area"] == pytest.approx((0.08 + 0.02 + 0.01) / 3)
    tags = spark.createDataFrame([(1, 1, "smile", 0.8), (1, 2, "smile", 0.4), (1, 2, "blush", 0.5)], "shot int, frame_id int, tag string, score double")
    assert rows(lib.tag_stats(tags, frames, ["shot"]), "tag", "peak", "share") == [("blush", 0.5, 0.25), ("smile", 0.8, 0.5)]
    assert rows(lib.top_tags(tags, frames, ["shot"], 1), "tag") == [("smile",)]
    assert rows(lib.tag_maps(frames, tags, ["smile"]).withColumn("n", F.size("scores")), "frame_id", "n") == [(1, 1), (2, 1), (3, 0), (4, 0)]
    status = spark.createDataFrame([("e", "kept")], "e string, status string")
    assert rows(lib.counts_filled(status, ["e"], "status", schema.SHOT_STATUS)) == [("e", "dropped", 0), ("e", "kept", 1), ("e", "pending", 0)]
    people = spark.createDataFrame([(1, "7"), (7, "Ann"), (8, None)], "id long, name string")
    assert lib.find(people, "7").first()["id"] == 1 and lib.find(people, "#8").first()["id"] == 8 and lib.find(people, "Bob").count() == 0


def test_scene_continuity(spark):
    red, blue, half = [1.0] + [0.0] * 3, [0.0, 1.0, 0.0, 0.0], [0.65, 0.35, 0.0, 0.0]
    facts = [(1, 0, True, None, [1], 0.0, 2.0, ["a"], red), (1, 1, True, None, [1], 2.0, 3.0, ["b"], blue), (1, 2, True, None, [], None, None, ["c"], red), (1, 3, True, None, [], None, None, ["c"], half), (1, 4, True, "op", [], None, None, ["c"], half), (1, 5, False, "op", [], None, None, ["c"], half)]
    df = spark.createDataFrame(facts, "episode_id int, idx int, kept boolean, part string, line_ids array<int>, first_line double, last_line double, cast array<string>, colours array<double>")
    assert [r["continues"] for r in lib.scenes(df).orderBy("idx").collect()] == [False, True, False, True, False, False]


def test_vectors(spark):
    angles = [0, 0.05, 0.1, 0.12, 2, 2.05, 2.1, 2.12, 4]
    v = spark.createDataFrame([(1, i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)], "p int, id long, embedding array<float>")
    got = {r["id"]: r["label"] for r in vec.cluster(v, "p", 0.2).collect()}
    assert [got[i] for i in range(9)] == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    inf = np.inf
    assert vec.average_linkage(np.array([[0, inf, 0.1], [inf, 0, 0.2], [0.1, 0.2, 0]]), 1.0).tolist() == [0, 1, 0]
    assert vec.average_linkage(np.zeros((0, 0)), 1.0).tolist() == []
    placed = v.withColumn("owner", F.when(F.col("id") < 4, 1).otherwise(2).cast("long"))
    new = spark.createDataFrame([(100, [math.cos(0.07), math.sin(0.07)]), (101, [math.cos(1.05), math.sin(1.05)])], "id long, embedding array<float>")
    assert rows(vec.knn_vote(new, placed, 3, 0.6, 3)) == [(100, 1)]
    close = vec.close_pairs(v, 0.01, 3)
    assert rows(close, "a", "b") == [(a, b) for a in range(9) for b in range(a + 1, 9) if 1 - math.cos(angles[a] - angles[b]) <= 0.01]
    h = spark.createDataFrame([(1, "a", 0), (2, "b", 255), (3, "b", 511), (4, "a", 255), (5, "c", -1)], "id long, o string, v long")
    assert rows(vec.near_hashes(h, "id", "v", "o")) == [(1, 2, 8), (2, 4, 0), (3, 4, 1)]
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 0.0, 0.0, 10.0, 9.0, 0.8), (1, 3, 20.0, 0.0, 30.0, 10.0, 0.7)], "frame int, id int, x0 double, y0 double, x1 double, y1 double, score double")
    assert rows(vec.suppressed(boxes, "frame"), "id") == [(1,), (3,)]
    flat = spark.createDataFrame([(1, [0.5] * 1024), (2, [float(i % 32) for i in range(1024)])], "id int, p array<double>")
    spread = dict((r["id"], r["spread"]) for r in vec.perceptual_hashes(flat, "p").collect())
    assert spread[1] == 0 and spread[2] > 0.03


def test_speakers(spark):
    weights = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 1.0), (3, "a", 1.0), (4, "b", 1.0)], "line_id int, name string, weight double")
    members = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8)], "line_id int, speaker int")
    found = {(r["speaker"], r["name"]): (r["share"], r["lift"]) for r in speakers.matches(weights, members).collect()}
    assert found[7, "a"] == (1.0, pytest.approx(4 / 3)) and found[8, "b"] == (1.0, 2.0)
    votes = spark.createDataFrame([(8, "z", 3), (8, "b", 1)], "speaker int, name string, n long")
    assert rows(speakers.suggestions(votes, speakers.matches(weights, members))) == [(7, "a"), (8, "z")]
    lyrics = spark.createDataFrame([("s", 1.0, 3.0, "ja", "x"), ("s", 1.2, 4.0, "zh", "y"), ("s", 1.25, 2.0, "ja", "z"), ("s", 9.0, 10.0, "zh", "w")], "song string, start double, end double, lang string, text string")
    assert [(r["start"], r["end"], r["texts"]) for r in speakers.paired(lyrics).orderBy("start").collect()] == [(1.0, 4.0, {"ja": "x", "zh": "y"}), (1.25, 2.0, {"ja": "z"}), (9.0, 10.0, {"zh": "w"})]
    lines = spark.createDataFrame([(1, "e", 0.0, 4.0), (2, "e", 4.0, 8.0)], "line_id int, episode string, start double, end double")
    cast = spark.createDataFrame([("e", 1, 0.0, 4.0, "a", 0.8, 0.5), ("e", 2, 4.0, 8.0, "a", 0.8, 0.5), ("e", 2, 4.0, 8.0, None, 0.3, 0.5)], "episode string, shot int, shot_start double, shot_end double, name string, presence double, height double")
    assert rows(speakers.seeds(lines, cast, 5.0)) == [(1, "a")]
    assert rows(speakers.on_screen(lines, cast, 5.0)) == [(1, "a", 0.8), (2, "a", 0.8)]


def test_overrides(spark):
    faces = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 5, 3), (2, 6, 4), (2, None, 5)], "shot_id long, cluster_id long, id int")
    fixes = spark.createDataFrame([(1, 5, 6), (2, 5, None)], "shot_id long, from_cluster long, to_cluster long")
    assert rows(overrides.apply_fixes(faces, fixes).withColumn("c", F.coalesce("cluster_id", F.lit(-1))), "id", "c") == [(1, 6), (2, 6), (3, -1), (4, 6), (5, -1)]
    log = spark.createDataFrame([(1, 9, 1, 2), (2, 9, 2, 3), (3, 8, 1, 2), (4, 8, 2, 1)], "seq int, shot_id long, from_cluster long, to_cluster long")
    assert rows(overrides.fold_fixes(log)) == [(8, 2, 1), (9, 1, 3), (9, 2, 3)]
    people = spark.createDataFrame([(5, None), (6, "x"), (7, None)], "id long, name string")
    f, c, x = overrides.merge_clusters(faces, people, fixes, 6, 5)
    assert rows(c.filter("id = 5"), "name") == [("x",)] and rows(x.filter("shot_id = 1")) == [] and f.filter("cluster_id = 6").count() == 0
    assert rows(overrides.without_empty(people, faces, "cluster_id"), "id") == [(5,), (6,)]
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "x")], "speaker long, name string")
    assert rows(overrides.accepted(names, people), "id", "into") == [(1, 1), (2, 1), (3, 6)]


def test_stages_and_stamps(spark):
    episodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    runs = spark.createDataFrame([(1, "shots", "2024-01-01T00:00:00", "{}"), (1, "filter", "2024-01-02T00:00:00", "{}"), (2, "shots", "2024-01-03T00:00:00", "{}")], schema.TABLES["stage_runs"])
    assert rows(stages.undone(episodes, runs, "filter"), "id") == [(2,)] and rows(stages.undone(episodes, runs, "cast"), "id") == [(1,)]
    assert rows(stages.fresh(runs, "filter", ["shots"])) == [(1, True), (2, False)]
    assert rows(stages.after(runs, episodes.filter("id = 1"), "filter"), "episode_id", "stage") == [(1, "shots"), (2, "shots")]
    data = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "k int, v int")
    stamp = stages.stamps(data, ["k"], ["v"])
    assert rows(stamp) == rows(stages.stamps(data.orderBy(F.desc("v")), ["k"], ["v"]))
    assert rows(stages.changed(stages.stamps(data.filter("v < 6"), ["k"], ["v"]), stamp, ["k"]), "k") == [(1,)]
    done = []
    stages.run([stages.Stage("shots", lambda e: done.append(e.count())), stages.Stage("filter", lambda e: done.append(e.count()))], episodes, lambda: runs, lambda s, e: None)
    assert done == [1]


def test_schema_violations_and_ids(spark):
    shots = spark.createDataFrame([(1, 1, 0, 0, 10, "kept"), (2, 1, 0, 10, 5, "dropped")], schema.TABLES["shots"])
    frames = spark.createDataFrame([(1, 2, 0, 0.0, 0.0, 0.0, 0.0)], schema.TABLES["frames"])
    got = {(r["table"], r["rule"]) for r in schema.violations({"shots": shots, "frames": frames}).collect()}
    assert got == {("shots", "unique episode_id,idx"), ("shots", "span"), ("frames", "only of kept shots")}
    ids = [r["id"] for r in schema.next_ids(spark.range(50).select("id").withColumnRenamed("id", "x").repartition(5), 100).collect()]
    assert sorted(ids) == list(range(101, 151))


def test_plans(spark):
    pairs = [("p", 0, "chorus", False, 1, 0.9), ("p", 0, "chorus", False, 2, 0.5), ("p", 1, "verse", True, 1, 0.4), ("p", 1, "verse", True, 2, 0.3), ("q", 0, "verse", False, 3, 0.1), ("q", 1, "verse", False, 3, 0.2)]
    scores = spark.createDataFrame(pairs, "plan string, slot long, section string, closing boolean, shot long, score double")
    assert rows(plans.assign(scores)) == [("p", 0, 2), ("p", 1, 1)]
    slots = spark.createDataFrame([("p", "s", 0, 0.0, 1.0, None), ("p", "s", 1, 1.01, 1.2, 1.1), ("p", "s", 2, 3.0, 2.0, None)], "plan string, song string, slot int, start double, end double, accent double")
    beats, songs = spark.createDataFrame([("s", 1.0)], "song string, beat double"), spark.createDataFrame([("s", 3.0)], "song string, duration double")
    assert rows(plans.timing_issues(slots, beats, songs), "slot", "code") == [(1, "slot.accent"), (1, "slot.gap"), (1, "slot.off_beat"), (1, "slot.too_short"), (2, "slot.order")]
    assert rows(plans.snapped(slots.filter("slot < 2"), beats, "song"), "start", "end") == [(1.0, 1.0), (1.0, 1.0)]
    voices = [("p", 0, 1, None, 0.0, 2.0, 0.0, 0.0, 6.0, "t", True, False, 0.0, 20.0), ("p", 1, 1, None, 0.0, 2.0, 1.0, 99.0, 6.0, "t", True, False, 0.0, 20.0), ("p", 2, 9, None, None, None, 5.0, 0.0, 6.0, "t", True, False, 0.0, 20.0), ("p", 3, None, "e", 0.0, 9.0, 10.0, 0.0, 6.0, "", True, True, 0.0, 20.0)]
    v = spark.createDataFrame(voices, "plan string, voice int, line int, episode string, in double, out double, at double, gain double, duck double, text string, sub boolean, force boolean, plan_start double, plan_end double")
    lines = spark.createDataFrame([(1, "e", "dialogue")], "line int, path string, kind string")
    kept, part = spark.createDataFrame([("e", 0.0, 5.0)], "episode string, start double, end double"), spark.createDataFrame([("e", 8.0, 9.5)], "episode string, start double, end double")
    sung = spark.createDataFrame([("p", 10.0, 12.0)], "plan string, start double, end double")
    got = rows(plans.voice_issues(v, lines, kept, part, sung), "voice", "level", "code")
    assert got == [(1, "error", "voice.gain"), (1, "error", "voice.overlap"), (2, "error", "voice.line_unknown"), (3, "error", "voice.dropped"), (3, "error", "voice.window"), (3, "warning", "voice.op_ed"), (3, "warning", "voice.sung"), (3, "warning", "voice.text")]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scalars.cuteness(F.create_map(F.lit("smile"), F.lit(0.5), F.lit("sky"), F.lit(1.0)), boost={"smile": 2.0})) == pytest.approx(0.7)
    assert [one(scalars.framing(F.lit(h))) for h in (0.35, 0.15, 0.1)] == ["close-up", "medium", "wide"]
    w = one(scalars.centred_window(F.lit(10.0), F.lit(14.0), F.lit(2.0)))
    assert (w["start"], w["length"], w["speed"]) == (11.0, 2.0, 1.0)
    assert [one(scalars.good_name(F.lit(n))) for n in ("a b", "", ".x", "a/b")] == [True, False, False, False]
    assert one(scalars.song_id(F.lit("My Song! (2024)"))).startswith("my-song-2024-")
    assert one(iv.frame_floor(F.lit(1.0 - 1e-5), 24)) == 1.0 and one(iv.seconds(F.lit(1001), F.lit(24000), F.lit(1001))) == pytest.approx(1001 * 1001 / 24000)
    assert datetime.timedelta(seconds=one(iv.frame_ceil(F.lit(0.9), 24))) == datetime.timedelta(seconds=22 / 24)


def test_nearest_takes_linear_time_and_is_dealt_by_time(spark):
    points = spark.createDataFrame([("k", None if i % 50 == 7 else i * 37 % 1000 / 7) for i in range(300)] + [("z", 1.0)], "k string, t double")
    grid = spark.createDataFrame([("k", g * g / 5) for g in range(4, 28)] + [("other", 3.0)], "k string, g double")
    whole = iv.nearest(points, grid, ["k"], "t", "g")
    # a frame up to the end of its key is gone through anew for each row
    assert "unboundedfollowing" not in whole._jdf.queryExecution().toString().lower()
    marks = [g * g / 5 for g in range(4, 28)]
    want = sorted((t, min(marks, key=lambda g: (abs(g - t), g))) for t in (i * 37 % 1000 / 7 for i in range(300) if i % 50 != 7))
    for df in (whole, *(iv.nearest(points, grid, ["k"], "t", "g", width=w) for w in (0.5, 10.0, 1000.0))):
        assert df.columns == ["k", "t", "nearest"]
        assert sorted(tuple(r) for r in df.filter("k = 'k' and t is not null").select("t", "nearest").collect()) == want
        assert df.filter("t is null and nearest is not null").count() == 6 and df.filter("k = 'z' and nearest is null").count() == 1


def test_vectors_are_clustered_without_their_square(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(40, 8))[rng.integers(0, 40, 700)] + rng.normal(size=(700, 8)) * 0.3
    e[600:650] = e[3]
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    for threshold in (0.05, 0.3, 0.8):
        assert (vec.vector_linkage(e, threshold) == vec.average_linkage(np.clip(1 - e @ e.T, 0, 2), threshold)).all()
    many = rng.normal(size=(4000, 8))
    many /= np.linalg.norm(many, axis=1, keepdims=True)
    tracemalloc.start()
    vec.vector_linkage(many, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all distances are 128 MB
    assert peak < 40e6


def test_blocks_of_vectors_meet_some_rows_at_a_time(spark):
    rng = np.random.default_rng(6)
    e = rng.normal(size=(900, 6)).astype(np.float32)
    e[::9] = e[0]
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(e)], "id long, embedding array<float>, owner long")
    u = e.astype(np.float64) / np.linalg.norm(e.astype(np.float64), axis=1, keepdims=True)
    d = 1 - u @ u.T
    assert (np.abs(d - 0.3) > 1e-9).all()
    for blocks in (1, 3, None):
        assert {(r["a"], r["b"]) for r in vec.close_pairs(df, 0.3, blocks).select("a", "b").collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(d <= 0.3, 1)))))
    one, off = e[np.arange(900) % 9 != 0], np.flatnonzero(np.arange(900) % 9)
    d = d[np.ix_(off, off)]
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :3]
    want = {(int(off[i]), int(off[near[i, 0]] % 4)) for i in range(len(one)) if len({int(off[j] % 4) for j in near[i]}) == 1 and d[i, near[i]].mean() <= 0.9}
    placed = df.filter("id % 9 <> 0")
    assert want and all({tuple(r) for r in vec.knn_vote(placed, placed, 3, 0.9, blocks).collect()} == want for blocks in (1, 3))
    assert vec._blocks(spark.range(10)) == 1 and vec._blocks(spark.range(5000)) == 4 and vec._blocks(spark.range(200_000)) == 13


def test_near_values_come_once_and_chance_meetings_are_rare(spark):
    rng = np.random.default_rng(7)
    base = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 30)]
    values = {v ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False)) for v in base for n in range(11)} | set(base)
    df = spark.createDataFrame([(v,) for v in [*values, *base, None]], "v long")
    got = [tuple(r) for r in vec.near_values(df, "v", 8).collect()]
    want = {(a, b) for a in values for b in values if ((a ^ b) & (2**64 - 1)).bit_count() <= 8}
    assert len(got) == len(set(got)) and set(got) == want


def test_strength_at_a_beat_comes_with_the_nearest_beat(spark):
    beats = spark.createDataFrame([(1, 1.0, 0.5), (1, 1.0, 0.9), (1, 1.0, None), (1, 2.0, None), (1, 3.0, 0.2), (3, 1.0, 0.4)], "song long, beat double, strength double")
    slots = spark.createDataFrame([(1, 1.0), (1, 0.99), (1, 1.01), (1, 2.0), (1, 2.5), (1, 9.0), (1, None), (2, 1.0), (3, 1.0)], "song long, start double")
    got = effects.at_beat(slots, beats, "start", "hit")
    # the beats are not joined again to find their strength
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(1, 1.0): (0.9, 1.0), (1, 0.99): (0.9, 1.0), (1, 1.01): (0.9, 1.0), (1, 2.0): (0.0, 2.0), (1, 2.5): (0.0, 2.0), (1, 9.0): (0.0, 3.0), (2, 1.0): (0.0, None), (3, 1.0): (0.4, 1.0)}
    assert {(r["song"], r["start"]): (r["hit"], r["hit_beat"]) for r in got.collect() if r["start"] is not None} == want
