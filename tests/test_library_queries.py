import math
import random

import pytest

from timeloom import library_queries, queries
from timeloom.operators import incremental, scenes, writes
from timeloom.plans import drafts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = pytest.importorskip("duckdb").connect()
    for name in ("events", "pages", "orders"):
        db.execute(f"create view {name} as from '{SMALL}/{name}.parquet'")
    return db


def values(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["q_scenes", "q_cut_lines", "q_usable_lines", "q_effect_issues", "q_refined", "q_media_values", "q_correction_writes"])
def test_queries_give_the_rows_of_their_sql(spark, duck, name):
    out, want = queries.QUERIES[name](spark, SMALL), duck.execute(queries.ORACLES[name])
    assert [c[0] for c in want.description] == out.columns
    assert values(out.collect()) == values(want.fetchall())


def alternated(slots, fits):
    """slots: (slot, shot, order, frame) of one stretch, by slot."""
    waiting, picks = sorted(slots, key=lambda s: (s[2], s[1])), []
    for place, *_ in slots:
        hit = [s for s in waiting if (place, s[1]) in fits]
        if not hit:
            return [s[1] for s in slots]
        picks.append(hit[0])
        waiting.remove(hit[0])
    for i in range(2, len(picks)):
        if picks[i][3] == picks[i - 1][3] == picks[i - 2][3]:
            for j in range(i + 1, len(picks)):
                if picks[j][3] != picks[i][3] and (slots[i][0], picks[j][1]) in fits and (slots[j][0], picks[i][1]) in fits:
                    picks[i], picks[j] = picks[j], picks[i]
                    break
    return [p[1] for p in picks]


def test_alternated_against_a_plain_version(spark):
    slots = [(p, k, 0, 100 * p + (k * 7 + p) % 9, (k * 5 + p) % 9, "wide" if (k * p) % 4 == 0 else "close") for p in range(6) for k in range(9)]
    fits = [(p, k, s) for p, k, _, s, _, _ in slots] + [(p, k, x[3]) for p, k, *_ in slots for x in slots if x[0] == p and (k + x[3]) % 6]
    got = drafts.alternated(spark.createDataFrame(slots, "plan long, slot long, run long, shot long, order long, frame string"), spark.createDataFrame(set(fits), "plan long, slot long, shot long")).collect()
    for p in range(6):
        own = [(k, s, o, f) for q, k, _, s, o, f in slots if q == p]
        assert [r["shot"] for r in sorted((r for r in got if r["plan"] == p), key=lambda r: r["slot"])] == alternated(own, {(k, s) for q, k, s in fits if q == p})


def test_arranged_goes_through_its_pairs_once(spark):
    rows = library_queries.q_arranged(spark, SMALL)
    steps = rows._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Scan parquet") == 1 and "CoGroup" not in steps
    slots = {}
    for r in rows.collect():
        slots.setdefault(r["plan"], []).append((r["slot"], r["shot"]))
    assert len(slots) > 10 and all(sorted(k for k, _ in own) == list(range(6)) and len({s for _, s in own}) == 6 for own in slots.values())


def test_slots_meet_the_beats_once_when_refined(spark):
    # forth and back over beats and slots, for both times of a slot and for its section
    steps = library_queries.q_refined(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Window [last(_g") == 2


def test_section_at_keeps_points_outside_of_all_sections(spark):
    points = spark.createDataFrame([(1, k, 1, t) for k, t in enumerate((0.0, 29.9999995, 30.0, 59.5, 90.0, None))], "plan long, slot long, song long, t double")
    parts = spark.createDataFrame([(1, "a", 0.0, 30.0), (1, "b", 30.0, 60.0), (1, "c", 50.0, 70.0), (2, "d", 0.0, 99.0)], "song long, label string, start double, end double")
    assert {r["slot"]: r["_label"] for r in drafts.section_at(points, parts, ["plan", "slot"]).collect()} == {0: "a", 1: "b", 2: "b", 3: "b", 4: None, 5: None}


def at(angle):
    return [math.cos(angle), math.sin(angle)]


def test_new_vectors_join_known_clusters_or_make_new_ones(spark):
    # two groups of four are there; of the new ones some lie beside them, five are a group of their own, one is alone
    old = [(i, 1, at(a), 1) for i, a in enumerate((0, 0.05, 0.1, 0.12))] + [(10 + i, 1, at(a), 2) for i, a in enumerate((2, 2.05, 2.1, 2.12))]
    new = [(20 + i, 2, at(a), None) for i, a in enumerate((0.02, 0.08, 2.02, 2.07, 4.0, 4.01, 4.02, 4.03, 4.04, 5.5))]
    rows = spark.createDataFrame(old + new, "id long, episode_id long, embedding array<double>, cluster long")
    parents = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    out, clusters = incremental.assign_clusters(rows, parents)
    got = {r["id"]: r["cluster"] for r in out.collect()}
    assert [got[i] for i in range(20, 30)] == [1, 1, 2, 2, 3, 3, 3, 3, 3, None]
    assert sorted((r["id"], r["name"]) for r in clusters.collect()) == [(1, "a"), (2, None), (3, None)]
    again, _ = incremental.recluster(out, clusters, "episode_id")
    assert {r["id"]: r["cluster"] for r in again.collect()}[20] == 1


def test_split_keeps_the_largest_part(spark):
    rows = [(i, at(a), 5) for i, a in enumerate((0, 0.01, 0.02, 0.03, 0.04, 1.2, 1.21, 1.22, 1.23, 2.5))]
    out, clusters = incremental.split_cluster(spark.createDataFrame(rows, "id long, embedding array<double>, cluster long"), spark.createDataFrame([(5, "x")], "id long, name string"), 5)
    assert [r["cluster"] for r in out.orderBy("id").collect()] == [5] * 5 + [6] * 4 + [None]
    assert sorted((r["id"], r["name"]) for r in clusters.collect()) == [(5, "x"), (6, None)]


def test_speakers_fill_up_from_their_neighbours(spark):
    rows = [(i, at(a), s, "clean") for i, (a, s) in enumerate([(0, 1), (0.1, 1), (0.2, 1), (1.0, None), (3.0, None), (3.05, None)])] + [(9, at(0), None, "short")]
    voices = spark.createDataFrame(rows, "id long, embedding array<double>, cluster long, status string")
    out, speakers = incremental.assign_speakers(voices, spark.createDataFrame([(1, "a")], "id long, name string"), spark.createDataFrame([(2,)], "id long"), threshold=0.1)
    assert {r["id"]: r["cluster"] for r in out.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 9: None} and speakers.count() == 2


def test_guards_raise(spark):
    shots = spark.createDataFrame([(1, 1, 0, 0, 9, "kept")], "id long, episode_id long, idx long, start_frame long, end_frame long, status string")
    frames = spark.createDataFrame([(7, 1, 3)], "id long, shot_id long, frame_index long")
    names = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    for bad in (writes.drop_shot(shots, frames, 1), writes.rename(names, 2, "a"), writes.rename(names, 9, "z"), writes.create(names, 5, "a")):
        with pytest.raises(Exception, match="frames|taken|no 9"):
            bad.collect()


def test_marks_are_stale_when_stamps_change(spark):
    marks = spark.createDataFrame([(3, 1, "op", [4, 5])], "shot_id long, episode_id long, kind string, like array<long>")
    stamps = spark.createDataFrame([(1, "x")], "episode_id long, stamp string")
    doc = scenes.marks_json(marks, stamps)
    assert scenes.marks_of(doc).collect()[0]["like"] == [4, 5]
    stale = lambda s: scenes.stale(doc, spark.createDataFrame(s, "episode_id long, stamp string")).first()[0]
    assert [stale(s) for s in ([(1, "x")], [(1, "y")], [(1, "x"), (2, "z")])] == [False, True, True]


def test_all_are_registered():
    assert library_queries.q_lookups.__name__ in queries.QUERIES and "q_lookups" in queries.ORACLES


def test_likes_are_counted_without_pairs(spark):
    rng = random.Random(3)
    shots = [(k, k % 5, rng.choice(["op", "ed", None]), sorted(rng.sample(range(12), rng.choice([1, 1, 2, 3, 5])))) for k in range(60)]
    linked = spark.createDataFrame(shots, "shot_id long, episode long, close string, near array<long>")
    drawn = linked.toDF("other", "episode", "other_close", "drawings")
    others = {k: [c for j, f, c, b in shots if f != e and set(a) & set(b)] for k, e, _, a in shots}
    want = {(k, len(others[k]), sum(x is not None and x == c for x in others[k])) for k, _, c, _ in shots}
    # with shots of few drawings only, with wide ones, and with nothing but these
    for wide in (12, 2, 0):
        assert {tuple(r) for r in scenes.like_counts(linked, drawn, wide).collect()} == want


def test_mean_histograms_make_no_row_for_each_colour(spark):
    one = lambda k: [1.0 if i == k else 0.0 for i in range(64)]
    x = scenes.mean_histograms(spark.createDataFrame([(1, one(0)), (1, one(63)), (2, one(5)), (3, None)], "shot_id long, colours array<double>"))
    assert "Generate" not in x._jdf.queryExecution().toString()
    assert {r["shot_id"]: r["colours"] for r in x.collect()} == {1: [(a + b) / 2 for a, b in zip(one(0), one(63))], 2: one(5)}
