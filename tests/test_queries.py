import datetime
import random

import pytest

from timeloom import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = pytest.importorskip("duckdb").connect()
    for name in ("events", "conversations", "embeddings"):
        db.execute(f"create view {name} as from '{SMALL}/{name}.parquet'")
    return db


def test_timing_of_all_slots(spark, duck):
    whole = sorted(duck.execute(queries.ORACLES["q_validate_timing"]).fetchall())
    assert any(slot > 40 for _, slot, _, _ in whole)
    assert sorted(map(tuple, queries.q_validate_timing(spark, SMALL).collect())) == whole


def test_refrains_are_whole_texts(spark, tmp_path):
    rows = [(1, 0, "user", "The same line!"), (1, 1, "assistant", "the SAME, line"), (2, 0, "user", "The other line"), (3, 0, "user", "Снова"), (3, 1, "assistant", "один раз"), (3, 2, "user", "снова!")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["conv_id"], r["turn"]): r["refrain"] for r in queries.q_refrain_count(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): True, (1, 1): True, (2, 0): False, (3, 0): True, (3, 1): False, (3, 2): True}


def test_refrain_bars_is_registered(spark, duck):
    want = sorted(duck.execute(queries.ORACLES["q_refrain_bars"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["q_refrain_bars"](spark, SMALL).collect())) == want
    assert {r[2] for r in want} == {True, False}


def test_hashes_hold_all_signs(spark, tmp_path):
    rng = random.Random(4)
    base = [rng.choice([-1.0, 1.0]) for _ in range(64)]
    # copies of one row of signs with some of them turned, anywhere in the 64
    rows = [(k, [-v if d in rng.sample(range(64), k % 16) else v for d, v in enumerate(base)], k % 3) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    far = lambda a, b: sum((x > 0) != (y > 0) for x, y in zip(a, b))
    want = {(a, b, far(x, y)) for a, x, _ in rows for b, y, _ in rows if a < b and a % 5 != b % 5 and far(x, y) <= 8}
    assert {tuple(r) for r in queries.q_hamming_dupes(spark, str(tmp_path)).collect()} == want
    assert {d for _, _, d in want} > {1, 2, 4, 5}
    hit = {k: {y // 10 for a, b, _ in want for x, y in ((a, b), (b, a)) if x == k} for k, _, _ in rows}
    group = {}
    for k, _, _ in rows:
        group.setdefault((k // 10, k % 5), []).append(k)
    shots = {(s, e, sum(bool(hit[k]) for k in g) / len(g), len(set().union(*(hit[k] for k in g)))) for (s, e), g in group.items() if 2 * sum(bool(hit[k]) for k in g) >= len(g)}
    assert {tuple(r) for r in queries.q_recurring_share(spark, str(tmp_path)).collect()} == shots


def test_knn_vote_has_all_rows_on_both_sides(spark, duck):
    want = sorted(duck.execute(queries.ORACLES["q_knn_vote"]).fetchall())
    assert any(k % 4 for k, _ in want)
    assert sorted(map(tuple, queries.q_knn_vote(spark, SMALL).collect())) == want


CHAIN = ["q_bar_phase_mode", "q_sync_best", "q_lyric_end", "q_greedy_assign", "q_nms", "q_lang_pair", "q_sections", "q_excerpt", "q_slots", "q_fold_fixes", "q_subtitle_timing", "q_gap_pick", "q_stamp"]


@pytest.mark.parametrize("name", CHAIN)
def test_choices_in_order_equal_recursive_sql(spark, duck, name):
    answer = duck.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in answer.description)
    want = answer.fetchdf()[columns]
    got = queries.QUERIES[name](spark, SMALL).toPandas()[columns]
    assert len(want) and sorted(map(repr, got.astype(str).values.tolist())) == sorted(map(repr, want.astype(str).values.tolist()))


@pytest.mark.parametrize("name", ["q_on_screen_weight", "q_match_lift"])
def test_lines_without_length_have_weights_that_are_no_numbers(spark, tmp_path, name):
    # a click of value 0 is a line without length, inside of the shot that its neighbours make
    when = datetime.datetime(2024, 1, 1, 1)
    rows = [(7 * i + 2 * (i % 4), when + datetime.timedelta(minutes=i), 1 + i // 20, ("click", "view", "error")[i % 3], 0.0 if i == 9 else 1.0 + i) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    db = pytest.importorskip("duckdb").connect()
    db.execute("set timezone = 'UTC'")
    db.execute(f"create view events as select event_id, ts::timestamp as ts, user_id, event_type, value from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(repr(r) for r in db.execute(queries.ORACLES[name]).fetchall())
    assert any("nan" in r for r in want)
    assert sorted(repr(tuple(r)) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()) == want
