import json

from timeloom import api, schema
from timeloom.plans import documents, plans


def test_documents_name_every_problem(spark):
    good = {"schema": 4, "name": "n", "song": "s", "fps": "24000/1001", "slots": [{"start": 0.00001, "end": 1.5, "shot": 3, "in": 1.0, "out": 2.5, "speed": 1.00049}], "voices": []}
    bad = {"schema": 9, "name": "a/b", "fps": "x", "slots": [{"start": 0.0}, {"start": 0.0, "end": 1.0, "in": 2.0}], "voices": [{"gain": 1.0}]}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "[]"), (4, "{")], "id int, value string")
    got = {r["id"]: r for r in documents.read(df).collect()}
    assert got[1]["problems"] == [] and got[3]["problems"] == got[4]["problems"] == ["no JSON object"]
    assert got[2]["problems"] == ["schema is not readable", "name is not a plain name", "song is missing", "fps is no rate", "slots[0] has no start or end", "slots[1] has in without out", "voices[0] has no at", "voices[0] has neither line nor episode"]
    back = json.loads(documents.written(documents.read(df.filter("id = 1"))).first()["value"])
    assert back == good | {"slots": [good["slots"][0] | {"start": 0.0, "speed": 1.0}]}
    slots = documents.rows_of(documents.read(df.filter("id = 1")), "id", "slots").first()
    assert (slots["slot"], slots["shot"], slots["out"]) == (0, 3, 2.5)


def test_pick_voice(spark):
    gaps = spark.createDataFrame([("p", 0.0, 2.0, "intro"), ("p", 10.0, 16.0, "between")], "plan string, start double, end double, place string")
    rows = [("p", 1, 0.0, 5.0, [1], ["a"], "a", 0.0, 5.0), ("p", 2, 0.0, 2.0, [7], ["a", "b"], "a", 0.0, 2.0), ("p", 3, 0.0, 1.2, [1], ["a"], "a", 0.0, 1.9), ("p", 4, 0.0, 1.0, [9], ["b"], "a", 0.0, 1.0)]
    lines = spark.createDataFrame(rows, "plan string, line int, start double, end double, shots array<int>, on_screen array<string>, character string, heard_in double, heard_out double")
    slots = spark.createDataFrame([("p", 7, 12.0, 13.0)], "plan string, shot int, start double, end double")
    r = plans.pick_voice(gaps, lines, slots).first()
    assert (r["line"], r["at"], r["out"]) == (2, 10.3, 2.0)


def test_answers_hide_dropped_shots(spark):
    shots = spark.createDataFrame([(1, 1, 0, 0, 10, "kept"), (2, 1, 1, 10, 20, "dropped")], schema.TABLES["shots"])
    details = spark.createDataFrame([(1, "smile"), (2, "secret")], "shot_id long, tag string")
    got = json.loads(api.episode_shots(shots, details).first()["value"])
    assert got[0]["tag"] == "smile" and set(got[1]) == {"idx", "id", "start_frame", "end_frame", "status"}
    marks = spark.createDataFrame([(1, "op")], "shot_id long, kind string")
    total = {r["episode_id"]: (r["kept"], r["marked"], r["op"], r["ed"]) for r in api.repeats(marks, shots.filter("status = 'kept'")).collect()}
    assert total == {1: (1, 1, 1, 0), None: (1, 1, 1, 0)}
    e = spark.createDataFrame([(1, "a.mkv", 1920, 1080, 24000, 1001, 1000)], schema.TABLES["episodes"])
    runs = spark.createDataFrame([(1, "filter", "2", ""), (1, "shots", "1", "")], schema.TABLES["stage_runs"])
    doc = json.loads(api.episodes(e, runs, spark.createDataFrame([(1, "op", 5.5, 9.0)], schema.TABLES["episode_parts"])).first()["value"])
    assert doc["fps"] == "24000/1001" and doc["seconds"] == 41.708 and doc["stages"] == ["shots", "filter"] and doc["parts"][0]["kind"] == "op"


def test_voice_review(spark):
    rows = [(1, 0.0, 1.0, "clean", [1.0, 0.0], 5), (2, 0.0, 2.0, "clean", [0.9, 0.1], 5), (3, 0.0, 1.0, "clean", [0.0, 1.0], 5), (4, 0.0, 9.0, "short", None, None)]
    v = spark.createDataFrame(rows, schema.TABLES["line_voices"])
    r = api.voice_review(v, 1).first()
    assert (r["lines"], r["seconds"], r["typical"][0]["line_id"]) == (3, 4.0, 2)
    assert {x["status"]: x["n"] for x in api.voice_statuses(v).collect()}["silent"] == 0
