import json

import numpy as np
import pytest

from timeloom import schema
from timeloom.functions import sound
from timeloom.plans import documents

RATE = 200


def frame(spark, songs):
    return spark.createDataFrame([(k, i, float(v)) for k, x in songs.items() for i, v in enumerate(x)], "song string, i long, v double")


def arrays(df):
    out = {}
    for r in df.orderBy("song", "i").collect():
        out.setdefault(r["song"], []).append(r["v"])
    return {k: np.array(v) for k, v in out.items()}


def rise(n):
    return np.array([0.5 - 0.5 * np.cos(np.pi * k / (n - 1)) if n > 1 else 0.0 for k in range(n)])


def test_gain_under_spans(spark):
    samples = frame(spark, {"a": np.ones(400), "b": np.ones(50)})
    spans = spark.createDataFrame([("a", 0.05, 0.5, 6.0), ("a", 0.4, 0.9, 12.0), ("a", 1.9, 5.0, 9.0)], "song string, start double, end double, depth double")
    down, up, want = rise(30), rise(80), np.zeros(400)
    for start, end, depth in ((10, 100, 6.0), (80, 180, 12.0), (380, 1000, 9.0)):
        for i in range(400):
            d = 0.0
            if start <= i < end:
                d = depth
            elif start - 30 <= i < start:
                d = depth * down[i - start + 30]
            elif end <= i < end + 80:
                d = depth * up[end + 79 - i]
            want[i] = max(want[i], d)
    got = arrays(sound.under(samples, spans, ["song"], RATE))
    assert got["a"] == pytest.approx(10 ** (-want / 20)) and (got["b"] == 1).all()
    assert arrays(sound.under(samples, spans.limit(0), ["song"], RATE))["a"].sum() == 400


def test_levels_pass_over_quiet_moments(spark):
    rng = np.random.default_rng(3)
    loud, quiet = rng.normal(size=400) * 0.2, rng.normal(size=200) * 1e-4
    got = {r["song"]: r["level"] for r in sound.levels(frame(spark, {"both": np.concatenate([loud, quiet, [0.5, 0.5]]), "short": [0.1] * 3, "none": np.zeros(40)}), ["song"], RATE).collect()}
    assert got["both"] == pytest.approx(20 * np.log10(np.sqrt((loud**2).mean())), abs=0.3)
    assert got["short"] == sound.FLOOR and got["none"] < -200
    assert sound.levels(frame(spark, {"x": [0.0]}).limit(0), ["song"], RATE).count() == 0


def test_fades_and_peaks(spark):
    got = arrays(sound.faded(frame(spark, {"a": np.ones(300), "tiny": np.ones(5)}), ["song"], RATE, 0.05, 0.5))
    want = np.ones(300)
    want[:10] *= rise(10)
    want[200:] *= rise(100)[::-1]
    assert got["a"] == pytest.approx(want) and got["tiny"] == pytest.approx(rise(5) * rise(5)[::-1])
    peak = arrays(sound.normalised(frame(spark, {"a": [0.1, -0.4], "still": [0.0, 0.0]}), ["song"]))
    assert peak["a"] == pytest.approx(np.array([0.25, -1.0]) * 10 ** (-1 / 20)) and (peak["still"] == 0).all()


def test_changes_between_pictures(spark):
    pictures = [("a", 0, [0, 0, 0, 0]), ("a", 1, [0, 10, 11, 255]), ("a", 2, [0, 10, 11, 255]), ("b", 0, [9, 9, 9, 9])]
    got = [tuple(r) for r in sound.differences(spark.createDataFrame(pictures, "film string, i int, pixels array<int>"), ["film"]).orderBy("film", "i").collect()]
    assert [(f, i) for f, i, _, _ in got] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert [m for _, _, m, _ in got] == pytest.approx([0, 276 / 4 / 255, 0, 0]) and [c for *_, c in got] == [0, 0.5, 0, 0]


def test_shape_of_plans():
    told = json.loads(documents.shape())
    assert told["properties"]["slots"]["items"]["properties"]["fx"]["items"]["properties"]["zoom"] == {"type": "number"}
    assert set(told["required"]) <= told["properties"].keys() and told["properties"]["schema"] == {"type": "integer"}


def test_names_and_references_of_later_tables(spark):
    speakers = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], schema.TABLES["speakers"])
    fixes = spark.createDataFrame([(1, 9), (2, None), (3, 4)], schema.TABLES["speaker_fixes"])
    got = {(r["table"], r["rule"], r["rows"]) for r in schema.violations({"speakers": speakers, "speaker_fixes": fixes}).collect()}
    assert got == {("speakers", "unique name", 1), ("speaker_fixes", "speaker_id in speakers", 1)}
