from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from timeloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, DOC_size int"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_near_targets_and_repeatable(spark):
    rows = [(i, "w " * (i % 17), ["b", "a", None, "é", "Z"][min(i % 9, 4)], i) for i in range(900)]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == r["doc_id"] % 17 and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = targets(sizes)
    assert {r["source"]: r["source_size"] for r in got} == sizes
    for s in sizes:
        assert all(r["target"] == pytest.approx(want[s]) for r in got if r["source"] == s)
        assert abs(taken[s] - want[s]) <= 8
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_nulls_empty_texts_and_repeated_rows(spark):
    rows = [(1, None, "a", 0), (2, "", "a", 0), (None, "one two", "a", 0), (3, "x\x0by\x1cz", None, 0), (4, "p q", "b", 1), (4, "p q", "b", 1), (5, " ", "c", 0)]
    got = {(r["doc_id"], r["source"]): r for r in mixing.mix(docs(spark, rows)).collect()}
    assert got[1, "a"]["size"] == got[2, "a"]["size"] == 0 and got[3, None]["size"] == 2 and got[5, "c"]["target"] == 0
    assert mixing.mix(docs(spark, rows)).count() == len(rows)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixed_documents_keep_columns_and_repeat(spark):
    rows = [(i, "w " * 10, "a" if i % 3 else "b", i) for i in range(60)]
    df = docs(spark, rows)
    taken = mixing.mix(df).agg(F.sum(F.col("taken") / F.col("size"))).first()[0]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == taken


def test_a_very_long_text_and_one_hot_source(spark):
    rows = [(i, "w " * 3, "hot", i) for i in range(400)] + [(1000, "word\x0b" * 500_000, "long", 0), (1001, "w", "tiny", 0)]
    got = {r["doc_id"]: r for r in mixing.mix(docs(spark, rows)).collect()}
    want = targets({"hot": 1200, "long": 500_000, "tiny": 1})
    assert got[1000]["size"] == got[1000]["source_size"] == 500_000
    assert all(got[i]["target"] == pytest.approx(want[s]) for i, s in ((0, "hot"), (1000, "long"), (1001, "tiny")))
    assert all(r["taken"] <= 2 * r["size"] for r in got.values())
    assert abs(sum(got[i]["taken"] for i in range(400)) - want["hot"]) <= 3
    assert abs(got[1000]["taken"] - want["long"]) <= 250_000
