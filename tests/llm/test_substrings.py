import random

import pytest

from timeloom.llm import substrings


def brute(docs, window):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = (t or "").encode().split()
        hit = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                hit[s : s + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(hit), b" ".join(x for x, h in zip(w, hit) if not h).decode())
    return out


def result(spark, docs, **options):
    rows = substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in rows}


def test_against_all_windows(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randint(4, 40))] for _ in range(8)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 20))]
        docs.append((i, " ".join(w)))
    for window, gram in ((6, 3), (6, 6), (9, 1), (20, 6)):
        assert result(spark, docs, window=window, gram=gram) == brute(docs, window)


def test_repeats_inside_a_document_and_edges(spark):
    period = " ".join(["a", "b", "c"] * 40)
    docs = [(1, None), (2, ""), (3, "x " * 500), (4, period), (5, " ".join(f"u{k}" for k in range(25)) + "\n" + " ".join(f"u{k}" for k in range(25))), (6, period), (-7, period)]
    assert result(spark, docs) == brute(docs, 20)
    assert result(spark, []) == {}
    with pytest.raises(ValueError):
        substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=3, gram=5)


def test_a_repeated_row_is_no_earlier_occurrence(spark):
    t = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, t, 0), (1, t, 0), (2, t, 0), (None, t, 0)], "doc_id long, text string, n_words int")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.without_repeats(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 30)]


def test_long_document_over_several_chunks(spark):
    body = " ".join(f"word{k}" for k in range(90_000))
    docs = [(1, body), (2, "intro of another kind " + body[:700_000].rsplit(" ", 1)[0])]
    assert result(spark, docs) == brute(docs, 20)
