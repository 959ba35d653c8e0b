import random

from timeloom.llm import lines


def near(a, b, fuzzy):
    if a == b or not fuzzy or min(len(a), len(b)) < lines.FUZZY_WORDS:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, least=lines.MIN_WORDS, fuzzy=True):
    places = [(i, p, tuple(x.split())) for i, t in docs for p, x in enumerate(t.split("\n"))]
    places = sorted(x for x in places if len(x[2]) >= least)
    gone = {x[:2] for k, x in enumerate(places) if any(near(x[2], y[2], fuzzy) for y in places[:k])}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


def result(spark, docs, **options):
    return {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()}


def test_against_all_pairs(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefg") for _ in range(rng.randint(3, 12))] for _ in range(25)]
    docs = []
    for i in range(40):
        made = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base))
            k, kind = rng.randrange(len(w)), rng.randrange(5)
            if kind == 0:
                w[k] = rng.choice("xyz")
            elif kind == 1:
                w.insert(k, rng.choice("xyz"))
            elif kind == 2:
                del w[k]
            made.append(" ".join(w))
        docs.append((i, "\n".join(made)))
    for fuzzy in (True, False):
        assert {i: r["text"] for i, r in result(spark, docs, fuzzy=fuzzy).items()} == brute(docs, fuzzy=fuzzy)


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    docs = [(1, None), (2, ""), (3, long), (4, long.replace("w1500", "x")), (5, "a b c d\na b c d"), (6, "p q r s t\r\np  q r\ts t")]
    got = result(spark, docs)
    assert got[1]["text"] is None and got[1]["n_lines"] == 0
    assert got[2]["text"] == "" and got[4]["text"] == "" and got[4]["n_removed"] == 1
    assert got[5]["text"] == "a b c d" and got[5]["n_removed"] == 1 and got[6]["n_removed"] == 1
    assert result(spark, []) == {}


def test_clashing_columns_and_clean(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 11, "x"), (2, "a b c d e f\nown", 15, "y"), (None, "n", 1, "z")], "doc_id long, text string, n_chars long, n_lines string")
    out = lines.clean(df)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[2]["text"] == "own" and rows[2]["n_chars"] == 3 and rows[1]["n_chars"] == 11


def test_short_lines_go_if_they_repeat_exactly(spark):
    got = result(spark, [(1, "End.\n\n \na b"), (2, "end.\nEnd.\n\na  b\na c"), (3, "")])
    assert {i: r["text"] for i, r in got.items()} == {1: "End.\n\n \na b", 2: "end.\n\na c", 3: ""}
    kept = {i: r["text"] for i, r in result(spark, [(1, "a b c d e f\nx"), (2, "x\na b c d e g")], min_words=5).items()}
    assert kept == {1: "a b c d e f\nx", 2: "x"}


def test_names_of_all_kinds_clash(spark):
    names = "_kept _kept_of _text _lines _gone kept kept_of old_text lines gone n_lines n_removed pos line".split()
    df = spark.createDataFrame([(1, "a b c d e f", *names), (2, "a b c d e f\nown", *names)], ", ".join(["doc_id long, text string", *(f"{n} string" for n in names)]))
    out = lines.clean(df)
    assert out.columns == df.columns and all(tuple(r)[2:] == tuple(names) for r in out.collect())
    both = lines.dedup_lines(df)
    assert both.columns == [*df.columns, "_n_lines", "_n_removed"] and {r["doc_id"]: r["_n_removed"] for r in both.collect()} == {1: 0, 2: 1}
