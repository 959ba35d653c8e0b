import random
import zlib

from timeloom.llm import toxicity


def corpus(n=900):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 8 == 0:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["zorgle", "Brunk!", "vipt" + rng.choice(words)]))
        docs.append((i, " ".join(own), i))
        labels.append((i, int(i % 8 == 0)))
    return docs, labels


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = corpus()
    d, given = spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classified(d, given).collect()}
    truth = dict(labels)
    held = {i for i, r in got.items() if r["held_out"]}
    assert held == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.98
    flipped = [(i, 1 - y if i in held else y) for i, y in labels]
    again = {r["doc_id"]: r["score"] for r in toxicity.classified(d, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_edges(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame([*docs, (None, None, 0), (-1, "", 0), (-2, "zorgle " * 200000, 0)], "doc_id long, text string, x int")
    given = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classified(d, given).collect()}
    assert got[-1]["predicted"] == 0 and got[None]["score"] == got[-1]["score"] and 0 <= got[-2]["score"] <= 1
    assert len(toxicity.classified(d, given.limit(0)).select("score").distinct().collect()) == 1
    assert toxicity.classified(d.limit(0), given).count() == 0
