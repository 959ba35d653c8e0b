import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_lines import brute as plain_lines
from test_mixing import targets
from test_neardup import brute as plain_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean, toxic, copied and leaked documents; lines that repeat, exactly and by one word."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(30)) for k in range(4)]
    common = [say(9) for _ in range(3)]
    docs, labels = [], []
    for i in range(240):
        text = "\n".join(say(rng.randint(3, 25)) for _ in range(rng.randint(1, 4)))
        if i % 6 == 0:
            text = text.replace(" ", " zorgle brunk ", 2)
            labels.append((i, 1, 1))
        elif i % 2:
            labels.append((i, 1, 0))
        if i % 10 == 1 and i > 10:
            text = docs[i - 10][1] + " end"  # a near copy
        if i % 10 == 2:
            text += "\n" + rng.choice(common)
        if i % 10 == 3:
            w = rng.choice(common).split()
            w[rng.randrange(9)] = "other"
            text += "\n" + " ".join(w)
        if i % 40 == 4:
            text += "\n" + items[i % 4][1]
        docs.append((i, text, "en", f"s{i % 5}", len(text)))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_equal_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == before.dtypes
        kept.append({r["doc_id"]: r for r in docs.collect()})
    toxic, cleaned, single, free, mixed = kept
    assert not any(r["text"] and "zorgle" in r["text"] for r in toxic.values()) and {1, 7, 900, 901} <= toxic.keys()
    assert toxic.keys() == {i for i in range(240) if i % 6} | {900, 901}
    texts = {i: r["text"] for i, r in toxic.items()}
    want = plain_lines([(i, t) for i, t in texts.items() if t is not None])
    assert {i: r["text"] for i, r in cleaned.items()} == want | {900: None}
    assert all(r["n_chars"] == len(r["text"]) for i, r in cleaned.items() if r["text"] is not None)
    groups = plain_groups([(i, r["text"]) for i, r in cleaned.items()], 2)
    assert single.keys() == {i for i, (_, top) in groups.items() if top == i}
    leaked = {i for i, r in single.items() if any(t in (r["text"] or "") for t in items)}
    assert leaked and single.keys() - free.keys() == leaked
    sizes = {}
    for r in free.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    goal = targets(sizes)
    for s in sizes:
        own = [r for r in mixed.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= max(r["size"] for r in own)
    assert mixed.keys() == free.keys()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "mixing"] and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables_and_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    extra = docs.limit(20).selectExpr("*", *(f"'x' as {c}" for c in ("score", "_score", "kept", "gone_id", "component_id", "item_id", "n_lines", "size")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, sf_dir)
        assert out.columns == extra.columns and {r["score"] + r["_score"] + r["size"] for r in out.collect()} == {"xxx"}
