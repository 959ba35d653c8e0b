import random

from timeloom.llm import components, neardup


def brute(docs, words, percent=80):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in docs:
        w = [x.decode() for x in (t or "").translate(lower).encode().split()]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def make(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(12, 80))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(w)))
    return docs


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, k) for k in range(501, 700)] + [(700, 699), (800, 800), (900, 901), (901, 900)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 500 for k in range(500, 701)} | {900: 900, 901: 900}


def test_against_all_pairs(spark):
    for words in (2, 5):
        docs = make() + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "two words"), (1006, "TWO words"), (1007, "x\x1cy z")]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, words=words).collect()}
        assert got == brute(docs, words)


def test_dense_groups_keep_links_between_non_leads(spark):
    # documents that share a long passage collide in many tables without a link; pairs among them are linked
    rng = random.Random(9)
    common = [f"c{k}" for k in range(60)]
    texts = []
    for _ in range(120):
        own = [f"o{rng.randrange(10**6)}" for _ in range(30)]
        texts += [" ".join(common + own), " ".join(common + own[:-2] + ["u", "v"])]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=2).collect()}
    assert got == brute(docs, 2)


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, t, 1), (5, t, 2), (5, t, 2), (3, t, 3), (3, "other words of it", 4)], "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    out = neardup.deduplicated(df)
    assert out.columns == df.columns and out.count() == 3
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_lone_rows_count_where_the_size_of_null_is_negative(spark):
    # near copies in different tasks, so that each bucket row stands alone
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string").repartitionByRange(2, "doc_id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.ansi.enabled", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k in old:
            spark.conf.set(k, "false")
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, words=2, percent=80).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {1: 1, 2: 1}
