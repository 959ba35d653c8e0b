import random
import re

from timeloom.llm import decontam

ITEMS = [
    (1, "A train leaves the old station at noon and covers 120 km in 3 hours while Maria waits beside the wooden gate for her brother to arrive."),
    (2, "Two painters need 14 days to finish a large wall; how long would 7 painters of equal skill need to finish that same wall together?"),
    (3, "one two"),
]


def run(spark, docs, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontam.contamination(d, spark.createDataFrame(ITEMS, "item_id long, text string"), **options).collect()
    return {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in got}


def test_exact_and_reparameterised_copies(spark):
    twin = ITEMS[0][1].replace("120", "75").replace(" 3 ", " 2 ").replace("Maria", "Anton")
    mixed = ITEMS[1][1].replace("14", "9").replace("7 painters", "5 painters")
    rest = "There is nothing here that any list of questions would hold, only plain words about weather. "
    docs = [(1, rest + ITEMS[0][1] + " " + rest), (2, rest + twin), (3, rest + mixed), (4, rest * 3), (5, ITEMS[0][1][:60]), (6, None), (7, ""), (8, "one two"), (9, rest * 9000 + ITEMS[1][1])]
    got = run(spark, docs)
    assert got[1] == (True, 1) and got[2] == (True, 1) and got[3] == (True, 2) and got[9] == (True, 2)
    assert not any(got[k][0] for k in (4, 5, 6, 7, 8))


def test_inconsistent_slots_are_no_copy(spark):
    # the item repeats one number; a text with two different ones in its places asks something else
    item = [(1, "Add 12 apples to the basket on the table and then take the same 12 apples out of the basket on the table again before noon.")]
    same, other = item[0][1].replace("12", "40"), item[0][1].replace("12", "40", 1)
    d = spark.createDataFrame([(1, same), (2, other)], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontam.contamination(d, spark.createDataFrame(item, "item_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_edges(spark):
    d = spark.createDataFrame([(None, ITEMS[0][1], 1), (4, ITEMS[0][1], 2), (4, ITEMS[0][1], 2), (5, "free", 3)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([*ITEMS, ITEMS[0], (None, "x")], "item_id long, text string")
    out = decontam.decontaminated(d, b)
    assert out.columns == d.columns and sorted(r["item_id"] for r in out.collect()) == [1, 3]
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert {r["contaminated"] for r in decontam.contamination(d, b.limit(0)).collect()} == {False}


def test_items_without_a_window_are_found_word_for_word(spark):
    numbers = " ".join(str(k * k) for k in range(40))
    items = [(1, "What is 3 + 4?"), (2, "Anna Berta Clara Dora"), (3, numbers), (4, "12 13 14"), (4, "7 8 9")]
    docs = [(1, "He asked: what is 3 4 and left"), (2, "What is 3 + 5?"), (3, f"x {numbers} y"), (4, numbers.replace("1444", "1443")), (5, "see anna berta clara, dora"), (6, "of 7 8 9"), (7, "What is"), (8, "3 + 4?")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in decontam.leaks(d, b).collect()}
    assert got == {(1, 1, 1.0), (3, 3, 1.0), (5, 2, 1.0), (6, 4, 1.0)}


def plain(text):
    """(template word, value or None) of each word, by the rules in words."""
    out, number = [], False
    for word in text.split():
        core = re.sub(r"^[^A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff]+$", "", word)
        if not core:
            continue
        low, digit, letter = core.lower(), bool(re.search("[0-9]", core)), bool(re.search("[^0-9\\W_]", core))
        mark = "#" if digit and not letter else "q" if core[0].isdigit() else "u" if number and low in decontam.UNITS else "N" if core[0].isupper() and not (core[1:2] or core).isupper() else None
        number = mark == "#"
        out.append((mark or low, low if mark else None))
    return out


def brute(docs, items, share=0.8):
    found = set()
    for item_id, item in items:
        t = plain(item)
        need = {k: tuple(x[0] for x in t[k : k + 5]) for k in range(len(t) - 4) if sum(x[1] is None for x in t[k : k + 5]) >= 3}
        for doc_id, doc in docs:
            d = plain(doc)
            at = {}
            for k in range(len(d) - 4):
                at.setdefault(tuple(x[0] for x in d[k : k + 5]), []).append(k)
            diagonals = {}
            for k, w in need.items():
                for j in at.get(w, []):
                    hit = diagonals.setdefault(j - k, (set(), set()))
                    hit[0].add(w)
                    hit[1].update((a[1], b[1]) for a, b in zip(t[k : k + 5], d[j : j + 5]) if a[1])
            have = set().union(*(w for w, pairs in diagonals.values() if len({a for a, _ in pairs}) == len(pairs)))
            if need and len(have) >= share * len(set(need.values())) - 1e-9:
                found.add((doc_id, item_id))
    return found


NAMES = "Natalia Ben Tom Maria Anton Lea Omar Yuki Nils Rosa".split()
FORMS = [
    "{a} sold clips to {x} of her friends in April, and then she sold half as many clips in May. How many clips did {a} sell altogether in April and May? {a} sold {x} first.",
    "{a} has {x} red pens and {y} blue ones. {b} gives {a} another {z} pens from the old box. How many pens does {a} have once {b} has gone home?",
    "A tank holds {x} liters of water. {a} pours out {y} liters each hour while {b} adds {z} liters from a small bucket. After how many hours is the tank of {a} empty?",
    "{b} drives {x} km to the lake at {y} kmh and walks back along the river with {a} in {z} hours. How fast did {b} walk on the way back home with {a}?",
]


def made(rng, form):
    a, b = rng.sample(NAMES, 2)
    x, y, z = rng.sample(range(2, 900), 3)
    return form.format(a=a, b=b, x=x, y=y, z=z)


def test_word_problems_against_a_plain_version(spark):
    rng = random.Random(3)
    items = [(k, made(rng, f)) for k, f in enumerate(FORMS)]
    prose = lambda n: " ".join(rng.choice("the river was cold and nobody knew where old boats went after dark".split()) for _ in range(n))
    docs = []
    for i in range(80):
        text = made(rng, FORMS[i % 4])
        if i % 5 == 3:  # one name or number of several is another one
            w = text.split()
            k = rng.choice([k for k, x in enumerate(w) if x.rstrip("?.,") in NAMES or x.isdigit()])
            w[k] = rng.choice(NAMES) if w[k][0].isalpha() else "901"
            text = " ".join(w)
        if i % 5 == 4:
            w = text.split()
            del w[rng.randrange(len(w))]
            text = " ".join(w)
        docs.append((i, prose(rng.randint(0, 40)) + ". " + text + " " + prose(20)))
    docs += [(100 + i, prose(60)) for i in range(20)]
    # an inconsistent copy in front of a consistent one hides nothing
    docs.append((200, items[1][1].replace(re.search(r"\d+", items[1][1])[0], "7", 1) + " " + prose(9) + " " + items[1][1]))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b).collect()}
    assert got == brute(docs, items)
    whole = {(i, i % 4) for i in range(80) if i % 5 < 3}
    assert len(got & whole) >= 0.9 * len(whole) and (200, 1) in got and not any(i in range(100, 120) for i, _ in got)


def test_where_a_long_text_is_cut_changes_nothing(spark):
    items = [(1, "A barrel that holds 40 liters of dark beer is rolled into the cellar by Maria before the evening guests arrive at the inn.")]
    at = 1 << 19
    texts = [("word " * at)[: at - n] + " " + items[0][1].replace("40", "75").replace("Maria", "Anton") for n in range(20, 60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert decontam.leaks(d, spark.createDataFrame(items, "item_id long, text string")).count() == len(texts)
