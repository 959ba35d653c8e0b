import hashlib
import re

from timeloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(s))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base(t):
    number = lambda m: re.sub(r"\D", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(number(m)) <= 19 and luhn(number(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(number(m)) <= 15]
    return sorted(out)


TEXTS = [
    "a@b.c%x@d.e, ..@x.y a.b@c a@b@c.d x@y..z é@ñ.com q@w.e.r.t-u.",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 1.2.3 99999999999999999999.1.1.1 a1.2.3.4b",
    "4111 1111 1111 1111, 4111-1111-1111-1111 and 4111  1111 1111 1111 4111111111111112 5 5 5 5 5",
    "+1 (499) 555-6503 +44.20.7946.0958 + 1 555 +12 +123456789012345678 ++49 30 901820",
    "\x01 1\x012 a\x02.b@c\x01d.e 😀 mail me@x.org 🎉 10.0.0.1",
    "1" * 3000, "a." * 20000 + "@" + "b." * 20000, "1 2 " * 20000, "", "+" + "1 " * 10000,
]


def test_base_spans_equal_the_plain_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.personal_data(df).collect()}
    assert got.pop(99) == []
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}


def test_added_spans_and_redaction(spark):
    secret = lambda i: f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"'
    rows = [(i, f"words and {secret(i)} more", "x") for i in range(40)] + [(100 + i, f"the plainword{i} of_no_digits_at_all_here", "x") for i in range(40)] + [(500, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert all(len(got[i]["added"]) == 1 for i in range(40)) and all(not got[i]["added"] for i in range(100, 140))
    out = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert out[3]["text"] == 'words and token = "<secret>" more' and out[500]["text"] is None and out[3]["base"] == "x"
    assert pii.personal_data(df.limit(0)).count() == 0


def test_each_row_is_redacted_by_its_own_spans(spark):
    rows = [(1, "hello there x.y@zzz.com please", "a", "b"), (1, "x.y@zzz.com first", "a", "b"), (None, "10.0.0.1", "a", "b"), (1, None, "a", "b")]
    out = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string, _of string, row string"))
    assert out.columns == ["doc_id", "text", "_of", "row"]
    assert {r["text"] for r in out.collect()} == {"hello there <email> please", "<email> first", "<ip>", None}


def test_many_spans_in_one_text(spark):
    # around the sizes of a block of folded matches, and a text with thousands
    texts = {n: " ".join(f"é{k} a{k % 13}@b.cc, 10.0.0.{k % 256}" for k in range(n)) for n in (1, 63, 64, 65, 128, 129, 4000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.personal_data(df).collect()}
    assert got == {n: base(t) for n, t in texts.items()}
    whole = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert whole == {n: IP.sub("<ip>", EMAIL.sub("<email>", t)) for n, t in texts.items()}
