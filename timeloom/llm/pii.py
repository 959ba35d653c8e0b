"""Personal data by weak supervision, with DataFrame functions only.

Fixed patterns give the base spans. Wider patterns give candidates; regular-expression, gazetteer and context labelers vote
on each, expectation maximisation estimates how reliable each labeler is, and the posteriors train a classifier of spans,
which decides on the candidates. No regular expression here repeats a group without bound, so long runs neither overflow the
stack nor take more than linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, bound, cut, once, placed

#: In the order in which spans of one start are listed; the last two are those that the method adds.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
MARK, OTHER = "\x01", "\x02"
_local = rf"[A-Za-z0-9._%+{MARK}-]"
#: On a text in which dots between domain characters are MARK: a domain is a run with a mark behind its first label.
EMAIL = rf"(?:\G|(?<!{_local})){_local}++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: On a text in which single blanks and hyphens between digits are MARK.
CARD = rf"(?<![0-9{MARK}])[0-9{MARK}]{{12,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+"
NUMBER = r"(?<![A-Za-z0-9.+])\(?[0-9][0-9().\x20/-]{7,}[0-9]"
#: Words before a value that speak for personal data or credentials. Fixed values.
GAZETTEER = (
    "token secret password passwd pwd key apikey api auth bearer credential credentials private login pin ssn iban bic account konto compte cuenta "
    "tel telephone telefon telefono mobile mobil handy fax phone call whatsapp contact kontakt passport card karte carte tarjeta"
).split()
AGAINST = "isbn issn doi version page pages chapter figure vol volume commit sha md5 build".split()
VOTES, FEATURES, ROUNDS = 5, 8, 20

Span = "struct<start:int,k:int,end:int>"


def _found(text: Column, regex: str) -> Column:
    """Array of (start, end, value, before): all matches in code points; before: up to 24 characters in front."""
    pieces, values = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,before:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"), F.right(pair["piece"], F.lit(24)).alias("before")))).alias("out"))

    def moved(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"), s["before"].alias("before"))

    pairs = bound(values, lambda v: F.zip_with(F.slice(pieces, F.lit(1), F.size(v)), v, lambda p, x: F.struct(p.alias("piece"), x.alias("value"))))
    return placed(pairs, start, step, moved)


def _some(condition: Column, found: Column) -> Column:
    """found, or nothing without looking where the text cannot match."""
    return F.when(condition, found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(number)
    one = lambda i: F.substring(number, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, one(i)).otherwise(one(i) * 2 - F.when(one(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))


def spans_of(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, base (sorted spans) and candidates (start, k, end, votes, features), of whole texts; null texts are empty.

    The ``carried`` columns of docs (other names than those here) come along in their rows.
    """
    text = F.coalesce("text", F.lit(""))
    x = docs.select("doc_id", *carried, F.replace(text, F.lit(MARK), F.lit(OTHER)).alias("t"))
    dotted = F.regexp_replace("t", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    joined = F.regexp_replace("t", r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    t = F.col("t")
    x = once(x, **{
        "email": _some(F.contains(t, F.lit("@")), _found(dotted, EMAIL)),
        "ip": _some(t.rlike(r"[0-9]\.[0-9]"), _found(t, IP)),
        "card": _some(t.rlike(r"[0-9](?:[ -]?[0-9]){11}"), _found(joined, CARD)),
        "phone": _some(F.contains(t, F.lit("+")), _found(t, PHONE)),
        "secret": _some(t.rlike("[A-Za-z0-9_-]{16}"), _found(t, SECRET)),
        "number": _some(t.rlike(r"[0-9][0-9().\x20/-]{7}"), _found(t, NUMBER)),
    })
    n = lambda s: F.length(digits(s["value"]))
    small = lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    base = F.concat(
        _spans(F.col("email"), "email"), _spans(F.filter("ip", small), "ip"),
        _spans(F.filter("card", lambda s: n(s).between(12, 19) & luhn(digits(s["value"]))), "card"), _spans(F.filter("phone", lambda s: n(s).between(9, 15)), "phone"),
    )
    x = once(x, base=F.array_sort(base))

    def judged(kind: str) -> Column:
        apart = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.transform(F.filter(F.col(kind), apart), lambda s: _judged(s, kind))

    return x.select("doc_id", *carried, "base", F.concat(judged("secret"), judged("number")).alias("candidates"))


def _judged(s: Column, kind: str) -> Column:
    """The votes of the labelers (1: personal, 0: not, null: abstains) and the classifier's features (0 or 1)."""
    value, before, n, d = s["value"], F.lower(s["before"]), F.length(s["value"]), F.length(digits(s["value"]))
    word = F.regexp_extract(before, r"([a-z]++)[^a-z]*$", 1)
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).cast("int")
    hexa, grouped = value.rlike("^[0-9a-fA-F]+$"), value.rlike(r"[0-9][ ()./-]+[0-9]")
    assigned = before.rlike(r"[=:]\s*[\"']?$")
    secret = kind == "secret"
    shape = vote(hexa & (n >= 32), ~value.rlike("[0-9].*[A-Za-z].*[0-9]")) if secret else vote(grouped & d.between(9, 12), (d < 9) | (d > 15))
    spread = vote((d * 4 >= n) & (d * 8 <= n * 7), d * 10 < n) if secret else vote(value.rlike(r"^\(?0[0-9]"), value.rlike(r"^(19|20)[0-9]{2}[ ./-]"))
    votes = [shape, spread, vote(word.isin(*GAZETTEER), word.isin(*AGAINST)), vote(assigned, before.rlike(r"[0-9a-z]\s$")), vote(value.rlike(r"^[0-9a-z]+$") if secret else grouped, F.length(F.regexp_replace(value, "(.)\\1{3,}", "")) < n)]
    flags = [F.lit(secret), n >= 24, n >= 36, d * 2 >= n, assigned, word.isin(*GAZETTEER), grouped | hexa, before.rlike(r"[\"'(<]$")]
    return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end"), F.array(*votes).alias("votes"), F.array(*[f.cast("int") for f in flags]).alias("features"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit(found: DataFrame) -> DataFrame:
    """One row (prior, yes, no, weights, bias): the labelers' reliabilities and the classifier.

    Candidates are counted by kind, votes and features first, a table with a bounded number of rows (2 * 3**VOTES *
    2**(FEATURES - 1) at most). In each round the posterior of every pattern follows from the labelers' rates of voting 1
    in either class, and the rates from the posteriors. The classifier is a linear one over the features: its weights are the
    logarithms of their rates among posterior labels (naive Bayes with soft labels).
    """
    x = found.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.features").agg(F.count("*").cast("double").alias("n"))
    x = x.agg(F.sort_array(F.collect_list(F.struct("votes", "features", "n"))).alias("rows"))
    places = F.sequence(F.lit(0), F.lit(VOTES - 1))
    add = lambda a, v: a + v
    total = lambda f: F.aggregate(F.transform("rows", f), F.lit(0.0), add)

    def posterior(m: Column, row: Column) -> Column:
        said = F.transform(row["votes"], lambda v, j: F.when(v == 1, F.log(F.get(m["yes"], j) / F.get(m["no"], j))).when(v == 0, F.log((1 - F.get(m["yes"], j)) / (1 - F.get(m["no"], j)))).otherwise(0.0))
        return _sigmoid(_logit(m["prior"]) + F.aggregate(said, F.lit(0.0), add))

    def rates(post: Column, positive: bool) -> Column:
        share = lambda i: F.get(post, i) if positive else 1 - F.get(post, i)
        mass = lambda j, only: F.aggregate(F.transform("rows", lambda r, i: F.when(only(F.get(r["votes"], j)), r["n"] * share(i)).otherwise(0.0)), F.lit(0.0), add)
        return F.transform(places, lambda j: (mass(j, lambda v: v == 1) + (2.0 if positive else 0.5)) / (mass(j, lambda v: v.isNotNull()) + 2.5))

    def step(m: Column, _: Column) -> Column:
        return F.get(F.transform(F.array(F.transform("rows", lambda r: posterior(m, r))), lambda post: F.struct(((F.aggregate(F.zip_with(post, F.col("rows"), lambda p, r: p * r["n"]), F.lit(0.0), add) + 1) / (total(lambda r: r["n"]) + 2)).alias("prior"), rates(post, True).alias("yes"), rates(post, False).alias("no"))), 0)

    first = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.8), VOTES).alias("yes"), F.array_repeat(F.lit(0.2), VOTES).alias("no"))
    x = once(x, m=F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step))
    x = once(x, post=F.transform("rows", lambda r: posterior(F.col("m"), r)))

    def rate(j: Column, positive: bool) -> Column:
        share = lambda i: F.get("post", i) if positive else 1 - F.get("post", i)
        mass = lambda f: F.aggregate(F.transform("rows", f), F.lit(0.0), add)
        return (mass(lambda r, i: r["n"] * share(i) * F.get(r["features"], j)) + 0.5) / (mass(lambda r, i: r["n"] * share(i)) + 1)

    features = F.sequence(F.lit(0), F.lit(FEATURES - 1))
    x = once(x, on=F.transform(features, lambda j: F.struct(rate(j, True).alias("p"), rate(j, False).alias("q"))))
    weight = F.transform("on", lambda r: _logit(r["p"]) - _logit(r["q"]))
    bias = _logit(F.col("m.prior")) + F.aggregate(F.transform("on", lambda r: F.log((1 - r["p"]) / (1 - r["q"]))), F.lit(0.0), add)
    return x.select("m.prior", "m.yes", "m.no", weight.alias("weights"), bias.alias("bias"))


def personal_data(docs: DataFrame, threshold: float = 0.5, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``carried`` columns, base, added: for each row of docs (doc_id, text) its base spans and the candidates that the classifier accepts.

    Spans are (start, k, end), k the place in KINDS, in code points, end exclusive, sorted. Added spans overlap no base span.
    Null texts are empty and have none; without candidates nothing is added. Rows are handled one by one, so nulls, ties,
    repeated rows and extra columns change nothing else; the model (one row of VOTES and FEATURES numbers) is the only thing
    that leaves the executors.
    """
    found = cut(spans_of(docs, *carried))
    model = fit(found).first()
    weights = F.array(*map(F.lit, model["weights"]))
    chance = lambda c: _sigmoid(F.lit(model["bias"]) + F.aggregate(F.zip_with(c["features"], weights, lambda f, w: f * w), F.lit(0.0), lambda a, x: a + x))
    added = F.transform(F.filter("candidates", lambda c: chance(c) >= threshold), lambda c: F.struct(c["start"], c["k"], c["end"]))
    return found.select("doc_id", *carried, "base", F.array_sort(added.cast(f"array<{Span}>")).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, **options) -> DataFrame:
    """docs with each found span of ``text`` replaced by its kind in angle brackets; null texts stay null.

    Spans are those of the row's own text, so rows of one doc_id may differ; of overlapping spans the first counts. Other
    columns stay, whatever their names; repeated rows stay; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = once(personal_data(rows, carried=("row",), **options), spans=F.array_sort(F.concat("base", "added")))
    names, text = F.array(*map(F.lit, KINDS)), F.col("row")["text"]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.get(names, s["k"]), F.lit(">")).alias("out")))
    # FOLD spans at a time, as each step copies what it appends to
    own = lambda a, k: F.aggregate(F.slice("spans", k * FOLD + 1, F.lit(FOLD)), F.struct(a["at"].alias("at"), F.lit("").alias("out")), step)
    block = lambda a, k: bound(own(a, k), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], r["out"]).alias("out")))
    blocks = F.sequence(F.lit(0), F.floor(F.size("spans") / FOLD).cast("int"))
    changed = F.aggregate(blocks, start, block, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.select(*[F.when(text.isNull(), None).otherwise(changed).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
