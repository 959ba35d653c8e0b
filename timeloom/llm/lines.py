"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, bounded, cut, free_name, once

#: Lines of fewer words are left alone: empty ones only.
MIN_WORDS = 1
#: Lines of fewer words go only if they repeat exactly: one word is a large part of them.
FUZZY_WORDS = 5


def spaced(text: Column) -> Column:
    """text with blanks for its other white space inside lines."""
    out = text
    for space in "\t\x0b\x0c\r":
        out = F.replace(out, F.lit(space), F.lit(" "))
    return F.when(text.rlike(r"[\t\x0b\x0c\r]"), out).otherwise(text)


def plain(line: Column) -> Column:
    """The words of a spaced() line, joined by one blank."""
    one = F.trim(line)
    return F.when(F.contains(one, F.lit("  ")), F.regexp_replace(one, " {2,}", " ")).otherwise(one)


def n_words(text: Column) -> Column:
    """Number of words of a plain() text."""
    return F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def _halves(text: Column, n: Column) -> Column:
    """Up to four keys of a line: for b = n and b = n - 1 words, its first b // 2 words and its last b - b // 2.

    If one word is substituted, inserted or deleted, one of these keys of both lines is equal: the one of the half that
    the edit is not in, for b the words of the shorter line.
    """

    def keys(b: Column) -> list[Column]:
        h = F.floor(b / 2).cast("int")
        return [F.xxhash64(F.lit("head"), b, _words_of(text, h)), F.xxhash64(F.lit("tail"), b, _words_of(text, h - b))]

    return F.array(*keys(n), *keys(n - 1))


def _words_of(text: Column, n: Column) -> Column:
    """The first n words of a plain text, or the last -n."""
    return F.call_function("substring_index", text, F.lit(" "), n)


def _xor(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _xor_before(values: Column, m: Column) -> Column:
    """For i in 0..m the XOR of the first i values, by blocks of about sqrt(m) values."""

    def by_blocks(c: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), c), lambda j: _xor(F.slice(values, j * c + 1, c)))
        ahead = bound(blocks, lambda b: F.transform(F.sequence(F.lit(0), c), lambda j: _xor(F.slice(b, F.lit(1), j))))
        at = lambda i: F.floor(i / c).cast("int")
        return bound(ahead, lambda a: F.transform(F.sequence(F.lit(0), m), lambda i: F.get(a, at(i)).bitwiseXOR(_xor(F.slice(values, at(i) * c + 1, (i % c).cast("int"))))))

    return bound(F.ceil(F.sqrt(m)).cast("int"), by_blocks)


def _variants(lines: DataFrame) -> DataFrame:
    """(variant, whole, doc_id, pos): hashed keys of the deletion neighbourhood of each line (w, halves: matched indexes).

    Only words outside the half that matched are deleted. Words hash with their place, so a deletion is an XOR of sums
    before and after it. Keys of substitutions hold the place and the length; a key of an insertion is the whole rest of
    the shorter line (``whole``) and the rest of the longer one without a word.
    """
    x = lines.withColumn("half", F.explode("halves"))
    n = F.size("w")
    b = F.when(F.col("half.i") < 2, n).otherwise(n - 1)
    h = F.floor(b / 2).cast("int")
    rest = F.when(F.col("half.i") % 2 == 0, F.slice("w", h + 1, n - h)).otherwise(F.slice("w", F.lit(1), n - (b - h)))
    x = once(x.select("doc_id", "pos", F.col("half.key").alias("key"), (F.col("half.i") < 2).alias("same"), rest.alias("rest")), r=F.col("rest"), m=F.size("rest")).drop("rest")
    x = once(x, f=F.transform("r", lambda w, i: F.xxhash64(w, i)), g=F.when(~F.col("same"), F.transform("r", lambda w, i: F.xxhash64(w, i - 1)))).drop("r")
    x = once(x, all=_xor(F.col("f")), fs=F.when(~F.col("same"), _xor_before(F.col("f"), F.col("m"))), gs=F.when(~F.col("same"), _xor_before(F.col("g"), F.col("m")))).drop("g")
    substituted = F.transform("f", lambda v, i: F.struct(F.xxhash64("key", F.lit("s"), i, F.col("all").bitwiseXOR(v)).alias("variant"), F.lit(None).cast("boolean").alias("whole")))
    whole = F.array(F.struct(F.xxhash64("key", F.lit("i"), "m", "all").alias("variant"), F.lit(True).alias("whole")))
    less = lambda v, i: F.struct(
        F.xxhash64("key", F.lit("i"), F.col("m") - 1, F.get("fs", i).bitwiseXOR(F.element_at("gs", -1)).bitwiseXOR(F.get("gs", i + 1))).alias("variant"), F.lit(False).alias("whole")
    )
    out = F.when(F.col("same"), F.concat(substituted, whole)).otherwise(F.transform("f", less))
    return x.select("doc_id", "pos", F.explode(out).alias("v")).select("doc_id", "pos", "v.variant", "v.whole")


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one substituted, inserted or deleted word apart."""
    n, m = F.size(a), F.size(b)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda e: e))
    long_, short = F.when(n > m, a).otherwise(b), F.when(n > m, b).otherwise(a)
    at = F.array_position(F.zip_with(long_, short, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    return F.when(n == m, differ <= 1).when(F.abs(n - m) == 1, F.slice(long_, at + 1, F.greatest(n, m)) == F.slice(short, at, F.greatest(n, m))).otherwise(False)


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line: the spaced() lines of each document; a null doc_id is the least there is."""
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc_id"), F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("pos", "line"))


def _near(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, pos): first places of distinct lines that are one edit from a line with an earlier place, verified."""
    keyed = lines.filter("halves is not null").select("h1", "h2", F.posexplode("halves").alias("i", "key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("key")
    matched = keyed.join(shared, "key").groupBy("h1", "h2").agg(F.collect_list(F.struct("i", "key")).alias("halves"))
    matched = cut(lines.select("h1", "h2", "doc_id", "pos").join(matched, ["h1", "h2"]).drop("h1", "h2"))
    # the words of these lines, from one place each
    text = exploded(docs).join(bounded(matched), ["doc_id", "pos"])
    text = text.groupBy("doc_id", "pos").agg(F.first("halves").alias("halves"), F.max("line").alias("line")).withColumn("t", plain(F.col("line")))
    text = cut(text.select("doc_id", "pos", "halves", F.split("t", " ").alias("w")))
    variants = _variants(text)
    place = F.struct("doc_id", "pos")
    mine = lambda c, name: F.min(F.when(c, place)).alias(name)
    groups = variants.groupBy("variant").agg(F.count("*").alias("n"), mine(F.isnull("whole"), "any"), mine(F.col("whole"), "one"), mine(~F.col("whole"), "others")).filter("n > 1")
    groups = cut(groups.filter("any is not null or (one is not null and others is not null)").drop("n"))
    found = variants.join(bounded(groups), "variant")
    partner = F.when(F.isnull("whole"), F.col("any")).when(F.col("whole"), F.col("others")).otherwise(F.col("one"))
    pairs = found.withColumn("other", partner).filter(F.col("other") < place).groupBy("doc_id", "pos").agg(F.min("other").alias("other"))
    pairs = cut(pairs.select("doc_id", "pos", F.col("other.doc_id").alias("doc_b"), F.col("other.pos").alias("pos_b")))
    small = bounded(pairs)
    ours = text.select("doc_id", "pos", "w").join(small, ["doc_id", "pos"])
    theirs = text.select(F.col("doc_id").alias("doc_b"), F.col("pos").alias("pos_b"), F.col("w").alias("w_b")).join(small, ["doc_b", "pos_b"]).select("doc_id", "pos", "w_b")
    return ours.join(theirs, ["doc_id", "pos"]).filter(one_edit_apart(F.col("w"), F.col("w_b"))).select("doc_id", "pos")


def added_names(docs: DataFrame) -> list[str]:
    """The names of the two columns that dedup_lines adds: n_lines and n_removed, or free ones like them."""
    return free_name(docs, "n_lines", "n_removed")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS, fuzzy: bool = True) -> DataFrame:
    """docs with ``text`` replaced, and the added columns n_lines and n_removed (long; see added_names() for clashes).

    Lines end at \\n; a line is its words, so white space does not tell lines apart. A line of at least ``min_words`` words
    goes if an equal line or, from ``fuzzy_words`` words on both sides, a line one word away (substituted, inserted or deleted;
    with ``fuzzy`` false: none) stands earlier: smaller doc_id, or same document and earlier line. Lines are judged on the
    input, so the earliest of each kind stays. Other lines and all order are kept; kept lines are joined by \\n. Documents
    always stay, with empty text if all lines went. Null texts stay null and have 0 lines. Null doc_ids come first. Rows of one
    doc_id are one document: what one of them keeps at a place, the others keep there too. Other columns stay, whatever their
    names; an empty table stays empty. Equal lines meet in aggregates combined before the shuffle; lines with equal variants
    are compared with the earliest only.
    """
    base = docs.select("doc_id", "text")
    rows = once(once(exploded(base), t=plain(F.col("line"))).drop("line"), n=n_words(F.col("t")))
    halves = F.when(F.col("n") >= fuzzy_words, _halves(F.col("t"), F.col("n")))
    rows = rows.filter(F.col("n") >= min_words).select("doc_id", "pos", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), halves.alias("halves"))
    lines = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.max("halves").alias("halves"))
    lines = cut(lines.select("h1", "h2", "at.doc_id", "at.pos", "halves"))
    places = lines.select("doc_id", "pos")
    if fuzzy:
        places = places.join(_near(base, lines), ["doc_id", "pos"], "left_anti")
    kept, of, old, split, gone = free_name(docs, "kept", "kept_of", "old_text", "lines", "gone")
    places = places.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list("pos").alias(kept))
    out = docs.join(places, F.coalesce(docs["doc_id"], F.lit(-(1 << 63)).cast("long")) == F.col(of), "left").withColumn(old, docs["text"])
    judged = F.filter(F.transform(F.split(spaced(F.col(old)), "\n"), lambda line, i: bound(plain(line), lambda t: F.when(n_words(t) >= min_words, i))), lambda i: i.isNotNull())
    out = once(out, **{split: F.split(F.col(old), "\n")})
    out = once(out, **{gone: F.array_except(judged, F.coalesce(kept, F.array().cast("array<int>")))})
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.when(F.size(gone) == 0, F.col(old)).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(split), i)), "\n"))
    own = [F.col(f"`{c}`") if c != "text" else F.when(F.col(old).isNull(), None).otherwise(text).alias("text") for c in docs.columns]
    # the size of null is -1 or null, by the session's settings
    count = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    n_lines, n_removed = added_names(docs)
    return out.select(*own, count(split).alias(n_lines), count(gone).alias(n_removed))


def clean(docs: DataFrame, **options) -> DataFrame:
    """docs with their own columns only: ``text`` without repeated lines and, if there is one, ``n_chars`` to match it."""
    out, (_, gone) = dedup_lines(docs, **options), added_names(docs)
    own = [F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(out["n_chars"]).alias(c) if c == "n_chars" else out[f"`{c}`"] for c in docs.columns]
    return out.select(*own)
