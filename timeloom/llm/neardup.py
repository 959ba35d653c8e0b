"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut
from .components import components
from .textkit import LOWER, U, combined, mixed, slices, windows, word_hashes

#: Two collections of SIDE keys, each key of ROWS minhashes; a table for each pair of keys, so SIDE * SIDE tables of
#: 2 * ROWS minhashes cost only 2 * SIDE * ROWS minhashes. A pair at 0.8 is missed with a probability of 2 * 0.488**SIDE.
SIDE, ROWS = 12, 3
#: Documents whose table keys are combined before the shuffle; documents that meet in one comparison.
NEAR, BLOCK = 4096, 256
#: Bytes of sets that a task hands on at once: a document goes to each group that it is compared in.
SENT = 8 << 20
_MUL = mixed(np.arange(1, 2 * SIDE * ROWS + 1, dtype=np.uint64)) | U(1)
_ADD = mixed(np.arange(1001, 2 * SIDE * ROWS + 1001, dtype=np.uint64))


def shingle_sets(texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, shingles): the distinct shingle hashes of each text, ascending; fewer words than asked make one shingle."""
    at, hashes = word_hashes(texts, LOWER)
    counts, found = np.zeros(len(texts) + 1, np.int64), []
    for k in range(len(texts)):
        own = hashes[at[k] : at[k + 1]]
        own = np.unique(windows(own, min(words, len(own)))) if len(own) else own
        counts[k + 1] = len(own)
        found.append(own)
    return np.cumsum(counts), np.concatenate(found) if found else hashes


def sketch(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The 2 * SIDE keys of each non-empty set, a row for each."""
    starts = bounds[:-1][bounds[1:] > bounds[:-1]]
    keys = np.zeros((len(starts), 2 * SIDE), np.uint64)
    if len(starts):
        for k in range(2 * SIDE):
            for r in range(ROWS):
                j = k * ROWS + r
                keys[:, k] = combined(keys[:, k], np.minimum.reduceat(shingles * _MUL[j] + _ADD[j], starts))
    return keys


def _sketches(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches):
            bounds, shingles = shingle_sets(rows["text"], words)
            sizes = np.diff(bounds)
            full = sizes > 0
            keys, sums = [None] * len(rows), np.zeros((len(rows), 2), np.int64)
            starts = bounds[:-1][full]
            if len(starts):
                sums[full, 0] = np.add.reduceat(shingles, starts).view(np.int64)
                sums[full, 1] = np.bitwise_xor.reduceat(mixed(shingles + U(77)), starts).view(np.int64)
            for k, own in zip(np.flatnonzero(full), sketch(bounds, shingles).view(np.int64)):
                keys[k] = own
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_shingles": sizes, "sum": sums[:, 0], "mix": sums[:, 1], "keys": keys})

    return run


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, lead, members: among NEAR documents at a time, those with one table key are one row, led by the least."""

    def group(batch: pd.DataFrame) -> pd.DataFrame:
        ids = batch["doc_id"].to_numpy(np.int64)
        keys = np.stack(batch["keys"].to_numpy()).view(np.uint64)
        a, b = keys[:, :SIDE], keys[:, SIDE:]
        table = np.arange(SIDE * SIDE, dtype=np.uint64).reshape(SIDE, SIDE)
        both = combined(combined(a[:, :, None], b[:, None, :]), table[None]).reshape(len(ids), -1)
        flat, own = both.ravel().view(np.int64), np.repeat(ids, SIDE * SIDE)
        order = np.lexsort((own, flat))
        flat, own = flat[order], own[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        more = np.diff(np.append(first, len(flat))) - 1
        members = np.full(len(first), None, object)
        for k in np.flatnonzero(more):
            members[k] = own[first[k] + 1 : first[k] + 1 + more[k]]
        return pd.DataFrame({"key": flat[first], "lead": own[first], "members": members})

    held, n = [], 0
    for batch in batches:
        for at in range(0, len(batch), 1024):
            held.append(batch.iloc[at : at + 1024])
            n += len(held[-1])
            if n >= NEAR:
                yield group(pd.concat(held))
                held, n = [], 0
    if n:
        yield group(pd.concat(held))


def _with_sets(words: int):
    names = ["g", "block", "lead", "part", "doc_id", "set"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches, most=1 << 20):
            bounds, shingles = shingle_sets(rows["text"], words)
            out, size = [], 0
            for k, (doc, groups) in enumerate(zip(rows["doc_id"], rows["groups"])):
                own = shingles[bounds[k] : bounds[k + 1]].tobytes()
                for x in groups:
                    out.append((x["g"], x["block"], x["lead"], x["part"], int(doc), own))
                    size += len(own) + 64
                    if size > SENT:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    return run


def _linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets have 100 * intersection >= percent * union."""
    small, large = sorted((len(one), len(other)))
    if 100 * small < percent * large:
        return False
    at = np.searchsorted(other, one)
    at[at == len(other)] = 0
    common = int(np.count_nonzero(other[at] == one))
    return 100 * common >= percent * (len(one) + len(other) - common)


def _star_links(percent: int):
    """Within a block: links between the lead and each member."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        lead, ids = rows["lead"].to_numpy(bool), rows["doc_id"].tolist()
        out = [(ids[i], ids[k]) for i in np.flatnonzero(lead) for k in np.flatnonzero(~lead) if _linked(sets[i], sets[k], percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _block_links(percent: int):
    """Between two parts of a table's bucket: links between documents of different components, a forest of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, parts = rows["doc_id"].to_numpy(np.int64), rows["part"].to_numpy(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        above = dict(zip(rows["component"], rows["component"]))

        def top(c):
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        split, own, out = len(set(parts)) > 1, rows["component"].to_numpy(np.int64), []
        for i in range(len(ids)):
            for j in range(i):
                if split and parts[i] == parts[j]:
                    continue
                x, y = top(own[i]), top(own[j])
                if x != y and _linked(sets[i], sets[j], percent):
                    above[max(x, y)] = min(x, y)
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


GROUPS = "array<struct<g:bigint,block:bigint,lead:boolean,part:bigint>>"
SETS = "g bigint, block bigint, lead boolean, part bigint, doc_id bigint, set binary"


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """A row for each group of ``wanted`` (doc_id, group) with the document's full set.

    Up to the rows that bounded() allows, the list of documents is broadcast; a longer one is joined by a shuffle.
    """
    wanted = cut(wanted)
    marked = bounded(wanted) is not wanted
    lists = wanted.groupBy("doc_id").agg(F.collect_list("group").alias("groups"))
    joined = docs.select("doc_id", "text").join(F.broadcast(lists) if marked else lists, "doc_id")
    return joined.mapInPandas(_with_sets(words), SETS)


def links(docs: DataFrame, sketches: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): confirmed links, enough of them that the components are those of all links that a table shows.

    sketches: doc_id, keys of representatives. Documents that share a table key form a bucket. First each bucket's members
    are compared with its least document (and, before the shuffle, with the least of the NEAR documents they stand among).
    Buckets that then still lie in several components are compared block against block until all pairs of different
    components are done.
    """
    rows = sketches.select("doc_id", "keys").mapInPandas(_tables, "key bigint, lead bigint, members array<bigint>")
    bucket = Window.partitionBy("key")
    # the size of null is -1 or null, by the session's settings
    others = F.when(F.col("members").isNull(), 0).otherwise(F.size("members"))
    rows = rows.withColumns({"least": F.min("lead").over(bucket), "n": F.sum(F.lit(1) + others).over(bucket)})
    buckets = cut(rows.filter("n > 1"))
    pairs = buckets.filter("lead <> least").select(F.col("least").alias("g"), F.col("lead").alias("doc_id"))
    pairs = pairs.unionByName(buckets.filter("members is not null").select(F.col("lead").alias("g"), F.explode("members").alias("doc_id"))).distinct()
    block = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    many = pairs.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = cut(pairs.join(many, "g").select("g", "doc_id", "blocks", F.pmod(block, F.col("blocks")).alias("block")))
    of = lambda df, lead: df.select("doc_id", F.struct("g", "block", F.lit(lead).alias("lead"), F.lit(0).cast("long").alias("part")).alias("group"))
    heads = dealt.select("g", "block").distinct().select("g", F.col("g").alias("doc_id"), "block")
    sets = _sets_of(docs, of(dealt, False).unionByName(of(heads, True)), words)
    star = cut(sets.groupBy("g", "block").applyInPandas(_star_links(percent), "a bigint, b bigint"))

    label = components(star)
    members = buckets.filter("n > 2").select("key", "least", F.explode(F.concat(F.array("lead"), F.coalesce("members", F.array().cast("array<bigint>")))).alias("doc_id"))
    members = members.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    # what is left of the buckets of one least document is compared together, and of equal unions only one
    members = cut(members.join(split, "key").select("least", "doc_id", "component").distinct())
    unions = members.groupBy("least").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("h1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("h2"))
    todo = unions.groupBy("n", "h1", "h2").agg(F.min("least").alias("least")).select("least", F.ceil(F.col("n") / BLOCK).alias("parts"))
    todo = cut(members.join(todo, "least").withColumnRenamed("least", "key"))
    if todo.isEmpty():
        return star
    part = F.pmod(block, F.col("parts"))
    todo = todo.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    wanted = todo.select("doc_id", F.struct(F.col("key").alias("g"), pair.alias("block"), F.lit(False).alias("lead"), "part").alias("group"))
    more = _sets_of(docs, wanted, words).join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    return star.unionByName(more.groupBy("g", "block").applyInPandas(_block_links(percent), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document of ``docs`` (doc_id, text; other columns are unused).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``words``-word shingles
    (A-Z lower-cased; fewer words make one shingle); component_id is the least doc_id that links reach. Equal sets are
    linked by grouping; all other links are found through the tables and confirmed on full sets. Null or empty texts
    have an empty set and link with nothing. Rows of one doc_id are one node; a null doc_id is linked with nothing, has a
    null component and is kept. An empty table gives an empty result.
    """
    base = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    found = cut(base.mapInPandas(_sketches(words), "doc_id bigint, n_shingles bigint, sum bigint, mix bigint, keys array<bigint>"))
    full = found.filter("doc_id is not null and n_shingles > 0")
    same = full.groupBy("n_shingles", "sum", "mix").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.count("*").alias("n"))
    same = cut(same)
    known = ["n_shingles", "sum", "mix"]
    copies = same.filter("n > 1").select("first", *known)
    equal = cut(full.join(copies, known).select("doc_id", "first").filter("doc_id <> first").distinct())
    # a doc_id of several rows may stand for several sets: only such ids link what their sets are equal to
    several = full.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    bridges = equal.join(several, "doc_id").unionByName(equal.join(several.withColumnRenamed("doc_id", "first"), "first").select("doc_id", "first"))
    reps = same.select(F.col("first").alias("doc_id"), "keys")
    near = links(base.filter("doc_id is not null"), reps, words, percent)
    label = components(near.unionByName(bridges.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))))
    # all other copies take the component of the document that they are equal to, outside of the search for components
    label = cut(label)
    others = equal.join(label.select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
    others = others.join(bounded(label.withColumnRenamed("node", "first")), "first", "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "first").alias("component"))
    others = others.groupBy("node").agg(F.min("component").alias("component"))
    out = found.select("doc_id", "n_shingles").join(label.unionByName(others).withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with their own columns, whose document is the least of its group."""
    gone = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
