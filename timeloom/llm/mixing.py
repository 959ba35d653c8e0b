"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, word_count

#: Bits of the hash that each round of histograms resolves; together all bits of the hash.
LEVELS = (12, 16, 16, 16)
BITS = sum(LEVELS)


def order_hash(doc_id):
    """A value below 2**60 from the id alone, the same in any engine: the first 15 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """A row for each source (``source``, ``total``): its target, by the level at which capped shares use up the budget.

    Sources by code point, null last, get the weights in turn. Resharing the excess over ``most * total`` until no
    source is above gives ``min(most * total, weight * level)`` with one level for all; sorted by total / weight, the
    capped sources are a prefix. One row for each source meets in one task here, documents never.
    """
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("total") * most)
    full = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"cap_sum": F.sum("cap").over(full), "w_sum": F.sum("w").over(full), "w_all": F.sum("w").over(everything), "budget": F.sum("total").over(everything) * F.lit(float(share))})
    # capped: with it and all before it at their caps, its own share of the rest would be above its cap
    before_cap, before_w = F.col("cap_sum") - F.col("cap"), F.col("w_sum") - F.col("w")
    x = x.withColumn("capped", (F.col("budget") - before_cap) * F.col("w") >= F.col("cap") * (F.col("w_all") - before_w))
    x = x.withColumns({"caps": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)), "open": F.coalesce(F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything), F.lit(0))})
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("budget") - F.col("caps")) * F.col("w") / F.col("open"))
    return x.select("source", "total", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, pass, bound): documents of the source whose hash is at most ``bound`` come nearest to the pass's budget.

    sized: source, hash, size. budgets: source, pass, rest (words). A histogram of words by hash bucket shows the bucket
    in which the budget is used up; only that bucket is split again, until buckets are single hashes. A document that
    crosses the budget is taken if that leaves the sum nearer to it. Documents are never sorted.
    """
    left, known = BITS, budgets.select("source", "pass", F.lit(0).cast("long").alias("prefix"), F.col("rest").cast("double").alias("rest"))
    for bits in LEVELS:
        left -= bits
        last = left == 0
        inside = sized.alias("d").join(known.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")) & (F.shiftright("d.hash", left + bits) == F.col("k.prefix")))
        by_bucket = inside.groupBy("k.source", "k.pass", "k.rest", F.shiftright("d.hash", left).alias("bucket")).agg(F.sum("d.size").alias("words"))
        upto = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = by_bucket.withColumn("sum", F.sum("words").over(upto)).withColumn("before", F.col("sum") - F.col("words"))
        if last:
            taken = summed.filter(F.col("before") + F.col("sum") <= 2 * F.col("rest"))
            known = known.select("source", "pass", "prefix").alias("k").join(taken.groupBy("source", "pass").agg(F.max("bucket").alias("top")).alias("t"), F.col("k.source").eqNullSafe(F.col("t.source")) & (F.col("k.pass") == F.col("t.pass")), "left")
            # none of the bucket's hashes taken: all below the bucket are
            return known.select("k.source", "k.pass", F.coalesce("top", F.shiftleft(F.col("prefix"), bits) - 1).alias("bound"))
        # the first bucket that reaches the budget, or the last one there is
        known = summed.groupBy("source", "pass").agg(F.min(F.when(F.col("sum") >= F.col("rest"), F.struct("bucket", "rest", "before"))).alias("hit"), F.max(F.struct("bucket", "rest", "before")).alias("end"))
        known = known.withColumn("at", F.coalesce("hit", "end")).select("source", "pass", F.col("at.bucket").alias("prefix"), (F.col("at.rest") - F.col("at.before")).alias("rest"))
    raise AssertionError


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken.

    ``taken`` is size times the number of nested passes (at most ``most``) whose threshold the document's hash is under,
    so a source's later passes repeat a subset of its earlier ones. Rows with one doc_id have one hash and are taken
    together; null or empty texts have size 0 and take 0; a null source is a source of its own, the last; a source
    without words has target 0; an empty table gives an empty result. Reruns agree, as hashes depend on ids alone.
    Texts are read once: ids, sources, sizes and hashes are cut off into the shared folder.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_hash(F.col("doc_id")).alias("hash")))
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("total")), weights, share, most)
    plan = cut(plan)  # one row for each source
    passes = plan.filter("total > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("rest", F.least(F.col("target") - (F.col("pass") - 1) * F.col("total"), F.col("total").cast("double")))
    partial = thresholds(sized, passes.filter("rest > 0 and rest < total").select("source", "pass", "rest"))
    bounds = passes.alias("p").join(partial.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.pass") == F.col("b.pass")), "left")
    whole = F.when(F.col("p.rest") >= F.col("p.total"), F.lit((1 << BITS) - 1)).when(F.col("p.rest") <= 0, F.lit(-1))
    bounds = bounds.groupBy("p.source").agg(F.sort_array(F.collect_list(F.coalesce(whole, F.col("b.bound"), F.lit(-1)).cast("long"))).alias("bounds"))
    plan = plan.alias("a").join(bounds.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", "b.bounds")
    plan = cut(plan)
    out = sized.alias("d").join(plan.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    repeats = F.size(F.filter(F.coalesce("t.bounds", F.array().cast("array<long>")), lambda b: F.col("d.hash") <= b))
    return out.select("d.doc_id", "d.source", "d.size", F.col("t.total").alias("source_size"), "t.target", (F.col("d.size") * repeats).alias("taken"))


def mixed_documents(docs: DataFrame, repeat: bool = True, **options) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with docs' own columns.

    Documents without words belong to no budget and stay away. With ``repeat`` false each taken document comes once.
    """
    rid, size, times = free_name(docs, "mix_id", "mix_size", "mix_times")
    taken = mix(docs, **options).filter("taken > 0").select(F.col("doc_id").alias(rid), (F.col("taken") / F.col("size")).cast("int").alias(times)).distinct()
    out = docs.filter(word_count(docs["text"]) > 0).join(taken, docs["doc_id"].eqNullSafe(taken[rid]))
    if repeat:
        out = out.withColumn(size, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[out[f"`{c}`"] for c in docs.columns])
