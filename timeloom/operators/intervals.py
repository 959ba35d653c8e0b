"""Half-open intervals: joins, merges, complements, clips and nearest values.

Joins over ranges have an equality key always: the caller's keys and a time bucket. An interval is in each bucket that it
touches, and a pair counts only in the bucket where the later of the two begins, so pairs come once and a long series is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def seconds(frame: Column, fps_num: Column, fps_den: Column) -> Column:
    """The time of a frame at a rational rate."""
    return frame * fps_den / fps_num


def frame_floor(time: Column, fps_num: int, fps_den: int = 1, slack: float = 0.01) -> Column:
    return F.floor(time * fps_num / fps_den + slack) * fps_den / fps_num


def frame_ceil(time: Column, fps_num: int, fps_den: int = 1, slack: float = 0.01) -> Column:
    return F.ceil(time * fps_num / fps_den - slack) * fps_den / fps_num


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of what two intervals share, 0 if nothing."""
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def touches(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether half-open intervals overlap; ends that meet do not."""
    return (a_start < b_end) & (a_end > b_start)


def _bucket(value: Column, width) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], spans: tuple[str, str, str, str], width: float, how: str = "inner") -> DataFrame:
    """Pairs of a and b that agree on ``keys`` and overlap; spans names a's start and end and b's start and end.

    width: of a time bucket, about the length of a typical interval. Column names of a and b differ but for the keys, of
    which a's are kept. how: inner or left; a left join gives rows of a without a partner once, with nulls.
    """
    s, e, t, u = spans
    cut = lambda df, x, y, name: df.withColumn(name, F.explode(F.sequence(_bucket(df[x], width), F.greatest(_bucket(df[y], width), _bucket(df[x], width)))))
    left, right = cut(a, s, e, "_bucket_a"), cut(b, t, u, "_bucket_b")
    right = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k) == F.col(f"_key_{k}") for k in keys]
    on = [*same, F.col("_bucket_a") == F.col("_bucket_b"), touches(F.col(s), F.col(e), F.col(t), F.col(u)), F.col("_bucket_a") == _bucket(F.greatest(s, t), width)]
    drop = ["_bucket_a", "_bucket_b", *[f"_key_{k}" for k in keys]]
    pairs = left.join(right, on).drop(*drop)
    if how == "inner":
        return pairs
    if how != "left":
        raise ValueError("how is inner or left")
    alone = left.join(right, on, "left_semi").select(*[F.col(c).alias(f"_a_{c}") for c in a.columns]).distinct()
    alone = a.join(alone, [F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in a.columns], "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def contained(a: DataFrame, ranges: DataFrame, keys: Sequence[str], spans: tuple[str, str, str, str], width: float, eps: float = EPS, how: str = "left_semi") -> DataFrame:
    """Rows of a that lie in one of the ranges, within eps (how: left_semi), or in none (left_anti)."""
    s, e, t, u = spans
    right = ranges.withColumn("_bucket_b", F.explode(F.sequence(_bucket(F.col(t) - eps, width), F.greatest(_bucket(F.col(u) + eps, width), _bucket(F.col(t) - eps, width)))))
    right = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_bucket_b", F.col(t).alias("_t"), F.col(u).alias("_u"))
    on = [*[F.col(k) == F.col(f"_key_{k}") for k in keys], _bucket(F.col(s), width) == F.col("_bucket_b"), F.col("_t") - eps <= F.col(s), F.col(e) <= F.col("_u") + eps]
    return a.join(right, on, how)


def merged(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float = 0, closed: bool = False) -> DataFrame:
    """Unions of intervals of one key: an interval joins those before it if it begins less than gap behind their end.

    closed: also if it begins exactly gap behind. Returns keys, start and end.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    far = (F.col(start) - before > gap) if closed else (F.col(start) - before >= gap)
    x = df.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int"))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def complement(df: DataFrame, bounds: DataFrame, keys: Sequence[str], start: str, end: str, shortest: float = 0) -> DataFrame:
    """What merged intervals leave free of each key's bounds (columns lo, hi), in pieces of at least ``shortest``.

    Returns keys, start, end and place (intro, between, outro; whole if nothing is taken).
    """
    inside = df.select(*keys, start, end).join(bounds, list(keys)).filter((F.col(start) < F.col("hi")) & (F.col(end) > F.col("lo")))
    marks = inside.select(*keys, F.greatest(start, "lo").alias(start), F.least(end, "hi").alias(end), F.lit(1).alias("_real"))
    marks = marks.unionByName(bounds.select(*keys, F.col("lo").alias(start), F.col("lo").alias(end), F.lit(0).alias("_real")))
    marks = marks.unionByName(bounds.select(*keys, F.col("hi").alias(start), F.col("hi").alias(end), F.lit(2).alias("_real")))
    w = Window.partitionBy(*keys).orderBy(start, end, "_real")
    upto = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.max(F.when(F.col("_real") == 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 0
    place = F.when(first & (F.col("_real") == 2), "whole").when(first, "intro").when(F.col("_real") == 2, "outro").otherwise("between")
    x = marks.withColumns({"_from": upto, "_place": place})
    return x.filter((F.col("_real") > 0) & (F.col(start) - F.col("_from") >= shortest) & (F.col(start) > F.col("_from"))).select(*keys, F.col("_from").alias(start), F.col(start).alias(end), F.col("_place").alias("place"))


def nearest(points: DataFrame, grid: DataFrame, keys: Sequence[str], at: str, value: str, name: str = "nearest", width: float | None = None, carry: tuple[str, str] | None = None) -> DataFrame:
    """points with the grid value nearest to ``at``, the earlier one on a tie; null without a grid.

    Two sorts of both sides by key and time, forth and back: the last value of each is carried along, so a key takes linear time.
    width: of a time bucket, for keys of more rows than a task should hold; buckets then know the values around them by a row each.
    carry: a column of the grid, and its name in the result: the value's greatest, so that the grid need not be joined (no width).
    """
    if carry:
        if width:
            raise ValueError("carry is for keys without a width")
        return _nearest_with(points, grid, keys, at, value, name, *carry)
    both = points.withColumns({"_t": F.col(at), "_g": F.lit(None).cast(dict(grid.dtypes)[value])})
    marks = grid.select(*keys, F.col(value).alias("_t"), F.col(value).alias("_g"))
    both = both.withColumn("_point", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    own = list(keys)
    if width:
        both, own = both.withColumn("_w", F.coalesce(_bucket(F.col("_t"), width), F.lit(-(1 << 62)))), [*keys, "_w"]
        sides = Window.partitionBy(*keys).orderBy("_w"), Window.partitionBy(*keys).orderBy(F.desc("_w"))
        earlier, later = (F.last(c, True).over(o.rowsBetween(Window.unboundedPreceding, -1)) for c, o in zip(("_most", "_least"), sides))
        ends = both.groupBy(*own).agg(F.min("_g").alias("_least"), F.max("_g").alias("_most")).select(*own, earlier.alias("_earlier"), later.alias("_later"))
        both = both.join(ends, own)
    w = Window.partitionBy(*own)
    last = lambda order: F.last("_g", True).over(w.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before, behind = last(F.asc("_t")), last(F.desc("_t"))
    if width:
        before, behind = F.coalesce(before, "_earlier"), F.coalesce(behind, "_later")
    x = both.withColumns({"_b": before, "_a": behind}).filter("_point")
    pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_a") - F.col(at) < F.col(at) - F.col("_b"), F.col("_a")).otherwise(F.col("_b"))
    return x.withColumn(name, pick).drop("_t", "_g", "_point", "_b", "_a", "_w", "_earlier", "_later")


def _nearest_with(points: DataFrame, grid: DataFrame, keys: Sequence[str], at: str, value: str, name: str, more: str, more_name: str) -> DataFrame:
    kinds = dict(grid.dtypes)
    both = points.withColumns({"_t": F.col(at), "_c": F.lit(None).cast(kinds[more]), "_g": F.lit(None).cast(f"struct<g:{kinds[value]},c:{kinds[more]}>"), "_point": F.lit(True)})
    marks = grid.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_t"), F.col(more).alias("_c"), F.struct(F.col(value).alias("g"), F.col(more).alias("c")).alias("_g"), F.lit(False).alias("_point"))
    # at one time grid rows stand before points, the greatest one last
    last = lambda order: F.last("_g", True).over(Window.partitionBy(*keys).orderBy(order, "_point", "_c").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    x = both.unionByName(marks, allowMissingColumns=True).withColumns({"_b": last(F.asc("_t")), "_a": last(F.desc("_t"))}).filter("_point")
    b, a = F.col("_b"), F.col("_a")
    pick = F.when(b.isNull(), a).when(a.isNull(), b).when(a["g"] - F.col(at) < F.col(at) - b["g"], a).otherwise(b)
    return x.withColumn("_p", pick).withColumns({name: F.col("_p.g"), more_name: F.col("_p.c")}).drop("_t", "_c", "_g", "_point", "_b", "_a", "_p")
