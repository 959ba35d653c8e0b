"""Ordered series: sessions, segments, edges, peaks, runs and samples, by windows over a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], new: Column, name: str = "island") -> DataFrame:
    """df with the number, from 1, of the run that each row is in; ``new`` tells where one begins (null: it does)."""
    w = _by(keys, order)
    return df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap: float, tie: str, name: str = "idx") -> DataFrame:
    """df with session numbers: a row more than ``gap`` behind the one before begins a session."""
    return islands(df, keys, [at, tie], F.col(at) - F.lag(at).over(_by(keys, [at, tie])) > gap, name)


def capped_sessions(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, cap: float, tie: str) -> DataFrame:
    """Sessions that end at a gap, or before a row that would end more than ``cap`` behind the session's start.

    The cap depends on where the current session began, so rows of one gap-free run are folded in order; runs are the
    unit that must fit in a row. Returns keys, run, scene (from 1 in the run), start, end, n.
    """
    runs = sessions(df, keys, start, gap, tie, "run")
    runs = runs.groupBy(*keys, "run").agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(tie).alias("t"), F.col(end).alias("e")))).alias("_rows"))
    kind = dict(df.dtypes)[start]
    scene = f"struct<s:{kind},e:{kind},n:bigint>"
    # the scene that is open stands beside those that are done, so a row that joins it copies no array
    first = F.struct(F.array().cast(f"array<{scene}>").alias("done"), F.lit(None).cast(scene).alias("open"))

    def step(acc: Column, row: Column) -> Column:
        open_ = acc["open"]
        joins = F.coalesce(row["e"] - open_["s"] <= cap, F.lit(False))
        grown = F.struct(open_["s"].alias("s"), F.greatest(open_["e"], row["e"]).alias("e"), (open_["n"] + 1).alias("n"))
        fresh = F.struct(row["s"].alias("s"), row["e"].alias("e"), F.lit(1).cast("bigint").alias("n"))
        done = F.when(joins | open_.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(open_)))
        return F.struct(done.alias("done"), F.when(joins, grown).otherwise(fresh).alias("open"))

    x = runs.withColumn("_scenes", F.aggregate("_rows", first, step, lambda acc: F.concat(acc["done"], F.array(acc["open"]))))
    x = x.select(*keys, "run", F.posexplode("_scenes").alias("_i", "_s"))
    return x.select(*keys, "run", (F.col("_i") + 1).alias("scene"), F.col("_s.s").alias(start), F.col("_s.e").alias(end), F.col("_s.n").alias("n"))


def threshold_segments(df: DataFrame, keys: Sequence[str], at: str, value: str, threshold: float) -> DataFrame:
    """Spans [start, end) between transitions (value > threshold) of a series with consecutive ``at``.

    A span ends on the first frame of a transition, which it includes; frames inside a transition are in none, one that
    begins the series is skipped. A series that is one transition is one span. Returns keys, start, end.
    """
    w = _by(keys, [at])
    hot = F.col(value) > threshold
    x = df.withColumns({"_hot": hot, "_was": F.lag(hot).over(w)})
    x = islands(x, keys, [at], F.col("_hot") != F.col("_was"), "_run")
    ends = Window.partitionBy(*keys)
    x = x.withColumns({"_last": F.max(at).over(ends), "_first": F.min(at).over(ends), "_calm": F.min("_hot").over(ends)})
    runs = x.groupBy(*keys, "_run").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("_end"), F.first("_hot").alias("_hot"), F.first("_last").alias("_last"), F.first("_calm").alias("_all"), F.first("_first").alias("_first"))
    spans = runs.filter("not _hot or _all")
    end = F.when(F.col("_end") <= F.col("_last"), F.col("_end") + 1).otherwise(F.col("_end"))
    return spans.select(*keys, "start", end.alias("end"))


def rising_edges(df: DataFrame, keys: Sequence[str], at: str, value: str, threshold: float) -> DataFrame:
    """Rows from which the value is at least the threshold and was not in the row before; a first row is no edge."""
    on = F.col(value) >= threshold
    return df.withColumn("_was", F.lag(on).over(_by(keys, [at]))).filter(on & ~F.col("_was")).drop("_was")


def peaks(df: DataFrame, keys: Sequence[str], at: str, value: str, reach: int = 3) -> DataFrame:
    """Places of maxima within ``reach`` rows to either side that are above 0; neighbouring ones become their mean."""
    w = _by(keys, [at])
    top = df.withColumn("_top", F.max(value).over(w.rowsBetween(-reach, reach))).filter((F.col(value) == F.col("_top")) & (F.col(value) > 0))
    runs = islands(top, keys, [at], F.col(at) - F.lag(at).over(w) > 1, "_run")
    return runs.groupBy(*keys, "_run").agg(F.avg(at).alias(at), F.max(value).alias(value)).drop("_run")


def onsets(df: DataFrame, keys: Sequence[str], at: str, value: str, active: float, calm: int = 6, burst: int = 12) -> DataFrame:
    """Active rows (value >= active) with ``calm`` rows before, none active; strength is the greatest of ``burst`` rows from it on."""
    w = _by(keys, [at])
    on = (F.col(value) >= active).cast("int")
    x = df.withColumns({"_n": F.row_number().over(w), "_on": on, "_before": F.max(on).over(w.rowsBetween(-calm, -1)), "strength": F.max(value).over(w.rowsBetween(0, burst - 1))})
    return x.filter((F.col("_on") == 1) & (F.col("_n") > calm) & (F.col("_before") == 0)).drop("_n", "_on", "_before")


def loud_runs(df: DataFrame, keys: Sequence[str], at: str, level: str, below: float, pause: int) -> DataFrame:
    """Runs [start, end) of rows at most ``below`` under the key's greatest level, over pauses of up to ``pause`` rows."""
    x = df.withColumn("_top", F.max(level).over(Window.partitionBy(*keys))).filter(F.col(level) >= F.col("_top") - below)
    x = islands(x, keys, [at], F.col(at) - F.lag(at).over(_by(keys, [at])) - 1 > pause, "_run")
    return x.groupBy(*keys, "_run").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end")).drop("_run")


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """``limit`` rows of each key at equal steps, all rows if there are no more: of n rows those at int(i * n / limit)."""
    x = df.withColumns({"_i": F.row_number().over(_by(keys, order)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    before = F.ceil(F.col("_i") * limit / F.col("_n"))  # the least i' whose place is not before this row
    return x.filter((F.col("_n") <= limit) | (F.floor(before * F.col("_n") / limit) == F.col("_i")) & (before < limit)).drop("_i", "_n")


def sample_frames(df: DataFrame, start: str, end: str, fps: float, interval: float = 0.5, least: int = 3, name: str = "frame") -> DataFrame:
    """A row for each sampled frame of [start, end): one every ``interval`` seconds, in the middle of equal parts."""
    n = F.col(end) - F.col(start)
    count = F.least(F.greatest(F.ceil(n / fps / interval), F.lit(least)), n).cast("long")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.col(start) + F.floor((2 * i + 1) * n / (2 * count)).cast("long"))
    return df.filter(n > 0).withColumn(name, F.explode(F.array_distinct(parts)))


def merge_runs(df: DataFrame, keys: Sequence[str], order: str, label: str, size: str, means: Sequence[str]) -> DataFrame:
    """Neighbouring rows of one label as one row: first order, summed size, means weighted by size."""
    w = _by(keys, [order])
    x = islands(df, keys, [order], ~F.col(label).eqNullSafe(F.lag(label).over(w)), "_run")
    mean = [(F.sum(F.col(m) * F.col(size)) / F.sum(size)).alias(m) for m in means]
    return x.groupBy(*keys, "_run").agg(F.min(order).alias(order), F.first(label).alias(label), F.sum(size).alias(size), *mean).drop("_run")


def neighbour_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], mark: str, name: str = "filled") -> DataFrame:
    """Unmarked rows between two rows of one mark take it. A filled row is never followed by an unmarked one, so one pass
    does what a scan in order would do."""
    w = _by(keys, order)
    before, behind = F.lag(mark).over(w), F.lead(mark).over(w)
    return df.withColumn(name, F.coalesce(F.col(mark), F.when(before == behind, before)))


def bucketed_mean(frames: DataFrame, bars: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Mean of the values in each bar [start, end) of its key, by the bar that began last: no range join."""
    marks = bars.select(*keys, F.col("start").alias(at), F.col("bar"), F.col("end").alias("_end"), F.lit(0).alias("_kind"))
    both = frames.select(*keys, at, value, F.lit(1).alias("_kind")).unionByName(marks, allowMissingColumns=True)
    w = _by(keys, [at, "_kind"]).rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumns({"bar": F.last("bar", True).over(w), "_end": F.last("_end", True).over(w)})
    return x.filter((F.col("_kind") == 1) & (F.col(at) < F.col("_end"))).groupBy(*keys, "bar").agg(F.avg(value).alias(value), F.count("*").alias("n"))


def lag_products(a: DataFrame, b: DataFrame, keys: Sequence[str], at: str, value: str, reach: int) -> DataFrame:
    """(keys, lag, score): sums of a(t) * b(t + lag) for lags up to reach; the series' rows are shifted, then joined by time."""
    shifted = a.select(*keys, F.col(value).alias("_a"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag"), F.col(at).alias("_t"))
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(at).alias("_u"), F.col(value).alias("_b"))
    on = [*[F.col(k) == F.col(f"_{k}") for k in keys], F.col("_t") + F.col("lag") == F.col("_u")]
    return shifted.join(right, on).groupBy(*keys, "lag").agg(F.sum(F.col("_a") * F.col("_b")).alias("score"))


def best_lag(products: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lag of the greatest score of each key, the least lag on a tie."""
    return products.groupBy(*keys).agg(F.max(F.struct("score", -F.col("lag"))).alias("_m")).select(*keys, (-F.col("_m.col2")).alias("lag"), F.col("_m.score").alias("score"))
