"""Sound as rows of samples: levels, fades, the gain under spoken lines, and how much pictures change.

samples: the caller's keys, i (from 0, without gaps), v (-1 to 1). A row is a sample, so a long song is spread over tasks; what a
key shares (its length, its loudest moment) is aggregated first and joined back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds and decibels of the sound under a line, and the share of luma that counts as a change. Fixed values.
ATTACK, RELEASE, GATE, FLOOR, CHANGED = 0.15, 0.4, 25.0, -120.0, 0.04


def ramp(at: Column, n: int | Column) -> Column:
    """A raised-cosine rise over n samples, at one of them (from 0)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 1, 0.5 - 0.5 * F.cos(at * math.pi / (n - 1))).otherwise(0.0)


def ducked(spans: DataFrame, keys: Sequence[str], rate: int) -> DataFrame:
    """keys, i, gain: for the samples near spans (keys, start, end, depth in dB) the gain of what plays below them.

    It falls by the depth within ATTACK before a span and comes back within RELEASE after it; the deepest of several spans counts.
    Samples that no span reaches have no row: their gain is 1. There are as many rows as there are samples under spans.
    """
    attack, release = round(ATTACK * rate), round(RELEASE * rate)
    a, b = F.bround(F.col("start") * rate).cast("long"), F.bround(F.col("end") * rate).cast("long")
    x = spans.select(*keys, "depth", a.alias("_a"), b.alias("_b"))
    x = x.withColumn("i", F.explode(F.sequence(F.greatest(F.col("_a") - attack, F.lit(0)), F.greatest(F.col("_b") + release - 1, F.lit(0)))))
    x = x.filter((F.col("i") >= F.col("_a") - attack) & (F.col("i") < F.col("_b") + release))
    share = F.when(F.col("i") < F.col("_a"), ramp(F.col("i") - F.col("_a") + attack, attack)).when(F.col("i") >= F.col("_b"), ramp(F.col("_b") + release - 1 - F.col("i"), release)).otherwise(1.0)
    return x.groupBy(*keys, "i").agg(F.pow(F.lit(10.0), -F.max(F.col("depth") * share) / 20).alias("gain"))


def under(samples: DataFrame, spans: DataFrame, keys: Sequence[str], rate: int) -> DataFrame:
    """samples with the gain of ducked() applied."""
    x = samples.join(ducked(spans, keys, rate), [*keys, "i"], "left")
    return x.withColumn("v", F.col("v") * F.coalesce("gain", F.lit(1.0))).drop("gain")


def levels(samples: DataFrame, keys: Sequence[str], rate: int) -> DataFrame:
    """keys, level: RMS in dB of the moments (20 ms) within GATE of the loudest one; FLOOR for less than one moment."""
    hop = max(1, rate // 50)
    x = samples.groupBy(*keys, F.floor(F.col("i") / hop).alias("_h")).agg(F.avg(F.col("v") * F.col("v")).alias("_p"), F.count("*").alias("_n"))
    decibels: callable = lambda power: 20 * F.log10(F.sqrt(power) + 1e-12)
    x = x.withColumn("_d", F.when(F.col("_n") == hop, decibels(F.col("_p"))))
    x = x.withColumn("_top", F.max("_d").over(Window.partitionBy(*keys)))
    return x.groupBy(*keys).agg(F.coalesce(decibels(F.avg(F.when(F.col("_d") >= F.col("_top") - GATE, F.col("_p")))), F.lit(FLOOR)).alias("level"))


def faded(samples: DataFrame, keys: Sequence[str], rate: int, rise: float, fall: float) -> DataFrame:
    """samples that rise over their first and fall over their last seconds; shorter ones do both over all they have."""
    n = samples.groupBy(*keys).agg((F.max("i") + 1).alias("_n"))
    a, b = (F.least(F.lit(round(s * rate)), F.col("_n")) for s in (rise, fall))
    i = F.col("i")
    gain = F.when(i < a, ramp(i, a)).otherwise(1.0) * F.when(i >= F.col("_n") - b, ramp(F.col("_n") - 1 - i, b)).otherwise(1.0)
    return samples.join(n, list(keys)).withColumn("v", F.col("v") * gain).drop("_n")


def normalised(samples: DataFrame, keys: Sequence[str], decibels: float = -1.0) -> DataFrame:
    """samples scaled so that each key's peak is at the level; silence stays."""
    top = samples.groupBy(*keys).agg(F.max(F.abs("v")).alias("_top"))
    return samples.join(top, list(keys)).withColumn("v", F.when(F.col("_top") > 0, F.col("v") * 10 ** (decibels / 20) / F.col("_top")).otherwise(F.col("v"))).drop("_top")


def differences(pictures: DataFrame, keys: Sequence[str], order: str = "i", pixels: str = "pixels") -> DataFrame:
    """keys, order, mean, changed: of each picture (luma from 0 to 255), its mean difference from the one before (0 to 1; 0 for the
    first) and the share of pixels that differ by more than CHANGED."""
    before = F.coalesce(F.lag(pixels).over(Window.partitionBy(*keys).orderBy(order)), F.col(pixels))
    x = pictures.select(*keys, order, F.zip_with(F.col(pixels), before, lambda p, q: F.abs(p.cast("double") - q.cast("double")) / 255).alias("_d"))
    size = F.greatest(F.size("_d"), F.lit(1))
    total = F.aggregate("_d", F.lit(0.0), lambda s, d: s + d)
    return x.select(*keys, order, (total / size).alias("mean"), (F.size(F.filter("_d", lambda d: d > CHANGED)) / size).alias("changed"))
