"""Who is on screen and what is shown: aggregates over shots, frames, tags and faces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unsafe(questionable: Column, explicit: Column, threshold: float = 0.2) -> Column:
    return questionable + explicit >= threshold


def shot_status(frames: DataFrame, shot: Sequence[str], bad: Column) -> DataFrame:
    """One unsafe frame drops the whole shot."""
    return frames.groupBy(*shot).agg(F.when(F.bool_or(bad), "dropped").otherwise("kept").alias("status"))


def counts_filled(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Rows by key and value, 0 where there are none; the values are a closed set, so keys are repeated and not joined."""
    counts = [F.count(F.when(F.col(column) == v, 1)).alias(f"_{i}") for i, v in enumerate(values)]
    x = df.groupBy(*keys).agg(*counts)
    pairs = F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"_{i}").alias("n")) for i, v in enumerate(values)])
    return x.select(*keys, F.explode(pairs).alias("_p")).select(*keys, F.col("_p.v").alias(column), F.col("_p.n").alias("n"))


def shot_cast(faces: DataFrame, frames: DataFrame, shot: Sequence[str]) -> DataFrame:
    """shot, cluster_id, presence, height, area: share of all frames of the shot with the cluster's face, tallest face, mean area.

    faces: shot columns, frame_id, cluster_id, y0, y1, x0, x1. frames: shot columns, frame_id, faceless ones too.
    """
    total = frames.groupBy(*shot).agg(F.count("*").alias("_frames"))
    height, width = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    seen = faces.filter("cluster_id is not null").groupBy(*shot, "cluster_id").agg(F.count_distinct("frame_id").alias("_seen"), F.max(height).alias("height"), F.avg(height * width).alias("area"))
    return seen.join(total, list(shot)).select(*shot, "cluster_id", (F.col("_seen") / F.col("_frames")).alias("presence"), "height", "area")


def named_cast(cast: DataFrame, clusters: DataFrame, shot: Sequence[str]) -> DataFrame:
    """The named part of a cast, ranked in each shot by presence, then cluster."""
    x = cast.join(clusters.filter("name is not null").select(F.col("id").alias("cluster_id"), "name"), "cluster_id")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*shot).orderBy(F.desc("presence"), "cluster_id")))


def tag_stats(tags: DataFrame, frames: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """tag, peak, share: greatest score and share of all frames that have the tag."""
    found = tags.groupBy(*keys, "tag").agg(F.max("score").alias("peak"), F.count("*").alias("_n"))
    total = frames.groupBy(*keys).agg(F.greatest(F.count("*"), F.lit(1)).alias("_total"))
    joined = found.join(total, list(keys)) if keys else found.withColumn("_total", total.scalar())
    return joined.select(*keys, "tag", "peak", (F.col("_n") / F.col("_total")).alias("share"))


def top_tags(tags: DataFrame, frames: DataFrame, shot: Sequence[str], limit: int) -> DataFrame:
    """The tags with the greatest mean score over all frames of a shot; a frame without the tag counts 0."""
    total = frames.groupBy(*shot).agg(F.count("*").alias("_frames"))
    sums = tags.groupBy(*shot, "tag").agg(F.sum("score").alias("_sum"))
    w = Window.partitionBy(*shot).orderBy(F.desc("_sum"), "tag")
    top = sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return top.join(total, list(shot)).select(*shot, "tag", (F.col("_sum") / F.col("_frames")).alias("mean"), "rank")


def tag_maps(frames: DataFrame, tags: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """frame_id and its map of the wanted tags to scores, an empty map for frames that have none."""
    some = tags.filter(F.col("tag").isin(*wanted)).groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("scores"))
    return frames.select("frame_id").join(some, "frame_id", "left").withColumn("scores", F.coalesce("scores", F.create_map().cast("map<string,double>")))


def largest(df: DataFrame, keys: Sequence[str], size: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """The values that the row of the greatest size has, the least ``tie`` among equals."""
    best = F.max_by(F.struct(size, tie, *columns), F.struct(F.col(size), -F.col(tie)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def samples(faces: DataFrame, group: Sequence[str], shot: Sequence[str], area: str, tie: str, limit: int = 8) -> DataFrame:
    """Of each group the faces with the greatest area, one of a shot."""
    one = largest(faces, [*group, *shot], area, tie, [])
    w = Window.partitionBy(*group).orderBy(F.desc(area), tie)
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def solo_hints(faces: DataFrame, tags: DataFrame, limit: int = 3) -> DataFrame:
    """cluster_id, tag, share: tags on frames that have one face only, as a share of the cluster's such frames."""
    alone = faces.withColumn("_n", F.count("*").over(Window.partitionBy("frame_id"))).filter("_n = 1 and cluster_id is not null")
    total = alone.groupBy("cluster_id").agg(F.count("*").alias("_total"))
    found = alone.join(tags, "frame_id").groupBy("cluster_id", "tag").agg(F.count("*").alias("_tags")).join(total, "cluster_id")
    x = found.withColumn("share", F.col("_tags") / F.col("_total"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("share"), "tag"))).filter(F.col("rank") <= limit).select("cluster_id", "tag", "share", "rank")


def members(df: DataFrame, parents: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Every parent (id, name) with the count of its rows, 0 included, most first."""
    n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return parents.join(n, parents["id"] == n[key], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), *order)


def find(parents: DataFrame, ref: str) -> DataFrame:
    """The row whose name is ref, else the one whose id it is, with or without #."""
    number = F.lit(ref.removeprefix("#")).try_cast("long")
    hit = parents.filter((F.col("name") == ref) | (F.col("id") == number))
    return hit.orderBy(F.when(F.col("name") == ref, 0).otherwise(1), "id").limit(1)


def scenes(facts: DataFrame, gap: float = 1.5, alike: float = 0.75, similar: float = 0.6) -> DataFrame:
    """facts with ``continues``: whether a shot goes on with the scene of the shot before it in its episode.

    facts: episode_id, idx, kept, part (null outside), line_ids, first_line, last_line, cast (array of names), colours (array,
    sums to 1). Both shots are kept, neighbours and of one part; and they share a line, or the next line follows within
    ``gap`` seconds, or their colours agree to ``alike``, or to ``similar`` if a name is in both casts.
    """
    w = Window.partitionBy("episode_id").orderBy("idx")
    was = F.lag(F.struct("idx", "kept", "part", "line_ids", "last_line", "cast", "colours")).over(w)
    x = facts.withColumn("_was", was)
    agree = F.aggregate(F.zip_with("_was.colours", "colours", lambda a, b: F.least(a, b)), F.lit(0.0), lambda a, v: a + v)
    talk = F.arrays_overlap("_was.line_ids", "line_ids") | (F.col("first_line") - F.col("_was.last_line") <= gap)
    look = (agree >= alike) | (F.arrays_overlap("_was.cast", "cast") & (agree >= similar))
    next_ = F.col("_was.kept") & F.col("kept") & (F.col("idx") == F.col("_was.idx") + 1) & F.col("_was.part").eqNullSafe(F.col("part"))
    return x.withColumn("continues", F.coalesce(next_, F.lit(False)) & (F.coalesce(talk, F.lit(False)) | F.coalesce(look, F.lit(False)))).drop("_was")
