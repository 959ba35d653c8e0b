"""JSON answers over a library: one document a row, the same fields whatever serves them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import schema
from .operators import stages, vectors
from .sources.store import documents


def episodes(e: DataFrame, runs: DataFrame, parts: DataFrame) -> DataFrame:
    """Each episode with its rate, length, stages in the order in which they ended, and parts."""
    done = stages.latest(runs).groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("finished_at", "stage"))), lambda s: s["stage"]).alias("stages")).withColumnRenamed("episode_id", "_s")
    own = parts.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("parts")).withColumnRenamed("episode_id", "_p")
    x = e.join(done, F.col("id") == F.col("_s"), "left").join(own, F.col("id") == F.col("_p"), "left")
    fps = F.when(F.col("fps_den") == 1, F.col("fps_num").cast("string")).otherwise(F.concat_ws("/", "fps_num", "fps_den"))
    seconds = F.bround(F.col("frame_count") * F.col("fps_den") / F.col("fps_num"), 3)
    return documents(x.select("id", "path", "width", "height", fps.alias("fps"), seconds.alias("seconds"), F.coalesce("stages", F.array().cast("array<string>")).alias("stages"), "parts"))


def episode_shots(shots: DataFrame, details: DataFrame) -> DataFrame:
    """episode_id, value: an episode's shots in order; of a dropped shot only its id, range and status, whatever is known of it.

    details: shot_id and further columns.
    """
    more = [c for c in details.columns if c != "shot_id"]
    kept = F.col("status") == "kept"
    x = shots.join(details.withColumnRenamed("shot_id", "_d"), F.col("id") == F.col("_d"), "left")
    row = F.struct("idx", "id", "start_frame", "end_frame", "status", *[F.when(kept, F.col(f"`{c}`")).alias(c) for c in more])
    return x.groupBy("episode_id").agg(F.to_json(F.array_sort(F.collect_list(row)), {"ignoreNullFields": "true"}).alias("value"))


def repeats(marks: DataFrame, kept: DataFrame) -> DataFrame:
    """episode_id, kept, marked, op, ed, preview, recap, recurring: marks by kind, for each episode and (null) in all."""
    kinds = ("op", "ed", "preview", "recap", "recurring")
    x = kept.join(marks.select(F.col("shot_id").alias("_m"), "kind"), F.col("id") == F.col("_m"), "left")
    return x.groupingSets([[F.col("episode_id")], []], "episode_id").agg(F.count("*").alias("kept"), F.count("kind").alias("marked"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def voice_review(voices: DataFrame, typical: int = 3) -> DataFrame:
    """speaker_id, lines, seconds, typical: for each speaker its clean lines, and those nearest to their mean embedding."""
    clean = voices.filter("status = 'clean' and speaker_id is not null")
    mean = clean.select("speaker_id", F.posexplode("embedding").alias("p", "v")).groupBy("speaker_id", "p").agg(F.avg("v").alias("v"))
    mean = mean.groupBy("speaker_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("mean"))
    x = clean.join(mean, "speaker_id").withColumn("distance", F.bround(vectors.cosine_distance(F.col("embedding"), F.col("mean")), 3))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy("speaker_id").orderBy("distance", "line_id")))
    near = F.filter(F.array_sort(F.collect_list(F.when(F.col("_r") <= typical, F.struct("_r", "line_id", "distance")))), lambda s: s.isNotNull())
    return x.groupBy("speaker_id").agg(F.count("*").alias("lines"), F.sum(F.col("end") - F.col("start")).alias("seconds"), F.transform(near, lambda s: F.struct(s["line_id"], s["distance"])).alias("typical"))


def voice_statuses(voices: DataFrame) -> DataFrame:
    """status, n: all statuses, 0 where there are none."""
    counts = voices.agg(*[F.count_if(F.col("status") == s).alias(s) for s in schema.VOICE_STATUS])
    return counts.unpivot([], list(schema.VOICE_STATUS), "status", "n")
