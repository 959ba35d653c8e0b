"""Tables of a media library: schemas, closed value sets and the constraints that rows must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 6
SHOT_STATUS = ("pending", "kept", "dropped")
TAG_CATEGORY = ("general", "character")
LINE_KIND = ("dialogue", "lyrics", "other")
PART_KIND = ("op", "ed")
VOICE_STATUS = ("clean", "short", "long", "overlap", "silent", "mixed")

TABLES = {
    "episodes": "id long, path string, width long, height long, fps_num long, fps_den long, frame_count long",
    "stage_runs": "episode_id long, stage string, finished_at string, params string",
    "shots": "id long, episode_id long, idx long, start_frame long, end_frame long, status string",
    "frames": "id long, shot_id long, frame_index long, general double, sensitive double, questionable double, explicit double",
    "frame_tags": "frame_id long, tag string, category string, score double",
    "clusters": "id long, name string",
    "faces": "id long, frame_id long, x0 double, y0 double, x1 double, y1 double, score double, embedding array<float>, cluster_id long",
    "lines": "id long, episode_id long, start double, end double, kind string, style string, text string",
    "episode_parts": "episode_id long, kind string, start double, end double",
    "scenes": "id long, episode_id long, idx long",
    "scene_shots": "scene_id long, shot_id long",
    "cast_fixes": "shot_id long, from_cluster long, to_cluster long",
    "speakers": "id long, name string",
    "line_voices": "line_id long, start double, end double, status string, embedding array<float>, speaker_id long",
    "speaker_fixes": "line_id long, speaker_id long",
    "transcripts": "line_id long, model string, text string",
    "voice_styles": "speaker_id long, style string, line_id long",
}
#: Unique keys; rows that share one break the table, but for nulls, which differ from all.
KEYS = {
    "episodes": [["id"], ["path"]], "stage_runs": [["episode_id", "stage"]], "shots": [["id"], ["episode_id", "idx"]], "frames": [["id"], ["shot_id", "frame_index"]],
    "frame_tags": [["frame_id", "tag"]], "clusters": [["id"], ["name"]], "faces": [["id"]], "lines": [["id"]], "episode_parts": [["episode_id", "kind"]], "scenes": [["id"], ["episode_id", "idx"]],
    "scene_shots": [["shot_id"]], "cast_fixes": [["shot_id", "from_cluster"]], "speakers": [["id"], ["name"]], "line_voices": [["line_id"]], "speaker_fixes": [["line_id"]],
    "transcripts": [["line_id"]], "voice_styles": [["speaker_id", "style"]],
}
#: Conditions that every row keeps.
CHECKS: dict[str, list[tuple[str, str]]] = {
    "shots": [("span", "end_frame > start_frame"), ("status", f"status in {SHOT_STATUS}")],
    "frame_tags": [("category", f"category in {TAG_CATEGORY}")],
    "lines": [("kind", f"kind in {LINE_KIND}")],
    "episode_parts": [("kind", f"kind in {PART_KIND}")],
    "cast_fixes": [("moves", "not (from_cluster <=> to_cluster)")],
    "line_voices": [("span", "end > start"), ("status", f"status in {VOICE_STATUS}"), ("speaker", "speaker_id is null or status = 'clean'")],
}
#: (table, column, parent): references; nulls are free.
REFERENCES = (
    ("shots", "episode_id", "episodes"), ("frames", "shot_id", "shots"), ("frame_tags", "frame_id", "frames"), ("faces", "frame_id", "frames"), ("faces", "cluster_id", "clusters"),
    ("lines", "episode_id", "episodes"), ("scenes", "episode_id", "episodes"), ("scene_shots", "scene_id", "scenes"), ("scene_shots", "shot_id", "shots"),
    ("cast_fixes", "shot_id", "shots"), ("line_voices", "line_id", "lines"), ("line_voices", "speaker_id", "speakers"),
    ("stage_runs", "episode_id", "episodes"), ("episode_parts", "episode_id", "episodes"), ("cast_fixes", "from_cluster", "clusters"), ("cast_fixes", "to_cluster", "clusters"),
    ("speaker_fixes", "line_id", "lines"), ("speaker_fixes", "speaker_id", "speakers"), ("transcripts", "line_id", "lines"), ("voice_styles", "speaker_id", "speakers"), ("voice_styles", "line_id", "lines"),
)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns and types; a missing column is null, extra ones go."""
    wanted = [x.split() for x in TABLES[table].split(", ")]
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, rows): how many rows break each constraint; an empty result means a sound library."""
    found: list[DataFrame] = []
    tell = lambda df, table, rule: found.append(df.agg(F.count("*").alias("rows")).filter("rows > 0").select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), "rows"))
    for name, df in tables.items():
        for key in KEYS[name]:
            tell(df.dropna(subset=key).groupBy(*key).count().filter("count > 1"), name, "unique " + ",".join(key))
        for rule, condition in CHECKS.get(name, []):
            tell(df.filter(f"not coalesce({condition}, false)"), name, rule)
    for name, column, parent in REFERENCES:
        if name in tables and parent in tables:
            ids = tables[parent].select(F.col("id").alias("_id"))
            tell(tables[name].filter(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_id"), "left_anti"), name, f"{column} in {parent}")
    if {"frames", "shots"} <= tables.keys():
        loose = tables["shots"].filter("status <> 'kept'").select(F.col("id").alias("_id"))
        for name in {"frames", "scene_shots"} & tables.keys():
            tell(tables[name].join(loose, F.col("shot_id") == F.col("_id"), "left_semi"), name, "only of kept shots")
    return reduce(DataFrame.unionByName, found)


def label(name: Column, id_: Column) -> Column:
    """A name, or #id where it is null or empty."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("#"), id_.cast("string")))


def next_ids(rows: DataFrame, high: int, name: str = "id") -> DataFrame:
    """rows with new ids above the high-water mark, never used before; dealt by partition, so no rows meet in one task."""
    indexed = rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    before = indexed.groupBy("_p").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = before.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    out = indexed.join(before, F.col("_p") == F.col("_q"))
    return out.withColumn(name, F.lit(high) + 1 + F.coalesce("_before", F.lit(0)) + F.col("_i").bitwiseAND((1 << 33) - 1)).drop("_p", "_q", "_i", "_before")
