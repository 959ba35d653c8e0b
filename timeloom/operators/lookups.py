"""Point lookups, filters and key joins over the library's tables, under the names that users know them by.

All are lazy. What must exist is asked for through required(), which raises when the plan runs and finds no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .library import find, members


def required(rows: DataFrame, what: str) -> DataFrame:
    """The one row that there is, or an error that names what is missing."""
    found = rows.agg(F.count("*").alias("_n"), F.any_value(F.struct(*rows.columns)).alias("_row"))
    return found.select(F.when(F.col("_n") > 0, F.col("_row")).otherwise(F.raise_error(F.lit(f"no {what}"))).alias("_row")).select("_row.*")


def get_episode(episodes: DataFrame, episode_id: int) -> DataFrame:
    return required(episodes.filter(F.col("id") == episode_id), f"episode {episode_id}")


def find_episode(episodes: DataFrame, path: str) -> DataFrame:
    return episodes.filter(F.col("path") == path)


def list_episodes(episodes: DataFrame) -> DataFrame:
    return episodes.orderBy("path")


def episodes_like(episodes: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """Episodes whose path holds one of the texts; all without texts."""
    return episodes.filter(reduce(Column.__or__, [F.contains(F.col("path"), F.lit(o)) for o in only])) if only else episodes


def some_episodes(episodes: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """As episodes_like(), but an error if there is none."""
    found = episodes_like(episodes, only)
    none = found.agg(F.count("*").alias("n")).scalar() == 0
    return episodes.filter(F.when(none, F.raise_error(F.lit(f"no episode matches {list(only)}"))).otherwise(F.lit(True))).join(found.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi")


def list_shots(shots: DataFrame, episode_id: int, status: str | None = None) -> DataFrame:
    own = shots.filter(F.col("episode_id") == episode_id)
    return (own.filter(F.col("status") == status) if status else own).orderBy("idx")


def get_shot(shots: DataFrame, shot_id: int) -> DataFrame:
    return required(shots.filter(F.col("id") == shot_id), f"shot {shot_id}")


def list_frames(frames: DataFrame, shot_id: int) -> DataFrame:
    return frames.filter(F.col("shot_id") == shot_id).orderBy("frame_index", "id")


def frame_tags(tags: DataFrame, frame_id: int) -> DataFrame:
    return tags.filter(F.col("frame_id") == frame_id).orderBy(F.desc("score"), "tag")


def list_lines(lines: DataFrame, episode_id: int, kind: str | None = None) -> DataFrame:
    own = lines.filter(F.col("episode_id") == episode_id)
    return (own.filter(F.col("kind") == kind) if kind else own).orderBy("start", "id")


def get_line(lines: DataFrame, line_id: int) -> DataFrame:
    return required(lines.filter(F.col("id") == line_id), f"line {line_id}")


def list_parts(parts: DataFrame, episode_id: int) -> DataFrame:
    return parts.filter(F.col("episode_id") == episode_id).orderBy("start", "kind")


def voices_of(voices: DataFrame, lines: DataFrame) -> DataFrame:
    """Voices with the episode, text and subtitle times of their lines."""
    own = lines.select(F.col("id").alias("line_id"), "episode_id", "text", F.col("start").alias("line_start"), F.col("end").alias("line_end"))
    return voices.join(own, "line_id")


def get_voice(voices: DataFrame, lines: DataFrame, line_id: int) -> DataFrame:
    return required(voices_of(voices.filter(F.col("line_id") == line_id), lines), f"voice of line {line_id}")


def episode_voices(voices: DataFrame, lines: DataFrame, episode_id: int) -> DataFrame:
    return voices_of(voices, lines.filter(F.col("episode_id") == episode_id)).orderBy("start", "line_id")


def clean_voices(voices: DataFrame, lines: DataFrame, speaker_id: int | None = None) -> DataFrame:
    clean = voices.filter("status = 'clean'")
    return voices_of(clean if speaker_id is None else clean.filter(F.col("speaker_id") == speaker_id), lines).orderBy("episode_id", "start", "line_id")


def clean_ids(voices: DataFrame, line_ids: DataFrame) -> DataFrame:
    """Of the ids (line_id) those whose voice is clean."""
    return line_ids.join(voices.filter("status = 'clean'").select("line_id"), "line_id", "left_semi")


def fixed_lines(fixes: DataFrame) -> DataFrame:
    return fixes.select("line_id").distinct()


def styles(voice_styles: DataFrame, speaker_id: int) -> DataFrame:
    """One row: the map of a speaker's styles to lines."""
    own = voice_styles.filter(F.col("speaker_id") == speaker_id)
    return own.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("style", "line_id")))).alias("styles"))


def transcripts(texts: DataFrame, lines: DataFrame, episode_id: int | None = None) -> DataFrame:
    own = lines.select(F.col("id").alias("line_id"), "episode_id")
    out = texts.join(own, "line_id")
    return out if episode_id is None else out.filter(F.col("episode_id") == episode_id)


def list_clusters(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """id, name, n: faces of each cluster, most first."""
    return members(faces, clusters, "cluster_id", ["id"])


def get_cluster(clusters: DataFrame, faces: DataFrame, cluster_id: int) -> DataFrame:
    return required(list_clusters(clusters, faces).filter(F.col("id") == cluster_id), f"cluster {cluster_id}")


def named(parents: DataFrame, ref: str) -> DataFrame:
    """What ref finds, which must have a name."""
    found = required(find(parents, ref), f"cluster {ref}")
    return found.withColumn("name", F.coalesce("name", F.raise_error(F.lit(f"{ref} has no name"))))


def list_speakers(speakers: DataFrame, voices: DataFrame) -> DataFrame:
    """id, name, n, seconds: lines and their length by speaker, the longest first, those without lines last."""
    own = voices.filter("speaker_id is not null").groupBy("speaker_id").agg(F.count("*").alias("_n"), F.sum(F.col("end") - F.col("start")).alias("_s"))
    out = speakers.join(own, F.col("id") == F.col("speaker_id"), "left")
    return out.select("id", "name", F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_s", F.lit(0.0)).alias("seconds")).orderBy(F.desc("seconds"), "id")


def get_speaker(speakers: DataFrame, voices: DataFrame, speaker_id: int) -> DataFrame:
    return required(list_speakers(speakers, voices).filter(F.col("id") == speaker_id), f"speaker {speaker_id}")


def faces_in_shots(faces: DataFrame, frames: DataFrame, shots: DataFrame) -> DataFrame:
    """Faces with the frame, shot and episode that they are in."""
    of = frames.select(F.col("id").alias("frame_id"), "shot_id", "frame_index").join(shots.select(F.col("id").alias("shot_id"), "episode_id", "idx"), "shot_id")
    return faces.join(of, "frame_id")


def episode_faces(faces: DataFrame, frames: DataFrame, shots: DataFrame, episode_id: int) -> DataFrame:
    return faces_in_shots(faces, frames, shots.filter(F.col("episode_id") == episode_id))


def cluster_faces(faces: DataFrame, frames: DataFrame, shots: DataFrame, cluster_id: int) -> DataFrame:
    return faces_in_shots(faces.filter(F.col("cluster_id") == cluster_id), frames, shots)


def clusters_in(cast: DataFrame, shot_id: int) -> DataFrame:
    return cast.filter(F.col("shot_id") == shot_id).select("cluster_id")


def clustered_face_ids(faces: DataFrame) -> DataFrame:
    """cluster_id, ids: the faces of each cluster, in order."""
    return faces.filter("cluster_id is not null").groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def list_episode_frames(frames: DataFrame, shots: DataFrame, episode_id: int) -> DataFrame:
    own = shots.filter(F.col("episode_id") == episode_id).select(F.col("id").alias("_shot"))
    return frames.join(own, F.col("shot_id") == F.col("_shot"), "left_semi").orderBy("frame_index", "id")


def kept_frames(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """episode_id, shot_id, frame_index of all sampled frames, which only kept shots own."""
    own = shots.filter("status = 'kept'").select(F.col("id").alias("shot_id"), "episode_id")
    return frames.join(own, "shot_id").select("episode_id", "shot_id", "frame_index")


def episode_cast(cast: DataFrame, shots: DataFrame, episode_id: int) -> DataFrame:
    """The cast of an episode's shots, unnamed clusters too, by shot and presence."""
    own = shots.filter(F.col("episode_id") == episode_id).select(F.col("id").alias("shot_id"), "idx")
    return cast.join(own, "shot_id").orderBy("idx", F.desc("presence"), "cluster_id")


def list_scenes(scenes: DataFrame, scene_shots: DataFrame, shots: DataFrame, episode_id: int | None = None) -> DataFrame:
    """id, episode_id, idx, shot_ids: scenes with their shots in order."""
    own = scenes if episode_id is None else scenes.filter(F.col("episode_id") == episode_id)
    of = scene_shots.join(shots.select(F.col("id").alias("shot_id"), F.col("idx").alias("_at")), "shot_id")
    of = of.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "shot_id"))), lambda s: s["shot_id"]).alias("shot_ids"))
    return own.join(of, F.col("id") == F.col("scene_id")).drop("scene_id")


def named_assignments(voices: DataFrame, lines: DataFrame, speakers: DataFrame, episode_id: int) -> DataFrame:
    """speaker_id, line_ids: what an episode's named speakers say."""
    named_ = speakers.filter("name is not null").select(F.col("id").alias("speaker_id"))
    own = voices_of(voices, lines.filter(F.col("episode_id") == episode_id)).join(named_, "speaker_id", "left_semi")
    return own.groupBy("speaker_id").agg(F.array_sort(F.collect_list("line_id")).alias("line_ids"))


def episodes_with_voices(voices: DataFrame, lines: DataFrame) -> DataFrame:
    return voices_of(voices, lines).select("episode_id").distinct()


def shot_views(shots: DataFrame, cast: DataFrame, clusters: DataFrame) -> DataFrame:
    """Kept shots with their cast as an array of structs (cluster_id, name or null, presence, height), empty for nobody."""
    who = cast.join(clusters.select(F.col("id").alias("cluster_id"), "name"), "cluster_id")
    who = who.groupBy(F.col("shot_id").alias("_shot")).agg(F.array_sort(F.collect_list(F.struct("cluster_id", "name", "presence", "height"))).alias("cast"))
    out = shots.filter("status = 'kept'").join(who, F.col("id") == F.col("_shot"), "left").drop("_shot")
    return out.withColumn("cast", F.coalesce("cast", F.array().cast(dict(who.dtypes)["cast"])))


def clusters_with_hints(clusters: DataFrame, faces: DataFrame, hints: DataFrame) -> DataFrame:
    """list_clusters() with an array of (tag, share), empty where there are no hints (cluster_id, tag, share, rank)."""
    own = hints.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag", "share"))), lambda h: F.struct(h["tag"], h["share"])).alias("hints"))
    out = list_clusters(clusters, faces).join(own, F.col("id") == F.col("cluster_id"), "left").drop("cluster_id")
    return out.withColumn("hints", F.coalesce("hints", F.array().cast(dict(own.dtypes)["hints"])))


def fix_labels(fixes: DataFrame, clusters: DataFrame) -> DataFrame:
    """The log of corrections with the names of what they move from and to; a target of null is nobody."""
    label = lambda c: F.coalesce("name", F.concat(F.lit("#"), F.col(c).cast("string")), F.lit("nobody"))
    out = fixes
    for c, name in (("from_cluster", "from_label"), ("to_cluster", "to_label")):
        out = out.join(clusters.select(F.col("id").alias("_id"), "name"), F.col(c) == F.col("_id"), "left").withColumn(name, label(c)).drop("_id", "name")
    return out.orderBy("shot_id", "from_cluster")
