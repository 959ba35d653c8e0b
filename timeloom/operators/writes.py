"""Changes to the library's tables as functions from tables to tables: replacing, keeping, naming, assigning and merging.

Each returns new versions of the tables that it changes; sources.store writes them. Rows of other episodes are passed through
untouched. Guards that a change must keep are checked in the plan and raise when it runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .overrides import apply_fixes, fold_fixes, merge_clusters, unassign_unnamed, upserted, without_empty


def _ids(df: DataFrame, column: str, name: str = "_id") -> DataFrame:
    return df.select(F.col(column).alias(name)).distinct()


def _top(table: DataFrame) -> Column:
    """The highest id of a table, 0 if it is empty, as a scalar subquery."""
    return F.coalesce(table.agg(F.max("id")).scalar(), F.lit(0).cast("long"))


def replace_shots(shots: DataFrame, episode_id: int, spans: DataFrame) -> DataFrame:
    """shots with the spans (start_frame, end_frame) in place of the episode's, numbered in order, all pending, with new ids."""
    at = (F.row_number().over(Window.orderBy("start_frame", "end_frame")) - 1).cast("long")
    fresh = spans.select(F.lit(episode_id).cast("long").alias("episode_id"), at.alias("idx"), "start_frame", "end_frame", F.lit("pending").alias("status"))
    fresh = fresh.withColumn("id", _top(shots) + 1 + F.col("idx"))
    return shots.filter(F.col("episode_id") != episode_id).unionByName(fresh.select(*shots.columns))


def set_status(shots: DataFrame, shot_id: int, status: str) -> DataFrame:
    return shots.withColumn("status", F.when(F.col("id") == shot_id, F.lit(status)).otherwise(F.col("status")))


def keep_shot(shots: DataFrame, frames: DataFrame, tags: DataFrame, shot_id: int, new_frames: DataFrame, new_tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with the shot kept and its rated frames and their tags added."""
    return set_status(shots, shot_id, "kept"), frames.unionByName(new_frames.withColumn("shot_id", F.lit(shot_id).cast("long")).select(*frames.columns)), tags.unionByName(new_tags.select(*tags.columns))


def drop_shot(shots: DataFrame, frames: DataFrame, shot_id: int) -> DataFrame:
    """shots with the shot dropped; an error while it has frames."""
    held = frames.filter(F.col("shot_id") == shot_id).agg(F.count("*")).scalar() > 0
    dropped = F.when(held, F.raise_error(F.lit(f"shot {shot_id} has frames and stays kept"))).otherwise(F.lit("dropped"))
    return shots.withColumn("status", F.when(F.col("id") == shot_id, dropped).otherwise(F.col("status")))


def reset_filter(shots: DataFrame, frames: DataFrame, tags: DataFrame, episode_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables with the episode's frames and tags gone and its shots pending again."""
    own = _ids(shots.filter(F.col("episode_id") == episode_id), "id")
    left = frames.join(own, F.col("shot_id") == F.col("_id"), "left_anti")
    gone = _ids(frames.join(own, F.col("shot_id") == F.col("_id"), "left_semi"), "id")
    pending = shots.withColumn("status", F.when(F.col("episode_id") == episode_id, F.lit("pending")).otherwise(F.col("status")))
    return pending, left, tags.join(gone, F.col("frame_id") == F.col("_id"), "left_anti")


def replace_of_episode(table: DataFrame, episode_id: int, rows: DataFrame) -> DataFrame:
    """table with rows in place of the episode's."""
    own = rows.withColumn("episode_id", F.lit(episode_id).cast("long"))
    return table.filter(F.col("episode_id") != episode_id).unionByName(own.select(*table.columns))


def replace_lines(lines: DataFrame, parts: DataFrame, episode_id: int, new_lines: DataFrame, new_parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with an episode's lines (start, end, kind, style, text) and parts replaced; lines get new ids by start."""
    at = F.row_number().over(Window.orderBy("start", "end", "text"))
    numbered = new_lines.withColumn("id", _top(lines) + at)
    return replace_of_episode(lines, episode_id, numbered), replace_of_episode(parts, episode_id, new_parts)


def replace_scenes(scenes: DataFrame, scene_shots: DataFrame, shots: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the scenes of groups (episode_id, scene, shot_id) in place of those of its episodes.

    Scenes are numbered by number in each episode and get new ids; an error if a shot is not kept.
    """
    kept = shots.select(F.col("id").alias("shot_id"), "status")
    sound = groups.join(kept, "shot_id", "left").withColumn("shot_id", F.when(F.col("status") == "kept", F.col("shot_id")).otherwise(F.raise_error(F.lit("a scene holds a shot that is not kept"))))
    episodes = _ids(groups, "episode_id", "_ep")
    fresh = sound.select("episode_id", "scene").distinct()
    fresh = fresh.withColumns({"idx": (F.row_number().over(Window.partitionBy("episode_id").orderBy("scene")) - 1).cast("long"), "id": _top(scenes) + F.dense_rank().over(Window.orderBy("episode_id", "scene"))})
    gone = _ids(scenes.join(episodes, F.col("episode_id") == F.col("_ep"), "left_semi"), "id")
    rest = scenes.join(episodes, F.col("episode_id") == F.col("_ep"), "left_anti").unionByName(fresh.select(*scenes.columns))
    of = sound.join(fresh.select("episode_id", "scene", F.col("id").alias("scene_id")), ["episode_id", "scene"]).select("scene_id", "shot_id")
    return rest, scene_shots.join(gone, F.col("scene_id") == F.col("_id"), "left_anti").unionByName(of)


def add_faces(faces: DataFrame, new: DataFrame) -> DataFrame:
    """faces with more of them, numbered behind the highest id in the order of frames and boxes."""
    at = F.row_number().over(Window.orderBy("frame_id", "x0", "y0", "x1", "y1"))
    return faces.unionByName(new.withColumn("id", _top(faces) + at).select(*faces.columns))


def clear_episode_faces(faces: DataFrame, frames: DataFrame, shots: DataFrame, clusters: DataFrame, episode_id: int) -> tuple[DataFrame, DataFrame]:
    """faces without those of the episode, clusters without unnamed ones that are then empty."""
    own = frames.join(_ids(shots.filter(F.col("episode_id") == episode_id), "id"), F.col("shot_id") == F.col("_id"), "left_semi")
    left = faces.join(_ids(own, "id"), F.col("frame_id") == F.col("_id"), "left_anti")
    return left, without_empty(clusters, left, "cluster_id")


def clear_line_voices(voices: DataFrame, lines: DataFrame, speakers: DataFrame, episode_id: int) -> tuple[DataFrame, DataFrame]:
    left = voices.join(_ids(lines.filter(F.col("episode_id") == episode_id), "id"), F.col("line_id") == F.col("_id"), "left_anti")
    return left, without_empty(speakers, left, "speaker_id")


def replace_line_voices(voices: DataFrame, lines: DataFrame, episode_id: int, new: DataFrame) -> DataFrame:
    own = _ids(lines.filter(F.col("episode_id") == episode_id), "id")
    return voices.join(own, F.col("line_id") == F.col("_id"), "left_anti").unionByName(new.select(*voices.columns))


def set_transcripts(texts: DataFrame, model: str, new: DataFrame) -> DataFrame:
    """texts with those of new (line_id, text) by a model, one for each line."""
    return upserted(texts, new.withColumn("model", F.lit(model)), ["line_id"])


def clear_transcripts(texts: DataFrame, lines: DataFrame, episode_id: int) -> DataFrame:
    return texts.join(_ids(lines.filter(F.col("episode_id") == episode_id), "id"), F.col("line_id") == F.col("_id"), "left_anti")


def set_style(styles: DataFrame, speaker_id: int, style: str, line_id: int) -> DataFrame:
    row = styles.sparkSession.range(1).select(F.lit(speaker_id).cast("long").alias("speaker_id"), F.lit(style).alias("style"), F.lit(line_id).cast("long").alias("line_id"))
    return upserted(styles, row, ["speaker_id", "style"])


def register_episodes(episodes: DataFrame, probed: DataFrame) -> DataFrame:
    """episodes with those of probed (path, width, height, fps_num, fps_den, frame_count) whose path is not there yet."""
    new = probed.join(episodes.select("path"), "path", "left_anti")
    new = new.withColumn("id", _top(episodes) + F.row_number().over(Window.orderBy("path")))
    return episodes.unionByName(new.select(*episodes.columns))


def set_frame_count(episodes: DataFrame, episode_id: int, n: int) -> DataFrame:
    return episodes.withColumn("frame_count", F.when(F.col("id") == episode_id, F.lit(n).cast("long")).otherwise(F.col("frame_count")))


def prune_frames(cached: DataFrame, frames: DataFrame, shots: DataFrame) -> DataFrame:
    """Of the cached pictures (episode_id, frame_index) those that no kept shot owns: what may be deleted."""
    kept = shots.filter("status = 'kept'").select(F.col("id").alias("shot_id"), "episode_id")
    return cached.join(frames.join(kept, "shot_id").select("episode_id", "frame_index"), ["episode_id", "frame_index"], "left_anti")


def ensure_frames(planned: DataFrame, cached: DataFrame) -> DataFrame:
    """Planned pictures (episode_id, frame_index) that are not cached: what must be extracted."""
    return planned.select("episode_id", "frame_index").distinct().join(cached, ["episode_id", "frame_index"], "left_anti")


def create(parents: DataFrame, high: int, name: str | None = None) -> DataFrame:
    """A table of clusters or speakers with one more, whose id is above the high-water mark; an error if the name is taken."""
    row = parents.sparkSession.range(1).select((F.greatest(_top(parents), F.lit(high)) + 1).alias("id"), F.lit(name).cast("string").alias("name"))
    return _unique(parents.unionByName(row), name)


def _unique(parents: DataFrame, name: str | None) -> DataFrame:
    """parents; an error if two have the name."""
    if name is None:
        return parents
    twice = F.count(F.when(F.col("name") == name, 1)).over(Window.partitionBy("name")) > 1
    return parents.withColumn("name", F.when(twice, F.raise_error(F.lit(f"the name {name} is taken"))).otherwise(F.col("name")))


def rename(parents: DataFrame, id_: int, name: str | None) -> DataFrame:
    """parents with one renamed; an error if there is no such id or the name is taken."""
    none = parents.filter(F.col("id") == id_).agg(F.count("*")).scalar() == 0
    changed = F.when(F.col("id") == id_, F.lit(name).cast("string")).otherwise(F.col("name"))
    return _unique(parents.withColumn("name", F.when(none, F.raise_error(F.lit(f"no {id_}"))).otherwise(changed)), name)


def assign(rows: DataFrame, key: str, ids: DataFrame, column: str, to: int | None) -> DataFrame:
    """rows with ``column`` set for the ids (a column id), to nobody if ``to`` is None."""
    hit = ids.select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct()
    out = rows.join(hit, F.col(key) == F.col("_id"), "left")
    return out.withColumn(column, F.when(F.col("_hit"), F.lit(to).cast("long")).otherwise(F.col(column))).drop("_id", "_hit")


def merge_all(faces: DataFrame, clusters: DataFrame, fixes: DataFrame, sources: Sequence[int], target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """merge_clusters() of several sources into one target, in order."""
    for source in sources:
        faces, clusters, fixes = merge_clusters(faces, clusters, fixes, source, target)
    return faces, clusters, fixes


def fix_shot_cast(faces: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, fixes): the folded log of corrections (seq, shot_id, from_cluster, to_cluster), and faces (with shot_id) to match."""
    fixes = fold_fixes(log)
    return apply_fixes(faces, fixes), fixes


def moves(shots: Sequence[int], cast: DataFrame, clusters: DataFrame, source: int | None, target: int | None) -> DataFrame:
    """shot_id, from_cluster, to_cluster, said: the corrections that moving a character in shots comes to.

    Without a source it is the one named character in the shot other than the target. An error for a shot that has none or
    several, or that the source is not in, and for clusters without a name.
    """
    spark = cast.sparkSession
    names = clusters.filter("name is not null")
    wanted = spark.createDataFrame([(s,) for s in shots], "shot_id long")
    here = cast.join(F.broadcast(wanted), "shot_id", "left_semi").join(names.select(F.col("id").alias("cluster_id"), "name"), "cluster_id").select("shot_id", "cluster_id", "name")
    here = here.filter(F.col("cluster_id") == source) if source is not None else here.filter(~F.col("cluster_id").eqNullSafe(F.lit(target)))
    here = here.groupBy("shot_id").agg(F.count("*").alias("n"), F.min("cluster_id").alias("from_cluster"), F.min("name").alias("_from"))
    out = wanted.join(here, "shot_id", "left")
    sure = F.when(F.col("n") == 1, F.col("from_cluster")).otherwise(F.raise_error(F.concat(F.lit("shot "), F.col("shot_id").cast("string"), F.lit(": say which character moves"))))
    to = F.lit("nobody") if target is None else F.coalesce(names.filter(F.col("id") == target).agg(F.max("name")).scalar(), F.raise_error(F.lit(f"{target} has no name")))
    said = F.concat(F.lit("shot "), F.col("shot_id").cast("string"), F.lit(": "), "_from", F.lit(" -> "), to)
    return out.select("shot_id", sure.alias("from_cluster"), F.lit(target).cast("long").alias("to_cluster"), said.alias("said"))


def apply_speaker_fixes(voices: DataFrame, fixes: DataFrame, speakers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean voices of pinned lines get the pinned speaker (null: nobody); speakers without a name or a line go."""
    f = fixes.select(F.col("line_id").alias("_line"), F.col("speaker_id").alias("_to"), F.lit(True).alias("_hit"))
    x = voices.join(f, F.col("line_id") == F.col("_line"), "left")
    x = x.withColumn("speaker_id", F.when(F.coalesce("_hit", F.lit(False)) & (F.col("status") == "clean"), F.col("_to")).otherwise(F.col("speaker_id"))).drop("_line", "_to", "_hit")
    return x, without_empty(speakers, x, "speaker_id")


def fix_line_speaker(fixes: DataFrame, voices: DataFrame, speakers: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fixes, voices, speakers) after pins (line_id, speaker_id) were added; an error for a line whose voice is not clean or a
    speaker without a name."""
    clean = voices.filter("status = 'clean'").select("line_id", F.lit(True).alias("_clean"))
    named = speakers.filter("name is not null").select(F.col("id").alias("speaker_id"), F.lit(True).alias("_named"))
    x = new.join(clean, "line_id", "left").join(named, "speaker_id", "left")
    bad = F.col("_clean").isNull() | (F.col("speaker_id").isNotNull() & F.col("_named").isNull())
    pins = x.select(F.when(bad, F.raise_error(F.lit("only clean lines are pinned, and to named speakers"))).otherwise(F.col("line_id")).cast("long").alias("line_id"), "speaker_id")
    all_ = upserted(fixes, pins, ["line_id"])
    return all_, *apply_speaker_fixes(voices, all_, speakers)


def merge_speakers(voices: DataFrame, speakers: DataFrame, fixes: DataFrame, styles: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables after all of source has become target; of two styles of one name the target's stays."""
    if source == target:
        raise ValueError("a speaker cannot be merged into itself")
    to = lambda c: F.when(F.col(c) == source, F.lit(target).cast("long")).otherwise(F.col(c))
    own = F.max(F.when(F.col("id") == source, F.col("name"))).over(Window.partitionBy(F.col("id").isin(source, target)))
    left = speakers.withColumn("name", F.when(F.col("id") == target, F.coalesce("name", own)).otherwise(F.col("name"))).filter(F.col("id") != source)
    first = F.row_number().over(Window.partitionBy("_speaker", "style").orderBy(F.when(F.col("speaker_id") == target, 0).otherwise(1)))
    kept = styles.withColumn("_speaker", to("speaker_id")).withColumn("_r", first).filter("_r = 1").withColumn("speaker_id", F.col("_speaker")).select(*styles.columns)
    return voices.withColumn("speaker_id", to("speaker_id")), left, fixes.withColumn("speaker_id", to("speaker_id")), kept


def unassigned(rows: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, parents) with nobody in unnamed parents, which are gone: what clustering again begins with."""
    left = unassign_unnamed(rows, parents, key)
    return left, without_empty(parents, left, key)
