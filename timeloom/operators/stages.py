"""Stages of an ingest: order, completion, staleness and stamps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("shots", "filter", "cast", "lines", "scenes", "voice", "motion")
NEEDS = {"filter": ("shots",), "cast": ("filter",), "lines": (), "scenes": ("cast", "lines"), "voice": ("lines",), "motion": ("filter",)}


@dataclass
class Stage:
    """A step of an ingest: run makes its rows for episodes (a DataFrame with id), reset gives the tables that it owns."""

    name: str
    run: Callable[[DataFrame], None]
    owns: Sequence[str] = field(default=())


def undone(episodes: DataFrame, runs: DataFrame, stage: str) -> DataFrame:
    """Episodes whose stage is not done while all that it needs is."""
    done = runs.filter(F.col("stage") == stage).select(F.col("episode_id").alias("_e")).distinct()
    rest = episodes.join(done, F.col("id") == F.col("_e"), "left_anti")
    for need in NEEDS.get(stage, ()):
        have = runs.filter(F.col("stage") == need).select(F.col("episode_id").alias("_e")).distinct()
        rest = rest.join(have, F.col("id") == F.col("_e"), "left_semi")
    return rest


def run(stages: Sequence[Stage], episodes: DataFrame, log: Callable[[], DataFrame], mark: Callable[[str, DataFrame], None], until: str | None = None) -> None:
    """The stages in order, each over the episodes for which it is not done; mark() notes what is."""
    for stage in stages:
        rest = undone(episodes, log(), stage.name)
        if not rest.isEmpty():
            stage.run(rest)
            mark(stage.name, rest)
        if stage.name == until:
            return


def after(runs: DataFrame, episodes: DataFrame, stage: str) -> DataFrame:
    """runs without the stage and all later ones, for the episodes: what redoing it leaves."""
    later = NAMES[NAMES.index(stage) :]
    ids = episodes.select(F.col("id").alias("_e"))
    gone = runs.filter(F.col("stage").isin(*later)).join(ids, F.col("episode_id") == F.col("_e"), "left_semi").select(F.col("episode_id").alias("_g"), F.col("stage").alias("_s"))
    return runs.join(gone, (F.col("episode_id") == F.col("_g")) & (F.col("stage") == F.col("_s")), "left_anti")


def fresh(runs: DataFrame, stage: str, needs: Sequence[str]) -> DataFrame:
    """episode_id, fresh: whether the stage ended no earlier than each stage it depends on; a missing one counts as never."""
    at = lambda name: F.max(F.when(F.col("stage") == name, F.col("finished_at")))
    newest = F.greatest(F.lit(""), *[F.coalesce(at(n), F.lit("")) for n in needs], F.lit(""))
    return runs.groupBy("episode_id").agg(F.coalesce(at(stage) >= newest, F.lit(False)).alias("fresh"))


def status(episodes: DataFrame, runs: DataFrame, shots: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Each episode with its finished stages, in their order, and its number of shots by status."""
    done = runs.groupBy("episode_id").agg(F.collect_set("stage").alias("_s"))
    counts = shots.groupBy("episode_id").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in statuses]).withColumnRenamed("episode_id", "_e")
    x = episodes.join(done, episodes["id"] == done["episode_id"], "left").join(counts, episodes["id"] == F.col("_e"), "left")
    order = F.filter(F.array(*map(F.lit, NAMES)), lambda s: F.array_contains(F.coalesce("_s", F.array().cast("array<string>")), s))
    return x.select(episodes["id"], "path", order.alias("stages"), *[F.coalesce(s, F.lit(0)).alias(s) for s in statuses])


def stamps(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, stamp: a hash of each key's rows, the same for any order of them; equal stamps mean that nothing changed.

    Rows are hashed one by one and the hashes are combined by sums, so that no key's rows meet in one task.
    """
    h = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    part = lambda a: F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(30,0)")
    return rows.groupBy(*keys).agg(F.concat_ws("-", F.count("*").cast("string"), F.sum(part(1)).cast("string"), F.sum(part(13)).cast("string")).alias("stamp"))


def latest(runs: DataFrame) -> DataFrame:
    """The last run of each episode and stage."""
    w = Window.partitionBy("episode_id", "stage").orderBy(F.desc("finished_at"), F.desc("params"))
    return runs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def changed(now: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of now (keys, stamp) whose stamp is new or another one than before."""
    old = before.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("stamp").alias("_stamp"))
    return now.join(old, [*[F.col(k) == F.col(f"_{k}") for k in keys], F.col("stamp") == F.col("_stamp")], "left_anti")


def as_records(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """df as one JSON text a row, with the names that mapping gives its columns."""
    return df.select(F.to_json(F.struct(*[F.col(c).alias(n) for c, n in mapping.items()])).alias("value"))
