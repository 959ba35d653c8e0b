"""Corrections that users made, as logs over derived facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply_fixes(faces: DataFrame, fixes: DataFrame) -> DataFrame:
    """faces (shot_id, cluster_id, ...) with the fixed clusters; a fix to nobody sets null, so a hit counts, not its value."""
    f = fixes.select(F.col("shot_id").alias("_shot"), F.col("from_cluster").alias("_from"), F.col("to_cluster").alias("_to"), F.lit(True).alias("_hit"))
    x = faces.join(f, (F.col("shot_id") == F.col("_shot")) & (F.col("cluster_id") == F.col("_from")), "left")
    return x.withColumn("cluster_id", F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("cluster_id"))).drop("_shot", "_from", "_to", "_hit")


def fold_fixes(log: DataFrame) -> DataFrame:
    """shot_id, from_cluster, to_cluster: what a log (seq, shot_id, from_cluster, to_cluster) of corrections comes to.

    In order, a correction drops its own inverse, redirects the fixes that ended where it begins, and replaces a fix of the
    same cluster. A shot's corrections are the unit that is folded.
    """
    log = log.groupBy("shot_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("from_cluster").alias("f"), F.col("to_cluster").alias("t")))).alias("_log"))
    none = F.array().cast("array<struct<f:bigint,t:bigint>>")

    def step(acc, r):
        moved = F.transform(acc, lambda x: F.struct(x["f"].alias("f"), F.when(x["t"].eqNullSafe(r["f"]), r["t"]).otherwise(x["t"]).alias("t")))
        moved = F.filter(moved, lambda x: ~x["f"].eqNullSafe(x["t"]) & ~x["f"].eqNullSafe(r["f"]))
        return F.concat(moved, F.array(F.struct(r["f"].alias("f"), r["t"].alias("t"))))

    return log.select("shot_id", F.explode(F.aggregate("_log", none, step)).alias("_x")).select("shot_id", F.col("_x.f").alias("from_cluster"), F.col("_x.t").alias("to_cluster"))


def merge_clusters(faces: DataFrame, clusters: DataFrame, fixes: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after all of source has become target, which keeps its name or takes the source's."""
    if source == target:
        raise ValueError("a cluster cannot be merged into itself")
    to = lambda c: F.when(F.col(c) == source, F.lit(target)).otherwise(F.col(c))
    rest = fixes.filter(~(F.col("from_cluster").isin(source, target) & F.col("to_cluster").isin(source, target)) | F.col("to_cluster").isNull())
    rest = rest.withColumns({"_was": F.col("from_cluster"), "from_cluster": to("from_cluster"), "to_cluster": to("to_cluster")}).filter(~F.col("from_cluster").eqNullSafe(F.col("to_cluster")))
    w = Window.partitionBy("shot_id", "from_cluster").orderBy(F.when(F.col("_was") == source, 0).otherwise(1))
    rest = rest.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_was")
    name = F.max(F.when(F.col("id") == source, F.col("name"))).over(Window.partitionBy(F.col("id").isin(source, target)))
    merged = clusters.withColumn("name", F.when(F.col("id") == target, F.coalesce("name", name)).otherwise(F.col("name"))).filter(F.col("id") != source)
    return faces.withColumn("cluster_id", to("cluster_id")), merged, rest


def without_empty(parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """parents that are named or that some row refers to."""
    used = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_used")).distinct()
    return parents.join(used, F.col("id") == F.col("_used"), "left").filter("name is not null or _used is not null").drop("_used")


def unassign_unnamed(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """rows whose parent has no name are of nobody."""
    named = parents.filter("name is not null").select(F.col("id").alias("_id"))
    return rows.join(named, F.col(key) == F.col("_id"), "left").withColumn(key, F.col("_id")).drop("_id")


def accepted(suggestions: DataFrame, speakers: DataFrame) -> DataFrame:
    """id, name, into: what taking all suggestions does: the owner of a name, else its first unnamed speaker, keeps it."""
    owner = speakers.filter("name is not null").select("name", F.col("id").alias("_owner"))
    x = suggestions.join(owner, "name", "left")
    first = F.min("speaker").over(Window.partitionBy("name"))
    return x.select(F.col("speaker").alias("id"), "name", F.coalesce("_owner", first).alias("into"))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those of the same keys."""
    k = rows.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    return table.join(k, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left_anti").unionByName(rows.select(*table.columns))
