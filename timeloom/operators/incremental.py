"""Clusters that grow: new vectors join the groups that are there, the rest form groups of their own; splitting and clustering again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import evenly_spaced
from .vectors import average_linkage, knn_vote
from .writes import _top

#: Thresholds of faces and voices, least sizes of new groups, exemplars of old ones, how much tighter a split is.
FACES = {"threshold": 0.15, "least": 4, "exemplars": 64, "halved": True}
VOICES = {"threshold": 0.7, "least": 2, "exemplars": 48, "halved": False}
SPLIT = 0.7


def exemplars(rows: DataFrame, most: int) -> DataFrame:
    """cluster, embedding: at most ``most`` vectors of each cluster (id, cluster, embedding), evenly spaced by id."""
    return evenly_spaced(rows.filter("cluster is not null").select("id", "cluster", "embedding"), ["cluster"], ["id"], most).select("cluster", "embedding")


def grouped(new: DataFrame, known: DataFrame, part: str, threshold: float, halved: bool) -> DataFrame:
    """part, id, cluster, label, size: average linkage of the new vectors of each part together with what is known.

    new: part, id, embedding. known: cluster, embedding: exemplars, a table bounded by the number of clusters. A known cluster is
    one point, as far from a vector as its exemplars on average and as heavy as their number; two of them never merge. Vectors
    that end up with a known cluster have it; the others have the label of their group in the part, and its size. The vectors of a
    part, such as an episode, meet in a task.
    """
    old = known.groupBy("cluster").agg(F.collect_list("embedding").alias("vectors"))
    each = new.select(part).distinct().join(F.broadcast(old.agg(F.sort_array(F.collect_list(F.struct("cluster", "vectors"))).alias("old"))), F.lit(True), "inner")

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["part", "id", "cluster", "label", "size"]
        if not len(a):
            return pd.DataFrame([], columns=names)
        a = a.sort_values("id")
        unit = lambda v: (x := np.stack(v).astype(np.float64)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        apart = lambda x, y: np.clip((1 - x @ y.T) / 2, 0, 1) if halved else 1 - x @ y.T
        e, held = unit(a["embedding"]), list(b["old"].iloc[0]) if len(b) and b["old"].iloc[0] is not None else []
        k, n = len(held), len(a)
        d, weight = np.full((k + n, k + n), np.inf), np.ones(k + n)
        d[k:, k:] = apart(e, e)
        for j, h in enumerate(held):
            d[k:, j] = d[j, k:] = apart(e, unit(list(h["vectors"]))).mean(1)
            weight[j] = len(h["vectors"])
        labels = average_linkage(d, threshold, weight)
        owner = {labels[j]: held[j]["cluster"] for j in range(k)}
        own = labels[k:]
        size = pd.Series(own).map(pd.Series(own).value_counts())
        return pd.DataFrame({"part": key[0], "id": a["id"].to_numpy(), "cluster": pd.array([owner.get(x) for x in own], "Int64"), "label": own, "size": size.to_numpy()})

    kind = dict(new.dtypes)[part]
    out = new.select(F.col(part).alias("part"), "id", "embedding").groupBy("part").cogroup(each.select(F.col(part).alias("part"), "old").groupBy("part"))
    return out.applyInPandas(run, f"part {kind}, id long, cluster long, label long, size long")


def assigned(rows: DataFrame, parents: DataFrame, part: str, threshold: float, least: int, exemplars_: int, halved: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, parents) after the rows (id, part, embedding, cluster) without a cluster joined those there are or made new ones.

    New groups need ``least`` members; they get ids above the parents', the largest group of a part first; smaller ones stay of
    nobody. Parts are handled side by side, each against what was known before.
    """
    free = rows.filter("cluster is null")
    found = grouped(free, exemplars(rows, exemplars_), part, threshold, halved)
    groups = found.filter((F.col("cluster").isNull()) & (F.col("size") >= least)).groupBy("part", "label").agg(F.max("size").alias("n"), F.min("id").alias("first"))
    groups = groups.withColumn("new", _top(parents) + F.row_number().over(Window.orderBy("part", F.desc("n"), "first")))
    to = found.join(groups.select("part", "label", "new"), ["part", "label"], "left").select(F.col("id").alias("_id"), F.when(F.col("cluster").isNotNull(), F.col("cluster")).otherwise(F.col("new")).alias("_to"))
    out = rows.join(to, F.col("id") == F.col("_id"), "left").withColumn("cluster", F.coalesce("cluster", "_to")).drop("_id", "_to")
    return out, parents.unionByName(groups.select(F.col("new").alias("id"), F.lit(None).cast("string").alias("name")))


def assign_clusters(faces: DataFrame, clusters: DataFrame, part: str = "episode_id") -> tuple[DataFrame, DataFrame]:
    return assigned(faces, clusters, part, FACES["threshold"], FACES["least"], FACES["exemplars"], FACES["halved"])


def filled(rows: DataFrame, k: int = 3, far: float = 0.6) -> DataFrame:
    """rows (id, embedding, cluster) with those of nobody given to the one owner of their k nearest placed rows."""
    vote = knn_vote(rows.filter("cluster is null"), rows.filter("cluster is not null").withColumnRenamed("cluster", "owner"), k, far)
    out = rows.join(vote.select(F.col("id").alias("_id"), "owner"), F.col("id") == F.col("_id"), "left")
    return out.withColumn("cluster", F.coalesce("cluster", "owner")).drop("_id", "owner")


def assign_speakers(voices: DataFrame, speakers: DataFrame, pinned: DataFrame, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(voices, speakers): clean voices (id, embedding, cluster, status) that are not pinned (id) get speakers, then those left
    alone the one of all their nearest."""
    fixed = voices.join(pinned.select(F.col("id").alias("_p")), F.col("id") == F.col("_p"), "left_semi").filter("cluster is null").unionByName(voices.filter("status <> 'clean'"))
    fixed = fixed.dropDuplicates(["id"])
    free = voices.join(fixed.select(F.col("id").alias("_f")), F.col("id") == F.col("_f"), "left_anti").withColumn("_part", F.lit(0))
    out, parents = assigned(free, speakers, "_part", threshold or VOICES["threshold"], VOICES["least"], VOICES["exemplars"], VOICES["halved"])
    return filled(out.drop("_part")).unionByName(fixed), parents


def split_cluster(faces: DataFrame, clusters: DataFrame, cluster: int) -> tuple[DataFrame, DataFrame]:
    """(faces, clusters) with a cluster (id, embedding, cluster) grouped again, more tightly: its largest group keeps it, other
    groups that are large enough are new, the rest is of nobody."""
    own = faces.filter(F.col("cluster") == cluster).withColumn("_part", F.lit(0))
    none = own.select("cluster", "embedding").limit(0)
    found = grouped(own, none, "_part", FACES["threshold"] * SPLIT, FACES["halved"])
    groups = found.filter(F.col("size") >= FACES["least"]).groupBy("label").agg(F.max("size").alias("n"), F.min("id").alias("first"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first"))
    groups = groups.withColumn("_r", rank).withColumn("new", F.when(F.col("_r") == 1, F.lit(cluster)).otherwise(_top(clusters) + F.col("_r") - 1))
    # without a group that is large enough nothing changes owner but all are of nobody, as when clustered anew
    to = found.join(groups.select("label", "new"), "label", "left").select(F.col("id").alias("_id"), F.col("new").alias("_to"), F.lit(True).alias("_hit"))
    out = faces.join(to, F.col("id") == F.col("_id"), "left").withColumn("cluster", F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("cluster"))).drop("_id", "_to", "_hit")
    return out, clusters.unionByName(groups.filter("_r > 1").select(F.col("new").cast("long").alias("id"), F.lit(None).cast("string").alias("name")))


def recluster(rows: DataFrame, parents: DataFrame, part: str, **options) -> tuple[DataFrame, DataFrame]:
    """assigned() after the rows of unnamed parents were freed; named ones stay and attract."""
    named = parents.filter("name is not null")
    free = rows.join(named.select(F.col("id").alias("_n")), F.col("cluster") == F.col("_n"), "left").withColumn("cluster", F.col("_n")).drop("_n")
    return assigned(free, named, part, **({"threshold": FACES["threshold"], "least": FACES["least"], "exemplars_": FACES["exemplars"], "halved": FACES["halved"]} | options))
