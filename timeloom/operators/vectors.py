"""Vectors, bit hashes and clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def halved_difference(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2, in [0, 1]."""
    return F.least(F.greatest(cosine_distance(a, b) / 2, F.lit(0.0)), F.lit(1.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_values(values: DataFrame, value: str, most: int = 8) -> DataFrame:
    """Pairs (va, vb), in both orders and with itself, of the distinct 64-bit values that differ in at most ``most`` bits.

    In one of most // 3 + 1 bands of bits such values differ in at most two bits, so each value stands under its bands as they are
    and with one bit turned, and two values meet there. A pair counts in the first band that it is near in, and there once: where
    the left one has fewer bits turned, or the earlier of two. Bands of 21 bits keep chance meetings rare up to millions of values.
    """
    bands = most // 3 + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    part = lambda v, i: F.shiftrightunsigned(v, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    distinct = values.select(F.col(value).alias("v")).filter("v is not null").distinct()
    place = lambda i, t: F.struct(F.lit(i).alias("i"), (part(F.col("v"), i) if t < 0 else part(F.col("v"), i).bitwiseXOR(F.lit(1 << t))).alias("p"), F.lit(t).alias("t"))
    keys = F.array(*[place(i, t) for i in range(bands) for t in range(-1, edges[i + 1] - edges[i])])
    keyed = lambda v, t: distinct.select(F.col("v").alias(v), F.explode(keys).alias("k")).select(v, "k.i", "k.p", F.col("k.t").alias(t))
    far = lambda i: F.bit_count(part(F.col("va"), i).bitwiseXOR(part(F.col("vb"), i))) > 2
    earlier = [~(F.col("i") > i) | far(i) for i in range(bands - 1)]
    once = F.expr("ta < tb or (ta = -1 and tb = -1)")
    met = keyed("va", "ta").join(keyed("vb", "tb"), ["i", "p"]).filter(once & (F.col("va") < F.col("vb")) & (hamming(F.col("va"), F.col("vb")) <= most))
    # one row a pair, read in both orders: kept, so that the search runs once
    near = met.filter(reduce(Column.__and__, earlier, F.lit(True))).select("va", "vb").persist()
    return near.unionByName(near.select(F.col("vb").alias("va"), F.col("va").alias("vb"))).unionByName(distinct.select(F.col("v").alias("va"), F.col("v").alias("vb")))


def near_hashes(df: DataFrame, key: str, value: str, owner: str, most: int = 8) -> DataFrame:
    """Pairs (a, b, distance) of rows of different owners whose 64-bit values differ in at most ``most`` bits; a < b by key.

    Only distinct values are searched (near_values), so frequent ones do not multiply the search.
    """
    left = df.select(F.col(key).alias("a"), F.col(value).alias("va"), F.col(owner).alias("oa"))
    right = df.select(F.col(key).alias("b"), F.col(value).alias("vb"), F.col(owner).alias("ob"))
    out = near_values(df, value, most).join(left, "va").join(right, "vb").filter("a < b and oa <> ob")
    return out.select("a", "b", hamming(F.col("va"), F.col("vb")).cast("int").alias("distance"))


def recurring(frames: DataFrame, most: int = 8, flat: float = 0.04, share: float = 0.5) -> DataFrame:
    """shot, episode, share, partners: shots of which at least ``share`` of the frames that are not flat recur elsewhere.

    frames: frame, shot, episode, hash, spread. Only frames of other episodes count; partners are their shots.
    """
    usable = frames.filter(F.col("spread") >= flat)
    pairs = near_hashes(usable, "frame", "hash", "episode", most)
    both = pairs.select(F.col("a").alias("frame"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("frame"), F.col("a").alias("other")))
    hit = both.join(usable.select(F.col("frame").alias("other"), F.col("shot").alias("partner")), "other").select("frame", "partner").distinct()
    per = usable.join(hit, "frame", "left").groupBy("shot", "episode").agg((F.count_distinct(F.when(F.col("partner").isNotNull(), F.col("frame"))) / F.count_distinct("frame")).alias("share"), F.array_sort(F.collect_set("partner")).alias("partners"))
    return per.filter(F.col("share") >= share)


def _blocks(*dfs: DataFrame, most: int = 16384, few: int = 1024) -> int:
    """Into how many blocks the largest of the tables falls if a block holds ``most`` rows, and up to eight if it has ``few`` each:
    a counted size, not a constant."""
    return max(1, *[max(-(-n // most), min(8, n // few)) for n in (df.count() for df in dfs)])


#: Rows of a block that meet the other block at once, and by how much a product of unit vectors in single precision may be off.
_TILE, _OFF = 256, 1e-4


def _unit(vectors: pd.Series) -> np.ndarray:
    e = np.stack(vectors).astype(np.float64)
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine distances of unit vectors, row by row."""
    return 1 - np.einsum("ij,ij->i", x, y)


def knn_vote(rows: DataFrame, placed: DataFrame, k: int = 3, far: float = 0.6, blocks: int | None = None) -> DataFrame:
    """id, owner: rows whose k nearest placed rows all have one owner and lie at a mean distance of at most ``far``.

    rows: id, embedding. placed: id, embedding, owner. Each block of placed rows meets each block of rows as matrices, some rows at
    a time, and yields k candidates for a row, so a row sends blocks * k candidates on, however many are placed. Products in single
    precision only leave out what cannot be among the k; the rest is compared in double precision.
    """
    blocks = blocks or _blocks(rows, placed)
    deal = lambda df: df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = deal(rows.select("id", "embedding")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # names of its own, as both sides may come from one table
    right = deal(placed.select("id", "embedding", "owner")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select(F.col("id").alias("p_id"), F.col("embedding").alias("p_embedding"), F.col("owner").alias("p_owner"), F.col("_c").alias("p_b"), F.col("_b").alias("p_c"))

    def nearest(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "owner": [], "distance": []})
        x, y = _unit(a["embedding"]), _unit(b["p_embedding"])
        x4, y4 = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
        out, own, ids, owners = [], a["id"].to_numpy(), b["p_id"].to_numpy(), b["p_owner"].to_numpy()
        shared, n = np.isin(own, ids), len(ids)
        group = min(64, n // (4 * k))
        for at in range(0, len(x), _TILE):
            s = x4[at : at + _TILE] @ y4
            for i in np.flatnonzero(shared[at : at + _TILE]):
                s[i, ids == own[at + i]] = -np.inf
            # the k-th best of the groups' best ones is no better than the k-th best of all
            best = s[:, : n // group * group].reshape(len(s), -1, group).max(2) if group > 1 else s
            least = np.partition(best, best.shape[1] - k, axis=1)[:, -k] if best.shape[1] > k else np.full(len(s), -np.inf)
            i, j = np.nonzero((s >= least[:, None] - _OFF) & (s > -np.inf))
            d = _exact(x[at + i], y[j])
            order = np.lexsort((ids[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, d = i[first], j[first], d[first]
            out.append(pd.DataFrame({"id": own[at + i], "other": ids[j], "owner": owners[j], "distance": d}))
        return pd.concat(out)

    found = left.groupBy("_b", "_c").cogroup(right.groupBy("p_b", "p_c")).applyInPandas(nearest, "id long, other long, owner long, distance double").filter("distance < double('infinity')")
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))).filter(F.col("_r") <= k)
    vote = ranked.groupBy("id").agg(F.count("*").alias("_n"), F.count_distinct("owner").alias("_o"), F.avg("distance").alias("mean"), F.min("owner").alias("owner"))
    return vote.filter((F.col("_n") == k) & (F.col("_o") == 1) & (F.col("mean") <= far)).select("id", "owner")


def close_pairs(rows: DataFrame, most: float, blocks: int | None = None) -> DataFrame:
    """(a, b, distance), a < b: pairs of rows (id, embedding) at a cosine distance of at most ``most``, block against block.

    Some rows of a block at a time meet the other one, so memory does not depend on the size of a block.
    """
    blocks = blocks or _blocks(rows)
    x = rows.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_b")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x = x.select("id", "embedding", F.col("_b").alias("_own"), F.least("_b", "_c").alias("_b"), F.greatest("_b", "_c").alias("_c"))

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        ids, own, e = g["id"].to_numpy(), g["_own"].to_numpy(), _unit(g["embedding"])
        one = own == own.min()
        left, right = np.flatnonzero(one), np.flatnonzero(~one) if not one.all() else np.arange(len(g))
        y, out = np.ascontiguousarray(e[right].astype(np.float32).T), []
        for at in range(0, len(left), _TILE):
            tile = left[at : at + _TILE]
            i, j = np.nonzero(e[tile].astype(np.float32) @ y >= 1 - most - _OFF)
            i, j = tile[i], right[j]
            if one.all():
                i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]
            d = _exact(e[i], e[j])
            i, j, d = i[d <= most], j[d <= most], d[d <= most]
            out.append(pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "distance": d}))
        return pd.concat(out)

    diagonal = x.filter("_b = _c").groupBy("_b", "_c").applyInPandas(pairs, "a long, b long, distance double")
    return diagonal.unionByName(x.filter("_b <> _c").groupBy("_b", "_c").applyInPandas(pairs, "a long, b long, distance double"))


def average_linkage(distances: np.ndarray, threshold: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Labels, by first appearance, of agglomerative clustering with average linkage, cut at a mean distance.

    The closest two groups merge until none are within the threshold; a row's nearest group is kept, so a merge looks again
    only at groups whose nearest one changed. Infinite distances never merge. Ties: the lower row, then the lower column.
    """
    n = len(distances)
    d = np.array(distances, np.float64)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if weights is None else np.array(weights, np.float64)
    group, near = np.arange(n), d.argmin(1) if n else np.zeros(0, int)
    least = d[np.arange(n), near] if n else np.zeros(0)
    while n:
        a = int(least.argmin())
        if not least[a] <= threshold:
            break
        a, b = sorted((a, int(near[a])))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        row[[a, b]] = np.inf
        d[a], d[:, a], d[b], d[:, b] = row, row, np.inf, np.inf
        size[a] += size[b]
        group[group == b] = a
        least[b] = np.inf
        for k in {a, *np.flatnonzero((near == a) | (near == b)).tolist()} - {b}:
            near[k] = d[k].argmin()
            least[k] = d[k, near[k]]
        better = row < least
        near[better], least[better] = a, row[better]
    _, first, labels = np.unique(group, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[labels]


def vector_linkage(e: np.ndarray, threshold: float) -> np.ndarray:
    """average_linkage() of the cosine distances of unit vectors, in memory of their own size instead of its square.

    The mean distance of two groups is 1 - <sum a, sum b> / (size a * size b), so sums take the place of distances. A merge never
    brings a third group nearer than its two parts were, so what a row knew of its nearest group stays a lower bound: it is looked
    up again only if it is the least of all. Groups without a partner within the threshold never get one and leave.
    """
    n = len(e)
    label, at, s, size = np.arange(n), np.arange(n), np.array(e, np.float64), np.ones(n)
    near, least, stale = np.zeros(n, int), np.full(n, np.inf), np.zeros(n, bool)
    single = e.astype(np.float32)
    for i in range(0, n, _TILE):
        d = 1 - single[i : i + _TILE] @ single.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        # in double precision among those that may be the nearest
        r, c = np.nonzero(d <= d.min(1, keepdims=True) + _OFF)
        exact = np.maximum(_exact(s[i + r], s[c]), 0)
        order = np.lexsort((c, exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.unique(r, return_index=True)[1]
        near[i + r[first]], least[i + r[first]] = c[first], exact[first]
    live = n
    while live > 1:
        a = int(least.argmin())
        if not least[a] <= threshold:
            break
        if stale[a]:
            d = np.maximum(1 - (s @ s[a]) / (np.maximum(size, 1) * size[a]), 0)
            d[(size == 0) | (np.arange(len(d)) == a)] = np.inf
            near[a] = d.argmin()
            # not below what was known: sums are rounded
            least[a], stale[a] = max(d[near[a]], least[a]), False
            continue
        a, b = sorted((a, int(near[a])))
        label[at[b]] = at[a]
        s[a] += s[b]
        size[a] += size[b]
        s[b], size[b], least[b], stale[b] = 0, 0, np.inf, False
        least[a] = min(least[a], threshold)
        stale[a] = True
        stale |= ((near == a) | (near == b)) & (size > 0)
        live -= 1
        if live < 0.8 * len(s):
            kept = (size > 0) & (least <= threshold)
            live = int(kept.sum())
            where = np.cumsum(kept) - 1
            # one whose nearest group has left looks again
            stale = (stale | ~kept[near])[kept]
            near, at, s, size, least = where[near][kept], at[kept], s[kept], size[kept], least[kept]
    while (label != label[label]).any():
        label = label[label]
    _, first, labels = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[labels]


def cluster(rows: DataFrame, partition: str, threshold: float, distance: str = "cosine") -> DataFrame:
    """partition, id, label: average linkage of the rows (id, embedding) of each partition, the unit that fits in a task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        return pd.DataFrame({partition: g[partition], "id": g["id"], "label": vector_linkage(_unit(g["embedding"]), threshold * 2 if distance == "halved" else threshold)})

    return rows.select(partition, "id", "embedding").groupBy(partition).applyInPandas(run, f"{partition} {dict(rows.dtypes)[partition]}, id long, label long")


def suppressed(boxes: DataFrame, frame: str, iou: float = 0.7) -> DataFrame:
    """boxes without those that overlap a better one (greater score, then lower id) of their frame by more than ``iou``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True])
        x0, y0, x1, y1 = (g[c].to_numpy(np.float64) for c in ("x0", "y0", "x1", "y1"))
        area, kept = (x1 - x0) * (y1 - y0), []
        for i in range(len(g)):
            k = np.array(kept, int)
            shared = np.clip(np.minimum(x1[k], x1[i]) - np.maximum(x0[k], x0[i]), 0, None) * np.clip(np.minimum(y1[k], y1[i]) - np.maximum(y0[k], y0[i]), 0, None)
            if not (shared / np.maximum(area[k] + area[i] - shared, 1e-9) > iou).any():
                kept.append(i)
        return g.iloc[kept]

    return boxes.groupBy(frame).applyInPandas(run, boxes.schema)


_k, _x = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
_DCT = np.sqrt(2 / 32) * np.where(_k == 0, np.sqrt(0.5), 1) * np.cos((2 * _x + 1) * _k * np.pi / 64)


def perceptual_hashes(rows: DataFrame, pixels: str) -> DataFrame:
    """rows with hash (64 bits, from the low frequencies of a 32 x 32 grey picture) and spread (deviation / 255)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", hash long, spread double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            p = np.stack(g[pixels]).astype(np.float64).reshape(-1, 32, 32) if len(g) else np.zeros((0, 32, 32))
            low = (_DCT @ p @ _DCT.T)[:, :8, :8].reshape(-1, 64)
            bits = low > np.median(low[:, 1:], axis=1, keepdims=True) if len(g) else np.zeros((0, 64), bool)
            yield g.assign(hash=np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel(), spread=p.std(axis=(1, 2)) / 255)

    return rows.mapInPandas(run, schema)


def doubtful(faces: DataFrame, target: int, limit: int = 12) -> DataFrame:
    """shot, own, other, margin: the shots of a named cluster that look least like it.

    faces: id, shot, cluster, embedding, of named clusters. own: mean difference to the cluster's faces in other shots; other:
    the least mean difference to another named cluster. Means over sums of unit vectors: no pairs of faces are made.
    """
    unit = faces.withColumn("u", F.transform("embedding", lambda v: v / norm(F.col("embedding"))))
    summed = lambda df, *keys: df.select(*keys, F.posexplode("u").alias("p", "v")).groupBy(*keys, "p").agg(F.sum("v").alias("v")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("sum"))
    mine = unit.filter(F.col("cluster") == target)
    shots = summed(mine, "shot").join(mine.groupBy("shot").agg(F.count("*").alias("n")), "shot")
    totals = summed(unit, "cluster").join(unit.groupBy("cluster").agg(F.count("*").alias("m")), "cluster")
    # each shot meets each named cluster, by a list of the clusters' sums (a row each) that goes along
    each = F.explode(totals.agg(F.collect_list(F.struct("cluster", F.col("sum").alias("total"), "m"))).scalar())
    pairs = shots.withColumn("_each", each).select("shot", "sum", "n", "_each.*")
    rest = F.when(F.col("cluster") == target, F.zip_with("total", "sum", lambda a, b: a - b)).otherwise(F.col("total"))
    size = F.when(F.col("cluster") == target, F.col("m") - F.col("n")).otherwise(F.col("m"))
    x = pairs.withColumns({"_rest": rest, "_size": size}).filter("_size > 0").withColumn("d", (1 - dot(F.col("sum"), F.col("_rest")) / (F.col("n") * F.col("_size"))) / 2)
    out = x.groupBy("shot").agg(F.min(F.when(F.col("cluster") == target, F.col("d"))).alias("own"), F.min(F.when(F.col("cluster") != target, F.col("d"))).alias("other"))
    return out.filter("own is not null and other is not null").withColumn("margin", F.col("other") - F.col("own")).orderBy("margin", "shot").limit(limit)


def gathered(rows: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Vectors of the ids, in their order (place from 0)."""
    wanted = rows.sparkSession.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "place int, id long")
    return rows.join(F.broadcast(wanted), "id").orderBy("place")
