"""Every operator of the library applied to the driver's tables, each with the SQL that gives the same rows.

Stand-ins: an episode is a user, a frame is an event, a shot is a session of events, a line is a click or view that lasts some
minutes, parts are signup and error events with a length, framewise series are orders with their lines in order, bit hashes and
faces come from embeddings. Times are whole microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .functions import scalars, sound
from .operators import intervals as iv
from .operators import library as lib
from .operators import overrides, speakers, stages
from .operators import sequences as seq
from .operators import song
from .operators import vectors as vec
from .plans import plans
from .sources import texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR = 3_600_000_000
GAP = 6 * HOUR


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames(spark, d):
    e = _table(spark, d, "events")
    return e.select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("episode"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("tag"), F.col("value").alias("score"), (F.col("event_id") % 7).alias("cluster_id"))


def placed(spark, d):
    return seq.sessions(frames(spark, d), ["episode"], "t", GAP, "frame_id")


def shots(spark, d):
    return placed(spark, d).groupBy("episode", "idx").agg(F.min("t").alias("start"), (F.max("t") + 1_000_000).alias("end"), F.count("*").alias("n"))


def lines(spark, d):
    f = frames(spark, d).filter(F.col("tag").isin("click", "view"))
    return f.select("episode", F.col("frame_id").alias("line_id"), F.col("t").alias("start"), (F.col("t") + F.floor(F.col("score") * 6e7)).alias("end"), F.col("tag").alias("kind"))


def parts(spark, d):
    f = frames(spark, d).filter(F.col("tag").isin("signup", "error"))
    length = F.when(F.col("tag") == "signup", HOUR).otherwise(HOUR // 2)
    return f.select("episode", F.when(F.col("tag") == "signup", "op").otherwise("ed").alias("kind"), F.col("t").alias("p_start"), (F.col("t") + length).alias("p_end"))


def faces(spark, d):
    f = placed(spark, d)
    return f.select("episode", "idx", "frame_id", F.when(F.col("cluster_id") > 0, F.col("cluster_id")).alias("cluster_id"), F.lit(0.0).alias("x0"), (F.col("frame_id") % 10 / 10).alias("x1"), F.lit(0.0).alias("y0"), (F.col("frame_id") % 97 / 97).alias("y1"))


def clusters(spark, d):
    return spark.range(1, 7).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("c"), F.col("id").cast("string"))).alias("name"))


def series(spark, d):
    li = _table(spark, d, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return li.select(F.col("l_suppkey").alias("series"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("l_quantity").alias("v"))


FRAMES = "frames as (select event_id as frame_id, user_id as episode, epoch_us(ts) as t, event_type as tag, value as score, event_id % 7 as cluster_id from events)"
PLACED = FRAMES + f""", placed as (select *, cast(sum(fresh) over (partition by episode order by t, frame_id rows unbounded preceding) as bigint) as idx
 from (select *, case when t - lag(t) over (partition by episode order by t, frame_id) <= {GAP} then 0 else 1 end as fresh from frames))"""
SHOTS = PLACED + """, shots as (select episode, idx, min(t) as start, max(t) + 1000000 as "end", count(*) as n from placed group by episode, idx)"""
LINES = """, lines as (select episode, frame_id as line_id, t as start, t + cast(floor(score * 6e7) as bigint) as "end", tag as kind from frames where tag in ('click', 'view'))"""
PARTS = f""", parts as (select episode, case tag when 'signup' then 'op' else 'ed' end as kind, t as p_start, t + case tag when 'signup' then {HOUR} else {HOUR // 2} end as p_end from frames where tag in ('signup', 'error'))"""
FACES = """, faces as (select episode, idx, frame_id, case when cluster_id > 0 then cluster_id end as cluster_id, frame_id % 10 / 10 as w, frame_id % 97 / 97 as h from placed)"""
CAST = FACES + """, cast_ as (select episode, idx, cluster_id, count(distinct frame_id) / any_value(n) as presence, max(h) as height, avg(h * w) as area
 from faces join (select episode, idx, count(*) as n from placed group by all) using (episode, idx) where cluster_id is not null group by episode, idx, cluster_id)"""
MERGED = """, merged as (select episode, min(start) as start, max("end") as "end" from (select *, sum(fresh) over (partition by episode order by start, "end" rows unbounded preceding) as island
 from (select *, case when start - max("end") over (partition by episode order by start, "end" rows between unbounded preceding and 1 preceding) < 0 then 0 else 1 end as fresh from lines)) group by episode, island)"""
SERIES = "series as (select l_suppkey as series, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) - 1 as i, l_quantity as v from lineitem)"


@query(f"with {SHOTS} select * from shots")
def q_shots_sessionize(spark, d):
    return shots(spark, d)


@query(f"""with recursive {FRAMES}, r as (select *, row_number() over (partition by episode order by t, frame_id) as rn, lag(t) over (partition by episode order by t, frame_id) as p from frames),
walk as (select episode, rn, t, t as s, 1 as k from r where rn = 1 union all
 select r.episode, r.rn, r.t, case when r.t - r.p > {GAP} or r.t - w.s > {12 * HOUR} then r.t else w.s end, case when r.t - r.p > {GAP} or r.t - w.s > {12 * HOUR} then w.k + 1 else w.k end
 from walk w join r on r.episode = w.episode and r.rn = w.rn + 1)
select episode, min(t) as start, max(t) as "end", count(*) as n from walk group by episode, k""")
def q_scene_cap(spark, d):
    f = frames(spark, d).withColumns({"start": F.col("t"), "end": F.col("t")})
    return seq.capped_sessions(f, ["episode"], "start", "end", GAP, 12 * HOUR, "frame_id").select("episode", "start", "end", "n")


STATUS = """, status as (select episode, idx, case when bool_or(score >= 150) then 'dropped' else 'kept' end as status from placed group by episode, idx)"""


@query(f"with {PLACED}{STATUS} select * from status")
def q_status_any_unsafe(spark, d):
    return lib.shot_status(placed(spark, d), ["episode", "idx"], F.col("score") >= 150)


@query(f"""with {PLACED}{STATUS} select e.episode, v.status, count(s.idx) as n from (select distinct episode from frames) e cross join (values ('pending'), ('kept'), ('dropped')) v(status)
left join status s on s.episode = e.episode and s.status = v.status group by all""")
def q_status_counts_zero_fill(spark, d):
    return lib.counts_filled(q_status_any_unsafe(spark, d), ["episode"], "status", ["pending", "kept", "dropped"])


def _cast(spark, d):
    return lib.shot_cast(faces(spark, d), placed(spark, d), ["episode", "idx"])


@query(f"with {PLACED}{CAST} select episode, idx, cluster_id, presence, height, round(area, 9) as area from cast_")
def q_shot_cast(spark, d):
    return _cast(spark, d).withColumn("area", F.round("area", 9))


NAMED = """, named as (select episode, idx, cluster_id, 'c' || cluster_id as name, presence, height, row_number() over (partition by episode, idx order by presence desc, cluster_id) as rank from cast_ where cluster_id % 2 = 0)"""


@query(f"with {PLACED}{CAST}{NAMED} select episode, idx, name, presence, rank from named")
def q_named_cast_rank(spark, d):
    x = lib.named_cast(_cast(spark, d), clusters(spark, d), ["episode", "idx"])
    return x.select("episode", "idx", "name", "presence", F.col("rank").cast("long").alias("rank"))


@query(f"""with {SHOTS}{LINES} select s.episode, s.idx, l.line_id from shots s join lines l on l.episode = s.episode and l.start < s."end" and l."end" > s.start""")
def q_overlap_join(spark, d):
    right = lines(spark, d).select("episode", "line_id", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    return iv.overlap_join(shots(spark, d), right, ["episode"], ("start", "end", "l_start", "l_end"), GAP).select("episode", "idx", "line_id")


@query(f"""with {SHOTS}{PARTS} select s.episode, s.idx, arg_max(p.kind, (p.p_start, p.kind)) as kind from shots s join parts p on p.episode = s.episode and p.p_start < s."end" and p.p_end > s.start group by s.episode, s.idx""")
def q_parts_overlap(spark, d):
    x = iv.overlap_join(shots(spark, d), parts(spark, d), ["episode"], ("start", "end", "p_start", "p_end"), GAP)
    return x.groupBy("episode", "idx").agg(F.max_by("kind", F.struct("p_start", "kind")).alias("kind"))


@query(f"""with {SHOTS}{LINES} select l.episode, l.line_id from lines l where exists (select 1 from shots s where s.episode = l.episode and s.start <= l.start and l."end" <= s."end")""")
def q_contains_join(spark, d):
    right = shots(spark, d).select("episode", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return iv.contained(lines(spark, d), right, ["episode"], ("start", "end", "s_start", "s_end"), GAP, eps=0).select("episode", "line_id")


@query(f"with {FRAMES}{LINES}{MERGED} select * from merged")
def q_interval_merge(spark, d):
    return iv.merged(lines(spark, d), ["episode"], "start", "end")


@query(f"""with {FRAMES}{LINES}{MERGED}, b as (select episode, min(t) as lo, max(t) + {HOUR} as hi from frames group by episode),
m as (select m.episode, greatest(start, lo) as start, least("end", hi) as "end" from merged m join b using (episode) where start < hi and "end" > lo),
g as (select episode, lo as a, coalesce((select min(start) from m where m.episode = b.episode), hi) as z from b
 union all select m.episode, m."end", coalesce(lead(m.start) over (partition by m.episode order by m.start), b.hi) from m join b on b.episode = m.episode)
select episode, a as start, z as "end" from g where z - a >= {HOUR} and z > a""")
def q_interval_gaps(spark, d):
    bounds = frames(spark, d).groupBy("episode").agg(F.min("t").alias("lo"), (F.max("t") + HOUR).alias("hi"))
    return iv.complement(q_interval_merge(spark, d), bounds, ["episode"], "start", "end", HOUR).drop("place")


@query(f"""with {SHOTS}{LINES}{MERGED} select s.episode, s.idx, cast(sum(least(s."end", m."end") - greatest(s.start, m.start)) as bigint) as sung from shots s join merged m on m.episode = s.episode and m.start < s."end" and m."end" > s.start group by s.episode, s.idx""")
def q_sung_overlap(spark, d):
    right = q_interval_merge(spark, d).select("episode", F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    x = iv.overlap_join(shots(spark, d), right, ["episode"], ("start", "end", "m_start", "m_end"), GAP)
    return x.groupBy("episode", "idx").agg(F.sum(iv.overlap(F.col("start"), F.col("end"), F.col("m_start"), F.col("m_end"))).alias("sung"))


@query(f"""with {FRAMES} select v.frame_id, arg_min(p.t, abs(p.t - v.t) * 10 + case when p.t > v.t then 1 else 0 end) as nearest from frames v left join frames p on p.episode = v.episode and p.tag = 'purchase' where v.tag = 'view' group by v.frame_id""")
def q_nearest_asof(spark, d):
    f = frames(spark, d)
    grid = f.filter("tag = 'purchase'").select("episode", F.col("t").alias("g"))
    return iv.nearest(f.filter("tag = 'view'").select("episode", "frame_id", "t"), grid, ["episode"], "t", "g").select("frame_id", "nearest")


@query(f"with {FRAMES} select tag, max(score) as peak, count(*) / (select count(*) from frames) as share from frames group by tag")
def q_tag_stats(spark, d):
    f = frames(spark, d)
    return lib.tag_stats(f, f)


@query(f"""with {PLACED}, s as (select episode, idx, tag, sum(score) as total from placed group by all), n as (select episode, idx, count(*) as n from placed group by all),
r as (select *, row_number() over (partition by episode, idx order by total desc, tag) as rank from s) select episode, idx, tag, round(total / n, 6) as mean, rank from r join n using (episode, idx) where rank <= 3""")
def q_shot_tags_topk(spark, d):
    p = placed(spark, d)
    return lib.top_tags(p, p, ["episode", "idx"], 3).select("episode", "idx", "tag", F.round("mean", 6).alias("mean"), F.col("rank").cast("long").alias("rank"))


@query(f"with {FRAMES} select frame_id, case when tag in ('view', 'click') then tag end as tag, case when tag in ('view', 'click') then score end as score from frames")
def q_tag_map(spark, d):
    f = frames(spark, d)
    return lib.tag_maps(f, f, ["view", "click"]).select("frame_id", F.explode_outer("scores").alias("tag", "score"))


@query(f"""with {PLACED}{FACES} select episode, cluster_id, arg_max(frame_id, (h, -frame_id)) as frame_id, arg_max(w / 2, (h, -frame_id)) as cx from faces where cluster_id is not null group by all""")
def q_largest_per_group(spark, d):
    f = faces(spark, d).filter("cluster_id is not null").withColumns({"h": F.col("y1") - F.col("y0"), "cx": F.col("x1") / 2})
    return lib.largest(f, ["episode", "cluster_id"], "h", "frame_id", ["cx"]).select("episode", "cluster_id", "frame_id", "cx")


@query(f"""with {PLACED}{FACES}, one as (select cluster_id, episode, idx, arg_max(frame_id, (h * w, -frame_id)) as frame_id, max(h * w) as area from faces where cluster_id is not null group by all),
r as (select cluster_id, frame_id, row_number() over (partition by cluster_id order by area desc, frame_id) as rank from one) select * from r where rank <= 8""")
def q_samples_topk(spark, d):
    f = faces(spark, d).filter("cluster_id is not null").withColumn("area", F.col("y1") * F.col("x1"))
    return lib.samples(f, ["cluster_id"], ["episode", "idx"], "area", "frame_id").select("cluster_id", "frame_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {PLACED}, solo as (select *, count(*) over (partition by episode, idx) as n from placed), a as (select * from solo where n = 1 and cluster_id > 0), t as (select cluster_id, count(*) as total from a group by 1),
c as (select cluster_id, tag, count(*) as n from a group by all), r as (select cluster_id, tag, n / total as share, row_number() over (partition by cluster_id order by n desc, tag) as rank from c join t using (cluster_id)) select * from r where rank <= 3""")
def q_solo_tag_hints(spark, d):
    p = placed(spark, d).withColumn("shot", F.struct("episode", "idx"))
    f = p.select(F.col("shot").alias("frame_id"), F.when(F.col("cluster_id") > 0, F.col("cluster_id")).alias("cluster_id"))
    out = lib.solo_hints(f, p.select(F.col("shot").alias("frame_id"), "tag"))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {SERIES}, x as (select *, v > 40 as hot, max(i) over (partition by series) as last, bool_and(v > 40) over (partition by series) as flat from series),
r as (select *, i - row_number() over (partition by series, hot order by i) as g from x), s as (select series, hot, g, min(i) as start, max(i) + 1 as z, any_value(last) as last, any_value(flat) as flat from r group by series, hot, g)
select series, start, case when z <= last then z + 1 else z end as "end" from s where not hot or flat""")
def q_threshold_segments(spark, d):
    return seq.threshold_segments(series(spark, d), ["series"], "i", "v", 40)


@query(f"with {SERIES} select series, i, v from (select *, lag(v) over (partition by series order by i) as p from series) where v >= 25 and p < 25")
def q_rising_edges(spark, d):
    return seq.rising_edges(series(spark, d), ["series"], "i", "v", 25)


@query(f"""with {SERIES}, p as (select * from (select *, max(v) over (partition by series order by i rows between 3 preceding and 3 following) as top from series) where v = top and v > 0),
g as (select *, i - row_number() over (partition by series order by i) as g from p) select series, avg(i) as i, max(v) as v from g group by series, g""")
def q_local_maxima(spark, d):
    return seq.peaks(series(spark, d), ["series"], "i", "v")


@query(f"""with {SERIES}, x as (select *, max(case when v >= 45 then 1 else 0 end) over (partition by series order by i rows between 6 preceding and 1 preceding) as before, max(v) over (partition by series order by i rows between current row and 11 following) as strength from series)
select series, i, strength from x where v >= 45 and i >= 6 and before = 0""")
def q_onsets(spark, d):
    return seq.onsets(series(spark, d), ["series"], "i", "v", 45).select("series", "i", "strength")


@query(f"""with {SERIES}, l as (select * from (select *, max(v) over (partition by series) as top from series) where v >= top - 5), f as (select *, case when i - lag(i) over (partition by series order by i) - 1 <= 6 then 0 else 1 end as fresh from l),
g as (select *, sum(fresh) over (partition by series order by i rows unbounded preceding) as g from f) select series, min(i) as start, max(i) + 1 as "end" from g group by series, g""")
def q_voice_runs(spark, d):
    return seq.loud_runs(series(spark, d), ["series"], "i", "v", 5, 6)


@query(f"""with {SERIES}, n as (select series, count(*) as n from series group by 1), k as (select series, n, cast(floor(k * n / 10) as bigint) as i from n, range(10) t(k) where n > 10 union select series, n, i from series join n using (series) where n <= 10)
select s.series, s.i from series s join k on k.series = s.series and k.i = s.i""")
def q_systematic_sample(spark, d):
    return seq.evenly_spaced(series(spark, d), ["series"], ["i"], 10).select("series", "i")


@query("""with o as (select o_orderkey, o_orderkey % 100 as s, o_orderkey % 100 + 1 + o_custkey % 90 as e from orders), c as (select *, least(greatest(ceil((e - s) / 24.0 / 0.5), 3), e - s)::bigint as n from o)
select distinct o_orderkey, s + ((2 * k + 1) * (e - s)) // (2 * n) as frame from c, range(400) t(k) where k < n""")
def q_frame_sampling(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("s"), (F.col("o_orderkey") % 100 + 1 + F.col("o_custkey") % 90).alias("e"))
    return seq.sample_frames(o, "s", "e", 24).select("o_orderkey", "frame")


@query(f"""with {SHOTS} select s.episode, s.idx as bar, round(avg(f.score), 6) as score, count(*) as n from shots s join frames f on f.episode = s.episode and f.t >= s.start and f.t < s."end" group by all""")
def q_per_bar_mean(spark, d):
    bars = shots(spark, d).select("episode", F.col("idx").alias("bar"), "start", "end")
    return seq.bucketed_mean(frames(spark, d), bars, ["episode"], "t", "score").withColumnRenamed("score", "v").select("episode", "bar", F.round("v", 6).alias("score"), "n")


@query(f"""with {FRAMES}, b as (select episode, t, row_number() over (partition by episode order by t) - 1 as i from frames), d as (select episode, i % 4 as phase, count(*) as n, min(t) as first from b join (select frame_id, episode, t from frames where tag = 'purchase') using (episode, t) group by all)
select episode, arg_max(phase, (n, -first)) as phase from d group by episode""")
def q_bar_phase_mode(spark, d):
    f = frames(spark, d).select("episode", "t", "tag")
    first = song.bar_grid(f, f.filter("tag = 'purchase'"), "episode").filter("bar = 0").select("episode", "start")
    # a phase is the place of the first bar among the beats
    before = f.join(first, "episode").filter("t < start").groupBy("episode").agg(F.count("*").alias("phase"))
    told = f.filter("tag = 'purchase'").select("episode").distinct()
    return told.join(before, "episode", "left").select("episode", F.coalesce("phase", F.lit(0)).alias("phase"))


@query(f"""with {FRAMES}, x as (select *, row_number() over (partition by episode order by t, frame_id) - row_number() over (partition by episode, tag order by t, frame_id) as g from frames)
select episode, min(t) as t, tag, count(*) as size, round(avg(score), 6) as score from x group by episode, tag, g""")
def q_merge_runs(spark, d):
    f = frames(spark, d).withColumn("size", F.lit(1).cast("long"))
    return seq.merge_runs(f, ["episode"], "t", "tag", "size", ["score"]).withColumn("score", F.round("score", 6))


@query(f"""with {FRAMES}, m as (select *, case when tag in ('signup', 'error') then tag end as mark from frames), w as (select *, lag(mark) over (partition by episode order by t, frame_id) as b, lead(mark) over (partition by episode order by t, frame_id) as a from m)
select frame_id, coalesce(mark, case when a = b then b end) as filled from w""")
def q_neighbour_fill(spark, d):
    m = frames(spark, d).withColumn("mark", F.when(F.col("tag").isin("signup", "error"), F.col("tag")))
    return seq.neighbour_fill(m, ["episode"], ["t", "frame_id"], "mark").select("frame_id", "filled")


def _hashes(spark, d):
    e = _table(spark, d, "embeddings")
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0).cast("long")))
    return e.select(F.col("vec_id").alias("frame"), F.floor(F.col("vec_id") / 10).alias("shot"), (F.col("vec_id") % 5).cast("long").alias("episode"), bits.alias("hash"), F.lit(1.0).alias("spread"))


HASHES = """bits as (select vec_id, list_sum(list_transform(range(64), lambda k: case when embedding[k + 1] > 0 then 1::hugeint << (63 - k) else 0::hugeint end)) as u from embeddings),
hashes as (select vec_id as frame, vec_id // 10 as shot, vec_id % 5 as episode, cast(case when u >= 1::hugeint << 63 then u - (1::hugeint << 64) else u end as bigint) as hash from bits)"""


@query(f"with {HASHES} select a.frame as a, b.frame as b, cast(bit_count(xor(a.hash, b.hash)) as integer) as distance from hashes a join hashes b on a.frame < b.frame and a.episode <> b.episode where bit_count(xor(a.hash, b.hash)) <= 8")
def q_hamming_dupes(spark, d):
    return vec.near_hashes(_hashes(spark, d), "frame", "hash", "episode", 8)


@query(f"""with {HASHES}, hit as (select distinct a.frame, b.shot as partner from hashes a join hashes b on a.episode <> b.episode and bit_count(xor(a.hash, b.hash)) <= 8)
select h.shot, h.episode, count(distinct hit.frame) / count(distinct h.frame) as share, count(distinct partner) as partners from hashes h left join hit using (frame) group by h.shot, h.episode having count(distinct hit.frame) / count(distinct h.frame) >= 0.5""")
def q_recurring_share(spark, d):
    return vec.recurring(_hashes(spark, d), most=8).select("shot", "episode", "share", F.size("partners").cast("long").alias("partners"))


@query("select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id < b.vec_id where 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]) <= 0.6")
def q_cosine_pairs(spark, d):
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vec.close_pairs(e, 0.6).select("a", "b")


@query("""with q as (select * from embeddings), p as (select * from embeddings), r as (select q.vec_id as id, p.label as owner, 1 - list_cosine_similarity(q.embedding::double[], p.embedding::double[]) as dist, row_number() over (partition by q.vec_id order by 1 - list_cosine_similarity(q.embedding::double[], p.embedding::double[]), p.vec_id) as k from q, p where q.vec_id <> p.vec_id)
select id, min(owner)::bigint as owner from r where k <= 3 group by id having count(distinct owner) = 1 and avg(dist) <= 0.9""")
def q_knn_vote(spark, d):
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("owner"))
    return vec.knn_vote(e, e, 3, 0.9)


@query("""with f as (select vec_id as id, vec_id % 30 as shot, label as cluster, list_transform(embedding::double[], lambda v: v / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u from embeddings),
p as (select a.shot, b.cluster, avg((1 - list_dot_product(a.u, b.u)) / 2) as d from f a join f b on a.cluster = 3 and (b.cluster <> 3 or b.shot <> a.shot) group by all),
m as (select shot, min(d) filter (cluster = 3) as own, min(d) filter (cluster <> 3) as other from p group by shot)
select shot, round(own, 6) as own, round(other, 6) as other from (select *, row_number() over (order by other - own, shot) as r from m where own is not null and other is not null) where r <= 12""")
def q_doubtful(spark, d):
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 30).alias("shot"), F.col("label").cast("long").alias("cluster"), "embedding")
    return vec.doubtful(e, 3).select("shot", F.round("own", 6).alias("own"), F.round("other", 6).alias("other"))


@query()
def q_upgma_labels(spark, d):
    e = _table(spark, d, "embeddings").select(F.col("label").cast("long").alias("part"), F.col("vec_id").alias("id"), "embedding")
    return vec.cluster(e, "part", 0.8)


@query(f"""with recursive {PLACED}{FACES}, f as (select episode, frame_id as id, w, h, frame_id % 89 / 89 as score, row_number() over (partition by episode order by frame_id % 89 / 89 desc, frame_id) as k from faces where w > 0 and h > 0),
r as (select distinct episode, 0::bigint as k, []::struct(id bigint, w double, h double)[] as kept from f union all
 select f.episode, f.k, case when len(list_filter(kept, lambda b: least(b.w, f.w) * least(b.h, f.h) / greatest(b.w * b.h + f.w * f.h - least(b.w, f.w) * least(b.h, f.h), 1e-9) > 0.7)) > 0 then kept else list_append(kept, {{'id': f.id, 'w': f.w, 'h': f.h}}) end from r join f on f.episode = r.episode and f.k = r.k + 1),
b as (select episode, unnest(arg_max(kept, k)) as b from r group by episode)
select f.episode, f.id, 0.0::double as x0, 0.0::double as y0, f.w as x1, f.h as y1, f.score from b join f on f.episode = b.episode and f.id = b.b.id""")
def q_nms(spark, d):
    f = faces(spark, d).select("episode", F.col("frame_id").alias("id"), "x0", "y0", F.col("x1"), F.col("y1"), (F.col("frame_id") % 89 / 89).alias("score")).filter("x1 > 0 and y1 > 0")
    return vec.suppressed(f, "episode")


ONSCREEN = """, weights as (select l.line_id, c.name, sum((least(l."end", s."end") - greatest(l.start, s.start)) / (l."end" - l.start) * c.presence) as weight
 from lines l join shots s on s.episode = l.episode and s.start < l."end" and s."end" > l.start join named c on c.episode = s.episode and c.idx = s.idx group by all)"""


def _weights(spark, d):
    named = lib.named_cast(_cast(spark, d), clusters(spark, d), ["episode", "idx"])
    s = shots(spark, d).select("episode", "idx", F.col("start").alias("shot_start"), F.col("end").alias("shot_end"))
    return speakers.on_screen(lines(spark, d), s.join(named, ["episode", "idx"]), GAP)


@query(f"with {SHOTS}{LINES}{CAST}{NAMED}{ONSCREEN} select line_id, name, round(weight, 6) as weight from weights")
def q_on_screen_weight(spark, d):
    return _weights(spark, d).withColumn("weight", F.round("weight", 6))


MATCH = """, members as (select line_id, line_id % 5 as speaker from lines), n as (select speaker, count(*) as lines from members group by 1), s as (select speaker, name, sum(weight) as w from weights join members using (line_id) group by all),
base as (select name, sum(w) / (select count(*) from members) as base from s group by name), matches as (select speaker, name, w / lines as share, w / lines / base as lift, lines from s join n using (speaker) join base using (name) where w > 0)"""


def _members(spark, d):
    return lines(spark, d).select("line_id", (F.col("line_id") % 5).alias("speaker"))


@query(f"with {SHOTS}{LINES}{CAST}{NAMED}{ONSCREEN}{MATCH} select speaker, name, round(share, 6) as share, round(lift, 6) as lift from matches")
def q_match_lift(spark, d):
    m = speakers.matches(_weights(spark, d), _members(spark, d))
    return m.select("speaker", "name", F.round("share", 6).alias("share"), F.round("lift", 6).alias("lift"))


SEEDS = """, entries as (select s.episode, s.idx, s.start, s."end", count(*) filter (presence >= 0.1) as n, max(case when presence >= 0.1 and cluster_id % 2 = 0 then 'c' || cluster_id end) as name, max(presence) filter (presence >= 0.1) as p, max(height) filter (presence >= 0.1) as h
 from shots s left join cast_ c using (episode, idx) group by all), over_ as (select l.line_id, l.start, l."end", bool_and(coalesce(n = 1 and name is not null and h >= 0.2 and p >= 0.3, false)) as good, count(distinct name) as names, min(name) as name, sum(least(l."end", e."end") - greatest(l.start, e.start)) as shared
 from lines l join entries e on e.episode = l.episode and e.start < l."end" and e."end" > l.start group by l.line_id, l.start, l."end"), seeds as (select line_id, name from over_ where good and names = 1 and shared >= 0.05 * ("end" - start))"""


def _seeds(spark, d):
    cast = shots(spark, d).join(_cast(spark, d), ["episode", "idx"], "left").join(clusters(spark, d).withColumnRenamed("id", "cluster_id"), "cluster_id", "left")
    cast = cast.select("episode", F.col("idx").alias("shot"), F.col("start").alias("shot_start"), F.col("end").alias("shot_end"), "name", "presence", "height")
    return speakers.seeds(lines(spark, d), cast, GAP, present=0.1, close=0.3, covered=0.05)


@query(f"with {SHOTS}{LINES}{CAST}{SEEDS} select line_id, name from seeds")
def q_seed_votes(spark, d):
    return _seeds(spark, d)


@query(f"""with {SHOTS}{LINES}{CAST}{NAMED}{ONSCREEN}{MATCH}{SEEDS}, votes as (select speaker, name, count(*) as n from seeds join members using (line_id) group by all), top as (select speaker, max((n, name)) as t, sum(n) as total from votes group by speaker),
best as (select speaker, arg_max(name, (share * ln(greatest(lift, 1e-6)), name)) as name, arg_max(share, (share * ln(greatest(lift, 1e-6)), name)) as share, arg_max(lift, (share * ln(greatest(lift, 1e-6)), name)) as lift, any_value(lines) as lines from matches group by speaker)
select speaker, coalesce(case when t[1] >= 2 and t[1] >= 0.3 * total then t[2] end, case when lines >= 3 and share >= 0.01 and lift >= 1.0 then b.name end) as name from top full join best b using (speaker) where coalesce(case when t[1] >= 2 and t[1] >= 0.3 * total then t[2] end, case when lines >= 3 and share >= 0.01 and lift >= 1.0 then b.name end) is not null""")
def q_suggestion(spark, d):
    votes = _seeds(spark, d).join(_members(spark, d), "line_id").groupBy("speaker", "name").agg(F.count("*").alias("n"))
    return speakers.suggestions(votes, speakers.matches(_weights(spark, d), _members(spark, d)), majority=0.3, share=0.01, lift=1.0)


def _fixes(spark, d):
    f = placed(spark, d).filter("frame_id % 50 = 3 and cluster_id > 0")
    return f.groupBy("episode", "idx").agg(F.min("cluster_id").alias("from_cluster")).withColumns({"shot_id": F.col("episode") * 1000 + F.col("idx"), "to_cluster": F.when(F.col("from_cluster") < 6, F.col("from_cluster") + 1)}).select("shot_id", "from_cluster", "to_cluster")


@query(f"""with {PLACED}, fix as (select episode, idx, min(cluster_id) as f from placed where frame_id % 50 = 3 and cluster_id > 0 group by all)
select frame_id, case when fix.f is not null then case when f < 6 then f + 1 end else cluster_id end as cluster_id from placed p left join fix on fix.episode = p.episode and fix.idx = p.idx and fix.f = p.cluster_id""")
def q_overrides_apply(spark, d):
    f = placed(spark, d).withColumn("shot_id", F.col("episode") * 1000 + F.col("idx"))
    return overrides.apply_fixes(f, _fixes(spark, d)).select("frame_id", "cluster_id")


@query("""with c(id, name) as (values (1, null), (2, 'c2'), (3, null), (4, 'c4'), (5, null), (6, 'c6')) select c.id::bigint as id, case when id = 3 then 'c2' else name end as name, count(e.event_id) as n from c left join events e on case e.event_id % 7 when 2 then 3 else e.event_id % 7 end = c.id where c.id <> 2 group by all""")
def q_merge_clusters(spark, d):
    f, c, _ = overrides.merge_clusters(frames(spark, d), clusters(spark, d), _fixes(spark, d), 2, 3)
    return lib.members(f, c, "cluster_id", ["id"])


@query("""with c(id, name) as (values (1, null), (2, 'c2'), (3, null), (4, 'c4'), (5, null), (6, 'c6'), (7, null), (8, 'c8')) select id::bigint as id, name from c where name is not null or id in (select event_id % 7 from events)""")
def q_delete_empty(spark, d):
    c = spark.range(1, 9).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("c"), F.col("id").cast("string"))).alias("name"))
    return overrides.without_empty(c, frames(spark, d), "cluster_id")


RUNS = """runs as (select user_id as episode_id, case event_type when 'view' then 'scenes' when 'click' then 'cast' else 'lines' end as stage, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') as finished_at from events where event_type in ('view', 'click', 'purchase') group by all)"""


@query(f"""with {RUNS}, p as (select episode_id, max(finished_at) filter (stage = 'scenes') as s, max(finished_at) filter (stage = 'cast') as c, max(finished_at) filter (stage = 'lines') as l from runs group by 1) select episode_id, coalesce(s >= greatest(coalesce(c, ''), coalesce(l, '')), false) as fresh from p""")
def q_stage_fresh(spark, d):
    e = _table(spark, d, "events").filter(F.col("event_type").isin("view", "click", "purchase"))
    stage = F.when(F.col("event_type") == "view", "scenes").when(F.col("event_type") == "click", "cast").otherwise("lines")
    runs = e.groupBy(F.col("user_id").alias("episode_id"), stage.alias("stage")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("finished_at"))
    return stages.fresh(runs, "scenes", ["cast", "lines"])


@query(f"""with {FRAMES}, h as (select episode, md5(to_json({{'frame_id': frame_id, 't': t, 'tag': tag}})) as h from frames)
select episode, count(*) || '-' || sum(('0x' || substr(h, 1, 12))::bigint) || '-' || sum(('0x' || substr(h, 13, 12))::bigint) as stamp from h group by episode""")
def q_stamp(spark, d):
    return stages.stamps(frames(spark, d), ["episode"], ["frame_id", "t", "tag"])


@query(f"""with {SHOTS}{CAST}{NAMED}{PARTS}{STATUS} select s.episode, s.idx, n.presence from shots s join status t using (episode, idx) join named n using (episode, idx) where t.status = 'kept' and n.name = 'c2' and n.presence >= 0.3 and s."end" - s.start >= {HOUR}
and not exists (select 1 from parts p where p.episode = s.episode and p.p_start < s."end" and p.p_end > s.start) and (s.episode * 1000 + s.idx) % 11 <> 0""")
def q_candidates(spark, d):
    shot = (F.col("episode") * 1000 + F.col("idx")).alias("shot")
    s = shots(spark, d).join(q_status_any_unsafe(spark, d), ["episode", "idx"]).select("*", shot)
    named = lib.named_cast(_cast(spark, d), clusters(spark, d), ["episode", "idx"]).select(shot, "name", "presence", "height")
    again = s.filter("shot % 11 = 0").select("shot")
    p = parts(spark, d).select("episode", F.col("p_start").alias("start"), F.col("p_end").alias("end"))
    return plans.candidates(s, named, "c2", p, again, least=0.3, shortest=HOUR, width=GAP).select("episode", "idx", "presence")


SCORED = """s as (select episode, idx, cluster_id, case idx % 4 when 0 then 'chorus' when 1 then 'bridge' when 2 then 'intro' else 'verse' end as section, presence as p, height as h from cast_),
v as (select *, case section when 'chorus' then p + 0.8::double * h + 0.3::double * p when 'bridge' then 0.7::double * p + 0.5::double * p + 0.3::double * 0.5::double when 'intro' then 0.6::double * p + case when h >= 0.35 then 0.0 else 0.3 end::double + 0.3::double * (1 - least(p, 1.0)) else 0.5::double * p + 0.5::double * p + case when cluster_id > 3 then 0.2 else 0.0 end::double end as score from s)"""


def _scores(spark, d):
    x = _cast(spark, d).join(spark.range(4).select(F.col("id").alias("k")), F.col("idx") % 4 == F.col("k"))
    section = F.element_at(F.array(*map(F.lit, ("chorus", "bridge", "intro", "verse"))), (F.col("k") + 1).cast("int"))
    x = x.withColumns({"section": section, "frame": scalars.framing(F.col("height"))})
    score = scalars.section_score(F.col("section"), F.col("presence"), F.col("height"), F.col("presence"), F.lit(0.5), F.col("cluster_id") > 3, F.col("frame"))
    return x.select("episode", "idx", "section", "cluster_id", score.alias("score"))


@query(f"""with {PLACED}{CAST}, {SCORED},
r as (select *, row_number() over (partition by episode, section order by round(score, 6) desc, idx, cluster_id) as rank from v) select episode, section, idx, cluster_id, round(score, 6) as score from r where rank <= 3""")
def q_section_score_topk(spark, d):
    x = _scores(spark, d).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("episode", "section").orderBy(F.desc("score"), "idx", "cluster_id")
    return x.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("episode", "section", "idx", "cluster_id", "score")


@query(f"""with recursive {PLACED}{CAST}, {SCORED}, pairs as (select episode as plan, (idx + k) % 6 as slot, idx * 10 + cluster_id as shot, round(score, 6) as score from v cross join (values (0), (1), (2)) n(k)),
fits as (select plan, slot, case slot % 4 when 0 then 0 when 1 then 1 when 2 then 3 else 2 end as turn, list(shot order by score desc, shot) as shots from pairs group by plan, slot),
q as (select 0 as mode, *, row_number() over (partition by plan order by slot <> 5, turn, slot) as k from fits union all select 1, *, row_number() over (partition by plan order by len(shots), slot <> 5, turn, slot) from fits),
r as (select mode, plan, 0::bigint as k, []::bigint[] as used from q where k = 1 union all select q.mode, q.plan, q.k, list_append(used, list_filter(shots, lambda x: not list_contains(used, x))[1]) from r join q on q.mode = r.mode and q.plan = r.plan and q.k = r.k + 1),
done as (select mode, plan, arg_max(used, k) as used from r group by all), best as (select plan, min(mode) as mode from done where len(list_filter(used, lambda x: x is null)) = 0 group by plan)
select plan, slot, used[k] as shot from best join done using (plan, mode) join q using (plan, mode)""")
def q_greedy_assign(spark, d):
    s = _scores(spark, d).withColumn("slot", F.explode(F.transform(F.array(*map(F.lit, range(3))), lambda k: (F.col("idx") + k) % 6)))
    section = F.element_at(F.array(*map(F.lit, ("chorus", "bridge", "intro", "verse"))), (F.col("slot") % 4 + 1).cast("int"))
    pairs = s.select(F.col("episode").alias("plan"), "slot", section.alias("section"), (F.col("slot") == 5).alias("closing"), (F.col("idx") * 10 + F.col("cluster_id")).alias("shot"), F.round("score", 6).alias("score"))
    return plans.assign(pairs)


@query(f"""with {SHOTS}, b as (select episode, t from frames where tag = 'purchase') select s.episode, s.idx, coalesce((select arg_min(t, abs(t - s.start) * 10 + case when t > s.start then 1 else 0 end) from b where b.episode = s.episode), s.start) as start, coalesce((select arg_min(t, abs(t - s."end") * 10 + case when t > s."end" then 1 else 0 end) from b where b.episode = s.episode), s."end") as "end" from shots s""")
def q_beat_snap(spark, d):
    beats = frames(spark, d).filter("tag = 'purchase'").select("episode", F.col("t").alias("beat"))
    return plans.snapped(shots(spark, d), beats, "episode").select("episode", "idx", "start", "end")


@query(f"""with {SHOTS}, w as (select episode, idx, start, ("end" - start) / 1e6 as last from shots), o as (select episode, idx, last, (t - start) / 1e6 as time, score / 500 as strength from placed join w using (episode, idx) where tag = 'view' and score / 500 >= 0.03),
g as (select episode, idx, (t - start) / 1e6 as place, 0.5::double + (frame_id % 5) / 10.0::double as weight from placed join w using (episode, idx) where tag = 'click'),
x as (select *, time - place * (last / 2) / (last / 2) as new from o join g using (episode, idx)),
y as (select *, strength * weight - 1e-6::double * abs(new - last / 4) as score from x where new >= -1e-6 and new + last / 2 <= last + 1e-6 and new + least(0.25::double, last / 2 / 4) <= last / 2 and last / 2 <= new + last / 2 - least(0.25::double, last / 2 / 4))
select episode, idx, round(b.new, 6) as at, b.time as onset, b.place as target, round(b.score, 6) as score from (select episode, idx, arg_max({{'new': new, 'time': time, 'place': place, 'score': score}}, (score, -time, -place)) as b from y group by all)""")
def q_sync_best(spark, d):
    s = shots(spark, d)
    p = placed(spark, d).join(s.select("episode", "idx", F.col("start").alias("s")), ["episode", "idx"]).withColumn("sec", (F.col("t") - F.col("s")) / 1e6)
    last = (F.col("end") - F.col("start")) / 1e6
    # a slot of half a shot, whose anchor is the shot's middle
    slots = s.select("episode", "idx", F.lit(0.0).alias("start"), (last / 2).alias("length"), (last / 2).alias("duration"), (last / 4).alias("window"), F.lit(0.0).alias("first"), last.alias("last"), (last / 2).alias("anchor"))
    onsets = p.filter("tag = 'view'").select("episode", "idx", F.col("sec").alias("time"), (F.col("score") / 500).alias("strength"))
    targets = p.filter("tag = 'click'").select("episode", "idx", F.col("sec").alias("place"), (0.5 + F.col("frame_id") % 5 / F.lit(10.0)).alias("weight"))
    best = plans.synchronised(slots, onsets, targets, ["episode", "idx"], cost=1e-6)
    return best.select("episode", "idx", F.round("at", 6).alias("at"), "onset", "target", F.round("score", 6).alias("score"))


TIMING = f"""slots as (select episode as plan, idx as slot, start / 1e6 as start, "end" / 1e6 as "end", case when idx % 5 = 0 then start / 1e6 + 0.5::double end as accent, lag("end" / 1e6) over (partition by episode order by idx) as prev from shots),
grid as (select episode, t / 1e6 as beat from frames where tag <> 'error' union select episode, 0.0::double from frames union select distinct episode, 1.706e9::double from frames),
pts as (select plan, slot, 's' as kind, start as p from slots union all select plan, slot, 'e', "end" from slots union all select plan, slot, 'a', accent from slots where accent is not null),
dist as (select p.plan, p.slot, p.kind, least(p.p - b.beat, coalesce(a.beat - p.p, p.p - b.beat)) as d from pts p asof join grid b on b.episode = p.plan and b.beat <= p.p asof left join grid a on a.episode = p.plan and a.beat >= p.p),
near as (select s.*, (select d from dist where dist.plan = s.plan and dist.slot = s.slot and kind = 's') as ds, (select d from dist where dist.plan = s.plan and dist.slot = s.slot and kind = 'e') as de, (select d from dist where dist.plan = s.plan and dist.slot = s.slot and kind = 'a') as da from slots s)"""


@query(f"""with {SHOTS}, {TIMING} select plan, slot, 'error' as level, case when start > prev then 'slot.gap' else 'slot.overlap' end as code from near where abs(start - prev) > 1e-3
union all select plan, slot, 'error', 'slot.off_beat' from near where ds > 1 / 48.0::double union all select plan, slot, 'error', 'slot.off_beat' from near where de > 1 / 48.0::double
union all select plan, slot, 'error', 'slot.accent' from near where accent is not null and (not (accent > start and accent < "end") or da > 1 / 48.0::double)
union all select plan, slot, 'error', 'song.range' from near where "end" > 1.706e9 + 1e-3 union all select plan, slot, 'warning', 'slot.long' from near where "end" - start > 6
union all select plan, slot, 'warning', 'slot.short' from near where "end" - start >= 0.25 and "end" - start < 0.5""")
def q_validate_timing(spark, d):
    s = shots(spark, d)
    slots = s.select(F.col("episode").alias("plan"), F.col("episode").alias("song"), F.col("idx").alias("slot"), (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), F.when(F.col("idx") % 5 == 0, F.col("start") / 1e6 + 0.5).alias("accent"))
    f = frames(spark, d)
    songs = f.select(F.col("episode").alias("song")).distinct().withColumn("duration", F.lit(1.706e9))
    return plans.timing_issues(slots, f.filter("tag <> 'error'").select(F.col("episode").alias("song"), (F.col("t") / 1e6).alias("beat")), songs)


@query(f"""with {SHOTS}{STATUS}, slots as (select o_orderkey % 50 as plan, row_number() over (partition by o_orderkey % 50 order by o_orderkey) as slot, case when o_orderkey % 9 = 0 then null else (o_custkey % 160) * 1000 + o_orderkey % 30 end as shot, o_orderkey % 7 / 2 as "in", o_orderkey % 7 / 2 + o_custkey % 4 as "out" from orders),
u as (select *, row_number() over (partition by plan, shot order by slot) as use from slots), k as (select s.episode * 1000 + s.idx as shot, t.status, (s."end" - s.start) / 1e6 as last from shots s join status t using (episode, idx)), x as (select u.*, k.status, k.last, k.shot is not null as known, k.shot % 13 = 0 as part, k.shot % 7 = 0 as again from u left join k using (shot))
select plan, slot, 'error' as level, 'shot.missing' as code from x where shot is null union all select plan, slot, 'error', 'shot.repeat' from x where shot is not null and use > 1 union all select plan, slot, 'error', 'shot.unknown' from x where shot is not null and not known
union all select plan, slot, 'error', 'shot.not_kept' from x where status = 'dropped' union all select plan, slot, 'warning', 'shot.in_op_ed' from x where status = 'kept' and part union all select plan, slot, 'warning', 'shot.recurring' from x where status = 'kept' and not part and again
union all select plan, slot, 'error', 'window.order' from x where status = 'kept' and "out" <= "in" union all select plan, slot, 'error', 'window.outside' from x where status = 'kept' and "out" > "in" and ("in" < -1 / 48.0::double or "out" > last + 1 / 48.0::double)
union all select plan, slot, 'warning', 'window.edge' from x where status = 'kept' and "out" > "in" and not ("in" < -1 / 48.0::double or "out" > last + 1 / 48.0::double) and ("in" < 2 / 24.0::double - 1e-3 or "out" > last - 2 / 24.0::double + 1e-3)
union all select plan, slot, 'error', 'speed.bounds' from x where status = 'kept' and "out" > "in" and (("out" - "in") / 2.0::double < 0.9 - 1e-6 or ("out" - "in") / 2.0::double > 1.1 + 1e-6)""")
def q_validate_shots(spark, d):
    o = _table(spark, d, "orders")
    w = Window.partitionBy(F.col("o_orderkey") % 50).orderBy("o_orderkey")
    shot = F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("o_custkey") % 160 * 1000 + F.col("o_orderkey") % 30)
    slots = o.select((F.col("o_orderkey") % 50).alias("plan"), F.row_number().over(w).cast("long").alias("slot"), shot.alias("shot"), (F.col("o_orderkey") % 7 / 2).alias("in"), (F.col("o_orderkey") % 7 / 2 + F.col("o_custkey") % 4).alias("out"))
    none = F.lit(None).cast("string")
    slots = slots.withColumns({"character": none, "episode": none, "speed": F.lit(None).cast("double"), "start": F.lit(0.0), "end": F.lit(2.0)})
    key = F.col("episode") * 1000 + F.col("idx")
    known = shots(spark, d).join(q_status_any_unsafe(spark, d), ["episode", "idx"]).select(key.alias("shot"), none.alias("path"), "status", F.lit(0.0).alias("first"), ((F.col("end") - F.col("start")) / 1e6).alias("last"), F.lit(24.0).alias("fps"))
    cast = known.select("shot", F.lit("x").alias("name")).limit(0)
    return plans.shot_issues(slots, known, known.filter("shot % 13 = 0").select("shot"), known.filter("shot % 7 = 0").select("shot"), cast)


@query("""with s as (select o_orderkey % 50 as plan, o_custkey % 40 as shot, o_orderkey % 9 = 0 or o_custkey % 11 = 0 as missing, case when o_orderkey % 50 % 3 > 0 and o_orderkey % 7 = 0 then 'error' when o_orderkey % 5 = 0 then 'warning' end as level from orders)
select plan, count(*) filter (level = 'error') = 0 as ok, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warning') as warnings, count(distinct shot) as shots, count(*) filter (missing) as missing from s group by plan""")
def q_report_rollup(spark, d):
    o = _table(spark, d, "orders").withColumn("plan", F.col("o_orderkey") % 50)
    time = lambda c, n: F.when(F.col(c) % n != 0, 1.0)
    slots = o.select("plan", (F.col("o_custkey") % 40).alias("shot"), time("o_orderkey", 9).alias("in"), time("o_custkey", 11).alias("out"))
    level = F.when((F.col("plan") % 3 > 0) & (F.col("o_orderkey") % 7 == 0), "error").when(F.col("o_orderkey") % 5 == 0, "warning")
    return plans.report(o.select("plan", level.alias("level")).filter("level is not null"), slots)


@query(f"""with {FRAMES}, m as (select episode, frame_id, tag, (t - 1704067200000000) // 1000 as ms from frames), x as (select *, ms // 60000 * 60.0::double + ms % 60000 / 1000.0::double as s from m),
y as (select *, least(coalesce(lead(s) over (partition by episode order by s, frame_id), s + 18000), s + 36000) as e from x)
select episode, tag || frame_id as text, s - 0.25 as start, e - 0.25 as "end" from y""")
def q_lyric_end(spark, d):
    ms = F.floor((F.col("t") - 1704067200000000) / 1000)
    stamp = F.concat(F.lit("["), F.floor(ms / 60000).cast("string"), F.lit(":"), F.format_string("%02d.%03d", F.floor(ms % 60000 / 1000), ms % 1000), F.lit("]"))
    lyric = frames(spark, d).select("episode", F.struct("t", "frame_id", F.concat(stamp, "tag", F.col("frame_id").cast("string")).alias("line")).alias("x"))
    files = lyric.groupBy("episode").agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.col("episode").cast("string").alias("path"), F.concat(F.lit("[offset:250]\n"), F.array_join("x.line", "\n")).alias("text"))
    found = texts.read_lyrics(files, longest=36000.0, tail=18000.0)
    return found.select(F.col("path").cast("long").alias("episode"), "text", "start", "end")


@query("select conv_id, turn, count(*) over (partition by regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) > 1 as refrain from conversations")
def q_refrain_count(spark, d):
    c = _table(spark, d, "conversations")
    norm = song.sung_text("text")
    n = c.groupBy(norm.alias("_k")).agg((F.count("*") > 1).alias("refrain"))
    return c.withColumn("_n", norm).join(n, F.col("_n").eqNullSafe(F.col("_k"))).select("conv_id", "turn", "refrain")


@query(f"with {SERIES}, q as (select series, quantile_cont(v, 1 / 3.0::double) as q from series group by 1) select series, i from series join q using (series) where v <= q and i % 8 < 2")
def q_quiet_bars(spark, d):
    bars = series(spark, d).select("series", F.col("i").alias("bar"), F.col("v").alias("energy"), (F.col("i") % 8 / 8).alias("sung"))
    return song.quiet_bars(bars, "series").select("series", F.col("bar").alias("i"))


@query(f"""with {SERIES}, p as (select series, quantile_cont(v, 0.95::double) as p from series group by 1), b as (select series, i from series where i % 5 = 0),
m as (select b.series, b.i, max(f.v) as peak, max(f.v / 8) filter (f.i > b.i) - min(f.v / 8) filter (f.i <= b.i) as rise from b join series f on f.series = b.series and f.i between b.i - 2 and b.i + 2 group by all)
select series, i, round_even(0.7::double * least(greatest(peak / greatest(p, 1e-9::double), 0), 1) + 0.3::double * least(greatest(coalesce(rise, 0) / 6, 0), 1), 3) as strength from m join p using (series)""")
def q_accent_strength(spark, d):
    s = series(spark, d)
    # beats stand between frames, so that five frames are within reach of each
    levels = s.select("series", (F.col("i") * 0.02).alias("t"), F.col("v").alias("flux"), (F.col("v") / 8).alias("db"))
    beats = s.filter("i % 5 = 0").select("series", (F.col("i") * 0.02 + 0.005).alias("beat"))
    found = song.strengths(levels, beats, "series")
    return found.select("series", F.round((F.col("beat") - 0.005) / 0.02).cast("long").alias("i"), "strength")


@query(f"""with {SERIES}, l as (select a.series, lag, sum(a.v * b.v) as score from (select series, i, v, unnest(range(-5, 6)) as lag from series) a join series b on b.series = a.series and b.i = a.i + a.lag group by all) select series, arg_max(lag, (score, -lag)) as lag, max(score) as score from l group by series""")
def q_lag_correlation(spark, d):
    s = series(spark, d)
    return seq.best_lag(seq.lag_products(s, s, ["series"], "i", "v", 5), ["series"]).select("series", F.col("lag").cast("long").alias("lag"), "score")


@query(f"""with {SHOTS}, r as (select episode * 1000 + idx as shot, t, tag, score, row_number() over (partition by episode, idx order by score desc, t) as r from placed) select s.episode as scene, s.idx, r.r as place, r.t as time, r.score as cuteness from shots s join r on r.shot = s.episode * 1000 + s.idx where r.r <= 2""")
def q_nested_context(spark, d):
    s = shots(spark, d)
    scenes = s.groupBy(F.col("episode").alias("scene")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    inner = s.select(F.col("episode").alias("scene"), (F.col("episode") * 1000 + F.col("idx")).alias("shot"), "start", "end")
    f = placed(spark, d).select((F.col("episode") * 1000 + F.col("idx")).alias("shot"), F.col("t").alias("time"), F.col("score").alias("cuteness"), F.array(F.struct("tag", "score")).alias("tags"))
    out = plans.context(scenes, inner, f)
    doc = F.from_json("document", "scene bigint, shots array<struct<shot:bigint,peaks:array<struct<time:bigint,cuteness:double>>>>")
    x = out.select(doc.alias("d")).select("d.scene", F.explode("d.shots").alias("s")).select("scene", (F.col("s.shot") - F.col("scene") * 1000).alias("idx"), F.posexplode("s.peaks").alias("p", "q"))
    return x.select("scene", "idx", (F.col("p") + 1).cast("long").alias("place"), "q.time", F.col("q.cuteness").alias("cuteness"))


@query(f"""with recursive {FRAMES}, l as (select episode, t / 1e6 as s, t / 1e6 + 2 as e, tag, row_number() over (partition by episode order by t / 1e6, tag, frame_id::varchar) as k from frames),
r as (select episode, k, k as pair, s as start, e as "end", [tag] as langs from l where k = 1 union all
 select l.episode, l.k, case when joins then pair else l.k end, case when joins then r.start else l.s end, case when joins then greatest(r."end", l.e) else l.e end, case when joins then list_append(langs, tag) else [tag] end
 from r join l on l.episode = r.episode and l.k = r.k + 1 cross join lateral (select l.s - r.start <= 3600 and not list_contains(langs, tag) as joins))
select episode as song, arg_max(start, k) as start, arg_max("end", k) as "end", arg_max(len(langs), k)::int as langs from r group by episode, pair""")
def q_lang_pair(spark, d):
    f = frames(spark, d).select(F.col("episode").alias("song"), (F.col("t") / 1e6).alias("start"), (F.col("t") / 1e6 + 2).alias("end"), F.col("tag").alias("lang"), F.col("frame_id").cast("string").alias("text"))
    return speakers.paired(f, tolerance=3600.0).select("song", "start", "end", F.size("texts").alias("langs"))


BEATS = """b as (select episode, t, tag, row_number() over (partition by episode order by t) - 1 as i, count(*) over (partition by episode) as n from frames),
ph as (select episode, arg_max(phase, (v, -first)) as phase from (select episode, i % 4 as phase, count(*) as v, min(t) as first from b where tag = 'purchase' group by all) group by episode)"""


@query(f"""with {FRAMES}, {BEATS}, k as (select b.episode, b.t from b left join ph using (episode) where case when n < 4 then i = 0 else i % 4 = coalesce(phase, 0) end)
select episode as song, row_number() over (partition by episode order by t) - 1 as bar, t as start from k""")
def q_bar_grid(spark, d):
    f = frames(spark, d).select(F.col("episode").alias("song"), "t", "tag")
    return song.bar_grid(f, f.filter("tag = 'purchase'")).select("song", F.col("bar").cast("long").alias("bar"), "start")


def _bars(spark, d):
    f = frames(spark, d)
    w = Window.partitionBy("episode").orderBy("t", "frame_id")
    loud, start = F.col("score"), F.col("t") / 1e6
    features = F.array(F.col("score"), F.col("cluster_id").cast("double"), (F.col("frame_id") % 10).cast("double"), F.when(F.col("tag") == "view", 1.0).otherwise(0.0))
    x = f.select(F.col("episode").alias("song"), (F.row_number().over(w) - 1).alias("bar"), start.alias("start"), F.coalesce(F.lead("t").over(w) / 1e6, start + 60).alias("end"), features.alias("features"), (F.col("cluster_id") / 8).alias("vocal"), loud.alias("loudness"))
    return x.withColumn("refrain", F.lit(None).cast("boolean"))


@query(f"""with {FRAMES}{LINES}, bars as (select episode as song, row_number() over (partition by episode order by t, frame_id) - 1 as bar, t / 3.6e9 as start, coalesce(lead(t) over (partition by episode order by t, frame_id) / 3.6e9, t / 3.6e9 + 1) as "end" from frames),
l as (select episode as song, start / 3.6e9 as s, start / 3.6e9 + 1 + line_id % 6 as e, count(*) over (partition by episode, lower(regexp_replace(kind || '! ' || line_id % 20, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) as n from lines)
select b.song, bar, coalesce(sum(least("end", e) - greatest(start, s)) filter (s is not null), 0) / greatest("end" - start, 1e-9) >= 1 / 3.0::double as refrain from bars b left join (from l where n > 1) l on b.song = l.song and l.s < b."end" and b.start < l.e group by b.song, bar, start, "end" """)
def q_refrain_bars(spark, d):
    f = frames(spark, d)
    start = F.col("t") / 3.6e9
    following = F.lead("t").over(Window.partitionBy("episode").orderBy("t", "frame_id")) / 3.6e9
    number = F.row_number().over(Window.partitionBy("episode").orderBy("t", "frame_id")) - 1
    bars = f.select(F.col("episode").alias("song"), number.cast("long").alias("bar"), start.alias("start"), F.coalesce(following, start + 1).alias("end"))
    begin = F.col("start") / 3.6e9
    lyrics = lines(spark, d).select(F.col("episode").alias("song"), begin.alias("start"), (begin + 1 + F.col("line_id") % 6).alias("end"), F.concat("kind", F.lit("! "), F.col("line_id") % 20).alias("text"))
    return song.refrain_bars(bars, lyrics)


NOVELTY = """r as (select episode as song, row_number() over (partition by episode order by t, frame_id) - 1 as bar, score, cluster_id::double as c, (frame_id % 10)::double as m, case when tag = 'view' then 1.0::double else 0.0::double end as v from frames),
x as (select song, bar, 0 as p, score as f from r union all select song, bar, 1, c from r union all select song, bar, 2, m from r union all select song, bar, 3, v from r),
y as (select *, (f - avg(f) over (partition by song, p)) / (stddev_pop(f) over (partition by song, p) + 1e-9) as z0 from x), z as (select *, z0 / (sqrt(sum(z0 * z0) over (partition by song, bar)) + 1e-9) as z from y),
e as (select *, max(bar) over (partition by song) as last from z), k as (select range as k from range(-4, 4)),
n as (select e.song, e.bar, e.p, sum(case when k < 0 then -o.z else o.z end) as d from e cross join k join z o on o.song = e.song and o.p = e.p and o.bar = least(greatest(e.bar + k, 0), e.last) group by all)"""


@query(f"with {FRAMES}, {NOVELTY} select song, bar, round(sum(d * d), 6) as novelty from n group by song, bar")
def q_novelty(spark, d):
    return song.novelty(_bars(spark, d)).select("song", F.col("bar").cast("long").alias("bar"), F.round("novelty", 6).alias("novelty"))


def _sections(spark, d):
    b = _bars(spark, d)
    return song.sections(b.join(song.novelty(b), ["song", "bar"]), vocal_on=0.5)


SECTIONS = f"""{FRAMES}, {NOVELTY}, bars as (select episode as song, row_number() over o - 1 as bar, t / 1e6 as start, coalesce(lead(t) over o / 1e6, t / 1e6 + 60) as "end", score as loudness, cluster_id / 8.0::double as vocal from frames window o as (partition by episode order by t, frame_id)),
j as (select *, vocal >= 0.5 as sings, count(*) over s as total, avg(novelty) over s + 0.5::double * stddev_pop(novelty) over s as high from bars join (select song, bar, sum(d * d) as novelty from n group by song, bar) using (song, bar) window s as (partition by song)),
m as (select song, bar, novelty, total, case when lag(sings) over o <> sings and coalesce(lead(sings) over o = sings, true) then 1 when lag(bar) over o is not null and lead(bar) over o is not null and novelty >= greatest(high, lag(novelty) over o, lead(novelty) over o) then 2 end as trust from j window o as (partition by song order by bar)),
q as (select song, bar, row_number() over (partition by song order by trust, case when trust = 2 then -novelty else 0 end, bar) as turn from m where trust is not null and total - bar >= 2),
taken as (select distinct song, 0::bigint as turn, [0::bigint] as cuts from bars union all select q.song, q.turn, case when len(list_filter(cuts, lambda c: abs(c - q.bar) < 4)) > 0 then cuts else list_append(cuts, q.bar) end from taken join q on q.song = taken.song and q.turn = taken.turn + 1),
part as (select j.*, len(list_filter(cuts, lambda c: c <= j.bar)) - 1 as idx from j join (select song, arg_max(cuts, turn) as cuts from taken group by song) using (song)),
sec as (select song, idx, min(bar) as first_bar, max(bar) + 1 as end_bar, min(start) as start, max("end") as "end", avg(vocal) as vocal, avg(loudness) as loudness from part group by song, idx),
norms as (select song, p, avg(f) as mean, stddev_pop(f) + 1e-9 as spread from x group by song, p),
ways as (select song, idx, list(z order by p) as z from (select song, idx, p, (avg(f) - any_value(mean)) / any_value(spread) as z from x join part using (song, bar) join norms using (song, p) group by song, idx, p) group by song, idx),
twins as (select a.song, a.idx, min(b.idx) as twin from ways a left join ways b on b.song = a.song and b.idx < a.idx and list_cosine_similarity(a.z, b.z) >= 0.85 group by a.song, a.idx),
grown as (select distinct song, -1::bigint as idx, []::bigint[] as g from bars union all select t.song, t.idx, list_append(g, coalesce(g[twin + 1], list_max(g) + 1, 0)) from grown join twins t on t.song = grown.song and t.idx = grown.idx + 1),
h as (select sec.*, g[sec.idx + 1] as grp, vocal >= 0.5 as heard, count(*) over (partition by song) as n from sec join (select song, arg_max(g, idx) as g from grown group by song) using (song)),
gr as (select song, grp, count(*) filter (heard) as times, avg(loudness) as level, min(idx) filter (heard) as debut from h group by song, grp),
main as (select song, arg_max(grp, (case when times > 1 then 1 else 0 end, level, -debut)) as main from gr where times > 0 group by song),
w as (select h.*, times, coalesce(heard and grp = main, false) as is_main, min(idx) filter (heard) over (partition by song) as first, max(idx) filter (heard) over (partition by song) as last from h join gr using (song, grp) left join main using (song)),
sections as (select song, idx, case when not heard then case when coalesce(idx < first, true) then 'intro' when idx > last then 'outro' else 'interlude' end when is_main then 'chorus' when coalesce(lead(is_main) over (partition by song order by idx), false) and end_bar - first_bar <= 8 then 'pre-chorus'
 when times = 1 and idx > n // 2 then 'bridge' else 'verse' end as label, grp, first_bar, end_bar, start, "end", vocal, loudness from w)"""


@query(f'with recursive {SECTIONS} select song, idx, label, grp, first_bar, end_bar, start, "end", round(vocal, 6) as vocal, round(loudness, 6) as loudness from sections')
def q_sections(spark, d):
    return _sections(spark, d).withColumns({"vocal": F.round("vocal", 6), "loudness": F.round("loudness", 6)})


@query(f"""with recursive {SECTIONS}, a as (select song, min(start) as lo, max("end") as hi, coalesce(min("end") filter (label = 'chorus'), max("end")) as upto from sections group by song),
o as (select song, any_value(lo) as lo, any_value(hi) as hi, any_value(upto) as upto, max(start) filter ("end" <= upto) as own from sections join a using (song) group by song),
f as (select song, any_value(lo) as lo, any_value(hi) as hi, any_value(upto) as upto, coalesce(min(start) filter (upto - start <= 259200 and start <= own), any_value(own)) as since from sections join o using (song) group by song)
select song, case when any_value(hi - lo) <= 259200 then any_value(lo) else any_value(since) end as start, case when any_value(hi - lo) <= 259200 then any_value(hi) else coalesce(min("end") filter ("end" >= upto and "end" - since >= 86400), any_value(hi)) end as "end" from sections join f using (song) group by song""")
def q_excerpt(spark, d):
    return song.excerpt(_sections(spark, d), longest=86400.0 * 3, shortest=86400.0)


@query(f"""with recursive {SECTIONS}, {BEATS}, lines as (select b.episode as song, b.t / 1e6 as bar from b left join ph using (episode) where case when n < 4 then i = 0 else i % 4 = coalesce(phase, 0) end),
steps as (select song, idx, label, start, "end", level, beats from sections cross join (values (0, 4, 2), (1, 8, 4), (2, 16, 8)) v(level, slow, fast) cross join lateral (select case when label in ('pre-chorus', 'chorus') then fast else slow end as beats) where level = 0 or beats * 0.5 <= 4),
origin as (select s.*, coalesce(min(bar), any_value(s.start)) as origin from steps s left join lines l on l.song = s.song and bar >= s.start - 1e-6 and bar < s."end" group by all),
grid as (select o.*, f.t / 1e6 as beat, row_number() over (partition by o.song, o.idx, o.level order by f.t) - 1 as i from origin o join frames f on f.episode = o.song and f.t / 1e6 >= o.origin - 1e-6 and f.t / 1e6 < o."end"),
marks as (select song, idx, level, start, mark, row_number() over (partition by song, idx, level order by mark) as k from (select song, idx, level, start, beat as mark from grid where i % beats = 0 and beat - start > 1e-6 union select song, idx, level, start, "end" as mark from steps where "end" > start)),
cut as (select song, idx, level, 0::bigint as k, [start] as bounds from steps union all
 select c.song, c.idx, c.level, m.k, list_append(case when len(bounds) > 1 and least(mark - bounds[-1], bounds[-1] - bounds[-2]) < 0.5 then bounds[:-2] else bounds end, mark) from cut c join marks m on m.song = c.song and m.idx = c.idx and m.level = c.level and m.k = c.k + 1),
done as (select song, idx, level, arg_max(bounds, k) as bounds from cut group by all), parts as (select song, idx, label, start, level, beats, bounds, max(level) over (partition by song, idx) as top, list_position(['verse', 'intro', 'interlude', 'outro', 'bridge', 'pre-chorus', 'chorus'], label) as turn from done join steps using (song, idx, level)),
states as (select 0 as kind, 0 as lift union all select kind, lift from range(1, 8) k(kind) cross join range(1, 3) l(lift)),
shown as (select *, case when turn < kind then top when turn = kind then least(lift, top) else 0 end as wanted from parts cross join states),
sums as (select song, kind, lift, sum(len(bounds) - 1) as n from shown where level = wanted group by all), pick as (select song, coalesce(min((kind, lift)) filter (n <= 20), (7, 2)) as s from sums group by song),
flat as (select song, label, beats, start as s, bounds, unnest(range(1, len(bounds))) as j from shown join pick using (song) where level = wanted and kind = s[1] and lift = s[2])
select song, row_number() over (partition by song order by s, j) - 1 as slot, bounds[j] as start, bounds[j + 1] as "end", label as section, beats::bigint as beats from flat""")
def q_slots(spark, d):
    parts = _sections(spark, d).groupBy("song").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("p")).select("song", F.transform("p", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end"))).alias("sections"))
    f = frames(spark, d).groupBy(F.col("episode").alias("song")).agg(F.array_sort(F.collect_list(F.col("t") / 1e6)).alias("beats"))
    bars = q_bar_grid(spark, d).groupBy("song").agg(F.array_sort(F.collect_list(F.col("start") / 1e6)).alias("bars"))
    return song.slots(parts.join(f, "song").join(bars, "song").withColumn("bpm", F.lit(120.0)), budget=20)


@query(f"""with {FRAMES}, f as (select *, (t - 1704067200000000) // {6 * HOUR} as i from frames), sp as (select episode, i, max(score) / 500 as p from f group by all), sh as (select distinct episode, i from f where tag = 'view'),
b as (select sp.episode, sp.i, p - avg(p) over (partition by sp.episode) as p, case when sh.i is null then 0.0 else 1.0 end::double - avg(case when sh.i is null then 0.0 else 1.0 end::double) over (partition by sp.episode) as m from sp left join sh on sh.episode = sp.episode and sh.i = sp.i),
z as (select episode, sqrt(sum(m * m) * sum(p * p)) as norm from b group by episode),
c as (select a.episode, lag, sum(a.m * b.p) / case when any_value(norm) > 0 then any_value(norm) else 1 end as c from (select *, unnest(range(-6, 7)) as lag from b) a join b on b.episode = a.episode and b.i = a.i + a.lag join z on z.episode = a.episode group by a.episode, lag),
n as (select *, lag(c) over o as l, lead(c) over o as r from c window o as (partition by episode order by lag)),
t as (select episode, arg_max({{'c': c, 'lag': lag, 'l': l, 'r': r}}, (c, -lag)) as t from n group by episode),
o as (select episode, t.c as c, (t.lag + case when t.l - 2 * t.c + t.r < 0 then 0.5::double * (t.l - t.r) / (t.l - 2 * t.c + t.r) else 0 end) * 0.032::double as o from t)
select episode, round(o, 6) as "offset", round(c, 6) as correlation, 0.0::double as sharpness, false as applied from o""")
def q_subtitle_timing(spark, d):
    f = frames(spark, d).withColumn("i", F.floor((F.col("t") - 1704067200000000) / (6 * HOUR)).cast("int"))
    speech = f.groupBy("episode", "i").agg((F.max("score") / 500).alias("p"))
    shown = f.filter("tag = 'view'").select("episode", (F.col("i") * 0.032).alias("start"), (F.col("i") * 0.032 + 0.03).alias("end"))
    return song.timing(shown, speech, reach=0.2).withColumns({c: F.round(c, 6) for c in ("offset", "correlation", "sharpness")})


@query(f"""with free as ({ORACLES["q_interval_gaps"]}), fr as (with {FRAMES} select * from frames), sh as (with {SHOTS} select * from shots),
g as (select episode, start / 1e6 as gs, "end" / 1e6 as ge, "end" / 1e6 - start / 1e6 - 2 * 0.3::double as room, row_number() over (partition by episode order by case when start = lo then 0 else 1 end, start / 1e6 - "end" / 1e6, start) as turn from free join (select episode, min(t) as lo from fr group by episode) using (episode)),
l as (select episode, frame_id as line, t / 1e6 as s, (t + cast(floor(score * 6e7) as bigint)) / 1e6 as e from fr where tag = 'view'),
shown as (select g.episode, turn, idx % 50 as shot from g join sh on sh.episode = g.episode and sh.start / 1e6 < ge and gs < sh."end" / 1e6 group by all),
x as (select g.*, line, s, e, case when shot is null then 0 else 2 end + 1.0::double - abs(e - s - least(2.5::double, room)) / 2 as score from g join l using (episode) left join shown on shown.episode = g.episode and shown.turn = g.turn and shot = line % 50 where e - s >= 0.6 and e - s <= room),
k as (select *, row_number() over (partition by episode, turn order by score desc, line) as rank from x),
b as (select episode, arg_min({{'line': line, 'gs': gs, 's': s, 'e': e}}, (turn, rank)) as b from k where rank <= 8 and e - s <= room group by episode)
select episode as plan, b.line as line, round_even(b.gs + 0.3::double, 3) as at, round_even(b.s, 3) as "in", round_even(b.e, 3) as "out" from b""")
def q_gap_pick(spark, d):
    bounds = frames(spark, d).groupBy("episode").agg(F.min("t").alias("lo"), (F.max("t") + HOUR).alias("hi"))
    free = iv.complement(q_interval_merge(spark, d), bounds, ["episode"], "start", "end", HOUR)
    gaps = free.select(F.col("episode").alias("plan"), (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), "place")
    li = lines(spark, d).select(F.col("episode").alias("plan"), F.col("line_id").alias("line"), (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), F.array(F.col("line_id") % 50).alias("shots"), F.array(F.col("kind")).alias("on_screen"), F.lit("view").alias("character"))
    li = li.withColumns({"heard_in": F.col("start"), "heard_out": F.col("end")})
    slots = shots(spark, d).select(F.col("episode").alias("plan"), (F.col("idx") % 50).alias("shot"), (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"))
    return plans.pick_voice(gaps, li, slots)


@query(f"""with recursive {PLACED}, l as (select episode * 1000 + idx as shot_id, cluster_id as f, cluster_id % 6 + 1 as t, row_number() over (partition by episode, idx order by frame_id) as k from placed where cluster_id > 0),
r as (select shot_id, k, [{{'f': f, 't': t}}] as kept from l where k = 1 union all select l.shot_id, l.k, list_append(list_filter(list_transform(kept, lambda x: {{'f': x.f, 't': case when x.t = l.f then l.t else x.t end}}), lambda x: x.f <> x.t and x.f <> l.f), {{'f': l.f, 't': l.t}}) from r join l on l.shot_id = r.shot_id and l.k = r.k + 1)
select shot_id, x.f as from_cluster, x.t as to_cluster from (select shot_id, unnest(arg_max(kept, k)) as x from r group by shot_id)""")
def q_fold_fixes(spark, d):
    f = placed(spark, d).filter("cluster_id > 0")
    return overrides.fold_fixes(f.select(F.col("frame_id").alias("seq"), (F.col("episode") * 1000 + F.col("idx")).alias("shot_id"), F.col("cluster_id").alias("from_cluster"), (F.col("cluster_id") % 6 + 1).alias("to_cluster")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Scene summaries: for each shot its span, its lines, and the share of time that each named character is on screen."""
    named = lib.named_cast(_cast(spark, d), clusters(spark, d), ["episode", "idx"])
    cast = named.groupBy("episode", "idx").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "presence"))).alias("cast"))
    spoken = q_overlap_join(spark, d).groupBy("episode", "idx").agg(F.count("*").alias("lines"))
    return shots(spark, d).join(cast, ["episode", "idx"], "left").join(spoken, ["episode", "idx"], "left")


@query(f"""with {SERIES}, x as (select series, i, v / 50 - 0.5::double as v from series), h as (select series, i // 4 as h, avg(v * v) as p, count(*) as n from x group by all),
d as (select *, case when n = 4 then 20 * log10(sqrt(p) + 1e-12::double) end as db from h), t as (select *, max(db) over (partition by series) as top from d)
select series, round(coalesce(20 * log10(sqrt(avg(p) filter (db >= top - 25)) + 1e-12::double), -120), 6) as level from t group by series""")
def q_levels(spark, d):
    samples = series(spark, d).withColumn("v", F.col("v") / 50 - 0.5)
    return sound.levels(samples, ["series"], 200).select("series", F.round("level", 6).alias("level"))


@query(f"""with {SERIES}, n as (select series, max(i) + 1 as n from series group by series), spans as (select series, (series % 7) / 10.0::double as s, (series % 7) / 10.0::double + 0.5 as e, 9.0::double as depth from n union all select series, 0.8, 1.1, 12.0 from n),
r as (select series, depth, round(s * 200)::bigint as a, round(e * 200)::bigint as b from spans),
c as (select x.series, x.i, max(depth * case when i < a then 0.5::double - 0.5::double * cos(pi() * (i - a + 30) / 29) when i >= b then 0.5::double - 0.5::double * cos(pi() * (b + 79 - i) / 79) else 1.0 end) as db from series x join r on r.series = x.series and i >= a - 30 and i < b + 80 group by all)
select x.series, x.i, round(v * case when x.i < least(10, n) then 0.5::double - 0.5::double * cos(pi() * x.i / (least(10, n) - 1)) else 1 end * case when x.i >= n - least(100, n) then 0.5::double - 0.5::double * cos(pi() * (n - 1 - x.i) / (least(100, n) - 1)) else 1 end * power(10.0::double, -coalesce(db, 0) / 20), 6) as v from series x join n using (series) left join c on c.series = x.series and c.i = x.i""")
def q_ducked(spark, d):
    samples = series(spark, d)
    songs = samples.select("series").distinct()
    spans = songs.select("series", (F.col("series") % 7 / 10).alias("start"), (F.col("series") % 7 / 10 + 0.5).alias("end"), F.lit(9.0).alias("depth")).unionByName(songs.select("series", F.lit(0.8).alias("start"), F.lit(1.1).alias("end"), F.lit(12.0).alias("depth")))
    return sound.under(sound.faded(samples, ["series"], 200, 0.05, 0.5), spans, ["series"], 200).select("series", "i", F.round("v", 6).alias("v"))


@query("""with p as (select vec_id // 100 as film, vec_id as i, list_transform(embedding, lambda v: floor(abs(v::double) * 500)) as p from embeddings), q as (select *, coalesce(lag(p) over (partition by film order by i), p) as b from p),
e as (select film, i, unnest(p) as x, unnest(b) as y from q) select film, i, round(avg(abs(x - y) / 255), 6) as mean, round(avg(case when abs(x - y) / 255 > 0.04::double then 1.0 else 0.0 end::double), 6) as changed from e group by film, i""")
def q_picture_changes(spark, d):
    pictures = _table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("film"), F.col("vec_id").alias("i"), F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 500)).alias("pixels"))
    return sound.differences(pictures, ["film"]).select("film", "i", F.round("mean", 6).alias("mean"), F.round("changed", 6).alias("changed"))


@query("""with e as (select event_id as id, user_id as ep, event_type as ty from events), clusters as (select id, 'c' || id % 9 as name from e where id < 40), scenes as (select id, ep, id % 20 as idx from e),
fixes as (select id as shot_id, id % 50 as a, nullif(id % 3, 0) as b from e where ty = 'signup'), runs as (select id % 200 as ep, ty as stage from e where ty = 'error' group by all)
select * from (select 'clusters' as "table", 'unique name' as rule, count(*) as rows from (select name from clusters group by name having count(*) > 1) union all select 'scenes', 'unique episode_id,idx', count(*) from (select ep, idx from scenes group by all having count(*) > 1)
union all select 'scenes', 'episode_id in episodes', count(*) from scenes where ep not in (select ep from e where ep % 10 <> 0) union all select 'stage_runs', 'episode_id in episodes', count(*) from runs where ep not in (select ep from e where ep % 10 <> 0)
union all select 'cast_fixes', 'from_cluster in clusters', count(*) from fixes where a not in (select id from clusters) union all select 'cast_fixes', 'to_cluster in clusters', count(*) from fixes where b is not null and b not in (select id from clusters)
union all select 'cast_fixes', 'moves', count(*) from fixes where a = b) where rows > 0""")
def q_violations(spark, d):
    e = _table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("ep"), F.col("event_type").alias("ty"))
    tables = {
        "episodes": e.filter("ep % 10 <> 0").select(F.col("ep").alias("id")).distinct().withColumn("path", F.col("id").cast("string")),
        "clusters": e.filter("id < 40").select("id", F.concat(F.lit("c"), (F.col("id") % 9).cast("string")).alias("name")),
        "scenes": e.select("id", F.col("ep").alias("episode_id"), (F.col("id") % 20).alias("idx")),
        "cast_fixes": e.filter("ty = 'signup'").select(F.col("id").alias("shot_id"), (F.col("id") % 50).alias("from_cluster"), F.nullif(F.col("id") % 3, F.lit(0)).alias("to_cluster")),
        "stage_runs": e.filter("ty = 'error'").select((F.col("id") % 200).alias("episode_id"), F.col("ty").alias("stage")).distinct(),
    }
    return schema.violations({name: schema.conform(df, name) for name, df in tables.items()})
