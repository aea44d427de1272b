"""Queries on intervals, windows, catalogues and joins of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PlanConfig
from ..functions import intervals as iv
from ..operators import joins, windows
from ..operators.generation import rows_around
from ..operators.materialise import checkpoint
from ..sources.tables import narrations, table
from .base import N, bucket_sql, high_sql, query

B = bucket_sql


@query(f"SELECT event_id, {B('value')} AS bucket_lo, {high_sql(B('value'))} AS bucket_hi FROM events")
def bucketize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", iv.bucket_lo(F.col("value")).alias("bucket_lo"), iv.bucket_hi(F.col("value")).alias("bucket_hi"))


@query("""SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_convs, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY role""")
def unnest_counts(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    flat = nested.select("conv_id", F.inline("turns"))
    return flat.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_convs"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""WITH {N}, q AS (SELECT * FROM n)
SELECT q.uid, count(m.uid)::BIGINT AS n_inside, coalesce(min(m.uid), -1) AS first_uid FROM q LEFT JOIN n m ON m.video_uid = q.video_uid AND m.t BETWEEN q.t - 1.0 AND q.t + q.d / 10 + 1.0 GROUP BY q.uid""")
def padded_window_filter(spark: SparkSession, d: str) -> DataFrame:
    n = narrations(spark, d)
    q = n.select(F.col("narration_uid").alias("query_id"), "video_uid", F.col("timestamp_sec").alias("query_start_sec"), (F.col("timestamp_sec") + F.col("d") / 10).alias("query_end_sec"))
    inside = rows_around(q, n).groupBy("query_id").agg(F.count("*").alias("n"), F.min("narration_uid").alias("first"))
    return q.join(inside, "query_id", "left").select(F.col("query_id").alias("uid"), F.coalesce("n", F.lit(0)).alias("n_inside"), F.coalesce("first", F.lit(-1)).alias("first_uid"))


_ENDS = f"""WITH {N}, e AS (SELECT uid, CASE WHEN uid % 3 <> 0 THEN t END AS clip_s, CASE WHEN uid % 5 <> 0 THEN t + d END AS clip_e, CASE WHEN uid % 7 <> 0 THEN t + 1 END AS video_s, t + d + 1 AS video_e, t AS base_video, t - 0.5 AS base_clip, t, d FROM n)"""


def _ends(spark: SparkSession, d: str) -> DataFrame:
    n = narrations(spark, d)
    t, v, uid = F.col("timestamp_sec"), F.col("d"), F.col("narration_uid")
    return n.select(uid.alias("uid"), F.when(uid % 3 != 0, t).alias("clip_s"), F.when(uid % 5 != 0, t + v).alias("clip_e"), F.when(uid % 7 != 0, t + 1).alias("video_s"), (t + v + 1).alias("video_e"), t.alias("base_video"), (t - 0.5).alias("base_clip"), t.alias("t"), v.alias("d"))


@query(_ENDS + """ SELECT uid, CASE WHEN clip_s IS NOT NULL AND clip_e IS NOT NULL THEN clip_s WHEN video_s IS NOT NULL AND video_e IS NOT NULL THEN video_s + (base_clip - base_video) END AS s,
CASE WHEN clip_s IS NOT NULL AND clip_e IS NOT NULL THEN clip_e WHEN video_s IS NOT NULL AND video_e IS NOT NULL THEN video_e + (base_clip - base_video) END AS e, coalesce(video_s, clip_s) AS s_own, coalesce(video_e, clip_e) AS e_own FROM e""")
def coord_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    pair = iv.clip_coordinates(c("clip_s"), c("clip_e"), c("video_s"), c("video_e"), c("base_video"), c("base_clip"))
    return _ends(spark, d).withColumn("p", pair).select("uid", "p.s", "p.e", iv.first_given(c("video_s"), c("clip_s")).alias("s_own"), iv.first_given(c("video_e"), c("clip_e")).alias("e_own"))


@query(_ENDS + """, p AS (SELECT uid, t + 1 AS cs, t + 21 AS ce, CASE WHEN video_s IS NOT NULL THEN least(video_s, video_e) WHEN clip_s IS NOT NULL AND clip_e IS NOT NULL THEN least(clip_s, clip_e) ELSE t + 1 END AS s,
CASE WHEN video_s IS NOT NULL THEN greatest(video_s, video_e) WHEN clip_s IS NOT NULL AND clip_e IS NOT NULL THEN greatest(clip_s, clip_e) ELSE t + 21 END AS e FROM e),
c AS (SELECT uid, cs, ce, greatest(cs, least(s, ce)) AS s, greatest(cs, least(e, ce)) AS e FROM p)
SELECT uid, CASE WHEN s = e THEN greatest(cs, (cs + ce) / 2 - least(0.01::DOUBLE, greatest(1e-3::DOUBLE, (ce - cs) * 1e-4::DOUBLE))) ELSE s END AS s, CASE WHEN s = e THEN least(ce, (cs + ce) / 2 + least(0.01::DOUBLE, greatest(1e-3::DOUBLE, (ce - cs) * 1e-4::DOUBLE))) ELSE e END AS e FROM c""")
def clamp_interval(spark: SparkSession, d: str) -> DataFrame:
    rows = _ends(spark, d).withColumn("cs", F.col("t") + 1).withColumn("ce", F.col("t") + 21)
    got = iv.clamped_query([(F.col("video_s"), F.col("video_e")), (F.col("clip_s"), F.col("clip_e"))], F.col("cs"), F.col("ce"))
    return rows.withColumn("q", got).select("uid", "q.s", "q.e")


@query(f"""WITH {N}, r AS (SELECT uid, t - 2 AS cs, t + 98 AS ce, t AS s, t + d / 4 AS e FROM n), x AS (SELECT uid, (s - cs) / greatest(ce - cs, 1e-9) AS a, (e - cs) / greatest(ce - cs, 1e-9) AS b FROM r WHERE cs <= s AND s < e AND e <= ce)
SELECT uid, round(a, 9) AS qs_rel, round(b, 9) AS qe_rel, round(b - a, 9) AS d_rel, round(a / least(greatest(1 - (b - a), 1e-6), 1.0), 9) AS u FROM x WHERE a / least(greatest(1 - (b - a), 1e-6), 1.0) BETWEEN 0 AND 1""")
def relative_position(spark: SparkSession, d: str) -> DataFrame:
    n = narrations(spark, d)
    t = F.col("timestamp_sec")
    rows = n.select(F.col("narration_uid").alias("uid"), (t - 2).alias("cs"), (t + 98).alias("ce"), t.alias("s"), (t + F.col("d") / 4).alias("e"))
    rows = rows.where(iv.inside_clip(F.col("cs"), F.col("ce"), F.col("s"), F.col("e")))
    rows = rows.withColumn("p", iv.relative_position(F.col("cs"), F.col("ce"), F.col("s"), F.col("e"))).where(F.col("p.u").between(0, 1))
    return rows.select("uid", *[F.round(f"p.{c}", 9).alias(c) for c in ("qs_rel", "qe_rel", "d_rel", "u")])


@query(f"""WITH {N}, x AS (SELECT uid, t AS qs, d AS dur, (uid % 7) / 10.0::DOUBLE AS qs_rel, (uid % 4) / 8.0::DOUBLE AS d_rel FROM n WHERE d >= 0.4)
SELECT uid, round(greatest(dur / greatest(d_rel, 1e-6), dur), 6) AS length, round(qs - qs_rel * greatest(dur / greatest(d_rel, 1e-6), dur), 6) AS cs FROM x""")
def clip_solve(spark: SparkSession, d: str) -> DataFrame:
    rows = narrations(spark, d).where("d >= 0.4").select(F.col("narration_uid").alias("uid"), F.col("timestamp_sec").alias("qs"), "d", ((F.col("narration_uid") % 7) / F.lit(10.0)).alias("qs_rel"), ((F.col("narration_uid") % 4) / F.lit(8.0)).alias("d_rel"))
    return rows.withColumn("c", iv.solved_clip(F.col("qs"), F.col("d"), F.col("qs_rel"), F.col("d_rel"))).select("uid", F.round("c.length", 6).alias("length"), F.round("c.cs", 6).alias("cs"))


@query(f"""WITH {N}, x AS (SELECT uid, t, t + d / 10 AS e, lead(t) OVER w AS t2, lead(t + d / 10) OVER w AS e2 FROM n WINDOW w AS (PARTITION BY video_uid ORDER BY t, uid))
SELECT uid, NOT (e <= t2 + 1e-3::DOUBLE OR t >= e2 - 1e-3::DOUBLE) AS overlap FROM x WHERE t2 IS NOT NULL""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    w = windows.entity()
    end = F.col("timestamp_sec") + F.col("d") / 10
    rows = narrations(spark, d).withColumn("e", end).withColumn("t2", F.lead("timestamp_sec").over(w)).withColumn("e2", F.lead("e").over(w)).where("t2 IS NOT NULL")
    return rows.select(F.col("narration_uid").alias("uid"), iv.overlaps(F.col("timestamp_sec"), F.col("e"), F.col("t2"), F.col("e2")).alias("overlap"))


_CLIPS = "SELECT o_orderkey, l_linenumber, o_custkey AS video_uid, floor(o_totalprice / 1000) AS cs, floor(o_totalprice / 1000) + 20 AS ce, row_number() OVER (PARTITION BY o_custkey, floor(o_totalprice / 1000) ORDER BY o_orderkey, l_linenumber) - 1 AS query_idx, min(o_orderkey * 10 + l_linenumber) OVER (PARTITION BY o_custkey, floor(o_totalprice / 1000)) AS arrival FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


@query(f"""WITH q AS ({_CLIPS}), c AS (SELECT *, dense_rank() OVER (PARTITION BY video_uid ORDER BY arrival) - 1 AS clip_idx FROM q),
u AS (SELECT *, video_uid || '_' || cs::BIGINT || '_' || ce::BIGINT || '_' || clip_idx AS clip_uid FROM c)
SELECT o_orderkey, l_linenumber, clip_idx::BIGINT AS clip_idx, query_idx::BIGINT AS query_idx, clip_uid, clip_uid || '-ann0' AS annotation_uid, substr(md5(video_uid || '|' || clip_uid || '|' || query_idx), 1, 16) AS query_id FROM u""")
def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.merge import derived_ids as ids

    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select("o_orderkey", "l_linenumber", F.col("o_custkey").cast("string").alias("video_uid"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("clip_end_sec"), (F.floor(F.col("o_totalprice") / 1000) + 20).cast("double").alias("clip_start_sec"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"))
    return ids(rows, "arrival").select("o_orderkey", "l_linenumber", F.col("clip_idx").cast("long").alias("clip_idx"), F.col("query_idx").cast("long").alias("query_idx"), "clip_uid", "annotation_uid", "query_id")


def _islands(gap: float) -> str:
    return f"""g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {gap} OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM n WINDOW w AS (PARTITION BY video_uid ORDER BY t, uid)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY video_uid ORDER BY t, uid ROWS UNBOUNDED PRECEDING) AS island FROM g)"""


@query(f"WITH {N}, {_islands(8.0)} SELECT video_uid, island::BIGINT AS island, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM i GROUP BY video_uid, island HAVING count(*) > 1")
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.islands(narrations(spark, d), 8.0)
    return rows.groupBy("video_uid", "island").agg(F.min("timestamp_sec").alias("first_t"), F.max("timestamp_sec").alias("last_t"), F.count("*").alias("n"))


def _windows_sql(widths: tuple[int, ...], part: str, source: str, low: str, high: str) -> str:
    parts = " UNION ALL ".join(f"SELECT video_uid, uid, t AS cs, lead(t, {w - 1}) OVER (PARTITION BY {part} ORDER BY t, uid) AS ce, {w} AS width, max(unsure::INT) OVER (PARTITION BY {part} ORDER BY t, uid ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS bad FROM {source}" for w in widths)
    return f"SELECT * FROM ({parts}) WHERE ce IS NOT NULL AND bad = 0 AND ce - cs {low} AND ce - cs {high}"


_OUT = f"SELECT video_uid, uid AS first_uid, cs, ce, width::INT AS width, ce - cs AS dur, {B('ce - cs')} AS bucket_lo, {high_sql(B('ce - cs'))} AS bucket_hi FROM x"
SHORT = f"WITH {N}, x AS ({_windows_sql((2, 3), 'video_uid', 'n', '> 1e-6', '<= 4')})"
LONG = f"WITH {N}, {_islands(8.0)}, k AS (SELECT *, count(*) OVER (PARTITION BY video_uid, island) AS members FROM i), x AS ({_windows_sql((3, 4, 5, 6, 7, 8), 'video_uid, island', 'k', '>= 4', '< 60')})"


@query(f"{SHORT} {_OUT}")
def short_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.short_windows(narrations(spark, d))


@query(f"{LONG} {_OUT}")
def long_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.long_windows(narrations(spark, d))


def _truncated_sql(gap: float, widths: tuple[int, ...], low: float) -> str:
    leads = ", ".join(f"lead(t, {k - 1}) OVER w AS t{k}, max(unsure::INT) OVER (PARTITION BY video_uid, island ORDER BY t, uid ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS b{k}" for k in range(1, max(widths) + 1))
    wide = " UNION ALL ".join(f"SELECT *, {w} AS w, t{w} - t AS full_d FROM f WHERE t{w} IS NOT NULL" for w in widths)
    bucket = B("full_d")
    most = f"CASE {bucket} WHEN 4 THEN 3 WHEN 8 THEN 4 WHEN 16 THEN 5 WHEN 32 THEN 6 ELSE 99 END"
    pick = lambda c: "CASE width " + " ".join(f"WHEN {k} THEN {c}{k}" for k in range(1, max(widths) + 1)) + " END"
    return f"""WITH {N}, {_islands(gap)}, k AS (SELECT *, count(*) OVER (PARTITION BY video_uid, island) AS members FROM i), f AS (SELECT video_uid, uid, t, {leads} FROM k WHERE members > 1 WINDOW w AS (PARTITION BY video_uid, island ORDER BY t, uid)),
v AS (SELECT *, least(w, {most}) AS width FROM ({wide}) WHERE full_d >= {low} AND full_d < 60), x AS (SELECT video_uid, uid, t AS cs, {pick('t')} AS ce, width FROM v WHERE {pick('b')} = 0)"""


@query(f"{_truncated_sql(16.0, (3, 4, 5, 6, 7, 8), 4.0)} {_OUT}")
def long_windows_v2(spark: SparkSession, d: str) -> DataFrame:
    return windows.long_windows_v2(narrations(spark, d)).withColumn("width", F.col("width").cast("int"))


@query(f"{_truncated_sql(24.0, (3, 4, 5, 6), 32.0)} {_OUT}")
def roll_windows_v2(spark: SparkSession, d: str) -> DataFrame:
    return windows.roll_windows_v2(narrations(spark, d)).withColumn("width", F.col("width").cast("int"))


@query(f"""WITH {N}, s AS (SELECT video_uid, min(t) AS t0, max(t) AS t1, max(t) - min(t) AS span FROM n GROUP BY video_uid HAVING count(*) >= 4),
l AS (SELECT *, unnest([36.0, 44.0, 52.0, 60.0, 68.0])::DOUBLE AS len FROM s WHERE span > 0 AND span <= 21600),
p AS (SELECT *, greatest(8.0::DOUBLE, least(least(greatest(8.0::DOUBLE, 0.08::DOUBLE * span), 136.0::DOUBLE), 0.5::DOUBLE * len)) AS step FROM l WHERE len <= span + 1e-3::DOUBLE),
k AS (SELECT *, unnest(range(0, least(floor((span - len + 1e-3::DOUBLE) / step), ceil(span / step) + 1)::BIGINT + 1)) AS k FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY video_uid ORDER BY len, k) AS rank FROM k),
w AS (SELECT video_uid, len, k, t0 + k * step AS cs FROM r WHERE rank <= 4000)
SELECT w.video_uid, w.len AS length, w.k::BIGINT AS k, w.cs, w.cs + w.len AS ce, count(*) AS width FROM w JOIN n ON n.video_uid = w.video_uid AND n.t BETWEEN w.cs - 1e-3::DOUBLE AND w.cs + w.len + 1e-3::DOUBLE
GROUP BY w.video_uid, w.len, w.k, w.cs HAVING count(*) >= 4 AND NOT bool_or(n.unsure)""")
def rolling_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.rolling_windows(narrations(spark, d)).withColumn("k", F.col("k").cast("long"))


@query(f"WITH {N} SELECT video_uid, count(*) AS n, count(*) FILTER (NOT unsure) AS n_sure, count(*) FILTER (t <> 0 AND length(txt) > 0) AS n_valid FROM n GROUP BY video_uid HAVING count(*) >= 3")
def unsure_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.eligible(windows.valid(narrations(spark, d), falsy=True), 3)
    return rows.groupBy("video_uid").agg(F.count("*").alias("n"), F.count_if(~F.col("unsure")).alias("n_sure"), F.count_if(F.length("narration_text") > 0).alias("n_valid"))


@query(f"WITH {N} SELECT uid, count(*) OVER (PARTITION BY video_uid ORDER BY t RANGE BETWEEN 12.0 PRECEDING AND 12.0 FOLLOWING) AS n_around FROM n")
def range_frame_count(spark: SparkSession, d: str) -> DataFrame:
    return windows.counts_around(narrations(spark, d), 12.0, 12.0).select(F.col("narration_uid").alias("uid"), "n_around")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    n = narrations(spark, d)
    return windows.candidates([windows.short_windows(n), windows.long_windows(n)])


_CATALOG = f"{SHORT}, s AS ({_OUT}), {LONG.removeprefix(f'WITH {N}, ').replace('x AS (', 'y AS (', 1)}, l AS ({_OUT.replace('FROM x', 'FROM y')}), c AS (SELECT * FROM s UNION ALL SELECT * FROM l)"


@query(f"{_CATALOG} SELECT video_uid, cs, ce, width, dur, bucket_lo, row_number() OVER (PARTITION BY video_uid, cs, ce ORDER BY width, dur)::INT AS copy FROM c")
def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("video_uid", "cs", "ce", "width", "dur", "bucket_lo", "copy")


@query(f"""{_CATALOG}, kk AS (SELECT row_number() OVER () AS id, * FROM c)
SELECT a.video_uid, a.cs, a.ce, count(b.id) AS density, a.bucket_lo FROM kk a LEFT JOIN kk b ON a.dur >= 10 AND b.dur < 10 AND a.video_uid = b.video_uid AND b.cs >= a.cs AND b.ce <= a.ce GROUP BY a.id, a.video_uid, a.cs, a.ce, a.bucket_lo""")
def density(spark: SparkSession, d: str) -> DataFrame:
    return joins.containment_counts(catalog(spark, d)).select("video_uid", "cs", "ce", "density", "bucket_lo")


@query(f"""{_CATALOG}, kk AS (SELECT row_number() OVER () AS id, * FROM c),
z AS (SELECT a.id, a.bucket_lo, a.dur, count(b.id) AS density FROM kk a LEFT JOIN kk b ON a.dur >= 10 AND b.dur < 10 AND a.video_uid = b.video_uid AND b.cs >= a.cs AND b.ce <= a.ce GROUP BY a.id, a.bucket_lo, a.dur)
SELECT bucket_lo, count(*) AS n, max(density) AS max_density, sum(density)::BIGINT AS sum_density, round(avg(dur), 6) AS mean_dur FROM z GROUP BY bucket_lo""")
def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    found = joins.containment_counts(catalog(spark, d))
    return found.groupBy("bucket_lo").agg(F.count("*").alias("n"), F.max("density").alias("max_density"), F.sum("density").alias("sum_density"), F.round(F.avg("dur"), 6).alias("mean_dur"))


@query(f"WITH {N} SELECT video_uid, count(*) AS n FROM n WHERE video_uid % 10 NOT IN (0, 3, 7) GROUP BY video_uid")
def anti_split(spark: SparkSession, d: str) -> DataFrame:
    n = narrations(spark, d)
    splits = [n.where(F.col("video_uid") % 10 == k).select("video_uid").distinct() for k in (0, 3, 7)]
    return joins.without(n, *splits).groupBy("video_uid").agg(F.count("*").alias("n"))


@query(f"WITH {N} SELECT video_uid, count(*) AS n FROM n GROUP BY video_uid HAVING count(*) >= 2 ORDER BY n DESC, video_uid LIMIT 20")
def topk_entities(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sampling import top_entities

    return top_entities(narrations(spark, d), "video_uid", 20)


@query(f"WITH {N}, u AS (SELECT DISTINCT video_uid FROM n) SELECT u.video_uid, coalesce(max(t), 0) + 5 AS max_ts FROM u LEFT JOIN n ON n.video_uid = u.video_uid AND template <> 'error' GROUP BY u.video_uid")
def max_ts(spark: SparkSession, d: str) -> DataFrame:
    n = narrations(spark, d)
    times = n.withColumn("t", F.when(F.col("template") != "error", F.col("timestamp_sec")))
    return times.groupBy("video_uid").agg((F.coalesce(F.max("t"), F.lit(0.0)) + PlanConfig().end_buffer).alias("max_ts"))


@query(f"""WITH {N}, q AS (SELECT uid AS query_id, video_uid, t - 6 AS s, t + 6 AS e FROM n)
SELECT q.query_id, coalesce(string_agg(n.txt, ' ' ORDER BY n.t, n.uid), '') AS text FROM q LEFT JOIN n ON n.video_uid = q.video_uid AND n.t BETWEEN q.s AND q.e GROUP BY q.query_id""")
def range_join_text(spark: SparkSession, d: str) -> DataFrame:
    n = narrations(spark, d)
    q = n.select(F.col("narration_uid").alias("query_id"), "video_uid", (F.col("timestamp_sec") - 6).alias("s"), (F.col("timestamp_sec") + 6).alias("e"))
    return joins.texts_in_range(q, n).select("query_id", "text")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def equi_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("qty"))


@query(f"""WITH {N}, p AS (SELECT t - lag(t) OVER (PARTITION BY video_uid ORDER BY t, uid) AS g, uid, template FROM n), a AS (SELECT uid, g FROM p WHERE template = 'click' AND g IS NOT NULL), b AS (SELECT uid, g FROM p WHERE template = 'purchase' AND g IS NOT NULL)
SELECT a.uid, count(*) AS n, min(b.uid) AS first_uid FROM a JOIN b ON abs(a.g - b.g) <= 0.25 GROUP BY a.uid""")
def band_join(spark: SparkSession, d: str) -> DataFrame:
    n = narrations(spark, d)
    gaps = n.withColumn("g", F.col("timestamp_sec") - F.lag("timestamp_sec").over(windows.entity())).where("g IS NOT NULL")
    a = gaps.where("template = 'click'").select(F.col("narration_uid").alias("uid"), "g")
    b = gaps.where("template = 'purchase'").select(F.col("narration_uid").alias("other"), F.col("g").alias("h"))
    return joins.band_counts(a, b, "g", "h", 0.25, "uid", "other").select(F.col("key").alias("uid"), "n", F.col("first").alias("first_uid"))


_EVENTS = f"e AS (SELECT uid AS id, video_uid, t, d AS len, template, {B('d')} AS bucket_lo, (uid * 7919) % 97 AS density FROM n WHERE uid % 2 = 0), u AS (SELECT id FROM e WHERE id % 6 = 0), q AS (SELECT uid AS request_id, video_uid, template, {B('d')} AS bucket_lo, d * 0.9 AS d FROM n WHERE uid % 2 = 1)"


def _match_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = narrations(spark, d).withColumn("bucket_lo", iv.bucket_lo(F.col("d")))
    uid = F.col("narration_uid")
    events = n.where(uid % 2 == 0).select(uid.alias("id"), "video_uid", F.col("d").alias("len"), "template", "bucket_lo", (uid * 7919 % 97).alias("density"))
    requests = n.where(uid % 2 == 1).select(uid.alias("request_id"), "video_uid", "template", "bucket_lo", (F.col("d") * 0.9).alias("d"))
    return requests, events, events.where("id % 6 = 0").select("id")


@query(f"""WITH {N}, {_EVENTS}, m AS (SELECT q.request_id, e.id, row_number() OVER (PARTITION BY q.request_id ORDER BY e.density DESC, e.id) AS rank FROM q JOIN e ON e.template = q.template AND e.bucket_lo = q.bucket_lo AND e.len >= q.d WHERE e.id NOT IN (SELECT id FROM u))
SELECT request_id, id, rank::INT AS rank FROM m WHERE rank <= 3""")
def anchor_match(spark: SparkSession, d: str) -> DataFrame:
    requests, events, used = _match_inputs(spark, d)
    return joins.matching_events(requests.drop("video_uid"), events.drop("video_uid"), used, ["template", "bucket_lo"], 3).select("request_id", "id", "rank")


@query(f"""WITH {N}, {_EVENTS}, m AS (SELECT q.request_id, e.id FROM q JOIN e ON e.template = q.template AND e.bucket_lo = q.bucket_lo AND e.len >= q.d WHERE e.id NOT IN (SELECT id FROM u) QUALIFY row_number() OVER (PARTITION BY q.request_id ORDER BY e.density DESC, e.id) <= 5)
SELECT request_id, id FROM m QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY md5('42|' || request_id || '|' || id), id) = 1""")
def anchor_pick(spark: SparkSession, d: str) -> DataFrame:
    requests, events, used = _match_inputs(spark, d)
    return joins.picked_events(requests.drop("video_uid"), events.drop("video_uid"), used, ["template", "bucket_lo"], 5).select("request_id", "id")


@query(f"""WITH {N}, {_EVENTS}, m AS (SELECT q.request_id, e.id, row_number() OVER (PARTITION BY q.request_id ORDER BY e.density DESC, e.id) AS rank FROM q JOIN e ON e.video_uid = q.video_uid AND e.template = q.template AND e.bucket_lo = q.bucket_lo AND e.len >= q.d WHERE e.id NOT IN (SELECT id FROM u))
SELECT request_id, id FROM m WHERE rank = 1""")
def fill_match(spark: SparkSession, d: str) -> DataFrame:
    requests, events, used = _match_inputs(spark, d)
    return joins.matching_events(requests, events, used, ["video_uid", "template", "bucket_lo"]).select("request_id", "id")


@query(f"""WITH {N}, x AS (SELECT video_uid, uid, template, lag(template) OVER (PARTITION BY video_uid ORDER BY t, uid) AS before FROM n) SELECT video_uid, uid, template FROM x WHERE before IS NULL OR before <> template""")
def consecutive_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = narrations(spark, d).select("video_uid", F.col("narration_uid").alias("uid"), "timestamp_sec", "template")
    return windows.without_consecutive(rows, "template", ["video_uid"], ["timestamp_sec", "uid"]).select("video_uid", "uid", "template")


@query(f"""WITH RECURSIVE {N}, s AS (SELECT video_uid, t AS a, t + 2 AS b, row_number() OVER (PARTITION BY video_uid ORDER BY t, t + 2) AS k FROM n),
r AS (SELECT video_uid, k, a, b, a AS la, b AS lb, 1 AS seg FROM s WHERE k = 1
UNION ALL SELECT s.video_uid, s.k, s.a, s.b, CASE WHEN abs(r.la - s.a) <= 1.5 AND abs(r.lb - s.b) <= 1.5 THEN (r.la + s.a) / 2 ELSE s.a END, CASE WHEN abs(r.la - s.a) <= 1.5 AND abs(r.lb - s.b) <= 1.5 THEN (r.lb + s.b) / 2 ELSE s.b END, CASE WHEN abs(r.la - s.a) <= 1.5 AND abs(r.lb - s.b) <= 1.5 THEN r.seg ELSE r.seg + 1 END
FROM r JOIN s ON s.video_uid = r.video_uid AND s.k = r.k + 1),
f AS (SELECT video_uid, seg, la, lb, row_number() OVER (PARTITION BY video_uid, seg ORDER BY k DESC) AS z FROM r)
SELECT video_uid, (seg - 1)::INT AS seg, round(la, 6) AS s, round(lb, 6) AS e FROM f WHERE z = 1""")
def dedup_segments(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.merge import merge_segments

    t = F.col("timestamp_sec")
    ends = narrations(spark, d).select("video_uid", t.alias("s"), (t + 2).alias("e"))
    return merge_segments(ends, ["video_uid"], tol=1.5).select("video_uid", "seg", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"))


@query(f"WITH {N}, c AS (SELECT video_uid, uid, txt, t, row_number() OVER (PARTITION BY video_uid, txt ORDER BY t, uid) AS k FROM n) SELECT video_uid, string_agg(txt, ' ' ORDER BY t, uid) AS context_text, count(*) AS n FROM c WHERE k = 1 GROUP BY video_uid")
def context_text(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.merge import context_text as text

    rows = narrations(spark, d).withColumn("narration_uid", F.lit(None).cast("string"))
    return text(rows, ["video_uid"])


@query(f"WITH {N} SELECT video_uid, string_agg(template, ' ' ORDER BY t, uid) AS templates FROM n GROUP BY video_uid")
def string_agg(spark: SparkSession, d: str) -> DataFrame:
    line = F.array_sort(F.collect_list(F.struct("timestamp_sec", "narration_uid", "template")))
    return narrations(spark, d).groupBy("video_uid").agg(F.array_join(F.transform(line, lambda x: x["template"]), " ").alias("templates"))


@query(f"WITH {N} SELECT uid, row_number() OVER (PARTITION BY template ORDER BY d, uid) / count(*) OVER (PARTITION BY template) AS ecdf FROM n WHERE d IS NOT NULL")
def ecdf(spark: SparkSession, d: str) -> DataFrame:
    rows = narrations(spark, d).where("d IS NOT NULL").select("d", F.col("narration_uid").alias("uid"), "template")
    return windows.ecdf(rows, "d", ["template"]).select("uid", "ecdf")


def allocation(spark: SparkSession, d: str, total: int = 200) -> DataFrame:
    """Anchors and fills for catalogue events, against the stream's own intervals as references."""
    from ..operators.allocate import allocate
    from ..operators.planning import apportioned, joint_counts

    n = narrations(spark, d).withColumn("bucket_lo", iv.bucket_lo(F.col("d"))).withColumn("bucket_hi", iv.bucket_hi(F.col("d")))
    uid = F.col("narration_uid")
    refs = n.where((uid % 3 == 0) & (F.col("d") < 60)).select(uid.alias("ref_id"), "template", "bucket_lo", "d", ((uid % 8) / 10.0).alias("qs_rel"), (((uid % 2) + 1) / 10.0).alias("d_rel"))
    refs = refs.withColumn("clen", F.col("d") / F.col("d_rel"))
    events = n.where((uid % 3 != 0) & (F.col("d") < 60)).select(uid.alias("event_id"), "video_uid", F.col("timestamp_sec").alias("cs"), (F.col("timestamp_sec") + F.col("d")).alias("ce"), "template", "bucket_lo")
    ends = n.groupBy("video_uid").agg((F.max("timestamp_sec") + 600).alias("max_ts"))
    plan = apportioned(joint_counts(n.where("d < 60"), "template"), ["template", "bucket_lo"], total)
    return allocate(refs, events, ends, plan.select("template", "bucket_lo", "target"))


@query()
def allocate(spark: SparkSession, d: str) -> DataFrame:
    return allocation(spark, d, PlanConfig().final_target)


@query("SELECT DISTINCT user_id AS video_uid, 0::BIGINT AS n_overlaps, 0::BIGINT AS n_outside, 0::BIGINT AS n_repeated, 0::BIGINT AS n_too_short, 0::BIGINT AS n_full_beyond_ten FROM events")
def allocate_faults(spark: SparkSession, d: str) -> DataFrame:
    """What an allocation must not have, counted by video: overlaps in a clip, queries outside of it, events used twice or shorter than their query, more than ten queries."""
    placed = checkpoint(allocation(spark, d))
    n = narrations(spark, d)
    own = placed.join(n.select(F.col("narration_uid").alias("event_id"), "d"), "event_id")
    in_clip = Window.partitionBy("clip_id").orderBy("qs", "qe", "event_id")
    own = own.withColumn("before", F.max("qe").over(in_clip.rowsBetween(Window.unboundedPreceding, -1))).withColumn("nth", F.row_number().over(in_clip)).withColumn("use", F.row_number().over(Window.partitionBy("event_id").orderBy("clip_id")))
    count = lambda fault, name: F.count(F.when(fault, 1)).alias(name)
    outside = (F.col("qs") < F.col("clip_cs") - 1e-3) | (F.col("qe") > F.col("clip_ce") + 1e-3) | (F.col("clip_cs") < 0)
    found = own.groupBy("video_uid").agg(count(F.col("before") > F.col("qs") + 1e-3, "n_overlaps"), count(outside, "n_outside"), count(F.col("use") > 1, "n_repeated"), count(F.col("qe") - F.col("qs") > F.col("d") + 1e-6, "n_too_short"), count(F.col("nth") > 10, "n_full_beyond_ten"))
    every = n.select("video_uid").distinct().join(found, "video_uid", "left")
    return every.select("video_uid", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in found.columns[1:]])


@query("""SELECT e.user_id AS video_uid, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM events k WHERE k.event_id % 3 = 0 AND k.user_id = e.user_id AND k.event_type = e.event_type AND k.value IS NOT DISTINCT FROM e.value AND k.ts = e.ts) GROUP BY e.user_id""")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return joins.null_safe_anti(rows, rows.where("event_id % 3 = 0"), ["user_id", "event_type", "value", "ts"]).groupBy(F.col("user_id").alias("video_uid")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_present(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 4 = 0) ORDER BY c_custkey")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(some, "c_custkey", "left_anti").select("c_custkey").orderBy("c_custkey")
