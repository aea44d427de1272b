"""Column functions on durations and intervals in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DURATION_EDGES


def bucket_lo(d: Column, edges: tuple[float, ...] = DURATION_EDGES) -> Column:
    """Lower edge of the half-open bucket; whatever is outside (negative, too long, NaN) goes to the last."""
    out = None
    for lo, hi in zip(edges[:-2], edges[1:]):
        inside = (d >= lo) & (d < hi)
        out = F.when(inside, F.lit(lo)) if out is None else out.when(inside, F.lit(lo))
    return out.otherwise(F.lit(edges[-2]))


def bucket_hi(d: Column, edges: tuple[float, ...] = DURATION_EDGES) -> Column:
    low = bucket_lo(d, edges)
    out = None
    for lo, hi in zip(edges[:-2], edges[1:]):
        out = F.when(low == lo, F.lit(hi)) if out is None else out.when(low == lo, F.lit(hi))
    return out.otherwise(F.lit(edges[-1]))


def bucket_of(d: Column, edges: tuple[float, ...] = DURATION_EDGES) -> Column:
    return F.struct(bucket_lo(d, edges).alias("lo"), bucket_hi(d, edges).alias("hi"))


def bucket_label(lo: Column, hi: Column) -> Column:
    return F.concat(F.lit("["), lo.cast("int").cast("string"), F.lit(","), hi.cast("int").cast("string"), F.lit(")"))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column, tol: float = 1e-3) -> Column:
    return ~((e1 <= s2 + tol) | (s1 >= e2 - tol))


def inside_clip(cs: Column, ce: Column, s: Column, e: Column) -> Column:
    return (cs <= s) & (s < e) & (e <= ce)


def clip_coordinates(clip_s: Column, clip_e: Column, video_s: Column, video_e: Column, base_video: Column, base_clip: Column) -> Column:
    """Both clip coordinates if both are there, else both video coordinates moved into the clip, else null."""
    given = clip_s.isNotNull() & clip_e.isNotNull()
    moved = video_s.isNotNull() & video_e.isNotNull()
    shift = base_clip - base_video
    return F.when(given, F.struct(clip_s.alias("s"), clip_e.alias("e"))).when(moved, F.struct((video_s + shift).alias("s"), (video_e + shift).alias("e")))


def first_given(*candidates: Column) -> Column:
    """Each end on its own: the first that is not null."""
    return F.coalesce(*candidates)


def clamped_query(pairs: list[tuple[Column, Column]], cs: Column, ce: Column) -> Column:
    """The first complete pair (else the clip), put in order, cut to the clip, and widened around the clip's middle if empty."""
    pair = None
    for a, b in [*pairs, (cs, ce)]:
        there = a.isNotNull() & b.isNotNull()
        value = F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e"))
        pair = F.when(there, value) if pair is None else pair.when(there, value)
    s = F.greatest(cs, F.least(pair["s"], ce))
    e = F.greatest(cs, F.least(pair["e"], ce))
    middle = (cs + ce) / 2
    half = F.least(F.lit(0.01), F.greatest(F.lit(1e-3), (ce - cs) * 1e-4))
    return F.when(s == e, F.struct(F.greatest(cs, middle - half).alias("s"), F.least(ce, middle + half).alias("e"))).otherwise(F.struct(s.alias("s"), e.alias("e")))


def relative_position(cs: Column, ce: Column, s: Column, e: Column) -> Column:
    """Query ends relative to the clip, its relative length d, and its place u among all places of that length."""
    length = F.greatest(ce - cs, F.lit(1e-9))
    qs, qe = (s - cs) / length, (e - cs) / length
    width = qe - qs
    return F.struct(qs.alias("qs_rel"), qe.alias("qe_rel"), width.alias("d_rel"), (qs / F.least(F.greatest(1 - width, F.lit(1e-6)), F.lit(1.0))).alias("u"))


def valid_relative(qs_rel: Column, qe_rel: Column) -> Column:
    return qs_rel.between(0, 1) & qe_rel.between(0, 1) & (qe_rel > qs_rel) & (qe_rel - qs_rel <= 1)


def solved_clip(qs: Column, d: Column, qs_rel: Column, d_rel: Column) -> Column:
    """The clip in which a query of length d at qs has the relative position (qs_rel, d_rel)."""
    length = F.greatest(d / F.greatest(d_rel, F.lit(1e-6)), d)
    start = qs - qs_rel * length
    return F.struct(length.alias("length"), start.alias("cs"), (start + length).alias("ce"))


def anchor_slice(cs: Column, ce: Column, d: Column) -> Column:
    return F.struct(cs.alias("s"), F.least(cs + d, ce).alias("e"))


def milli(x: Column) -> Column:
    """A key to three digits: floor(1000 x + 1/2), the same in every engine."""
    return F.floor(x * 1000 + 0.5).cast("long")


def clip_uid(video: Column, cs: Column, ce: Column, k: Column) -> Column:
    return F.replace(F.concat_ws("_", video, F.floor(F.coalesce(cs, F.lit(0.0))).cast("string"), F.floor(F.coalesce(ce, F.lit(0.0))).cast("string"), k.cast("string")), F.lit(" "), F.lit("_"))


def query_uid(video: Column, clip: Column, k: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", video, clip, k.cast("string")).cast("binary")), 1, 16)


def annotation_uid(clip: Column, k: int = 0) -> Column:
    return F.concat(clip, F.lit(f"-ann{k}"))
