"""Allocation of anchors and fills to clips, in rounds instead of one by one.

Each turn: (a) in every cell with quota left as many hashed unused events try
references that they may be long enough for, some in turn; (b) clips are solved
and checked as columns, the first that fits makes the event an anchor, and one
that overruns its video before uses the event up; (c) the new clips are filled
to exhaustion.  After a turn without anchors, every open event tries, whatever
its quota; turns end when that changes nothing too.

*Fills* are a deferred acceptance in rounds.  Siblings of a clip are the
references of a like length of clip; in each round a task holds the siblings of
a range of lengths (a part of them where they are many) as arrays, beside some
of the clips of that range.  A clip proposes, in an order of its own, those
that fit between what it holds and for which its video still has a long enough
unused event of their cell, until no other of the part fits beside them.  In
each (video, cell) the longest proposals meet the longest events, rank by rank.
A clip with a refused proposal proposes anew in the next round; one without goes
on to its next part for good, as events only get used and clips only get
fuller.  A clip is done with ten queries or without parts, so no clip under ten
has a sibling that still fits.

Ranks by length come from counts by small steps of it and ranks within a step,
never from one task that sorts a cell.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PlanConfig
from ..functions.intervals import anchor_slice, solved_clip
from .materialise import checkpoint as _checkpoint
from .sampling import first_hashed, order_key

#: Seconds of a step of lengths of events and references; and of clips, if their tolerance is none.
STEP, CLIP_STEP = 0.05, 1.0
#: Siblings of a block, which a task holds at once, and pairs of a clip and a sibling that it tries in a round.
FIRST_BLOCK, PAIRS = 1 << 20, 1 << 28
#: Rounds whose fills are put together at once, so that plans don't grow with rounds.
FOLD = 4

#: Columns of placed queries; ids have the events' types.
CLIP = "clip_id string, rank {event}, video_uid {video}, clip_cs double, clip_ce double, event_id {event}, role string, template string, bucket_lo double, qs double, qe double"


def _step(length: Column, width: float) -> Column:
    return F.floor(length / F.lit(width)).cast("long")


def _up_to(counts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """(by, step, upto): rows of ``counts`` (by, step, n) up to each wanted (by, step); steps are few, whatever the rows."""
    both = counts.select(*by, "step", "n", F.lit(0).alias("w")).unionByName(wanted.select(*by, "step").distinct().select(*by, "step", F.lit(0).cast("long").alias("n"), F.lit(1).alias("w")))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("step", "w").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("upto", F.sum("n").over(order)).where("w = 1").select(*by, "step", "upto")


def _numbered(rows: DataFrame, by: list[str], length: str, width: float, name: str, *ties: Column | str) -> tuple[DataFrame, DataFrame]:
    """The rows with their number by length within ``by``, from 0 on, and their counts by step."""
    stepped = rows.withColumn("step", _step(F.col(length), width))
    counts = _checkpoint(stepped.groupBy(*by, "step").agg(F.count("*").alias("n")))
    before = _up_to(counts, counts, by).join(counts, [*by, "step"]).select(*by, "step", (F.col("upto") - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*by, "step").orderBy(length, *ties))
    return stepped.join(before, [*by, "step"]).withColumn(name, F.col("before") + nth - 1).drop("step", "before"), counts


def _proposals(config: PlanConfig):
    """Of each clip, what of the siblings overlaps neither the queries that it holds nor what it proposes before, until nothing else fits."""
    eps, most = config.eps, config.most_queries

    def run(clips: pa.Table, siblings: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        rel, part, d, clen, cell, hashed = (siblings.column(c).to_numpy() for c in ("f_rel", "f_d", "d", "clen", "c", "hashed"))
        order = np.argsort(clen, kind="stable")
        rel, part, d, clen, cell, hashed = (x[order] for x in (rel, part, d, clen, cell, hashed.view(np.uint64)))
        longest = np.full(int(cell.max()) + 1 if len(cell) else 1, -np.inf)
        for at, clip in enumerate(clips.select(["clip_cs", "clip_ce", "length", "own", "own_order", "held", "spare"]).to_pylist()):
            start, end, length = clip["clip_cs"], clip["clip_ce"], clip["length"]
            # the slice is a little wide, lengths are compared exactly below
            low, high = np.searchsorted(clen, (length - config.clip_tolerance - 1e-6, length + config.clip_tolerance + 1e-6))
            if low == high:
                continue
            longest[:] = -np.inf
            for x in clip["spare"]:
                if x["c"] < len(longest):
                    longest[x["c"]] = x["longest"]
            use = slice(low, high)
            qs = start + rel[use] * length
            qe = qs + part[use] * length
            need = qe - qs
            fits = (longest[cell[use]] >= need) & (need >= config.least_query) & (np.abs(need - d[use]) <= config.fill_tolerance * d[use]) & (qs >= start) & (qe <= end)
            fits &= (np.abs(clen[use] - length) <= config.clip_tolerance) & (hashed[use] != np.int64(clip["own"]).view(np.uint64))
            for x in clip["held"]:
                fits &= (qe <= x["qs"] + eps) | (qs >= x["qe"] - eps)
            left = np.flatnonzero(fits)
            qs, qe, need = qs[left], qe[left], need[left]
            key = (hashed[use][left] ^ np.int64(clip["own_order"]).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
            for i in range(most - len(clip["held"])):
                if not len(left):
                    break
                k = int(np.argmin(key))
                s, e = float(qs[k]), float(qe[k])
                rows.append((at, int(cell[low + left[k]]), i, s, e, float(need[k])))
                free = (qe <= s + eps) | (qs >= e - eps)
                free[k] = False
                left, qs, qe, need, key = left[free], qs[free], qe[free], need[free], key[free]
        at, *columns = zip(*rows, strict=True) if rows else ((),) * 6
        own = clips.select(["clip_id", "rank", "video_uid", "clip_cs", "clip_ce"]).take(pa.array(at, pa.int64()))
        for name, kind, values in zip(("c", "i", "qs", "qe", "need"), (pa.int32(), pa.int32(), *[pa.float64()] * 3), columns, strict=True):
            own = own.append_column(name, pa.array(values, kind))
        return own

    return run


def _siblings(refs: DataFrame, cells: DataFrame, config: PlanConfig) -> tuple[DataFrame, DataFrame, int]:
    """(siblings, loads, parts): references by the step of the clips that they may be siblings of, how many there are by (step, part), and into how many parts a step is dealt."""
    near = F.explode(F.sequence(_clip_step("clen", config) - 1, _clip_step("clen", config) + 1))
    rows = refs.join(F.broadcast(cells), ["template", "bucket_lo"]).select("c", "d", F.col("qs_rel").alias("f_rel"), F.col("d_rel").alias("f_d"), "clen", F.xxhash64("ref_id").alias("hashed"), near.alias("step"))
    rows = _checkpoint(rows)
    most = rows.groupBy("step").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // FIRST_BLOCK) or 1
    # the bits that deal out are not those of the shuffle
    rows = rows.withColumn("part", F.pmod(F.xxhash64("hashed"), F.lit(parts)).cast("int"))
    return rows, _checkpoint(rows.groupBy("step", "part").agg(F.count("*").alias("n_siblings"))), parts


def _clip_step(length: str, config: PlanConfig) -> Column:
    """Lengths that are no further apart than the tolerance are of the same step or of neighbours."""
    return _step(F.col(length), config.clip_tolerance or CLIP_STEP)


def _filled(anchors: DataFrame, siblings: tuple[DataFrame, DataFrame, int], cells: DataFrame, free: DataFrame, ledger: DataFrame, config: PlanConfig, seed: int) -> tuple[DataFrame | None, DataFrame]:
    """(placed fills, ledger): clips filled until no sibling fits.

    anchors: placed anchors with length and ref_id; siblings: of _siblings();
    cells: numbered as c; free: events with the c of their cell; ledger: used event_id.
    """
    near, loads, parts = siblings
    none = F.array().cast("array<struct<qs:double,qe:double>>")
    clips = _checkpoint(anchors.select("clip_id", "rank", "video_uid", "clip_cs", "clip_ce", "length", F.xxhash64("ref_id").alias("own"), F.xxhash64("clip_id", F.lit(seed)).alias("own_order"), _clip_step("length", config).alias("step"), F.lit(0).alias("part"), F.array(F.struct("qs", "qe")).alias("held")))
    spare = _checkpoint(free.join(ledger, "event_id", "left_anti").join(clips.select("video_uid").distinct(), "video_uid", "left_semi").select("video_uid", "c", "event_id", "len"))
    fills: list[DataFrame] = []
    by = ["video_uid", "c"]
    while True:
        longest = spare.groupBy(*by).agg(F.max("len").alias("longest")).groupBy("video_uid").agg(F.collect_list(F.struct("c", "longest")).alias("spare"))
        open_ = _checkpoint(clips.join(longest, "video_uid"))
        if not open_.limit(1).count():
            break
        dealt = open_.groupBy("step", "part").agg(F.count("*").alias("n")).join(loads, ["step", "part"]).select("step", "part", F.least(F.ceil(F.col("n") * F.col("n_siblings") / F.lit(PAIRS)), "n").alias("salts"))
        dealt = _checkpoint(dealt)
        asks = open_.join(dealt, ["step", "part"]).withColumn("salt", F.pmod("own_order", "salts"))
        tried = near.join(dealt, ["step", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        group = ["step", "part", "salt"]
        kinds = {f.name: f.dataType.simpleString() for f in open_.schema}
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("clip_id", "rank", "video_uid", "clip_cs", "clip_ce")) + ", c int, i int, qs double, qe double, need double"
        proposed = _checkpoint(asks.groupBy(*group).cogroup(tried.groupBy(*group)).applyInArrow(_proposals(config), schema))
        # the k-th longest proposal meets the k-th longest event; the first always fits
        within = Window.partitionBy(*by)
        asked = proposed.withColumn("k", F.row_number().over(within.orderBy(F.desc("need"), "rank", "i")))
        offered = spare.join(asked.groupBy(*by).agg(F.max("k").alias("most_k")), by)
        offered = offered.withColumn("k", F.row_number().over(within.orderBy(F.desc("len"), order_key("event_id", seed=seed), "event_id"))).where("k <= most_k")
        matched = asked.join(offered.select(*by, "k", "event_id", "len"), [*by, "k"]).where("len >= need")
        # an event of several cells goes to the smallest rank
        owner = F.row_number().over(Window.partitionBy("event_id").orderBy("rank", "i", "clip_id"))
        won = _checkpoint(matched.withColumn("o", owner).where("o = 1").select("clip_id", "rank", "video_uid", "clip_cs", "clip_ce", "event_id", F.lit("f").alias("role"), "c", "qs", "qe"))
        fills.append(won)
        if len(fills) == FOLD:
            fills = [_checkpoint(functools.reduce(DataFrame.unionByName, fills))]
        some = proposed.groupBy("clip_id").agg(F.count("*").alias("proposals"))
        got = won.groupBy("clip_id").agg(F.collect_list(F.struct("qs", "qe")).alias("got"))
        after = open_.drop("spare").join(some, "clip_id", "left").join(got, "clip_id", "left").withColumn("got", F.coalesce("got", none))
        # what all of a part's proposals won leaves no other of it that fits
        through = F.coalesce("proposals", F.lit(0)) == F.size("got")
        after = after.withColumn("part", F.col("part") + through.cast("int")).withColumn("held", F.concat("held", "got")).drop("proposals", "got")
        clips = _checkpoint(after.where((F.size("held") < config.most_queries) & (F.col("part") < parts)))
        spare = _checkpoint(spare.join(won.select("event_id"), "event_id", "left_anti").join(clips.select("video_uid").distinct(), "video_uid", "left_semi").select(*spare.columns))
    if not fills:
        return None, ledger
    placed = _checkpoint(functools.reduce(DataFrame.unionByName, fills).join(F.broadcast(cells), "c"))
    return placed, _checkpoint(ledger.union(placed.select("event_id")))


def allocate(references: DataFrame, events: DataFrame, video_end: DataFrame, plan: DataFrame, config: PlanConfig = PlanConfig(), most_rounds: int | None = None, seed: int = 42, tries: int = 16, geom_only: bool = False) -> DataFrame:
    """Rows of CLIP: placed queries.

    references: (ref_id, template, bucket_lo, d, qs_rel, d_rel, clen); events:
    (event_id, video_uid, cs, ce, template, bucket_lo), an event once for each
    of its templates; video_end: (video_uid, max_ts); plan: (template,
    bucket_lo, target).  An event tries ``tries`` references a turn; there is no
    bound of turns unless ``most_rounds`` is given.  With ``geom_only`` templates
    don't matter: cells are buckets, and placed queries have an empty template.
    """
    spark = events.sparkSession
    if geom_only:
        references, events = (t.withColumn("template", F.lit("")) for t in (references, events))
        events = events.dropDuplicates(["event_id"])
        plan = plan.groupBy("bucket_lo").agg(F.sum("target").alias("target")).select(F.lit("").alias("template"), "bucket_lo", "target")
    cell = ["template", "bucket_lo"]
    refs = _checkpoint(references.where((F.col("d") >= config.least_query) & (F.col("d_rel") > 0)))
    by_length, counts = _numbered(refs, cell, "d", STEP, "k", order_key("ref_id", seed=seed), "ref_id")
    by_length = _checkpoint(by_length)
    cells = _checkpoint(refs.select(*cell).distinct().withColumn("c", F.row_number().over(Window.orderBy(*cell)) - 1))  # few by nature
    siblings = _siblings(refs, cells, config)
    # an event may be long enough for the first n_fit references of its cell; in its last step lengths decide
    timed = events.join(video_end, "video_uid").withColumn("len", F.col("ce") - F.col("cs")).withColumn("step", _step(F.col("len"), STEP))
    free = _checkpoint(timed.join(_up_to(counts, timed, cell).select(*cell, "step", F.col("upto").alias("n_fit")), [*cell, "step"]).join(F.broadcast(cells), cell).drop("step"))
    kinds = {k: events.schema[c].dataType.simpleString() for k, c in (("event", "event_id"), ("video", "video_uid"))}
    placed = spark.createDataFrame([], CLIP.format(**kinds))
    ledger = spark.createDataFrame([], f"event_id {kinds['event']}")
    everyone = False
    for turn in itertools.count() if most_rounds is None else range(most_rounds):
        done = placed.groupBy(*cell).agg(F.count("*").alias("placed"))
        left = _checkpoint(plan.join(done, cell, "left").withColumn("left", F.col("target") - F.coalesce("placed", F.lit(0))).where("left > 0").select(*cell, "left"))
        if not left.limit(1).count():
            break
        limits = left.select(*cell, F.col("left").alias("limit_"))
        open_events = free.where("n_fit > 0").join(ledger, "event_id", "left_anti").join(left.select(*cell), cell, "left_semi").withColumn("h_", order_key("event_id", seed=seed + turn))
        chosen = open_events if everyone else first_hashed(open_events, cell, limits, "event_id")
        chosen = chosen.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("k", F.pmod(F.xxhash64("event_id", "try", F.lit(seed + turn)), F.col("n_fit")))
        pairs = chosen.join(by_length.select(*cell, "k", "ref_id", "d", "qs_rel", "d_rel", "clen"), [*cell, "k"]).where("d <= len")
        part = pairs.withColumn("q", anchor_slice(F.col("cs"), F.col("ce"), F.col("d"))).withColumn("c", solved_clip(F.col("q.s"), F.col("q.e") - F.col("q.s"), F.col("qs_rel"), F.col("d_rel")))
        inside = (F.col("q.s") >= F.col("c.cs") - config.eps) & (F.col("q.e") <= F.col("c.ce") + config.eps) & (F.col("q.e") - F.col("q.s") >= config.least_query)
        over = F.col("c.ce") > F.col("max_ts") + config.eps
        first = F.row_number().over(Window.partitionBy("event_id").orderBy("try", *cell))
        fit = _checkpoint(part.where(inside & (over | (F.col("c.cs") >= 0))).withColumn("over", over).withColumn("nth", first).where("nth = 1"))
        if not fit.limit(1).count():
            if everyone:
                break
            everyone = True
            continue
        everyone = False
        tried = _checkpoint(first_hashed(fit, cell, limits, "event_id"))
        anchors = _checkpoint(tried.where("NOT over").select(
            F.concat(F.lit(f"{turn}-"), F.col("event_id").cast("string")).alias("clip_id"), F.col("event_id").alias("rank"), "video_uid", F.col("c.cs").alias("clip_cs"), F.col("c.ce").alias("clip_ce"), F.col("c.length").alias("length"),
            "event_id", F.lit("a").alias("role"), *cell, F.col("q.s").alias("qs"), F.col("q.e").alias("qe"), "ref_id",
        ))
        # every anchor is placed; an event whose clip overruns is not tried again
        ledger = _checkpoint(ledger.union(tried.select("event_id")))
        if not anchors.limit(1).count():
            continue
        fills, ledger = _filled(anchors, siblings, cells, free, ledger, config, seed)
        new = anchors.select(*placed.columns)
        placed = _checkpoint(placed.unionByName(new if fills is None else new.unionByName(fills.select(*placed.columns))))
    return placed
