"""Line dedup by an exact set-similarity join, in DataFrame operations alone.

A line is the set of its shingles of ``shingle`` words (five; with one, the set
of its words), lower-cased; a line of fewer words is one shingle.  It is removed if an earlier line, by document id and
line number, has a Jaccard similarity of at least ``p / q`` with it; whether
that line goes itself does not matter.

1. *Exact repeats.*  Lines meet by hash, as counts and first places; later
   repeats go at once, and only first lines take part below.
2. *Prefix.*  Of two similar lines, ordered alike, the first n - o + 1 shingles
   of each (o: the least overlap) share one.  Lines meet by the shingles of
   their prefixes, in order of hash.  In meetings of a few lines all are
   compared.  A shingle that stands too far behind in all its lines to be the
   first that two similar ones share is dropped.
3. *Rarity.*  Shingles of larger meetings are the frequent ones.  The lines of
   these meetings are ordered anew, rare shingles first and those last, and meet
   again by the prefixes of this order: lines that only share a frequent passage
   part.  A pair that the first order misses consists of two such lines, as a
   shingle that a line without them shares is rare.  What is large still is a
   family of lines, similar or nearly so: each is compared with the meeting's
   first and with the one before, and those that stay meet all earlier ones.
4. *Length and position.*  Pairs of lines are dropped whose sizes, or whose
   shingles left from the shared one's places on, can't reach the overlap; a
   similar pair passes at the first shingle that it shares.  In families, bit
   counts of hashed bitmaps bound the overlap before a pair becomes a row.
5. *Verification* on the sets, which are read once for all lines that met
   another; the later line of a similar pair is removed.

Defined results: null texts stay null and have no lines; a line without words
is never removed and matches nothing; every row is a document of its own, rows
with a null id come first, and rows of equal ids are ordered by a hash of their
texts; extra columns stay as they are, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import checkpoint, free_name, keyed, release, small, stored

LOOK_BACK = 6
SHINGLE = 5
#: Lines of one meeting that are ordered in one place, to find neighbours.
CHUNK = 500
# What parts words inside a line
BLANKS = "\t\u000b\f\r"


def _sets(lines: DataFrame, k: int) -> DataFrame:
    """``lines`` with s for line: the hashes of its k-word shingles, distinct, in order.

    Each step is a column that an exploded entry holds: a plain one would be
    computed anew for each use, and inside the generator nothing is compiled.
    """
    others = [c for c in lines.columns if c != "line"]
    parts = F.array_remove(F.split(F.lower("line"), f"[ {BLANKS}]+"), "")
    words = lines.select(*others, F.transform(parts, lambda w: F.xxhash64(w)).alias("w")).select(*others, F.explode(F.array("w")).alias("w"))
    starts = F.slice("w", F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1)))
    windows = F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get("w", i + j) for j in range(1, k)]))
    return words.select(*others, F.sort_array(F.array_distinct(windows)).alias("s")).select(*others, F.explode(F.array("s")).alias("s"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, line_no, line) of the lines that have a word."""
    split = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.where(F.col("line").rlike("[^ \\t\\x0B\\f\\r]"))


def prefix(n: Column, p: int, q: int) -> Column:
    """n - o + 1 for the least overlap o = ceil(n p / q) with any partner."""
    return n - F.ceil(n * p / q).cast("int") + 1


def _reach(p: int, q: int, low_n: str, high_n: str, sum_n: str, least_rest: str) -> Column:
    """Length and position filters at the first shingle that two lines share, at i and j: nothing before is shared, so the overlap is at most the shorter rest from there."""
    return F.expr(f"{p} * {high_n} <= {q} * {low_n} AND ({p} + {q}) * {least_rest} >= {p} * {sum_n}")


def _reach_pair(p: int, q: int, x: str, y: str) -> Column:
    return _reach(p, q, f"least({x}.n, {y}.n)", f"greatest({x}.n, {y}.n)", f"({x}.n + {y}.n)", f"least({x}.n - {x}.i, {y}.n - {y}.i)")


MAP = ("m0", "m1", "m2", "m3")


def _bits(sets: DataFrame) -> DataFrame:
    """``sets`` with a bitmap of the hashes in s, 256 bits in four words; s is in order, so each word is of one stretch of it."""
    below = lambda least: F.size(F.filter("s", lambda h: h < F.lit(least)))
    cut = sets.select("*", F.explode(F.array(F.struct(F.lit(0).alias("c0"), below(-(1 << 62)).alias("c1"), below(0).alias("c2"), below(1 << 62).alias("c3"), F.size("s").alias("c4")))).alias("at"))
    words = [F.expr(f"aggregate(slice(s, at.c{k} + 1, at.c{k + 1} - at.c{k}), 0L, (m, h) -> m | shiftleft(1L, CAST(h & 63 AS INT)))").alias(f"m{k}") for k in range(4)]
    return cut.select(*sets.columns, *words)


def _bound_pair(p: int, q: int, x: str, y: str) -> Column:
    """Whether the overlap can be enough by bit counts: bits of one line that the other lacks are shingles that it lacks."""
    lacks = lambda a, b: " + ".join(f"bit_count({a}.m{k} & ~{b}.m{k})" for k in range(4))
    return F.expr(f"({p} + {q}) * least({x}.n - ({lacks(x, y)}), {y}.n - ({lacks(y, x)})) >= {p} * ({x}.n + {y}.n)")


def repeated_lines(docs: DataFrame, p: int = 4, q: int = 5, shingle: int = SHINGLE) -> DataFrame:
    """(doc, line_no) of the lines to remove; ``docs`` has (doc, text), each doc once."""
    if not 0 < p < q:
        raise ValueError("the threshold must be more than 0 and less than 1")
    place = F.struct("doc", "line_no")
    hashed = _lines(docs).select("doc", "line_no", F.xxhash64("line").alias("h"))
    heads = stored(hashed.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")))
    exchanged = 250 * heads.count()  # about so many bytes a line
    is_first = F.expr("first IS NULL OR (first.doc <=> doc AND first.line_no = line_no)")
    marked = _lines(docs).withColumn("h", F.xxhash64("line")).join(small(heads.where("n > 1").select("h", "first")), "h", "left")
    sets = _sets(marked.where(is_first).select("h", "line"), shingle)
    n = F.size("s")
    met = stored(_met(sets.select("h", n.alias("n"), F.posexplode(F.slice("s", F.lit(1), prefix(n, p, q))).alias("i", "key")), p, q))
    del sets, marked  # frames that are held keep their exchanges
    release(docs.sparkSession, exchanged)
    pairs = stored(_pairs_of_small(met, p, q))
    frequent = met.where(F.col("met") > LOOK_BACK + 1)
    open_ = checkpoint(frequent.select("h").distinct())
    # one more reading of the lines: the sets of all that are in a pair or met many others, and the places of repeats
    own = checkpoint(pairs.select(F.explode(F.array("x", "y")).alias("h")).union(open_).distinct().select("h", F.lit(True).alias("own")))
    tags = heads.join(small(own), "h", "left").where("n > 1 OR own").select("h", "first", "own")
    tagged = _lines(docs).withColumn("h", F.xxhash64("line")).join(small(checkpoint(tags)), "h").withColumn("head", is_first)
    wanted = F.expr("CASE WHEN head AND own THEN line ELSE '' END").alias("line")
    marks = stored(_bits(_sets(tagged.select("h", "first", "own", "head", "doc", "line_no", wanted), shingle)).withColumn("n", F.size("s")))
    later = marks.where("NOT head").select("doc", "line_no")
    held = marks.where("head AND own").select("h", "first", "n", *MAP, "s")
    place_of = held.select("h", "first")

    gone = result = _later_of_similar(held, pairs, p, q)
    if open_.limit(1).count():
        # rare shingles first: the frequent ones of a line are found by a probe of its set, and moved to its end
        words = held.join(small(open_), "h", "left_semi").select("h", "s")
        often = words.select("h", F.explode("s").alias("key")).join(small(checkpoint(frequent.select("key").distinct())), "key").groupBy("h").agg(F.sort_array(F.collect_list("key")).alias("often"))
        turned = stored(words.join(small(checkpoint(often)), "h").select("h", F.size("s").alias("n"), F.slice(F.concat(F.array_except("s", "often"), "often"), F.lit(1), prefix(F.size("s"), p, q)).alias("pre")))
        del words, often
        anew = stored(_met(turned.select("h", "n", F.posexplode("pre").alias("i", "key")), p, q))
        release(docs.sparkSession, exchanged)
        crowd = stored(anew.where(F.col("met") > LOOK_BACK + 1).join(place_of, "h"))
        near = _pairs_of_small(anew, p, q).union(_neighbours(crowd, p, q))
        more = _later_of_similar(held, near.distinct().join(gone.withColumnRenamed("h", "x"), "x", "left_anti"), p, q)
        # what is still large is a family of lines, similar or nearly so: those that stay meet all earlier
        # ones; only pairs that the bitmaps admit become rows, each at the first shingle that it shares
        result = checkpoint(gone.union(more).distinct())
        placed = stored(crowd.join(held.select("h", *MAP), "h").join(turned.select("h", "pre"), "h").select("key", "h", "n", "i", "first", "pre", *MAP))
        rest = placed.join(result, "h", "left_anti")
        pairs = rest.alias("x").join(placed.alias("y"), F.expr("x.key = y.key AND y.first < x.first") & _reach_pair(p, q, "x", "y") & _bound_pair(p, q, "x", "y") & F.expr("NOT arrays_overlap(slice(x.pre, 1, x.i), slice(y.pre, 1, y.i))")).select(F.col("x.h").alias("x"), F.col("y.h").alias("y")).distinct()
        result = result.union(_later_of_similar(held, pairs, p, q))
    return later.unionByName(result.distinct().join(place_of, "h").select("first.doc", "first.line_no"))


def _met(rows: DataFrame, p: int, q: int) -> DataFrame:
    """``rows`` (key, h, n, i) of the keys at which two lines can be similar, with met, the number of their lines.

    The shorter line of a similar pair has its least overlap, 2 n p / (p + q) or
    more, left from the first shared shingle on; a key that no line has so far
    in front is dropped.  Rows are exchanged once, n and i in one word, and read
    twice: for the counts, and for the rows of what met.  x is never null; with
    it both readings need the same columns, so the exchange is the same.
    """
    dealt = rows.select("key", "h", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("at")).repartition("key")
    sums = dealt.groupBy("key").agg(F.count("*").alias("met"), F.max("h").alias("x"), F.max(F.expr(f"{p + q} * (shiftright(at, 32) - (at & 4294967295)) >= {2 * p} * shiftright(at, 32)")).alias("front")).where("met > 1 AND x IS NOT NULL AND front")
    both = dealt.join(sums.select("key", "met").hint("shuffle_hash"), "key")
    return both.select("key", "h", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("i"), "met")


def _pairs_of_small(met: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (x, y) of the lines of each meeting of a few, each pair once."""
    groups = met.where(F.col("met") <= LOOK_BACK + 1).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("h", "n", "i"))).alias("g"))
    others = groups.select("g", F.posexplode("g").alias("k", "x")).select("x", F.explode(F.slice("g", F.col("k") + 2, F.size("g"))).alias("y"))
    return others.where(_reach_pair(p, q, "x", "y")).select(F.col("x.h").alias("x"), F.col("y.h").alias("y")).distinct()


def _neighbours(crowd: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (x later, y earlier) of each line of a large meeting with the meeting's first line and with the one before it in a chunk of bounded size."""
    line = F.struct("h", "n", "i")
    leads = crowd.groupBy("key").agg(F.min(F.struct("first", line.alias("x"))).alias("lead")).select("key", F.col("lead.x").alias("lead"))
    by_place = Window.partitionBy("key", "chunk").orderBy("first")
    sized = crowd.join(leads, "key").select("key", "lead", "first", line.alias("x"), F.pmod(F.xxhash64("h"), F.ceil(F.col("met") / CHUNK).cast("long")).alias("chunk"))
    before = sized.select("x", F.array(F.lag("x").over(by_place), F.col("lead")).alias("ys")).select("x", F.explode("ys").alias("y")).where("y.h <> x.h")
    return before.where(_reach_pair(p, q, "x", "y")).select(F.col("x.h").alias("x"), F.col("y.h").alias("y"))


def _sets_of(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h, first, s) of the lines in pairs (x, y)."""
    lines = small(pairs.select(F.explode(F.array("x", "y")).alias("h")).distinct())
    return held.select("h", "first", "s").join(lines, "h", "left_semi")


def _later_of_similar(held: DataFrame, pairs: DataFrame, p: int, q: int) -> DataFrame:
    """(h) of the later line of every pair (x, y) that is similar; ``held`` has the lines' sets and bitmaps.

    Bitmaps go to all pairs; sets only to those that they admit, and no others are exchanged.
    """
    maps = small(held.select("h", "n", *MAP))
    joined = pairs.alias("p").join(maps.alias("x"), F.expr("p.x = x.h")).join(maps.alias("y"), F.expr("p.y = y.h") & _bound_pair(p, q, "x", "y"))
    fit = checkpoint(joined.select("p.x", "p.y"))
    own = _sets_of(held, fit)
    a, b = own.select(F.col("h").alias("x"), F.col("first").alias("fx"), F.col("s").alias("sx")), own.select(F.col("h").alias("y"), F.col("first").alias("fy"), F.col("s").alias("sy"))
    both = fit.join(a, "x").join(b, "y").select("x", "y", "fx", "fy", F.size("sx").alias("n"), F.size("sy").alias("m"), F.size(F.array_intersect("sx", "sy")).alias("o"))
    similar = both.where(F.lit(q) * F.col("o") >= F.lit(p) * (F.col("n") + F.col("m") - F.col("o")))
    return checkpoint(similar.select(F.when(F.expr("fx > fy"), F.col("x")).otherwise(F.col("y")).alias("h")).distinct())


def dedup(docs: DataFrame, p: int = 4, q: int = 5, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with later similar lines removed from the text, and n_lines_removed (with underscores after it where docs has such a column)."""
    rows = keyed(docs, id_col, text_col)
    removed = repeated_lines(rows.select("doc", "text"), p, q, shingle)
    per_doc = removed.groupBy("doc").agg(F.collect_set("line_no").alias("removed_"))
    per_doc = small(checkpoint(per_doc), 500_000)
    joined = rows.alias("d").join(per_doc.alias("r"), F.expr("d.doc <=> r.doc"), "left")
    # places that stay, looked up in lines held by a lambda: linear in the text's lines
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("r.removed_"))
    held = F.transform(F.array(F.split("d.text", "\n", -1)), lambda lines: F.transform(stay(lines), lambda k: F.get(lines, k)))
    kept = F.array_join(F.get(held, F.lit(0)), "\n")
    text = F.when(F.col("r.removed_").isNull(), F.col("d.text")).otherwise(kept)
    own = [text.alias(c) if c == text_col else F.col(f"d.row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*own, F.coalesce(F.size("r.removed_"), F.lit(0)).alias(free_name(docs, "n_lines_removed")))
