"""Diagnostics of distributions, as aggregates and window sums."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DURATION_EDGES
from .joins import aligned
from .windows import running_sums


def value_fractions(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, fraction) over rows with a value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per value


def bucket_histogram(rows: DataFrame, template: str | None = None) -> DataFrame:
    """Rows per bucket, empty buckets with 0."""
    by = [template] if template else []
    edges = rows.sparkSession.createDataFrame([(lo, hi) for lo, hi in zip(DURATION_EDGES, DURATION_EDGES[1:])], "bucket_lo double, bucket_hi double")
    counts = rows.groupBy(*by, "bucket_lo").agg(F.count("*").alias("n"))
    every = rows.select(*by).distinct().join(F.broadcast(edges)) if by else edges
    return every.join(counts, [*by, "bucket_lo"], "left").select(*by, "bucket_lo", "bucket_hi", F.coalesce("n", F.lit(0)).alias("n"))


def distribution_pairs(rows: DataFrame, value: str, is_first: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, cdf_first, cdf_second, n_first, n_second): both samples' distribution functions at every value of either.

    Values are counted first, so the running sums go over distinct values.  An
    empty sample has no function.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.col(is_first).cast("long")).alias("a"), F.sum((~F.col(is_first)).cast("long")).alias("b"))
    run = running_sums(counts, ["a", "b"], [value], by)
    return run.select(*by, value, (F.col("run_a") / F.nullif("all_a", F.lit(0))).alias("cdf_first"), (F.col("run_b") / F.nullif("all_b", F.lit(0))).alias("cdf_second"), F.col("all_a").alias("n_first"), F.col("all_b").alias("n_second"))


def ks_statistic(rows: DataFrame, value: str, is_first: str, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """(by, ks, n_first, n_second): the largest gap of the two samples' distribution functions."""
    gap = F.abs(F.col("cdf_first") - F.col("cdf_second"))
    found = distribution_pairs(rows, value, is_first, by).groupBy(*(by or []), "n_first", "n_second").agg(F.max(gap).alias("ks"))
    return found.withColumn("ks", F.when((F.col("n_first") >= least) & (F.col("n_second") >= least), F.col("ks")))


def share_pairs(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, share_first, share_second): counts n of two samples as shares of each, over the keys of either; an empty sample's are 0."""
    both = aligned(first.withColumnRenamed("n", "a"), second.withColumnRenamed("n", "b"), keys, "a", "b")
    total = both.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    return both.join(F.broadcast(total)).select(*keys, *[F.coalesce(F.col(n) / F.nullif(s, F.lit(0)), F.lit(0.0)).alias(f"share_{c}") for n, s, c in (("a", "sa", "first"), ("b", "sb", "second"))])


def heatmaps(first: DataFrame, second: DataFrame, template: str) -> DataFrame:
    """(template, bucket_lo, bucket_hi, share_first, share_second): two joint distributions on one grid, every bucket of every template of either."""
    return share_pairs(bucket_histogram(first, template), bucket_histogram(second, template), [template, "bucket_lo", "bucket_hi"])


def rebuilt_chi_square(first: DataFrame, second: DataFrame, keys: list[str], n_first: int, n_second: int) -> DataFrame:
    """chi_square() of counts that are rebuilt, rounded, from two samples' (keys, share) and sizes."""
    return chi_square(rebuilt_counts(first, keys, "share", n_first), rebuilt_counts(second, keys, "share", n_second), keys)


def chi_square(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(chi2, dof, n_empty): expected counts scaled to the observed mass; cells that expect nothing are counted, not divided by."""
    both = aligned(observed.withColumnRenamed("n", "o"), expected.withColumnRenamed("n", "e"), keys, "o", "e")
    total = both.agg(F.sum("o").alias("so"), F.sum("e").alias("se"))
    scaled = both.join(F.broadcast(total)).withColumn("x", F.col("e") * F.col("so") / F.col("se"))
    term = F.when(F.col("x") > 0, (F.col("o") - F.col("x")) ** 2 / F.col("x"))
    return scaled.agg(F.sum(term).alias("chi2"), (F.count("*") - 1).alias("dof"), F.sum((F.col("x") == 0).cast("long")).alias("n_empty"))


def kl_divergence(p: DataFrame, q: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    """(kl): sum p ln(p / q) over the union of supports, both smoothed by eps and scaled to 1."""
    both = aligned(p.withColumnRenamed("n", "p"), q.withColumnRenamed("n", "q"), keys, "p", "q")
    total = both.agg(F.sum(F.col("p") + eps).alias("sp"), F.sum(F.col("q") + eps).alias("sq"))
    x = both.join(F.broadcast(total)).select(((F.col("p") + eps) / F.col("sp")).alias("x"), ((F.col("q") + eps) / F.col("sq")).alias("y"))
    return x.agg(F.sum(F.col("x") * F.ln(F.col("x") / F.col("y"))).alias("kl"))


#: Rows of a bracket that are sorted in one row, and the accuracy of the sketches that narrow brackets.
FEW, ACCURACY = 10_000, 10_000


def quantiles(rows: DataFrame, value: str, fractions: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours; null where there are no values.

    Selection by refinement: each rank is held in a bracket of values, sketches
    of the rows inside propose a narrower one, and counts prove it.  A pass
    leaves a few thousandths of the rows, so two or three settle any table; then
    the few rows of a bracket are sorted.  No buffer grows with the table.
    """
    own = rows.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    total = own.count()
    if not total:
        return [None for _ in fractions]
    ranks = sorted({r for f in fractions for r in (math.floor(f * (total - 1)), math.ceil(f * (total - 1)))})
    # value bounds (inclusive), rows below them and in them
    brackets = {r: (-math.inf, math.nan, 0, total) for r in ranks}  # NaN is the largest double
    done: dict[int, float] = {}
    while len(done) < len(ranks):
        wide = [r for r in ranks if r not in done]
        inside = {r: F.col("x").between(F.lit(brackets[r][0]), F.lit(brackets[r][1])) for r in wide}
        small_ = [r for r in wide if brackets[r][3] <= FEW]
        if small_:
            found = own.agg(*[F.sort_array(F.collect_list(F.when(inside[r], F.col("x"))))[r - brackets[r][2]].alias(str(r)) for r in small_]).first()
            done |= {r: found[str(r)] for r in small_}
            continue
        part = lambda r, d: F.lit(min(1.0, max(0.0, (r - brackets[r][2]) / brackets[r][3] + d)))
        proposed = own.agg(*[F.percentile_approx(F.when(inside[r], F.col("x")), F.array(part(r, -2.5 / ACCURACY), part(r, 2.5 / ACCURACY)), F.lit(ACCURACY)).alias(str(r)) for r in wide]).first()
        bounds = {r: tuple(proposed[str(r)]) for r in wide}
        tests = {"under": lambda x, lo, hi: x < lo, "low": lambda x, lo, hi: x == lo, "between": lambda x, lo, hi: (x > lo) & (x < hi), "high": lambda x, lo, hi: (x == hi) & (hi > lo)}
        counted = own.agg(*[F.count(F.when(test(F.col("x"), *map(F.lit, bounds[r])), 1)).alias(f"{name}_{r}") for r in wide for name, test in tests.items()]).first()
        for r in wide:
            (lo, hi), (low, high, below, n) = bounds[r], brackets[r]
            edges = [counted[f"{name}_{r}"] for name in tests]
            upto = list(itertools.accumulate(edges))
            if r < upto[0]:
                brackets[r] = low, math.nextafter(lo, -math.inf), below, upto[0] - below
            elif r < upto[1]:
                done[r] = lo
            elif r < upto[2]:
                brackets[r] = math.nextafter(lo, math.inf), math.inf if math.isnan(hi) else math.nextafter(hi, -math.inf), upto[1], edges[2]
            elif r < upto[3]:
                done[r] = hi
            else:
                brackets[r] = math.nextafter(hi, math.inf), high, upto[3], below + n - upto[3]

    def between(at: float) -> float:
        low, high = done[math.floor(at)], done[math.ceil(at)]
        return low if low == high else low + (high - low) * (at - math.floor(at))

    return [between(f * (total - 1)) for f in fractions]


def freedman_diaconis(rows: DataFrame, value: str, least: int = 10, most: int = 200) -> DataFrame:
    """(n, q25, q75, width, bins): bins of width 2 IQR / cbrt(n), their number kept within bounds."""
    low, high = quantiles(rows, value, [0.25, 0.75])
    s = rows.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    s = s.withColumns({"q25": F.lit(low).cast("double"), "q75": F.lit(high).cast("double")})
    s = s.withColumn("width", 2 * (F.col("q75") - F.col("q25")) / F.cbrt("n"))
    bins = F.when(F.col("width") > 0, F.ceil((F.col("hi") - F.col("lo")) / F.col("width"))).otherwise(F.lit(least))
    return s.select("n", "q25", "q75", "width", F.least(F.greatest(bins, F.lit(least)), F.lit(most)).cast("long").alias("bins"))


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int, by: list[str] | None = None, weight: str | None = None, percent: bool = False) -> DataFrame:
    """(by, bin, n) over [lo, hi], the last bin closed; n may be a sum of weights, or a share of the group in percent."""
    width = (hi - lo) / bins
    inside = rows.where(F.col(value).between(lo, hi))
    at = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("long")
    counts = inside.groupBy(*(by or []), at.alias("bin")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    if not percent:
        return counts
    return counts.withColumn("n", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*(by or []))))  # one row per bin


def pivot_fractions(rows: DataFrame, key: str) -> DataFrame:
    """One row per key with the share of all rows in each bucket; the buckets are named, so the pivot needs no extra pass."""
    wide = rows.groupBy(key).pivot("bucket_lo", list(DURATION_EDGES[:-1])).count().na.fill(0)
    names = {str(lo): f"b{int(lo)}" for lo in DURATION_EDGES[:-1]}
    total = sum((F.col(f"`{c}`") for c in names), F.lit(0))
    every = F.sum(total).over(Window.partitionBy())
    return wide.select(key, *[(F.col(f"`{c}`") / every).alias(n) for c, n in names.items()])


def queries_per_clip(rows: DataFrame, clip: list[str]) -> DataFrame:
    """(n_queries, n_clips, percent)."""
    each = rows.groupBy(*clip).agg(F.count("*").alias("n_queries")).groupBy("n_queries").agg(F.count("*").alias("n_clips"))
    return each.withColumn("percent", 100.0 * F.col("n_clips") / F.sum("n_clips").over(Window.partitionBy()))


def window_ratio(rows: DataFrame, window: list[str], alarm: float = 0.9) -> DataFrame:
    """(n_queries, n_windows, ratio, alarm)."""
    each = rows.groupBy(*window).agg(F.count("*").alias("n"))
    out = each.agg(F.sum("n").alias("n_queries"), F.count("*").alias("n_windows"))
    return out.withColumn("ratio", F.col("n_queries") / F.col("n_windows")).withColumn("alarm", F.col("n_windows") / F.col("n_queries") > alarm)


def rebuilt_counts(fractions: DataFrame, keys: list[str], fraction: str, total: int) -> DataFrame:
    """(keys, n): counts rebuilt from fractions of a known total, halves to even."""
    return fractions.select(*keys, F.bround(F.col(fraction) * total).cast("long").alias("n"))
