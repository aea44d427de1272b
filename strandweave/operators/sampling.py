"""Sampling by hash order: the same rows in every run, in any partitioning."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MergeConfig
from ..functions.intervals import bucket_lo


def order_key(*parts: Column | str, seed: int = MergeConfig().seed) -> Column:
    """A key that stands for a random number: md5 of the seed and the parts."""
    text = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[t.cast("string") for t in text]).cast("binary"))


def shuffled(rows: DataFrame, *key: str, seed: int = MergeConfig().seed) -> DataFrame:
    return rows.orderBy(order_key(*key, seed=seed), *key)


def _same(left: list[str], right: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def _smallest(rows: DataFrame, by: list[str], limits: DataFrame, digits: int = 4) -> DataFrame:
    """Rows whose hash ``h_`` may be among the first ``limit_`` of their group.

    Hashes are counted by their first digits, so that only rows up to the digits
    at which a group's limit is reached are ranked, whatever the group's size.
    """
    keys, own = [f"key_{i}" for i in range(len(by))], [f"own_{i}" for i in range(len(by))]
    first = F.left("h_", F.lit(digits))
    counts = rows.groupBy(*[F.col(c).alias(k) for k, c in zip(keys, by, strict=True)], first.alias("p_")).agg(F.count("*").alias("n_"))
    reached = counts.withColumn("reached_", F.sum("n_").over(Window.partitionBy(*keys).orderBy("p_")))
    bounds = limits.select(*[F.col(c).alias(k) for k, c in zip(own, by, strict=True)], "limit_")
    cut = reached.join(bounds, _same(keys, own)).where("reached_ >= limit_").groupBy(*keys).agg(F.min("p_").alias("cut_"))
    return rows.join(cut, _same(by, keys), "left").where(F.col("cut_").isNull() | (first <= F.col("cut_"))).select(*rows.columns)


def first_hashed(rows: DataFrame, by: list[str], limits: DataFrame, *ties: str) -> DataFrame:
    """The first ``limit_`` rows of each group by their hash ``h_``; groups without a limit have none."""
    few = _smallest(rows, by, limits).join(limits, by)
    return few.withColumn("rank_", F.row_number().over(Window.partitionBy(*by).orderBy("h_", *ties))).where("rank_ <= limit_").drop("rank_", "limit_")


def at_most(rows: DataFrame, n: int, by: list[str], key: list[str], seed: int = MergeConfig().seed) -> DataFrame:
    """At most ``n`` rows of each group, without replacement."""
    hashed = rows.withColumn("h_", order_key(*key, seed=seed))
    few = _smallest(hashed, by, rows.select(*by).distinct().withColumn("limit_", F.lit(n)))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("h_", *key))
    return few.withColumn("rank_", rank).where(F.col("rank_") <= n).drop("rank_", "h_")


#: What a candidate of a pool is longer than.
LEAST_LENGTH = 1e-9


def candidate_pool(rows: DataFrame, start: str, end: str, template: str = "template") -> DataFrame:
    """Adds d and bucket_lo to the rows that a cell can draw from: those with numbers as ends, some length, and a template."""
    ends = [F.col(c).try_cast("double") for c in (start, end)]
    timed = rows.withColumn("d", ends[1] - ends[0]).where((F.col("d") > LEAST_LENGTH) & ~F.isnan("d") & (F.col(template) != ""))
    return timed.withColumn("bucket_lo", bucket_lo(F.col("d")))


def quota_sample(pool: DataFrame, plan: DataFrame, cell: list[str], key: list[str], seed: int = MergeConfig().seed) -> DataFrame:
    """Exactly ``target`` rows of every cell that has any.

    A cell with enough rows gives them without replacement; one with fewer
    gives all and repeats some, each repeat drawn by its own hash.  ``draw``
    numbers a row's uses.  Cells without rows are quota_deficits().
    """
    few = _smallest(pool.withColumn("h_", order_key(*key, seed=seed)), cell, plan.select(*cell, F.col("target").alias("limit_")))
    ranked = few.withColumn("rank_", F.row_number().over(Window.partitionBy(*cell).orderBy("h_", *key))).drop("h_")
    sizes = pool.groupBy(*cell).agg(F.count("*").alias("size_"))
    wanted = plan.select(*cell, "target").join(sizes, cell)
    first = ranked.join(wanted, cell).where(F.col("rank_") <= F.col("target")).withColumn("draw", F.lit(0))
    again = wanted.where(F.col("target") > F.col("size_")).withColumn("draw", F.explode(F.sequence(F.lit(1), (F.col("target") - F.col("size_")).cast("int"))))
    pick = F.conv(F.substring(order_key(*[F.col(c) for c in cell], F.col("draw"), seed=seed), 1, 8), 16, 10).cast("long")
    again = again.withColumn("rank_", F.pmod(pick, F.col("size_")) + 1)
    repeats = again.join(ranked, [*cell, "rank_"])
    columns = [*pool.columns, "draw"]
    return first.select(*columns).unionByName(repeats.select(*columns))


def quota_deficits(pool: DataFrame, plan: DataFrame, cell: list[str]) -> DataFrame:
    """Cells of the plan without any row, with all that they lack."""
    return plan.where("target > 0").join(pool.select(*cell).distinct(), cell, "left_anti").select(*cell, F.col("target").alias("deficit"))


def best(rows: DataFrame, by: list[str], score: str, *ties: str) -> DataFrame:
    """The row with the highest score of each group, the smallest tie-breaks first."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *ties))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def top_entities(rows: DataFrame, key: str, k: int, least: int = 2) -> DataFrame:
    """The ``k`` keys with most rows, at least ``least``."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), key).limit(k)
