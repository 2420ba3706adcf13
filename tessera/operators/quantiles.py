"""Exact quantiles of groups of any size.

No task holds a group. Each wanted rank starts with the range of its group's values; a round counts the values of that range between splits, which combine before they are
dealt, and keeps the bucket that holds the rank, with its least and greatest value as the new range. The splits come from sketches of a bucket's values, so buckets are about as
large as each other however the values lie; counts are exact. It ends where a range is one value, after about log(values) / log(SPLITS) rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import with_checkpoints

SPLITS, ACCURACY = 64, 500
#: Parts in which a group's values meet its ranges.
PARTS = 32


def ranks_of(kind: str, p: float, n: Column) -> tuple[Column, Column, Column]:
    """The ranks (from 1) below and above the quantile, and the share of the way between them. nearest: the least rank with a share of p of all; between: as a line through the values."""
    exact = F.lit(str(p)).cast("decimal(12,9)")
    if kind == "nearest":
        rank = F.greatest(F.ceil(exact * n).cast("long"), F.lit(1).cast("long"))
        return rank, rank, F.lit(0.0)
    at = exact * (n - 1)
    low = F.floor(at).cast("long")
    return low + 1, F.ceil(at).cast("long") + 1, (at - low).cast("double")


def quantiles(rows: DataFrame, by: list[str], value: str, asked: dict[str, tuple[str, float]], rounds: int = 60) -> DataFrame:
    """by, and a double for each name in asked: ("nearest" or "between", p). Nulls and NaN are no values; groups without values, and empty tables, give no rows; null keys are a group."""
    v = F.col(value).cast("double")
    base = with_checkpoints(rows).filter(v.isNotNull() & ~F.isnan(v)).select(F.struct(*by, F.lit(0).alias("_all")).alias("g"), v.alias("v"), F.pmod(F.hash(v), F.lit(PARTS)).alias("part")).checkpoint()
    splits = F.percentile_approx("v", [i / SPLITS for i in range(1, SPLITS)], ACCURACY).alias("splits")
    whole = base.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), splits).checkpoint()
    wanted = {name: ranks_of(kind, p, F.col("n")) for name, (kind, p) in asked.items()}
    ranks = F.array_distinct(F.array(*(r for low, high, _ in wanted.values() for r in (low, high))))
    open_ = whole.select("g", "lo", "hi", "splits", F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("rank"))
    done: list[DataFrame] = []
    for _ in range(rounds):
        open_ = open_.checkpoint()
        done.append(open_.filter("lo = hi").select("g", "rank", F.col("lo").alias("x")))
        open_ = open_.filter("lo < hi")
        if open_.isEmpty():
            break
        ranges = open_.select("g", "lo", "hi", "splits").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        # the ends have buckets of their own, so every round gets on
        step = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), SPLITS + 1).otherwise(F.size(F.filter("splits", lambda x: x <= F.col("v"))))
        held = base.join(ranges, ["g", "part"]).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        counts = held.groupBy("g", "lo", "hi", step.alias("step")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"), splits.alias("next"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("step")))
        there = (F.col("rank") > F.col("below") + F.col("upto") - F.col("c")) & (F.col("rank") <= F.col("below") + F.col("upto"))
        open_ = open_.join(upto, ["g", "lo", "hi"]).filter(there).select("g", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("next").alias("splits"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), "rank")
    else:
        raise RuntimeError(f"no result after {rounds} rounds")
    found = reduce(DataFrame.unionByName, done).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x"))

    def result(low: Column, high: Column, share: Column) -> Column:
        a, b = F.element_at("x", low), F.element_at("x", high)
        return F.when(a == b, a).otherwise(a + (b - a) * share)

    return whole.join(found, "g").select(*(F.col(f"g.{b}").alias(b) for b in by), *(result(*w).alias(name) for name, w in wanted.items()))
