"""Exact order statistics of many groups, by counting and refining ranges of values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.matrix import small_side
from ..sources.store import discard, written

#: Parts that a pass splits a range of values into.
SPLIT = 512


def _scaled(v: Column) -> Column:
    """Rises with v, and spreads magnitudes evenly: logarithms of either sign, 0 between them."""
    return F.signum(v) * F.when(v == 0, 0.0).otherwise(F.log(F.abs(v)) + 750)


def _part(v: Column, lo: Column, hi: Column, spread: bool) -> Column:
    """The part of a range that a value lies in; the least and the greatest value have parts of their own."""
    halves = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    inside = F.coalesce(F.try_divide(_scaled(v) - _scaled(lo), _scaled(hi) - _scaled(lo)), halves) if spread else halves
    middle = F.floor(F.nanvl(inside, F.lit(0.5)) * (SPLIT - 2)).cast("int")
    return F.when(v == lo, -1).when(v == hi, SPLIT).otherwise(F.least(F.greatest(middle, F.lit(0)), F.lit(SPLIT - 2)))


def order_statistics(frame: DataFrame, keys: list[str], value: str, places: Callable[[Column], Column]) -> DataFrame:
    """keys, n, stats: for each group its number of values, and those at some places of their order.

    places makes an array of places, from 0, of n; a place outside gives no entry. Nulls and NaN are no values; groups
    without values have no row. Every pass counts the values of the ranges that still hold a wanted place in up to
    SPLIT parts, before they are shuffled, and goes on with the parts that hold one, so no task sees a
    group as a whole, however large it is. Passes split evenly and by magnitude in turn, so few are needed for
    any values; equal values are told apart from none, and end a range. A pass's ranges are a written table.
    """
    group = keys or ["_all"]
    rows = frame if keys else frame.withColumn("_all", F.lit(0))
    rows = rows.select(*group, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)").withColumn("_v", F.col("_v") + 0.0)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    wanted = sizes.select(*group, "n", "lo", "hi", F.posexplode(places(F.col("n"))).alias("_i", "_place")).where("_place >= 0 and _place < n")
    ranges = written(wanted.withColumn("below", F.lit(0).cast("long")))
    turn = 0
    while ranges.where("lo < hi").limit(1).count():
        lists = ranges.where("lo < hi").groupBy(*group).agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges"))
        inside = rows.join(small_side(lists), group).select(*group, "_v", F.explode(F.filter("_ranges", lambda r: (F.col("_v") >= r["lo"]) & (F.col("_v") <= r["hi"]))).alias("_r"))
        part = _part(F.col("_v"), F.col("_r.lo"), F.col("_r.hi"), turn % 2 == 1)
        counts = inside.select(*group, F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi"), part.alias("_part"), "_v")
        counts = counts.groupBy(*group, "lo", "hi", "_part").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        earlier = W.partitionBy(*group, "lo", "hi").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        place = F.col("_place") - F.col("below")
        found = ranges.join(counts, [*group, "lo", "hi"]).where((place >= F.col("_before")) & (place < F.col("_before") + F.col("_n")))
        found = found.select(*group, "n", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "_i", "_place", (F.col("below") + F.col("_before")).alias("below"))
        before, ranges = ranges, written(found.unionByName(ranges.where("lo = hi")))
        discard(before)
        turn += 1
    each = F.transform(F.array_sort(F.collect_list(F.struct("_i", "lo"))), lambda x: x["lo"])
    return ranges.groupBy(*group).agg(F.first("n").alias("n"), each.alias("stats")).select(*keys, "n", "stats")


def quantile_cuts(expr: DataFrame, bins: int) -> DataFrame:
    """var_id, cuts: rising values that deal a variable's values into up to bins parts of like sizes."""
    every = order_statistics(expr, ["var_id"], "value", lambda n: F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.floor(n * i / bins).cast("long")))
    return every.select("var_id", F.array_distinct("stats").alias("cuts"))


def summary(frame: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys,) mean, stdev (population), median, p25, p75, least and most; order statistics are elements at n div 2, n div 4 and 3n div 4."""
    group = keys or ["_all"]
    rows = frame if keys else frame.withColumn("_all", F.lit(0))
    places = lambda n: F.array(F.lit(0).cast("long"), *[F.floor(n * k / 4).cast("long") for k in (1, 2, 3)], n - 1)
    means = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))
    at = {name: F.get("stats", F.lit(i)).alias(name) for i, name in enumerate(("least", "p25", "median", "p75", "most"))}
    return order_statistics(rows, group, value, places).join(means, group).select(*(keys or []), "mean", "stdev", at["median"], at["p25"], at["p75"], at["least"], at["most"])
