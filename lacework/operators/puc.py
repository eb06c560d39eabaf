"""Proportional unique contribution of pairs, over triples or by sorted prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.matrix import small_side
from .measures import unique_shares


def _by_pair(shares: DataFrame) -> DataFrame:
    return shares.groupBy(F.least("about", "by").alias("x"), F.greatest("about", "by").alias("y")).agg(F.sum("share").alias("puc"))


def puc_direct(si: DataFrame, nobs: int) -> DataFrame:
    """x, y, puc: the sum over third variables of what is not redundant, for both orders. Cubic work, in tiles: the cross-check."""
    return _by_pair(unique_shares(si, nobs))


def puc_direct_sampled(si: DataFrame, nobs: int, subset: DataFrame) -> DataFrame:
    """x, y, puc: the mean over rounds of puc_direct() over each round's third variables (round, var_id).

    A third variable counts as often as rounds have it, so all rounds are one pass. A weight for each variable goes
    to all tasks.
    """
    rounds = subset.select("round").distinct().count()
    held = subset.groupBy("var_id").agg(F.count("*").alias("n")).collect()
    return _by_pair(unique_shares(si, nobs, {r["var_id"]: r["n"] / max(rounds, 1) for r in held}))


def min_sums(lmr: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """(round,) about, by, min_sum: over states and third variables, the sum of the lesser lmr.

    In order of lmr all earlier values are less, so the sum is a prefix sum and a count: n log n for a state in
    place of n squared. With a subset (round, var_id) only its variables count as third ones, others are
    looked up among them with weight 0.
    """
    keys = ["about", "state"]
    if subset is None:
        rows = lmr.withColumn("member", F.lit(1))
    else:
        keys = ["round", *keys]
        rounds = sorted(r["round"] for r in subset.select("round").distinct().collect())
        marks = subset.select("round", F.col("var_id").alias("by"), F.lit(1).alias("member"))
        each = lmr.withColumn("round", F.explode(F.array(*map(F.lit, rounds)).cast("array<int>")))
        rows = each.join(small_side(marks), ["round", "by"], "left").fillna(0, ["member"])
    order = W.partitionBy(*keys).orderBy("lmr", "by")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    low = F.coalesce(F.sum(F.col("lmr") * F.col("member")).over(before), F.lit(0.0))
    rank = F.sum("member").over(order.rowsBetween(W.unboundedPreceding, 0))
    above = F.sum("member").over(W.partitionBy(*keys)) - rank
    parts = rows.select(*keys, "by", (low + above * F.col("lmr")).alias("part"))
    return parts.groupBy(*keys[:-1], "by").agg(F.sum("part").alias("min_sum"))


def puc_lmr(lmr: DataFrame, mi: DataFrame, nvars: int) -> DataFrame:
    """x, y, puc from min_sums(): the same as puc_direct() where information is not negative. Pairs without information have 0."""
    s = min_sums(lmr).withColumns({"x": F.least("about", "by"), "y": F.greatest("about", "by")})
    share = F.when(F.col("mi") > 0, F.lit(float(nvars - 2)) - F.try_divide(F.col("min_sum"), F.col("mi"))).otherwise(0.0)
    return s.join(mi, ["x", "y"]).groupBy("x", "y").agg(F.sum(share).alias("puc"))


def puc_subsets(lmr: DataFrame, mi: DataFrame, subset: DataFrame) -> DataFrame:
    """round, x, y, puc over third variables of each round's subset (round, var_id)."""
    s = min_sums(lmr, subset).withColumns({"x": F.least("about", "by"), "y": F.greatest("about", "by")})
    sizes = subset.groupBy("round").agg(F.count("*").alias("size"))
    has = lambda c: small_side(subset.select("round", F.col("var_id").alias(c), F.lit(1).alias(f"has_{c}")))
    s = s.join(small_side(sizes), "round").join(has("about"), ["round", "about"], "left").join(has("by"), ["round", "by"], "left")
    factor = F.col("size") - F.coalesce("has_about", F.lit(0)) - F.coalesce("has_by", F.lit(0))
    share = F.when(F.col("mi") > 0, factor - F.try_divide(F.col("min_sum"), F.col("mi"))).otherwise(0.0)
    return s.join(mi, ["x", "y"]).groupBy("round", "x", "y").agg(F.sum(share).alias("puc"))


def puc_sampled(lmr: DataFrame, mi: DataFrame, subset: DataFrame) -> DataFrame:
    """x, y, puc: the mean over rounds."""
    return puc_subsets(lmr, mi, subset).groupBy("x", "y").agg(F.avg("puc").alias("puc"))


def sample_rounds(variables: DataFrame, rounds: int, size: int, seed: str = "72") -> DataFrame:
    """round, var_id: for each round a subset without replacement, in the order of an md5."""
    each = variables.select("var_id").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    order = W.partitionBy("round").orderBy(F.md5(F.concat_ws(":", "round", "var_id", F.lit(seed))))
    return each.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= size).select("round", "var_id")
