"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGS = {"2": F.log2, "e": F.log, "10": F.log10}


def around(value: Column, decimals: int | None) -> Column:
    """Rounds to decimals, half away from zero, by scaling first; None leaves the value."""
    if decimals is None:
        return value
    return F.round(value * float(10**decimals), 0) / float(10**decimals) + 0.0


def log_ratio(n_xy: Column, n_x: Column, n_y: Column, weight: Column, base: str = "2") -> Column:
    """log(n_xy * weight / (n_x * n_y)); what is not finite is 0."""
    return F.coalesce(LOGS[base](F.try_divide(n_xy * weight, n_x * n_y)), F.lit(0.0))


def mpuc(mi: Column, redundancy: Column) -> Column:
    """The share of mi that is not redundant; 0 where mi is 0 or the share negative."""
    share = F.try_divide(mi - redundancy, mi)
    return F.when((mi != 0) & (share >= 0), share).otherwise(0.0)


def triu_index(n: Column | int, i: Column, j: Column) -> Column:
    """The place of pair i < j in the upper triangle of n variables."""
    n = F.lit(n) if isinstance(n, int) else n
    return (i * n + j - F.floor((i + 2) * (i + 1) / 2)).cast("long")


def triu_pair(n: int, k: Column) -> tuple[Column, Column]:
    """The pair at a place of the upper triangle."""
    i = F.floor(n - 2 - F.floor(F.sqrt(-8.0 * k + 4.0 * n * (n - 1) - 7) / 2.0 - 0.5)).cast("long")
    return i, (k + i + 1 - F.floor(F.lit(n) * (n - 1) / 2) + F.floor((n - i) * (n - i - 1) / 2)).cast("long")


def block_low(rank: Column, ranks: int, n: Column | int) -> Column:
    """The first item of a rank's block of n items."""
    return F.floor(rank * n / ranks).cast("long")


def block_owner(item: Column, ranks: int, n: Column | int) -> Column:
    """The rank whose block an item lies in."""
    return F.floor((ranks * (item + 1) - 1) / n).cast("long")


def bin_of(value: Column, edges: Column) -> Column:
    """The right-closed bin of a value: edges below it less one, clamped; NaN lies in the last bin, null in none."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.when(value.isNotNull(), F.least(F.greatest(below - 1, F.lit(0)), F.size(edges) - 2))


def spline_weight(z: Column, i: int, order: int, bins: int) -> Column:
    """B-spline basis i of an order over knots 0 (order times), 1, 2, ... and the last (order times); the last is closed."""
    last = bins - order + 1
    knots = [0] * order + list(range(1, last)) + [last] * order

    def basis(i: int, k: int) -> Column:
        lo, hi = knots[i], knots[i + 1]
        if k == 1:
            inside = (z >= lo) & (z < hi) if lo < hi else F.lit(False)
            if lo < hi and hi == last:
                inside = inside | (z == last)
            return F.when(inside, 1.0).otherwise(0.0)
        out = F.lit(0.0)
        if knots[i + k - 1] > knots[i]:
            out = out + (z - knots[i]) / float(knots[i + k - 1] - knots[i]) * basis(i, k - 1)
        if knots[i + k] > knots[i + 1]:
            out = out + (knots[i + k] - z) / float(knots[i + k] - knots[i + 1]) * basis(i + 1, k - 1)
        return out

    return basis(i, order)
