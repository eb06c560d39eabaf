"""Adaptive and uniform bins, and histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_of
from ..sources.matrix import small_side


def unique_counts(expr: DataFrame) -> DataFrame:
    """var_id, value, n: distinct values and how often they occur."""
    return expr.groupBy("var_id", "value").agg(F.count("*").alias("n"))


def uniform_edges(expr: DataFrame, bins: int) -> DataFrame:
    """var_id, edges: bins of equal width from least to greatest; a constant has one bin."""
    span = expr.groupBy("var_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    even = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / float(bins))
    return span.select("var_id", F.when(F.col("lo") == F.col("hi"), F.array("lo", "hi")).otherwise(even).alias("edges"))


def block_edges(values: np.ndarray, counts: np.ndarray, chunk: int | None = None) -> np.ndarray:
    """Edges of the optimal Bayesian blocks of sorted distinct values and their counts.

    The prior is that of each step, at a false-positive rate of 0.05; the last of equally fit partitions is
    taken, and the first edge always stays. A constant has the one bin [v, v].

    A block's fitness N log(N/T) never exceeds that of two blocks in its place (the log-sum inequality), and a step's
    prior is the same for all its starts. So for starts j up to e, before k: best(j) + fit(j, k) is at most the
    largest best(j) + fit(j, e), plus fit(e, k). Starts are bounded so in chunks, and only chunks whose bound
    reaches the best start known are looked into: the result is that of the full programme, at some square root of
    its work.
    """
    n = len(values)
    if n == 1:
        return np.array([values[0], values[0]])
    edges = np.concatenate([values[:1], (values[1:] + values[:-1]) / 2, values[-1:]])
    total = np.concatenate([[0.0], np.cumsum(counts)])
    chunk = chunk or max(64, int(np.sqrt(n)))
    best, last, bounds = np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(-(-n // chunk))

    def fit(j, k: int) -> np.ndarray:
        inside = total[k] - total[j]
        return inside * np.log(inside / (edges[k] - edges[j]))

    ends = np.arange(chunk, n + 1, chunk)
    for k in range(1, n + 1):
        prior = 4 - np.log(73.53 * 0.05 * k**-0.478)
        done = (k - 1) // chunk  # chunks that end before k
        spans = [slice(done * chunk, k)]
        at = np.argmax((x := fit(spans[0], k) - prior + best[spans[0]])[::-1])
        top, start = x[::-1][at], k - 1 - at
        if done:
            bound = bounds[:done] + fit(ends[:done], k) - prior
            slack = 1e-9 + 1e-12 * abs(top)
            while bound[c := int(bound.argmax())] >= top - slack:
                bound[c] = -np.inf
                span = slice(c * chunk, (c + 1) * chunk)
                x = fit(span, k) - prior + best[span]
                at = chunk - 1 - int(np.argmax(x[::-1]))
                if x[at] > top or x[at] == top and span.start + at > start:
                    top, start = x[at], span.start + at
        best[k], last[k] = top, start
        if k % chunk == 0:
            span = slice(k - chunk, k)
            bounds[k // chunk - 1] = (best[span] + fit(span, k)).max()
    cuts, at = [n], n
    while at > 0:
        at = last[at]
        cuts.append(at)
    return edges[cuts[::-1]]


def bayesian_edges(expr: DataFrame) -> DataFrame:
    """var_id, edges by Bayesian blocks. Values are counted first, so a task holds a variable's distinct values only. Nulls are missing."""
    each = unique_counts(expr.where(F.col("value").isNotNull())).groupBy("var_id").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [block_edges(np.array([x["value"] for x in u]), np.array([float(x["n"]) for x in u])) for u in b.column("u").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("var_id"), pa.array(out, pa.list_(pa.float64()))], ["var_id", "edges"])

    return each.mapInArrow(run, "var_id int, edges array<double>")


def assign(expr: DataFrame, edges: DataFrame) -> DataFrame:
    """obs_id, var_id, bin: each value is binned once, whatever the number of pairs. A null value is missing and has no row."""
    known = expr.where(F.col("value").isNotNull())
    return known.join(small_side(edges), "var_id").select("obs_id", "var_id", bin_of(F.col("value"), F.col("edges")).alias("bin"))


def histogram(binned: DataFrame) -> DataFrame:
    """var_id, bin, n."""
    return binned.groupBy("var_id", "bin").agg(F.count("*").alias("n"))


def nodes(edges: DataFrame, binned: DataFrame) -> DataFrame:
    """var_id, edges, hist, n_edges, n_bins: with bins that nothing falls in."""
    hist = histogram(binned).groupBy("var_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by"))
    both = edges.join(hist, "var_id")
    bins = F.sequence(F.lit(0), F.size("edges") - 2)
    counts = F.transform(bins, lambda b: F.coalesce(F.try_element_at("by", b), F.lit(0).cast("long")))
    return both.select("var_id", "edges", counts.alias("hist"), F.size("edges").alias("n_edges"), (F.size("edges") - 1).alias("n_bins"))


def spline_entropy(expr: DataFrame, bins: int, order: int) -> DataFrame:
    """var_id, entropy (bits) of B-spline bins."""
    from ..functions.scalars import spline_weight

    span = expr.groupBy("var_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = expr.join(small_side(span), "var_id").withColumn("z", F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * (bins - order + 1))
    shares = scaled.groupBy("var_id").agg(*[F.avg(spline_weight(F.col("z"), i, order, bins)).alias(f"p{i}") for i in range(bins)])
    terms = [F.when(F.col(f"p{i}") > 0, -F.col(f"p{i}") * F.log2(f"p{i}")).otherwise(0.0) for i in range(bins)]
    return shares.select("var_id", sum(terms[1:], terms[0]).alias("entropy"))
