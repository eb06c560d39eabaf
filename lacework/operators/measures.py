"""Information measures of joint histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import log_ratio

#: Variables of a tile of triples: a tile has 8 bytes for each two of them.
TILE = 512


def marginals(joint: DataFrame) -> DataFrame:
    """The cells with their marginal counts n_x and n_y and the number of observations w. Dealt by pair once, for all sums."""
    pair = W.partitionBy("x", "y")
    return joint.repartition("x", "y").withColumns({
        "n_x": F.sum("n").over(W.partitionBy("x", "y", "bx")),
        "n_y": F.sum("n").over(W.partitionBy("x", "y", "by")),
        "w": F.sum("n").over(pair),
    })


def log_ratios(joint: DataFrame, base: str = "2") -> DataFrame:
    """marginals() with lr, the log ratio of each cell."""
    c = {k: F.col(k).cast("double") for k in ("n", "n_x", "n_y", "w")}
    return marginals(joint).withColumn("lr", log_ratio(c["n"], c["n_x"], c["n_y"], c["w"], base))


def mutual_information(cells: DataFrame) -> DataFrame:
    """x, y, mi of log_ratios()."""
    return cells.groupBy("x", "y").agg((F.sum(F.col("n") * F.col("lr")) / F.first("w")).alias("mi"))


def specific_information(cells: DataFrame) -> DataFrame:
    """about, by, state, n_state, si, lmr for both orders of each pair.

    si is the information of the pair in a state of about; lmr its part of the pair's mutual information.
    """
    sides = F.array(
        F.struct(F.col("x").alias("about"), F.col("y").alias("by"), F.col("bx").alias("state"), F.col("n_x").alias("n_state")),
        F.struct(F.col("y").alias("about"), F.col("x").alias("by"), F.col("by").alias("state"), F.col("n_y").alias("n_state")),
    )
    rows = cells.select("n", "lr", "w", F.inline(sides))
    part = F.col("n") * F.col("lr")
    return rows.groupBy("about", "by", "state").agg(
        F.first("n_state").alias("n_state"), (F.sum(part) / F.first("n_state")).alias("si"), (F.sum(part) / F.first("w")).alias("lmr")
    )


def mutual_information_of(si: DataFrame) -> DataFrame:
    """x, y, mi as the sum of lmr over a variable's states: without the cells."""
    return si.where(F.col("about") < F.col("by")).groupBy(F.col("about").alias("x"), F.col("by").alias("y")).agg(F.sum("lmr").alias("mi"))


def _grid(table: pa.Table, nobs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one variable's rows: the others, their information by state (states by others; NaN: none), and the states' shares."""
    state, by, si, n = (table.column(c).to_numpy() for c in ("state", "by", "si", "n_state"))
    states, row = np.unique(state, return_inverse=True)
    others, column = np.unique(by, return_inverse=True)
    grid, share = np.full((len(states), len(others)), np.nan), np.zeros(len(states))
    grid[row, column], share[row] = si, n / float(nobs)
    return others, grid, share


def _tiles(grid: np.ndarray, share: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Redundancies of blocks of others with one another, each pair of blocks once; NaN where no state is shared."""
    blocks = [slice(lo, lo + TILE) for lo in range(0, grid.shape[1], TILE)]
    for i, a in enumerate(blocks):
        for b in blocks[i:]:
            sums = np.zeros((grid[:, a].shape[1], grid[:, b].shape[1]))
            shared = np.zeros(sums.shape, bool)
            for weight, left, right in zip(share, grid[:, a], grid[:, b], strict=True):
                least = np.minimum(left[:, None], right[None])
                held = ~np.isnan(least)
                shared |= held
                sums += np.where(held, weight * least, 0.0)
            yield a, b, np.where(shared, sums, np.nan)


def redundancies(si: DataFrame, nobs: int) -> DataFrame:
    """about, by, other, redundancy: of about's information on by and on a third variable, over all triples.

    A task takes one variable's information on all others, a small grid of states by variables, and goes through it
    in tiles; there is no row for a triple and state.
    """

    def run(table: pa.Table) -> pa.Table:
        others, grid, share = _grid(table, nobs)
        out = []
        for a, b, sums in _tiles(grid, share):
            left, right = others[a], others[b]
            x, y = np.nonzero(~np.isnan(sums) & (left[:, None] != right[None]))
            out.append((left[x], right[y], sums[x, y]))
            if a != b:
                out.append((right[y], left[x], sums[x, y]))
        by, other, value = (np.concatenate(c) for c in zip(*out, strict=True))
        about = np.full(len(by), table.column("about")[0].as_py())
        return pa.table({"about": pa.array(about, pa.int32()), "by": pa.array(by, pa.int32()), "other": pa.array(other, pa.int32()), "redundancy": value})

    rows = si.select("about", "by", "state", "si", "n_state")
    return rows.groupBy("about").applyInArrow(run, "about int, by int, other int, redundancy double")


def unique_shares(si: DataFrame, nobs: int, weights: dict[int, float] | None = None) -> DataFrame:
    """about, by, share: the sum over third variables of the part of the pair's information that is not redundant.

    weights: of third variables; those without one do not count. None: each counts once. As redundancies(), and the
    pair's information is read off the same grid, so a row leaves a task for each pair only.
    """

    def run(table: pa.Table) -> pa.Table:
        others, grid, share = _grid(table, nobs)
        mi = np.nansum(grid * share[:, None], axis=0)
        weight = np.ones(len(others)) if weights is None else np.array([weights.get(int(v), 0.0) for v in others])
        out = np.zeros(len(others))

        def part(rows, columns, redundancy):
            own = mi[rows][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                left = (own - redundancy) / own
            left = np.where((own != 0) & (left >= 0) & (others[rows][:, None] != others[columns][None]), left, 0.0)
            out[rows] += left @ weight[columns]

        for a, b, sums in _tiles(grid, share):
            part(a, b, sums)
            if a != b:
                part(b, a, sums.T)
        about = np.full(len(others), table.column("about")[0].as_py())
        return pa.table({"about": pa.array(about, pa.int32()), "by": pa.array(others, pa.int32()), "share": out})

    return si.select("about", "by", "state", "si", "n_state").groupBy("about").applyInArrow(run, "about int, by int, share double")
