"""Joint histograms of all pairs of variables."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks on a side of a task's square at most.
MOST_SIDE = 8
#: Cells that are packed at a time; a slab of a block is packed in as many parts as that asks for.
PACKED_CELLS = 1 << 19


def joint_histogram(binned: DataFrame) -> DataFrame:
    """x, y, bx, by, n for x < y, by a self-join on the observation; cells are summed before the shuffle.

    A repeated (obs_id, var_id) counts once, in its greatest bin; an observation counts for the pairs that it has both of.
    """
    binned = binned.repartition("obs_id").groupBy("obs_id", "var_id").agg(F.max("bin").alias("bin"))
    a = binned.select("obs_id", F.col("var_id").alias("x"), F.col("bin").alias("bx"))
    b = binned.select("obs_id", F.col("var_id").alias("y"), F.col("bin").alias("by"))
    return a.join(b, "obs_id").where("x < y").groupBy("x", "y", "bx", "by").agg(F.count("*").alias("n"))


def squares(packed: DataFrame, blocks: int, side: int) -> DataFrame:
    """packed rows of blocks, once for each square (i, j) of side by side blocks that they are part of."""
    last = max(-(-blocks // side) - 1, 0)
    own = F.floor(F.col("block") / side).cast("int")
    met = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return met.select("slab", F.least(own, "with").alias("i"), F.greatest(own, "with").alias("j"), *[c for c in packed.columns if c != "slab"])


def placement(bins: dict[int, int], side: int, tasks: int, width: int, observations: int) -> dict[tuple[int, int], int]:
    """The task of each square (i, j), so that all have like work: the dearest squares first, each to the task of least work so far.

    bins: numbers of bins by block. A square counts its blocks' pairs over all observations of a slab, and makes as
    many cells as the product of their bins.
    """
    sums: dict[int, list[int]] = {}
    for block, n in bins.items():
        one = sums.setdefault(block // side, [0, 0])
        one[0], one[1] = one[0] + 1, one[1] + n
    squares_ = [(i, j) for i in sorted(sums) for j in sorted(sums) if i <= j]
    cost = {(i, j): (width * width * observations * sums[i][0] * sums[j][0] + sums[i][1] * sums[j][1]) // (2 if i == j else 1) for i, j in squares_}
    loads = [(0, t) for t in range(tasks)]
    out = {}
    for square in sorted(squares_, key=lambda s: (-cost[s], s)):
        load, task = heapq.heappop(loads)
        out[square] = task
        heapq.heappush(loads, (load + cost[square], task))
    return out


def _side(blocks: int, slabs: int, parts: int) -> int:
    """Blocks on a side of a task's square: as many as leave enough squares for all tasks."""
    side = MOST_SIDE
    while side > 1 and slabs * (-(-blocks // side)) * (-(-blocks // side) + 1) // 2 < 2 * parts:
        side //= 2
    return side


def counted(first: tuple, second: tuple) -> Iterator[tuple]:
    """Cells (x, y, bx, by, n) of each pair x < y of two blocks' names, observations and grids. Rows are widened one by one, not a grid whole."""
    _, at, to = (first[1], ..., ...) if np.array_equal(first[1], second[1]) else np.intersect1d(first[1], second[1], True, True)
    size = int(second[2].max(initial=0)) + 1
    for k, x in enumerate(first[0]):
        a = first[2][k][at].astype(np.int64)
        for l, y in enumerate(second[0]):
            if x < y:
                b = second[2][l][to].astype(np.int64)
                both = (a >= 0) & (b >= 0)
                cells = np.bincount(a[both] * size + b[both])
                where = np.flatnonzero(cells)
                yield np.full(len(where), x), np.full(len(where), y), where // size, where % size, cells[where]


def joint_histogram_blocks(binned: DataFrame, width: int = 64, observations: int = 65_536, side: int | None = None) -> DataFrame:
    """The same, without a row for each observation and pair: for many variables.

    Variables are dealt into blocks of some width and observations into slabs of about that many. A block of a
    slab is packed into rows of up to some PACKED_CELLS, grids of 2 bytes a cell (4 where bins need them), so no group
    of cells holds a slab; the task that counts it puts its grids together. A task counts a square of side by
    side blocks against one another, so packed rows travel once for each side blocks that they meet, and it holds
    the rows of two sides at a time. Squares are dealt to tasks by their work, see placement(). Repeated cells count as in joint_histogram().
    """
    parts = int(binned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = binned.groupBy("var_id").agg((F.max("bin") + 1).alias("bins")).groupBy(F.floor(F.col("var_id") / width).cast("int").alias("block")).agg(F.sum("bins").alias("bins"), F.count("*").alias("vars"))
    sizes = held.collect()  # two numbers for each block of variables
    bins = {r["block"]: r["bins"] for r in sizes}
    blocks = max(bins, default=-1) + 1
    nobs = binned.agg(F.approx_count_distinct("obs_id")).first()[0]
    slabs = max(1, -(-nobs // observations))
    pieces = max(1, -(-nobs * max((r["vars"] for r in sizes), default=0) // (slabs * PACKED_CELLS)))
    side = side or _side(blocks, slabs, parts)
    place = F.pmod(F.xxhash64("obs_id"), F.lit(slabs * pieces))
    own = binned.select((place % slabs).alias("slab"), F.floor(place / slabs).cast("int").alias("piece"), F.floor(F.col("var_id") / width).cast("int").alias("block"), "obs_id", "var_id", "bin")

    def pack(table: pa.Table) -> pa.Table:
        obs, var, bins = (table.column(c).to_numpy() for c in ("obs_id", "var_id", "bin"))
        names, v = np.unique(var, return_inverse=True)
        seen, o = np.unique(obs, return_inverse=True)
        kind = np.int16 if bins.max() < 2**15 else np.int32
        grid = np.full((len(names), len(seen)), -1, kind)
        np.maximum.at(grid, (v, o), bins.astype(kind))
        head = [table.column(c).slice(0, 1) for c in ("slab", "piece", "block")]
        return pa.table([*head, pa.array([names.astype(np.int32)], pa.list_(pa.int32())), pa.array([seen.astype(np.int64).tobytes()], pa.binary()), pa.array([grid.tobytes()], pa.binary())], names=["slab", "piece", "block", "vars", "obs", "grid"])

    packed = own.groupBy("slab", "piece", "block").applyInArrow(pack, "slab long, piece int, block int, vars array<int>, obs binary, grid binary")
    met = squares(packed, blocks, side)

    def unpacked(rows: list[dict]):
        """A block's names, observations and grid; of several pieces put together, -1 where a piece lacks a name."""
        parts = []
        for row in rows:
            obs, grid, names = np.frombuffer(row["obs"], np.int64), np.frombuffer(row["grid"], np.uint8), np.array(row["vars"])
            kind = np.int16 if len(grid) == 2 * len(names) * len(obs) else np.int32
            parts.append((names, obs, grid.view(kind).reshape(-1, len(obs))))
        if len(parts) == 1:
            return parts[0]
        every, seen = np.unique(np.concatenate([p[0] for p in parts])), np.concatenate([p[1] for p in parts])
        grid, lo = np.full((len(every), len(seen)), -1, np.result_type(*(p[2] for p in parts))), 0
        for names, obs, part in parts:
            grid[np.searchsorted(every, names), lo : lo + len(obs)] = part
            lo += len(obs)
        return every, seen, grid

    def count(rows: list[dict]) -> pa.RecordBatch:
        at: dict[int, list[dict]] = {}
        for r in rows:
            at.setdefault(r["block"], []).append(r)
        i, j = rows[0]["i"], rows[0]["j"]
        out = []
        for p in sorted(b for b in at if b // side == i):
            first = unpacked(at[p])
            for q in sorted(b for b in at if b // side == j and b >= p):
                out += counted(first, first if p == q else unpacked(at[q]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        names = ("x", "y", "bx", "by", "n")
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if n == "n" else np.int32)) for n, c in zip(names, columns, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                if held and any(held[0][c] != row[c] for c in ("slab", "i", "j")):
                    yield count(held)
                    held = []
                held.append(row)
        if held:
            yield count(held)

    tasks = min(parts, max(1, slabs * (-(-blocks // side)) ** 2))
    owners = placement(bins, side, tasks, width, min(nobs, observations))
    placed = F.broadcast(binned.sparkSession.createDataFrame([(*s, t) for s, t in owners.items()], "i int, j int, owner int"))
    # Slabs have like squares, so their tasks are turned on by one from slab to slab.
    dealt = met.join(placed, ["i", "j"]).repartitionById(tasks, F.pmod(F.col("owner") + F.col("slab"), F.lit(tasks)).cast("int"))
    cells = dealt.sortWithinPartitions("slab", "i", "j", "piece").mapInArrow(run, "x int, y int, bx int, by int, n long")
    return cells.groupBy("x", "y", "bx", "by").agg(F.sum("n").alias("n"))
