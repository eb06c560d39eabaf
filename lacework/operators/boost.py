"""Gradient-boosted regression of each target variable: edges by gain, and cross-validation.

Observations are dealt in slabs, packed rows of the regulators' bins and the targets' values. Trees of all runs (a
target, or a target and fold) grow together: a job sums the gradients of each leaf that a run must know by feature
and bin within tasks, sums the sums, and finds each leaf's best split; what comes to the driver is a split for each
leaf. No task holds more of the matrix than some slabs at a time. Where the bins of all regulators and the values of
a task's own targets have at most WHOLE bytes, tasks get these and train their runs by themselves, without the
driver, and keep what a run knows from step to step. Gradients are whole numbers, so sums, splits and gains are the
same however observations are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import block_owner
from ..sources.matrix import Matrix, small_side
from ..sources.store import discard, new_folder, written
from .quantiles import quantile_cuts, summary

#: Runs that are trained together; more are trained one lot after another.
MOST_RUNS = 1_000
#: Slabs that a task holds and sums as one; small ones are held up to so many cells.
HELD, HELD_CELLS = 4, 1 << 20
#: Bytes of sums that a task adds up before it hands them on.
SUMS = 1 << 26
#: Cells of a slab where none are given, and of one that is only packed to be sent on.
SLAB_CELLS, SENT_CELLS = 4_000_000, 1_000_000
#: Bytes of packed observations that a task may hold to train its runs by itself.
WHOLE = 1 << 27
#: Rounds after which the runs' predictions are written, so that later jobs need not follow all trees from the first.
KEPT_EVERY = 8
#: Bytes of a row of sums: features are dealt into pieces of so many.
PIECE = 1 << 18
#: The number of a missing value; it lies beyond every cut.
MISSING = 255
#: Bits of a gradient, relative to a target's largest value, and rows of a slab at most: sums of a slab are exact in doubles,
#: and those of two billion observations in 64 bits.
BITS, MOST_ROWS = 32, 1 << 20
METRICS = ("rmse", "l2", "l1")


@dataclass
class BoostParams:
    """metric: of validation rows, that patience looks at. bagging_freq: rounds that share a bag; 0: all rows always.

    slab_cells: cells (of 8 bytes at most) of a slab; observations of more cells are trained over slabs. None: tasks
    train their runs whole as far as they can hold them. It changes how the work is dealt, not its result.
    """

    iterations: int = 300
    learning_rate: float = 0.1
    leaves: int = 31
    least_leaf: int = 20
    bagging: float = 0.9
    feature_fraction: float = 0.1
    bins: int = 64
    seed: int = 72
    patience: int = 10
    min_iterations: int = 32
    tolerance: float = 1e-4
    bagging_freq: int = 1
    metric: str = "rmse"
    slab_cells: int | None = None

    def __post_init__(self):
        if not 2 <= self.bins < MISSING:
            raise ValueError(f"bins must be 2 to {MISSING - 1}")
        if self.metric not in METRICS:
            raise ValueError(f"metric is one of {METRICS}")


@dataclass
class Tree:
    """Nodes with children after their parents; a feature of -1 is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> int:
        """Makes two leaves of a leaf; the right one follows the left."""
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, 0.0)):
            column += [empty, empty]
        return self.left[node]

    def route(self, q: np.ndarray) -> np.ndarray:
        """The leaf of each column of bins (features by observations)."""
        at = np.zeros(q.shape[1], np.int32)
        for node, feature in enumerate(self.feature):
            if feature >= 0:
                here = np.flatnonzero(at == node)
                at[here] = self.left[node] + (q[feature, here] > self.cut[node])
        return at


@dataclass
class Split:
    """The best split of a leaf, and the sums of gradients and rows of it and its left side."""

    gain: float
    feature: int
    cut: int
    g_left: int
    n_left: int
    g: int
    n: int


def best_splits(g: np.ndarray, n: np.ndarray, least: int) -> list[Split]:
    """Of sums by leaf, feature and bin: each leaf's first split of the largest gain in squared error; feature -1 if none has any."""
    out = []
    for gs, ns in zip(g, n, strict=True):
        total_g, total_n = int(gs[0].sum()), int(ns[0].sum())
        left_g, left_n = gs.cumsum(1)[:, :-1], ns.cumsum(1)[:, :-1]
        ok = (left_n >= least) & (total_n - left_n >= least)
        best = Split(0.0, -1, 0, 0, 0, total_g, total_n)
        if ok.any():
            a, b = left_g.astype(float), (total_g - left_g).astype(float)
            gain = np.where(ok, a * a / np.maximum(left_n, 1) + b * b / np.maximum(total_n - left_n, 1) - float(total_g) ** 2 / total_n, -1.0)
            f, cut = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, cut] > 0:
                best = Split(float(gain[f, cut]), int(f), int(cut), int(left_g[f, cut]), int(left_n[f, cut]), total_g, total_n)
        out.append(best)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    u = np.uint64
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


def in_bag(obs: np.ndarray, target: int, turn: int, p: BoostParams) -> np.ndarray:
    """Which observations a round of a target sees: by a hash of their ids, wherever they lie."""
    if p.bagging >= 1 or p.bagging_freq < 1:
        return np.ones(len(obs), bool)
    salt = np.array([p.seed, target, (turn - 1) // p.bagging_freq], np.int64).view(np.uint64)
    key = np.uint64(0)
    for s in salt:
        key = _mixed(np.atleast_1d(key ^ s) + np.uint64(0x9E3779B97F4A7C15))[0]
    return _mixed(obs.view(np.uint64) ^ key) < np.uint64(int(p.bagging * 2**64))


@dataclass
class Job:
    """What tasks need to know of a run: trees since predictions were written, the tree that grows and its unknown leaves."""

    run: int
    target: int
    place: int
    fold: int | None
    scale: float
    start: float
    trees: list[Tree]
    tree: Tree
    unknown: list[int]
    features: np.ndarray
    turn: int
    validates: bool


@dataclass
class Slab:
    """Some observations: bins of features, values of targets by place (NaN: none), folds, and predictions of runs, none before the first round."""

    obs: np.ndarray
    q: np.ndarray
    y: dict[int, np.ndarray]
    fold: np.ndarray
    f: dict[int, np.ndarray]

    @classmethod
    def joined(cls, slabs: list["Slab"]) -> "Slab":
        """Slabs of the same targets and runs as one."""
        first = slabs[0]
        if len(slabs) == 1:
            return first
        y, f = ({k: np.concatenate([getattr(s, of)[k] for s in slabs]) for k in getattr(first, of)} for of in ("y", "f"))
        return cls(np.concatenate([s.obs for s in slabs]), np.concatenate([s.q for s in slabs], axis=1), y, np.concatenate([s.fold for s in slabs]), f)

    def predicted(self, job: Job) -> np.ndarray:
        f = self.f[job.run] if job.run in self.f else np.full(len(self.obs), job.start)
        for tree in job.trees:
            f = f + np.array(tree.value)[tree.route(self.q)]
        return f


def round_rows(slab: Slab, f: np.ndarray, job: Job, p: BoostParams) -> tuple[np.ndarray, float, int]:
    """The rows that a round sees, and the error and number of validation rows."""
    y = slab.y[job.place]
    known = ~np.isnan(y)
    error, rows = 0.0, 0
    train = known
    if job.fold is not None:
        train = known & (slab.fold != job.fold)
        if job.validates:
            off = (y - f)[known & (slab.fold == job.fold)]
            error, rows = float(np.abs(off).sum() if p.metric == "l1" else (off * off).sum()), len(off)
    return np.flatnonzero(train & in_bag(slab.obs, job.target, job.turn, p)), error, rows


def gradient_sums(slab: Slab, job: Job, p: BoostParams) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums of gradients and rows by unknown leaf, feature and bin, and the error and number of validation rows."""
    f, y = slab.predicted(job), slab.y[job.place]
    use, error, rows = round_rows(slab, f, job, p)
    slot = np.full(len(job.tree.feature), -1)
    slot[job.unknown] = np.arange(len(job.unknown))
    slot = slot[job.tree.route(slab.q[:, use])]
    use, slot = use[slot >= 0], slot[slot >= 0]
    shape = (len(job.unknown), len(job.features), p.bins + 1)
    bins = np.minimum(slab.q[np.ix_(job.features, use)], p.bins).astype(np.int64)
    keys = ((slot[None] * shape[1] + np.arange(shape[1])[:, None]) * shape[2] + bins).ravel()
    # Whole numbers of up to 2^53 are exact in doubles.
    g = np.rint((y[use] - f[use]) * job.scale)
    size = shape[0] * shape[1] * shape[2]
    sums = np.bincount(keys, np.broadcast_to(g, bins.shape).ravel(), size).astype(np.int64)
    return sums.reshape(shape), np.bincount(keys, minlength=size).reshape(shape), error, rows


class Whole:
    """A run where all its observations are at hand: predictions, and a round's bins, gradients, rows of leaves and their sums.

    A split counts the rows of its smaller side; the other side's sums are what is left, exactly, as they are whole numbers.
    """

    def __init__(self, slab: Slab, job: Job, p: BoostParams):
        self.slab, self.p, self.f, self.trees, self.turn = slab, p, np.full(len(slab.obs), job.start), 0, 0

    def gradient_sums(self, job: Job) -> tuple[np.ndarray, np.ndarray, float, int]:
        error, rows = self._begin(job) if job.turn != self.turn else (0.0, 0)
        for node, feature in enumerate(job.tree.feature):
            if feature >= 0 and node in self.rows:
                here, left = self.rows.pop(node), job.tree.left[node]
                beyond = self.q[self.at[feature]][here] > job.tree.cut[node]
                self.rows[left], self.rows[left + 1] = here[~beyond], here[beyond]
                less, more = sorted((left, left + 1), key=lambda x: len(self.rows[x]))
                self.sums[less] = self._count(self.rows[less])
                self.sums[more] = self.sums.pop(node) - self.sums[less]
        both = np.stack([self.sums[x] for x in job.unknown], 1)
        return both[0], both[1], error, rows

    def _begin(self, job: Job) -> tuple[float, int]:
        for tree in job.trees[self.trees :]:
            self.f = self.f + np.array(tree.value)[tree.route(self.slab.q)]
        self.trees, self.turn = len(job.trees), job.turn
        use, error, rows = round_rows(self.slab, self.f, job, self.p)
        self.g = np.rint((self.slab.y[job.place][use] - self.f[use]) * job.scale)
        self.q = [np.minimum(self.slab.q[x][use], self.p.bins) for x in job.features]
        self.at = {int(x): i for i, x in enumerate(job.features)}
        self.rows = {0: np.arange(len(use))}
        self.sums = {0: self._count(self.rows[0])}
        return error, rows

    def _count(self, rows: np.ndarray) -> np.ndarray:
        """Sums of gradients, then of rows, by feature and bin."""
        out, g = np.zeros((2, len(self.q), self.p.bins + 1), np.int64), self.g[rows]
        for i, q in enumerate(self.q):
            bins = q[rows].astype(np.int64)
            out[0, i] = np.bincount(bins, g, self.p.bins + 1).astype(np.int64)
            out[1, i] = np.bincount(bins, minlength=self.p.bins + 1)
        return out


class Run:
    """A run's state on the driver: the tree that grows, what is known of its leaves, its gains and validation errors."""

    def __init__(self, number: int, target: int, place: int, fold: int | None, features: list[int], largest: float, p: BoostParams, width: int):
        self.number, self.target, self.place, self.fold, self.p = number, target, place, fold, p
        self.usable = np.array([i for i, t in enumerate(features) if t != target])
        # A power of 2, by which gradients become whole numbers.
        self.scale = float(2.0 ** (BITS - max(0 if largest <= 0 else int(np.ceil(np.log2(largest))) + 1, -500)))
        self.start, self.trees, self.turn = 0.0, [], 0
        self.gains = np.zeros(width)
        self.ahead = True  # leaves are opened ahead, as a step is dear
        self.best, self.best_round, self.done = np.inf, 0, not len(self.usable)
        self._begin()

    def _begin(self) -> None:
        self.turn += 1
        self.tree, self.known, self.fresh = Tree(), {}, True
        take = max(1, int(round(self.p.feature_fraction * len(self.usable))))
        rng = np.random.default_rng([self.p.seed, self.target, self.turn])
        self.features = np.sort(rng.choice(self.usable, min(take, len(self.usable)), replace=False)) if len(self.usable) else self.usable
        self.unknown = [0]

    def job(self) -> Job:
        return Job(self.number, self.target, self.place, self.fold, self.scale, self.start, self.trees, self.tree, self.unknown, self.features, self.turn, self.fresh and self.turn > 1)

    def take(self, splits: list[Split], error: float, rows: int) -> None:
        """What a job found out; goes on with the tree, or to the next round."""
        if self.fresh and self.fold is not None and self.turn > 1 and self._stops(error, rows):
            self.done = True
            return
        self.fresh = False
        self.known |= dict(zip(self.unknown, splits, strict=True))
        self._grow()
        if not self.unknown:
            self._finish()

    def _stops(self, error: float, rows: int) -> bool:
        mean = error / rows if rows else 0.0
        error = float(np.sqrt(mean)) if self.p.metric == "rmse" else mean
        if error < self.best - self.p.tolerance:
            self.best, self.best_round = error, self.turn - 1
        elif self.turn - 1 >= self.p.min_iterations and self.turn - 1 - self.best_round >= self.p.patience:
            return True
        return self.turn > self.p.iterations

    def _grow(self) -> None:
        """Splits best leaves first, as far as all leaves are known; those that may be split next are opened, too.

        The tree holds nodes that were opened early; final says which of them growth has come to.
        """
        leaves, self.final, blocked = [0], [], False
        while len(leaves) < self.p.leaves:
            if any(x not in self.known for x in leaves):
                blocked = True
                break
            best = max(leaves, key=lambda x: self.known[x].gain)
            if self.known[best].gain <= 0:
                break
            leaves.remove(best)
            self.final.append(best)
            left = self._open(best)
            leaves += [left, left + 1]
        self.unknown = []
        if not blocked:
            self.leaves = leaves
            return
        waiting = [x for x in leaves if x not in self.known]
        ready = sorted((x for x in leaves if self.ahead and x in self.known and self.known[x].gain > 0), key=lambda x: -self.known[x].gain)
        for x in ready[: max(0, min(self.p.leaves - len(leaves), (self.p.leaves - len(waiting)) // 2))]:
            left = self._open(x)
            waiting += [c for c in (left, left + 1) if c not in self.known]
        self.unknown = waiting

    def _open(self, node: int) -> int:
        if self.tree.feature[node] < 0:
            self.tree.split(node, int(self.features[self.known[node].feature]), self.known[node].cut)
        return self.tree.left[node]

    def _finish(self) -> None:
        """The tree without nodes that were opened in vain, and the next round."""
        sums = {0: (self.known[0].g, self.known[0].n)}
        out, name = Tree(), {0: 0}
        for node in self.final:
            s, left = self.known[node], self.tree.left[node]
            name[left] = out.split(name[node], self.tree.feature[node], self.tree.cut[node])
            name[left + 1] = name[left] + 1
            sums[left], sums[left + 1] = (s.g_left, s.n_left), (s.g - s.g_left, s.n - s.n_left)
            self.gains[self.tree.feature[node]] += s.gain / self.scale / self.scale
        for leaf in self.leaves:
            g, n = sums[leaf]
            out.value[name[leaf]] = self.p.learning_rate * (g / n) / self.scale if n else 0.0
        self.trees = [*self.trees, out]
        if self.fold is None and self.turn >= self.p.iterations:
            self.done = True
        else:
            self._begin()


def train(runs: list[Run], step: Callable[[list[Job]], dict], keep: Callable[[list[Job]], None] | None = None) -> None:
    """Trains all runs together. step gives for each job its leaves' splits, the validation error and its rows; keep writes predictions."""
    kept = 0
    while alive := [r for r in runs if not r.done]:
        if keep and min(r.turn for r in alive) - 1 - kept >= KEPT_EVERY:
            keep([r.job() for r in alive])
            for r in runs:
                r.trees = []
            kept = min(r.turn for r in alive) - 1
        found = step([r.job() for r in alive])
        for r in alive:
            if r.number in found:
                r.take(*found[r.number])
            else:  # there is no observation
                r.done = True


def _starts(runs: list[Run], sums: dict[int, tuple[int, int]]) -> None:
    """First predictions: the mean of a run's training rows, from whole numbers."""
    for r in runs:
        g, n = sums.get(r.number, (0, 0))
        r.start = g / n / r.scale if n else 0.0


def _start_sums(slab: Slab, job: Job) -> tuple[int, int]:
    y = slab.y[job.place]
    use = ~np.isnan(y) & (slab.fold != job.fold if job.fold is not None else True)
    return int(np.rint(y[use] * job.scale).astype(np.int64).sum()), int(use.sum())


def boost(q: np.ndarray, y: np.ndarray, p: BoostParams, fold: np.ndarray | None = None, val: int | None = None, target: int = 0) -> tuple[np.ndarray, int]:
    """One run on one slab: gains by feature and the number of rounds kept.

    q: bins, observations by features; the target is none of them, and seeds the draws. With val, the fold that
    validates, it stops once the error has not fallen by over tolerance for patience rounds, after min_iterations at
    least; the best round is returned.
    """
    slab = Slab(np.arange(len(y)), np.ascontiguousarray(q.T), {0: y.astype(float)}, np.zeros(len(y), int) if fold is None else fold, {})
    run = Run(0, target, 0, val, list(range(1, q.shape[1] + 1)), float(np.abs(y).max(initial=0)), p, q.shape[1])
    train_on(slab, [run], p)
    return run.gains, p.iterations if val is None else max(run.best_round, 1)


def train_on(slab: Slab, runs: list[Run], p: BoostParams) -> None:
    """Trains runs on one slab that has all observations, one after another."""
    for r in runs:
        _starts([r], {r.number: _start_sums(slab, r.job())})
        r.ahead, held = False, Whole(slab, r.job(), p)

        def step(jobs: list[Job], held: Whole = held) -> dict:
            (job,) = jobs
            g, n, error, rows = held.gradient_sums(job)
            return {job.run: (best_splits(g, n, p.least_leaf), error, rows)}

        train([r], step)


RESULT = "target int, fold int, rounds int, tfs array<int>, gains array<double>"
_RESULT_TYPE = pa.schema([("target", pa.int32()), ("fold", pa.int32()), ("rounds", pa.int32()), ("tfs", pa.list_(pa.int32())), ("gains", pa.list_(pa.float64()))])


def _result(r: Run, features: list[int]) -> tuple:
    return (int(r.target), r.fold, max(r.best_round, 1), [int(features[f]) for f in r.usable], [float(r.gains[f]) for f in r.usable])


_PACKED = "slab long, obs binary, q binary, y array<binary>, fold binary"
_SLAB = "slab long, part int, runs array<int>, places array<int>, obs binary, q binary, y array<binary>, fold binary, f array<binary>"
_SLAB_TYPE = pa.schema([("slab", pa.int64()), ("part", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("runs", "places")), ("obs", pa.binary()), ("q", pa.binary()), ("y", pa.list_(pa.binary())), ("fold", pa.binary()), ("f", pa.list_(pa.binary()))])
_PIECE = "run int, piece int, sums binary, error double, rows long"
_BEST = "run int, slot int, gain double, piece int, feature int, cut int, g_left long, n_left long, g long, n long, error double, rows long"


class Slabs:
    """The packed observations of some runs, dealt over the cluster."""

    def __init__(self, matrix: Matrix, features: list[int], runs: list[Run], folds: DataFrame | None, p: BoostParams):
        self.p, self.features, self.width = p, features, len(features)
        self.spark = matrix.expr.sparkSession
        targets = list(dict.fromkeys(r.target for r in runs))
        parts = self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        nobs = int(matrix.expr.select(F.approx_count_distinct("obs_id")).first()[0] * 1.1)
        cells = nobs * (len(features) + len(targets) + 1)
        slabs = max(1, -(-cells // (p.slab_cells or SLAB_CELLS)), -(-nobs // MOST_ROWS))
        # Of a task's own: ids, bins, folds, and values of the targets of its runs.
        copies = max(1, min(len(runs), 2 * self.spark.sparkContext.defaultParallelism))
        own = max(len({r.target for r in x}) for x in self._shares(runs, copies))
        self.alone = slabs == 1 or p.slab_cells is None and nobs <= MOST_ROWS and nobs * (len(features) + 8 * own + 10) <= WHOLE
        if self.alone:
            slabs = -(-cells // min(p.slab_cells or SLAB_CELLS, SENT_CELLS))
        else:
            # Where slabs are fewer than tasks, each is dealt in copies, of which each serves a part of the runs.
            copies = max(1, min(-(-parts // slabs), len(runs) // 8))
        shares = [(i, [r.number for r in x], sorted({r.place for r in x})) for i, x in enumerate(self._shares(runs, copies))]
        dealt = F.broadcast(self.spark.createDataFrame(shares, "part int, runs array<int>, places array<int>"))
        every = self._packed(matrix, features, targets, folds, max(1, slabs)).crossJoin(dealt).withColumn("y", F.transform("places", lambda i: F.get("y", i)))
        every = every.withColumn("f", F.array().cast("array<binary>")).select(*_SLAB_TYPE.names)
        if self.alone:
            self.frame = every.repartitionById(copies, F.col("part")).sortWithinPartitions("part", "slab")
        else:
            self.frame = written(every.repartition(min(parts, slabs * copies), "slab", "part"))

    @staticmethod
    def _shares(runs: list[Run], copies: int) -> list[list[Run]]:
        """Runs in shares of like sizes; those of a target lie together."""
        return [runs[len(runs) * i // copies : len(runs) * (i + 1) // copies] for i in range(copies)]

    def _packed(self, matrix, features, targets, folds, slabs) -> DataFrame:
        """_PACKED of all observations. A cell is one row, with its bin as a regulator's and its value as a target's."""
        value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
        kinds = matrix.expr.where(F.col("var_id").isin(sorted({*features, *targets}))).withColumn("value", value)
        cuts = quantile_cuts(kinds.where(F.col("var_id").isin(features)), self.p.bins)
        below = F.size(F.filter("cuts", lambda c: c < F.col("value")))
        bins = F.when(F.col("value").isNotNull() & F.col("cuts").isNotNull(), below).otherwise(MISSING).cast("short")
        rows = kinds.join(small_side(cuts), "var_id", "left").select("obs_id", "var_id", bins.alias("bin"), "value")
        if folds is not None:
            rows = rows.unionByName(folds.select("obs_id", F.lit(0).alias("var_id"), F.lit(-1).cast("short").alias("bin"), F.col("fold").cast("double").alias("value")))
        names = [np.array(x, np.int64) for x in (features, targets)]
        order = [np.argsort(x) for x in names]

        def pack(table: pa.Table) -> pa.Table:
            obs, var, bins, value = (table.column(c).to_numpy() for c in ("obs_id", "var_id", "bin", "value"))
            seen, at = np.unique(obs, return_inverse=True)
            q = np.full((len(features), len(seen)), MISSING, np.uint8)
            y = np.full((len(targets), len(seen)), np.nan)
            fold = np.full(len(seen), -1, np.int16)
            cell = (bins >= 0) & ~np.isnan(value)
            for grid, k, given, use in ((q, 0, bins, cell & (bins != MISSING)), (y, 1, value, cell)):
                if len(names[k]):
                    place = np.minimum(np.searchsorted(names[k], var, sorter=order[k]), len(names[k]) - 1)
                    use = np.flatnonzero(use & (names[k][order[k][place]] == var))
                    grid[order[k][place[use]], at[use]] = given[use]
            use = np.flatnonzero(bins < 0)
            fold[at[use]] = value[use]
            one = [table.column("slab")[0].as_py(), seen.astype(np.int64).tobytes(), q.tobytes(), [x.tobytes() for x in y], fold.tobytes()]
            return pa.table([pa.array([c], t) for c, t in zip(one, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()), strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])

        return rows.withColumn("slab", F.pmod(F.xxhash64("obs_id"), F.lit(slabs))).groupBy("slab").applyInArrow(pack, _PACKED)

    @staticmethod
    def _read(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[dict, Slab, list[int]]]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                obs = np.frombuffer(row["obs"], np.int64)
                y, f = ({i: np.frombuffer(x) for i, x in zip(row[of], row[c], strict=True)} if row[c] else {} for of, c in (("places", "y"), ("runs", "f")))
                yield row, Slab(obs, np.frombuffer(row["q"], np.uint8).reshape(width, len(obs)), y, np.frombuffer(row["fold"], np.int16), f), row["runs"]

    @staticmethod
    def _held(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[Slab, list[int]]]:
        """Slabs of the same runs, some at a time as one."""
        held: dict[int, tuple[list[Slab], list[int]]] = {}
        for row, slab, own in Slabs._read(batches, width):
            slabs, _ = held.setdefault(row["part"], ([], own))
            slabs.append(slab)
            if len(slabs) >= HELD and sum(len(s.obs) for s in slabs) * (width + len(slab.y) + 1) >= HELD_CELLS:
                yield Slab.joined(slabs), own
                del held[row["part"]]
        for slabs, own in held.values():
            yield Slab.joined(slabs), own

    def train_in_tasks(self, runs: list[Run]) -> DataFrame:
        """RESULT of all runs, where each task has all observations in its one slab."""
        p, width, features, given = self.p, self.width, self.features, {r.number: r for r in runs}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in groupby(Slabs._read(batches, width), key=lambda x: x[0]["part"]):
                slabs, owns = zip(*((slab, own) for _, slab, own in rows), strict=True)
                mine = [given[r] for r in owns[0]]
                train_on(Slab.joined(list(slabs)), mine, p)
                out = [_result(r, features) for r in mine]
                yield pa.RecordBatch.from_pylist([dict(zip(("target", "fold", "rounds", "tfs", "gains"), x, strict=True)) for x in out], _RESULT_TYPE)

        return self.frame.mapInArrow(run, RESULT)

    def starts(self, runs: list[Run]) -> None:
        width, jobs = self.width, {r.number: r.job() for r in runs}

        def run(batches):
            for _, slab, own in Slabs._read(batches, width):
                sums = [_start_sums(slab, jobs[r]) for r in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())], ["run", "g", "n"])

        found = self.frame.mapInArrow(run, "run int, g long, n long").groupBy("run").agg(F.sum("g"), F.sum("n")).collect()
        _starts(runs, {r[0]: (r[1], r[2]) for r in found})

    def step(self, jobs: list[Job]) -> dict:
        """A leaf's best split is sought within pieces of the features, then among them."""
        p, width = self.p, self.width
        shared = self.spark.sparkContext.broadcast({j.run: j for j in jobs})
        piece = max(1, PIECE // (16 * (p.bins + 1) * max(len(j.unknown) for j in jobs)))
        pieces = -(-max(len(j.features) for j in jobs) // piece)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for slab, own in Slabs._held(batches, width):
                for r in own:
                    if r in shared.value:
                        g, n, error, rows = gradient_sums(slab, shared.value[r], p)
                        if r in sums:
                            sums[r] = [x + y for x, y in zip(sums[r], (np.stack([g, n]), error, rows), strict=True)]
                        else:
                            sums[r] = [np.stack([g, n]), error, rows]
                if sum(x[0].nbytes for x in sums.values()) >= SUMS:
                    yield from handed(sums)
                    sums = {}
            yield from handed(sums)

        def handed(sums: dict[int, list]) -> Iterator[pa.RecordBatch]:
            for r, (both, error, rows) in sums.items():
                for k in range(0, both.shape[2], piece):
                    row = (r, k // piece, both[:, :, k : k + piece].tobytes(), error if k == 0 else 0.0, rows if k == 0 else 0)
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int64()), strict=True)], ["run", "piece", "sums", "error", "rows"])

        def pick(table: pa.Table) -> pa.Table:
            job, k = shared.value[table.column("run")[0].as_py()], table.column("piece")[0].as_py()
            both = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("sums")).reshape(2, len(job.unknown), -1, p.bins + 1)
            error, rows = sum(table.column("error").to_pylist()), sum(table.column("rows").to_pylist())
            out = [(job.run, slot, s.gain, k, s.feature + k * piece if s.feature >= 0 else -1, s.cut, s.g_left, s.n_left, s.g, s.n, error, rows) for slot, s in enumerate(best_splits(*both, p.least_leaf))]
            kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
            return pa.table({name: pa.array(c, kinds[t]) for (name, t), c in zip((x.split() for x in _BEST.split(", ")), zip(*out, strict=True), strict=True)})

        sums = self.frame.mapInArrow(add, _PIECE)
        best = sums.repartition(min(self.parts, len(jobs) * pieces), "run", "piece").groupBy("run", "piece").applyInArrow(pick, _BEST)
        if pieces > 1:
            first = F.max(F.struct("gain", (-F.col("piece")).alias("piece"), "feature", "cut", "g_left", "n_left", "g", "n")).alias("s")
            best = best.groupBy("run", "slot").agg(first, F.sum("error").alias("error"), F.sum("rows").alias("rows")).select("run", "slot", "s.*", "error", "rows")
        out: dict[int, list] = {}
        for r in sorted(self._collected(best), key=lambda r: (r["run"], r["slot"])):
            splits, _, _ = out.setdefault(r["run"], [[], r["error"], r["rows"]])
            splits.append(Split(r["gain"], r["feature"], r["cut"], r["g_left"], r["n_left"], r["g"], r["n"]))
        shared.destroy()
        return out

    def _collected(self, frame: DataFrame) -> list:
        """Rows of a short job. Its stages are known, so it is not planned anew between them."""
        was = self.spark.conf.get("spark.sql.adaptive.enabled")
        self.spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return frame.collect()
        finally:
            self.spark.conf.set("spark.sql.adaptive.enabled", was)

    def keep(self, jobs: list[Job]) -> None:
        """Writes the predictions after the rounds so far; runs that have ended are left out."""
        width, shared = self.width, self.spark.sparkContext.broadcast({j.run: j for j in jobs})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, slab, own in Slabs._read(batches, width):
                alive = [r for r in own if r in shared.value]
                row["runs"], row["f"] = alive, [slab.predicted(shared.value[r]).tobytes() for r in alive]
                yield pa.RecordBatch.from_pylist([row], _SLAB_TYPE)

        before, self.frame = self.frame, written(self.frame.mapInArrow(run, _SLAB))
        discard(before)
        shared.destroy()


def kfold(observations: DataFrame, folds: int, seed: str = "72") -> DataFrame:
    """obs_id, place, fold: contiguous blocks of a permutation in the order of an md5.

    The md5's leading digits deal the observations into ranges of that order, of about a million at most; a place is
    the number of observations in earlier ranges, and that of earlier ones in its own. Only the sizes of ranges are
    collected.
    """
    keyed = observations.select("obs_id").withColumn("_key", F.md5(F.concat_ws(":", "obs_id", F.lit(seed))))
    n = observations.count()
    digits = 2
    while n / 16**digits > 1_000_000:
        digits += 1
    keyed = keyed.withColumn("_range", F.substring("_key", 1, digits))
    before, total = [], 0
    for r in sorted(keyed.groupBy("_range").count().collect()):
        before.append((r["_range"], total))
        total += r["count"]
    offsets = observations.sparkSession.createDataFrame(before, "_range string, _before long")
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_key", "obs_id")) - 1
    placed = keyed.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn("place", F.col("_before") + F.col("_inside"))
    return placed.select("obs_id", "place", block_owner(F.col("place"), folds, n).alias("fold"))


def _largest(matrix: Matrix, targets: DataFrame) -> dict[int, float]:
    """The largest absolute value of each target."""
    rows = matrix.expr.where(~F.isnan("value") & (F.abs("value") < float("inf"))).join(small_side(targets), "var_id")
    return {r[0]: r[1] for r in rows.groupBy("var_id").agg(F.max(F.abs("value"))).collect()}


def _lots(targets: list[int], folds: int) -> Iterator[list[int]]:
    """Targets in lots of up to MOST_RUNS runs."""
    size = max(1, MOST_RUNS // max(folds, 1))
    for lo in range(0, len(targets), size):
        yield targets[lo : lo + size]


def _trained(matrix: Matrix, tfs: list[int], targets: list[int], folds: int, params: BoostParams) -> DataFrame:
    """RESULT of a run for each target, or for each target and fold. Each lot's results are appended to a table once it is trained."""
    spark = matrix.expr.sparkSession
    path = new_folder(spark)
    spark.createDataFrame([], RESULT).write.parquet(path)
    dealt = written(kfold(matrix.expr.select("obs_id").distinct(), folds)) if folds else None
    for lot in _lots(targets, folds):
        largest = _largest(matrix, spark.createDataFrame([(t,) for t in lot], "var_id int"))
        of = [(t, k) for t in lot for k in (range(folds) if folds else [None])]
        place = {t: i for i, t in enumerate(lot)}
        runs = [Run(i, t, place[t], k, tfs, largest.get(t, 0.0), params, len(tfs)) for i, (t, k) in enumerate(of)]
        slabs = Slabs(matrix, tfs, runs, dealt, params)
        if slabs.alone:
            results = slabs.train_in_tasks(runs)
        else:
            slabs.starts(runs)
            train(runs, slabs.step, slabs.keep)
            results = spark.createDataFrame([_result(r, tfs) for r in runs], RESULT)
        results.write.mode("append").parquet(path)
        if not slabs.alone:
            discard(slabs.frame)
    return spark.read.schema(RESULT).parquet(path)


def _targets(matrix: Matrix) -> list[int]:
    return sorted(r[0] for r in matrix.expr.select("var_id").distinct().collect())


def gb_network(matrix: Matrix, tfs: list[int], params: BoostParams, threshold: float | None = 0.0) -> DataFrame:
    """tf, target, importance over a threshold (None: all): one regressor for each target; a regulator is no feature of itself.

    Null and non-finite values are missing: beyond every cut as a feature, left out as a target's. A repeated
    (obs_id, var_id) counts once, by any of its values.
    """
    found = _trained(matrix, tfs, _targets(matrix), 0, params)
    edges = found.select("target", F.explode(F.arrays_zip("tfs", "gains")).alias("e")).select(F.col("e.tfs").alias("tf"), "target", F.col("e.gains").alias("importance"))
    return edges if threshold is None else edges.where(F.col("importance") > threshold)


def cv_rounds(matrix: Matrix, tfs: list[int], targets: list[int], folds: int, params: BoostParams) -> DataFrame:
    """target, fold, rounds: the best round of a run without the fold, by its error on the fold."""
    return _trained(matrix, tfs, targets, folds, params).select("target", "fold", "rounds")


def cv_stats(rounds: DataFrame) -> DataFrame:
    """summary() of column rounds, its order statistics as whole numbers."""
    s = summary(rounds, "rounds")
    return s.select("mean", "stdev", *[F.col(c).cast("long").alias(c) for c in ("median", "p25", "p75", "least", "most")])
