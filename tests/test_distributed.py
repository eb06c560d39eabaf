"""What is dealt over tasks against plain computations."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacework.functions import scalars
from lacework.operators import binning, boost, measures, pairs, puc, quantiles
from lacework.plans.config import BoostConfig, ConfigError, PucConfig, read_config
from lacework.plans.workflow import BoostWorkflow, PucWorkflow
from lacework.sources import store
from lacework.sources.matrix import Matrix, open_matrix, read_csv_column

CELL = "obs_id long, var_id int, value double"


def long_form(spark, x):
    return spark.createDataFrame([(o, v, None if x[o, v] is None else float(x[o, v])) for o in range(len(x)) for v in range(x.shape[1])], CELL)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_order_statistics(spark):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(size=3000),
        "ties": rng.integers(0, 4, 2000).astype(float),
        "wide": np.concatenate([np.exp(rng.normal(size=1000) * 100), -np.exp(rng.normal(size=1000) * 100), [0.0, -0.0, 5e-324, 1.7e308, -1.7e308, math.inf, -math.inf]]),
        "one": np.array([7.5]),
        "near": 1 + np.arange(1500) * 2.0**-52,
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("one", None), ("one", math.nan), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    places = lambda n: F.transform(F.sequence(F.lit(-1), F.lit(20)), lambda i: F.floor(n * i / 20).cast("long"))
    got = {r["k"]: (r["n"], r["stats"]) for r in quantiles.order_statistics(frame, ["k"], "v", places).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        s, n = np.sort(x), len(x)
        assert got[k] == (n, [s[n * i // 20] for i in range(20)]), k
    (row,) = quantiles.summary(frame.where("k = 'ties'"), "v").collect()
    s = np.sort(groups["ties"])
    assert (row["median"], row["p25"], row["p75"], row["least"], row["most"]) == (s[1000], s[500], s[1500], s[0], s[-1])
    assert math.isclose(row["mean"], s.mean()) and math.isclose(row["stdev"], s.std())
    assert quantiles.order_statistics(frame.where("false"), ["k"], "v", places).collect() == []


def test_no_group_holds_a_variable_whole(spark):
    frame = spark.range(4000).select(F.lit(0).alias("var_id"), (F.col("id") * 7919 % 4001).cast("double").alias("value"))
    (row,) = quantiles.quantile_cuts(frame, 64).collect()
    s = np.sort(np.arange(4000) * 7919 % 4001)
    assert row["cuts"] == sorted({float(s[4000 * i // 64]) for i in range(1, 64)})


def test_kfold_ranks_without_one_task(spark):
    import hashlib

    obs = spark.range(700).select((F.col("id") * 3).alias("obs_id"))
    folds = boost.kfold(obs, 7, "x")
    order = sorted(range(0, 2100, 3), key=lambda i: (hashlib.md5(f"{i}:x".encode()).hexdigest(), i))
    got = {r["obs_id"]: (r["place"], r["fold"]) for r in folds.collect()}
    assert got == {i: (p, p * 7 // 700) for p, i in enumerate(order)}
    assert "SinglePartition" not in plan(folds)
    assert boost.kfold(obs.where("false"), 3).collect() == []


def leafwise(q, y, p, rounds):
    """Gains of boosting by plain search in reals, on all rows and features."""
    f, gains = np.full(len(y), y.mean()), np.zeros(q.shape[1])
    for _ in range(rounds):
        r = y - f

        def best(rows):
            out = (0.0, None, None)
            for j in range(q.shape[1]):
                for cut in range(p.bins):
                    a, b = rows[q[rows, j] <= cut], rows[q[rows, j] > cut]
                    if min(len(a), len(b)) >= p.least_leaf:
                        g = r[a].sum() ** 2 / len(a) + r[b].sum() ** 2 / len(b) - r[rows].sum() ** 2 / len(rows)
                        out = max(out, (g, j, cut), key=lambda x: x[0])
            return out

        leaves = [(best(np.arange(len(y))), np.arange(len(y)))]
        while len(leaves) < p.leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
            (g, j, cut), rows = leaves[k]
            if j is None:
                break
            gains[j] += g
            leaves.pop(k)
            for side in (rows[q[rows, j] <= cut], rows[q[rows, j] > cut]):
                leaves.append((best(side), side))
        for _, rows in leaves:
            f[rows] += p.learning_rate * r[rows].mean()
    return gains


@pytest.mark.parametrize("leaves", [2, 4, 9, 31])
def test_gains_of_several_rounds(leaves):
    rng = np.random.default_rng(leaves)
    q = rng.integers(0, 9, (150, 4))
    y = q[:, 0] * 0.5 + (q[:, 1] > 4) * q[:, 2] + rng.normal(size=150)
    p = boost.BoostParams(iterations=4, leaves=leaves, least_leaf=5, bagging=1.0, feature_fraction=1.0, bins=10)
    assert np.allclose(boost.boost(q, y, p)[0], leafwise(q, y, p, 4), rtol=1e-5, atol=1e-5)


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 9)).round(2)
    x[:, 6] = (x[:, 0] + x[:, 1] * (x[:, 2] > 0)).round(2)
    return x


def test_boosting_in_slabs_is_boosting_in_one(spark, wide, monkeypatch):
    """All rows and features: the same gains to the last bit, however observations and features are dealt."""
    given = dict(iterations=3, leaves=5, least_leaf=8, bagging=1.0, feature_fraction=1.0, bins=16)
    p = boost.BoostParams(**given)
    tfs = [7, 0, 1, 2, 3]
    cuts = [np.unique(np.sort(wide[:, v])[240 * np.arange(1, 16) // 16]) for v in tfs]
    q = np.stack([np.searchsorted(c, wide[:, v], "left") for c, v in zip(cuts, tfs, strict=True)], 1)
    want = {}
    for t in range(9):
        use = [i for i, v in enumerate(tfs) if v != t]
        # Draws are of all features here, so the order of places is all that counts.
        want |= {(tfs[i], t): g for i, g in zip(use, boost.boost(q[:, use], wide[:, t], p)[0], strict=True)}
    m = Matrix(long_form(spark, wide))
    for cells, piece, most in ((p.slab_cells, boost.PIECE, boost.MOST_RUNS), (700, 16 * 17 * 2, 5)):
        p = boost.BoostParams(**given, slab_cells=cells)
        monkeypatch.setattr(boost, "PIECE", piece)
        monkeypatch.setattr(boost, "MOST_RUNS", most)
        monkeypatch.setattr(boost, "HELD", 2)
        monkeypatch.setattr(boost, "KEPT_EVERY", 2)
        got = {(r["tf"], r["target"]): r["importance"] for r in boost.gb_network(m, tfs, p, None).collect()}
        assert got == want
    assert max((t for t in want if t[1] == 6), key=want.get)[0] in (0, 1)


def test_written_tables_are_discarded(spark):
    import os

    frame = store.written(spark.range(10))
    folder = frame.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    store.discard(frame)
    assert not os.path.exists(folder)


def test_bags_and_folds_do_not_depend_on_slabs(spark, wide):
    given = dict(iterations=7, leaves=3, least_leaf=8, bins=16, feature_fraction=0.5, bagging=0.7, bagging_freq=2, min_iterations=2, patience=3, metric="l1")
    holes = wide.astype(object)
    holes[::7, 3], holes[::11, 6] = None, None
    m = Matrix(long_form(spark, holes))
    found = []
    for more in ({}, {"slab_cells": 500}):
        p = boost.BoostParams(**given, **more)
        rounds = boost.cv_rounds(m, [0, 1, 2, 3], [6, 8], 3, p)
        edges = boost.gb_network(m, [0, 1, 2, 3], p, None)
        found.append((sorted(map(tuple, rounds.collect())), sorted(map(tuple, edges.collect()))))
    assert found[0] == found[1]
    rounds = {(t, k): n for t, k, n in found[0][0]}
    assert rounds.keys() == {(t, k) for t in (6, 8) for k in range(3)} and all(1 <= n <= 7 for n in rounds.values())
    assert min(rounds[6, k] for k in range(3)) >= max(rounds[8, k] for k in range(3)), "noise ends sooner"
    (s,) = boost.cv_stats(spark.createDataFrame(found[0][0], "target int, fold int, rounds int")).collect()
    order = sorted(rounds.values())
    assert (s["median"], s["p25"], s["p75"], s["least"], s["most"]) == (order[3], order[1], order[4], order[0], order[5])


def test_runs_are_trained_whole_where_a_task_can_hold_them(spark, wide, monkeypatch):
    """More cells than a slab has, without a job for each step: tasks put the packed slabs together. The same results as by steps."""
    given = dict(iterations=5, leaves=6, least_leaf=8, bins=16, feature_fraction=0.5, bagging=0.8, min_iterations=2, patience=2)
    m = Matrix(long_form(spark, wide))

    def found(**more):
        p = boost.BoostParams(**given, **more)
        rounds, edges = boost.cv_rounds(m, [0, 1, 2, 3], [6, 8], 3, p), boost.gb_network(m, [0, 1, 2, 3], p, None)
        return sorted(map(tuple, rounds.collect())), sorted(map(tuple, edges.collect()))

    want = found(slab_cells=500)
    monkeypatch.setattr(boost, "SLAB_CELLS", 500)
    monkeypatch.setattr(boost, "SENT_CELLS", 300)
    with monkeypatch.context() as steps:
        steps.setattr(boost.Slabs, "step", lambda *a: 1 / 0)
        assert found() == want
        steps.setattr(boost, "WHOLE", 1000)
        with pytest.raises(ZeroDivisionError):
            found()


def test_small_slabs_are_summed_as_one(monkeypatch):
    """A task makes one slab of its small ones, each part's by themselves, so that what it hands on does not grow with their number."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(30):
        n, part = int(rng.integers(1, 5)), k % 2
        cells = [np.arange(n) + 10 * k, rng.integers(0, 9, (2, n)).astype(np.uint8), [rng.normal(size=n)], np.zeros(n, np.int16), [rng.normal(size=n)]]
        rows.append(dict(slab=k, part=part, runs=[part], places=[7], obs=cells[0].tobytes(), q=cells[1].tobytes(), y=[x.tobytes() for x in cells[2]], fold=cells[3].tobytes(), f=[x.tobytes() for x in cells[4]]))
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 7], boost._SLAB_TYPE) for i in range(0, 30, 7)]
    single = [(slab, own) for _, slab, own in boost.Slabs._read(batches, 2)]
    held = list(boost.Slabs._held(batches, 2))
    assert [own for _, own in held] == [[0], [1]]
    for slab, own in held:
        mine = [s for s, o in single if o == own]
        assert np.array_equal(slab.q, np.concatenate([s.q for s in mine], 1)) and np.array_equal(slab.y[7], np.concatenate([s.y[7] for s in mine]))
        assert np.array_equal(slab.f[own[0]], np.concatenate([s.f[own[0]] for s in mine])) and np.array_equal(slab.obs, np.concatenate([s.obs for s in mine]))
    monkeypatch.setattr(boost, "HELD_CELLS", 1)
    assert len(list(boost.Slabs._held(batches, 2))) == 8, "large ones up to HELD at a time"


def test_sums_of_a_run_at_hand_are_those_of_steps():
    """The smaller side is counted, the other is what is left."""
    rng = np.random.default_rng(1)
    q = rng.integers(0, 9, (5, 400)).astype(np.uint8)
    q[2, ::9] = boost.MISSING
    y = q[0] * 0.5 + rng.normal(size=400)
    y[::13] = np.nan
    p = boost.BoostParams(iterations=6, leaves=7, least_leaf=5, bins=10, feature_fraction=0.6)
    slab = boost.Slab(np.arange(400), q, {3: y}, rng.integers(0, 4, 400).astype(np.int16), {})
    run = boost.Run(0, 9, 3, 1, [1, 2, 3, 4, 5], float(np.nanmax(np.abs(y))), p, 5)
    boost._starts([run], {0: boost._start_sums(slab, run.job())})
    held, seen = boost.Whole(slab, run.job(), p), 0
    while not run.done:
        job = run.job()
        g, n, error, rows = held.gradient_sums(job)
        for a, b in zip((g, n, error, rows), boost.gradient_sums(slab, job, p), strict=True):
            assert np.array_equal(a, b)
        run.take(boost.best_splits(g, n, p.least_leaf), error, rows)
        seen += 1
    assert seen > 12


def test_boosting_parameters():
    for odd in ({"bins": 255}, {"metric": "auc"}):
        with pytest.raises(ConfigError):
            BoostConfig("m", "o", "gb_grn", gbm_params=odd)
    assert BoostConfig("m", "o", "gb_grn", gbm_params={"metric": "l2", "bagging_freq": 5}).params.bagging_freq == 5
    obs = np.arange(5000)
    p = boost.BoostParams(bagging=0.6, bagging_freq=3)
    bags = [boost.in_bag(obs, 4, turn, p) for turn in range(1, 8)]
    assert all(abs(b.mean() - 0.6) < 0.03 for b in bags)
    assert (bags[0] == bags[2]).all() and (bags[3] == bags[5]).all() and (bags[0] != bags[3]).any()
    assert boost.in_bag(obs, 4, 1, boost.BoostParams(bagging_freq=0)).all()


def test_nothing_to_boost(spark):
    m = Matrix(spark.createDataFrame([], CELL))
    assert boost.gb_network(m, [0], boost.BoostParams(iterations=2)).collect() == []
    alone = Matrix(long_form(spark, np.ones((30, 1))))
    assert boost.gb_network(alone, [0], boost.BoostParams(iterations=2), None).collect() == []


def test_tiles_of_triples(spark, monkeypatch):
    x = np.round(np.random.default_rng(5).normal(size=(80, 11)), 1)
    x[:, 3] = 1.0
    x[:, 4] = x[:, 5]
    expr = long_form(spark, x)
    cells = measures.log_ratios(pairs.joint_histogram(binning.assign(expr, binning.uniform_edges(expr, 3))))
    si = store.written(measures.specific_information(cells))
    table = {}
    for r in si.collect():
        table.setdefault(r["about"], {}).setdefault(r["by"], {})[r["state"]] = (r["si"], r["n_state"] / 80)
    want = {}
    for a, of in table.items():
        for b in of:
            for z in of:
                if b != z:
                    want[a, b, z] = sum(w * min(v, of[z][s][0]) for s, (v, w) in of[b].items())
    mi = {(a, b): sum(v * w for v, w in of[b].values()) for a, of in table.items() for b in of}
    share = {k: max(0.0, (mi[k[:2]] - r) / mi[k[:2]]) if mi[k[:2]] else 0.0 for k, r in want.items()}
    samples = spark.createDataFrame([(0, 1), (0, 4), (1, 1), (1, 9), (1, 10)], "round int, var_id int")
    count = {1: 2, 4: 1, 9: 1, 10: 1}
    for tile in (512, 3):
        monkeypatch.setattr(measures, "TILE", tile)
        got = {(r["about"], r["by"], r["other"]): r["redundancy"] for r in measures.redundancies(si, 80).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
        for frame, weight in ((puc.puc_direct(si, 80), lambda z: 1.0), (puc.puc_direct_sampled(si, 80, samples), lambda z: count.get(z, 0) / 2)):
            rows = {(r["x"], r["y"]): r["puc"] for r in frame.collect()}
            assert len(rows) == 55
            for (a, b), v in rows.items():
                both = sum(weight(z) * s for (i, j, z), s in share.items() if {i, j} == {a, b})
                assert math.isclose(v, both, abs_tol=1e-6), (a, b)
    assert "Join" not in plan(puc.puc_direct(si, 80))


def test_pairs_of_repeated_and_missing_cells(spark):
    rows = [(1, 0, 0), (1, 1, 2), (1, 1, 1), (2, 0, 1), (2, 1, 0), (3, 1, 1), (4, 0, 1), (4, 0, 1), (4, 1, 0)]
    binned = spark.createDataFrame(rows, "obs_id long, var_id int, bin int")
    want = [(0, 1, 0, 2, 1), (0, 1, 1, 0, 2)]
    assert sorted(map(tuple, pairs.joint_histogram(binned).collect())) == want
    assert sorted(map(tuple, pairs.joint_histogram_blocks(binned).collect())) == want
    expr = spark.createDataFrame([(1, 0, 1.0), (2, 0, None), (3, 0, math.nan), (4, 0, 3.0), (5, 0, 9.0)], CELL)
    edges = spark.createDataFrame([(0, [1.0, 2.0, 4.0])], "var_id int, edges array<double>")
    assert {r["obs_id"]: r["bin"] for r in binning.assign(expr, edges).collect()} == {1: 0, 3: 1, 4: 1, 5: 1}
    null = spark.createDataFrame([(None, [1.0, 2.0])], "v double, e array<double>")
    assert null.select(scalars.bin_of(F.col("v"), F.col("e"))).first()[0] is None


def test_blocks_travel_once_for_a_side(spark):
    x = np.random.default_rng(2).normal(size=(40, 24)).round(1)
    binned = binning.assign(expr := long_form(spark, x), binning.uniform_edges(expr, 3))
    want = sorted(map(tuple, pairs.joint_histogram(binned).collect()))
    for side in (1, 2, 5, 12):
        assert sorted(map(tuple, pairs.joint_histogram_blocks(binned, width=2, observations=16, side=side).collect())) == want
    packed = spark.createDataFrame([(0, b, [b], b"", b"") for b in range(96)], "slab long, block int, vars array<int>, obs binary, grid binary")
    assert [pairs.squares(packed, 96, side).count() for side in (1, 4, 8)] == [96 * 96, 96 * 24, 96 * 12]


def test_no_group_packs_a_slab_whole(spark, monkeypatch):
    """A slab of a block comes in pieces, of which some lack a variable; the counts are those of the join."""
    x = np.random.default_rng(3).normal(size=(90, 7)).round(1).astype(object)
    x[1:, 2] = None
    x[::4, 5] = None
    binned = store.written(binning.assign(expr := long_form(spark, x), binning.uniform_edges(expr, 3)))
    want = sorted(map(tuple, pairs.joint_histogram(binned).collect()))
    sizes, frame, plain = [], type(binned), pairs.squares
    monkeypatch.setattr(pairs, "PACKED_CELLS", 32)
    monkeypatch.setattr(pairs, "squares", lambda packed, *a: sizes.append(packed.select(F.size("vars").alias("n"), (F.length("obs") / 8).alias("o")).collect()) or plain(packed, *a))
    for observations in (1000, 40):
        sizes.clear()
        assert isinstance(got := pairs.joint_histogram_blocks(binned, width=4, observations=observations), frame)
        assert sorted(map(tuple, got.collect())) == want
        assert max(r["n"] * r["o"] for r in sizes[0]) <= 32 * 3 and sum(r["o"] for r in sizes[0]) <= 180


def test_grids_are_not_widened_whole():
    """Counting two blocks takes far less than their grids in 64 bits, and counts what a plain count does."""
    rng = np.random.default_rng(3)
    blocks = [(np.arange(lo, lo + 64), np.arange(at, at + 65_536), rng.integers(-1, 4, (64, 65_536)).astype(np.int16)) for lo, at in ((0, 0), (64, 0), (64, 7))]
    for first, second in ((0, 0), (0, 1), (0, 2)):
        tracemalloc.start()
        found = list(pairs.counted(blocks[first], blocks[second]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 * 65_536 * 8 / 2
        assert len(found) == (64 * 63 // 2 if first == second else 64 * 64)
        a, b = blocks[first], blocks[second]
        x, y, bx, by, n = found[100]
        lag = b[1][0] - a[1][0]
        row, other = a[2][x[0] - a[0][0]][lag:], b[2][y[0] - b[0][0]][: 65_536 - lag]
        want = {(u, v): int(((row == u) & (other == v)).sum()) for u in range(4) for v in range(4)}
        assert dict(zip(zip(bx.tolist(), by.tolist(), strict=True), n.tolist(), strict=True)) == want


def test_squares_are_dealt_by_their_work():
    bins = {b: 64 * (1 + 400 * (b % 5 == 0)) for b in range(60)}
    owners = pairs.placement(bins, 4, 7, 64, 1)
    assert owners.keys() == {(i, j) for i in range(15) for j in range(i, 15)}
    wide = [sum(n for b, n in bins.items() if b // 4 == k) for k in range(15)]
    cost = {(i, j): (64 * 64 * 16 + wide[i] * wide[j]) // (2 if i == j else 1) for i, j in owners}
    loads = [sum(c for s, c in cost.items() if owners[s] == t) for t in range(7)]
    assert max(loads) <= 4 / 3 * max(sum(cost.values()) / 7, max(cost.values()))


def whole_programme(values, counts):
    n = len(values)
    edges = np.concatenate([values[:1], (values[1:] + values[:-1]) / 2, values[-1:]])
    total = np.concatenate([[0.0], np.cumsum(counts)])
    best, last = np.zeros(n + 1), np.zeros(n + 1, int)
    for k in range(1, n + 1):
        inside = total[k] - total[:k]
        x = inside * np.log(inside / (edges[k] - edges[:k])) - (4 - np.log(73.53 * 0.05 * k**-0.478)) + best[:k]
        last[k] = k - 1 - np.argmax(x[::-1])
        best[k] = x[last[k]]
    cuts, at = [n], n
    while at > 0:
        cuts.append(at := last[at])
    return edges[cuts[::-1]]


@pytest.mark.parametrize("kind", range(5))
def test_pruned_blocks_are_those_of_the_whole_programme(kind):
    rng = np.random.default_rng(kind)
    for size in (2, 3, 65, 700, 3000):
        x = [rng.normal(size=size), rng.integers(0, 50, size) / 7, rng.exponential(size=size) ** 3, np.concatenate([rng.normal(size=size), rng.normal(size=size) * 0.01 + 3]), np.arange(size) * 1.0][kind]
        v, c = np.unique(x, return_counts=True)
        for chunk in (None, 1, 5):
            assert np.array_equal(binning.block_edges(v, c.astype(float), chunk if size < 1000 else None), whole_programme(v, c.astype(float)))


def test_csv_files_keep_their_order(spark, tmp_path):
    sizes = {"a.csv": 3, "b.csv": 4000, "c.csv": 40}
    for name, n in sizes.items():
        (tmp_path / name).write_text("k,gene\n" + "".join(f"{i},{name}{i}\n" + ("broken,row,of,many\n" if i % 7 == 3 else "") for i in range(n)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in (was, "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            rows = read_csv_column(spark, str(tmp_path), "gene")
            got = [(r["ord"], r["gene"]) for r in rows.orderBy("ord").collect()]
            assert got == list(enumerate(f"{name}{i}" for name, n in sizes.items() for i in range(n)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.fixture
def stored(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(50, 6)).round(1)
    path = f"{tmp_path}/m"
    spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(path)
    return path


def test_stored_information_is_clustered(spark, stored, tmp_path):
    run = PucWorkflow(spark, PucConfig(stored, ["hist_nodes", "hist2misi_dist", "puc_lmr_dist"], f"{tmp_path}/o", buckets=3)).run()
    si = run.read("ord_si")
    assert "Exchange" not in plan(puc.min_sums(si.select("about", "by", "state", "lmr")))
    assert "Exchange" not in plan(measures.unique_shares(si, 50)) and si.count() == spark.read.parquet(f"{tmp_path}/o/ord_si").count()
    for name in ("pair_mi", "puc"):
        order = [(r["x"], r["y"]) for r in run.read(name).collect()]
        assert order == sorted(order) and len(order) == 15
    direct = puc.puc_lmr(spark.read.parquet(f"{tmp_path}/o/ord_si"), run.read("pair_mi"), 6)
    assert {tuple(r)[:2]: round(r["puc"], 9) for r in direct.collect()} == {tuple(r)[:2]: round(r["puc"], 9) for r in run.read("puc").collect()}


def test_a_broken_run_goes_on(spark, stored, tmp_path, monkeypatch):
    config = PucConfig(stored, ["hist_nodes", "hist_dist", "misi_dist", "puc_lmr_dist"], f"{tmp_path}/o", resume=True)
    broken = PucWorkflow(spark, config)
    monkeypatch.setattr(measures, "mutual_information_of", lambda si: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.run()
    assert broken.whole("pair_hist") and broken.whole("ord_si") and not broken.whole("pair_mi")
    monkeypatch.undo()
    made = []
    again = PucWorkflow(spark, config)
    write = again._write
    monkeypatch.setattr(again, "_write", lambda name, *a: made.append(name) or write(name, *a))
    again.run()
    assert made == ["ord_si", "pair_mi", "puc"]
    made.clear()
    assert again.run().read("puc").count() == 15 and made == []
    other = PucWorkflow(spark, PucConfig(stored, config.mode, f"{tmp_path}/o", resume=True, tbase="e"))
    assert other.whole("nodes") and not other.whole("ord_si") and not other.whole("puc")
    store.unmark(spark, f"{tmp_path}/o/nodes")  # as while it is written anew
    with pytest.raises(FileNotFoundError):
        again.read("nodes")


def test_matrices_of_named_columns(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(40, 3)).round(2)
    wide_ = spark.createDataFrame([(i, *map(float, r), "text") for i, r in enumerate(x)], "cell long, `g.a` double, gb double, gc double, note string")
    wide_.write.parquet(f"{tmp_path}/wide")
    m = open_matrix(spark, f"{tmp_path}/wide", "cell", None)
    assert m.read_genes(["gc", "g.a", "note"]).select("var_id").distinct().count() == 2 and m.dims().first()["nvars"] == 3
    assert {r["obs_id"]: r["value"] for r in m.read_gene("g.a").collect()} == dict(enumerate(x[:, 0].tolist()))
    (tmp_path / "tf.csv").write_text("gene\ngc\nnone\n")
    (tmp_path / "gb.yml").write_text(f"h5ad_file: {tmp_path}/wide\nobs_col: cell\nvalues_col: null\ntf_csv_file: {tmp_path}/tf.csv\noutput_file: {tmp_path}/gb\nmode: gb_grn\nskip_cv: true\nnum_iterations: 2\nsamples_file: x\ngbm_params:\n  feature_fraction: 1.0\n  least_leaf: 5\n")
    with pytest.warns(UserWarning, match="samples_file"):
        config = read_config(f"{tmp_path}/gb.yml", BoostConfig)
    assert BoostWorkflow(spark, config).run().tfs == [2]
    assert {r["target"] for r in spark.read.parquet(f"{tmp_path}/gb/gb_edges").collect()} <= {0, 1}


def test_dense_rows(spark):
    si = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 4, 0.25), (0, 1, 1, 2.0), (3, 0, 0, 1.0)], "about int, state int, by int, si double")
    dense = store.dense_rows(si, "si", 5)
    assert sorted(map(tuple, dense.collect())) == [(0, 0, [0.0, 0.5, 0.0, 0.0, 0.25]), (0, 1, [0.0, 2.0, 0.0, 0.0, 0.0]), (3, 0, [1.0, 0.0, 0.0, 0.0, 0.0])]
    assert sorted(map(tuple, store.read_point(dense, 0, 4).collect())) == [(0, 0.25), (1, 0.0)]
    assert sorted(map(tuple, store.read_slice(dense, 0, 1, 3).collect())) == [(0, [0.5, 0.0]), (1, [2.0, 0.0])]
    assert "Generate" not in plan(dense)
