import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacework.functions import scalars
from lacework.operators import binning, boost, measures, pairs, puc
from lacework.plans import queries
from lacework.plans.config import BoostConfig, ConfigError, PucConfig, read_config
from lacework.plans.workflow import BoostWorkflow, PucWorkflow
from lacework.sources import store
from lacework.sources.matrix import GeneSet, Matrix, open_packed, read_csv_column


@pytest.fixture(scope="module")
def expr(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).round(1)
    x[:, 1] = x[:, 0]
    x[:, 2] = 3.0
    return spark.createDataFrame([(o, v, float(x[o, v])) for o in range(60) for v in range(5)], "obs_id long, var_id int, value double").cache()


def cells(expr):
    return measures.log_ratios(pairs.joint_histogram(binning.assign(expr, binning.uniform_edges(expr, 4))))


def test_unique_counts(spark):
    values = np.random.default_rng(17).integers(0, 12, 90).tolist()
    df = spark.createDataFrame([(i, 0, v / 4) for i, v in enumerate(values)], "obs_id long, var_id int, value double")
    assert {r["value"]: r["n"] for r in binning.unique_counts(df).collect()} == {v / 4: values.count(v) for v in set(values)}


def test_rounding(spark):
    given = [1.23456, -0.004, 250.5051, -2.125, 0.125, 99.995001]
    df = spark.createDataFrame([(v,) for v in given], "v double").select(scalars.around(F.col("v"), 2))
    want = [math.copysign(math.floor(abs(v) * 100 + 0.5) / 100, v) for v in given]
    assert [r[0] for r in df.collect()] == want


def test_measures_hold_their_identities(expr):
    c = cells(expr).cache()
    mi = {(r["x"], r["y"]): r["mi"] for r in measures.mutual_information(c).collect()}
    si = measures.specific_information(c).collect()
    for r in mi.values():
        assert r >= -1e-12
    assert all(abs(v) < 1e-12 for (x, y), v in mi.items() if 2 in (x, y))  # a constant
    for about, by in ((0, 3), (3, 0)):
        total = sum(r["lmr"] for r in si if (r["about"], r["by"]) == (about, by))
        assert math.isclose(total, mi[min(about, by), max(about, by)], abs_tol=1e-12)
    h = [r["n"] / 60 for r in binning.histogram(binning.assign(expr, binning.uniform_edges(expr, 4))).where("var_id = 0").collect()]
    assert math.isclose(mi[0, 1], -sum(p * math.log2(p) for p in h))  # equal variables: the entropy


def test_direct_and_sorted_puc_agree(expr):
    c = cells(expr)
    si, mi = measures.specific_information(c), measures.mutual_information(c)
    a = {(r["x"], r["y"]): r["puc"] for r in puc.puc_direct(si, 60).collect()}
    b = {(r["x"], r["y"]): r["puc"] for r in puc.puc_lmr(si, mi, 5).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_blocks_count_as_the_join_does(expr):
    b = binning.assign(expr, binning.uniform_edges(expr, 4))
    a = sorted(map(tuple, pairs.joint_histogram(b).collect()))
    assert a == sorted(map(tuple, pairs.joint_histogram_blocks(b, width=2, observations=16).collect()))


def test_block_edges():
    assert binning.block_edges(np.array([2.0]), np.array([5.0])).tolist() == [2.0, 2.0]
    e = binning.block_edges(np.arange(10.0), np.ones(10))
    assert e[0] == 0 and e[-1] == 9


def test_spline_weights_sum_to_one(spark):
    for order in (1, 2, 3):
        df = spark.createDataFrame([(z * (6 - order + 1) / 10,) for z in range(11)], "z double")
        total = sum((scalars.spline_weight(F.col("z"), i, order, 6) for i in range(1, 6)), scalars.spline_weight(F.col("z"), 0, order, 6))
        assert all(math.isclose(r[0], 1) for r in df.select(total).collect())


def test_matrix_lookups(spark, expr):
    m = Matrix(expr, spark.createDataFrame([("a", 0), ("b", 1), ("a", 3)], "gene string, var_id int"))
    assert {r["var_id"] for r in m.read_gene("a").collect()} == {3}
    with pytest.raises(KeyError):
        m.read_gene("none")
    assert m.read_genes(["b", "none"]).count() == 60


def test_config():
    with pytest.raises(NotImplementedError):
        PucConfig("m", ["puc2pidc"])
    with pytest.raises(ConfigError):
        PucConfig("m", ["odd"])


def test_gene_sets_stores_and_views(spark, expr, tmp_path):
    (tmp_path / "tf.csv").write_text("gene,tissue\nb,x\nnone,y\na,z\nbroken,line,of,four\nb,w\n")
    names = read_csv_column(spark, str(tmp_path / "tf.csv"), "gene")
    assert [r["gene"] for r in names.orderBy("ord").collect()][:3] == ["b", "none", "a"]
    with pytest.raises(KeyError):
        read_csv_column(spark, str(tmp_path / "tf.csv"), "missing")
    m = Matrix(expr, spark.createDataFrame([("a", 0), ("b", 1), ("a", 3), ("c", 4)], "gene string, var_id int"))
    chosen = GeneSet(m, names.where("ord < 3"), 1)
    assert chosen.contains_gene("a") and not chosen.contains_gene("c") and chosen.contains(3) and not chosen.contains(0)
    assert (chosen.index_of(1), chosen.index_of(3)) == (0, 1) and chosen.rows().count() == 120
    own = {r["obs_id"]: r["value"] for r in expr.where("var_id = 3").collect()}
    assert {r["obs_id"]: r["value"] for r in chosen.column_for("a").collect()} == own
    for missing in (lambda: chosen.column_for("c"), lambda: chosen.column(2), lambda: chosen.index_of(0)):
        with pytest.raises(KeyError):
            missing()
    m.first(3).write_packed(f"{tmp_path}/packed")
    rows = open_packed(spark, f"{tmp_path}/packed", 1, 3)
    assert {r["var_id"] for r in rows.collect()} == {1, 2} and rows.count() == 120
    assert "GreaterThanOrEqual(var_id,1)" in rows._jdf.queryExecution().toString()
    store.write_scalars(spark, f"{tmp_path}/meta", {"nobs": 60, "nvars": 5})
    assert store.read_scalar(spark, f"{tmp_path}/meta", "nvars") == 5
    with pytest.raises(KeyError):
        store.read_scalar(spark, f"{tmp_path}/meta", "nsi")
    for name in "ab":
        spark.createDataFrame([(name == "b", 1), (name == "b", 2)], "x boolean, y int").write.parquet(f"{tmp_path}/{name}")
    assert store.merge_shards(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], ["x", "y"]).count() == 4
    with pytest.raises(ValueError):
        store.merge_shards(spark, [f"{tmp_path}/a", f"{tmp_path}/a"], ["x", "y"])
    c = cells(expr)
    si = measures.specific_information(c)
    mi = measures.mutual_information_of(si)
    direct = {(r["x"], r["y"]): r["mi"] for r in measures.mutual_information(c).collect()}
    assert all(math.isclose(r["mi"], direct[r["x"], r["y"]], abs_tol=1e-12) for r in mi.collect()) and mi.count() == len(direct)
    nodes = binning.uniform_edges(expr, 4)
    view = store.InformationView.of_ranges(nodes, mi, si, 60, range(0, 2), range(4, 5))
    assert {r["about"] for r in view.ord_si.select("about").collect()} == {0, 1, 4} and view.nodes.count() == 3
    pair = store.InformationView.of_pair(nodes, mi, si, 60, 4, 3)
    assert math.isclose(pair.mutual_information(3, 4), direct[3, 4]) and pair.pair_mi.count() == 1
    whole = {(r["about"], r["by"], r["other"]): r["redundancy"] for r in measures.redundancies(si, 60).collect()}
    some = {r["other"]: r["redundancy"] for r in pair.redundancies(3, 4, spark.createDataFrame([(0,), (1,), (4,)], "var_id int")).collect()}
    assert some.keys() == {0, 1} and all(math.isclose(v, whole[3, 4, k]) for k, v in some.items())
    with pytest.raises(KeyError):
        pair.mutual_information(0, 1)


def test_configuration_files(spark, tmp_path):
    """One file of each shape: paths of histograms, information and scores by themselves, and regulators by name."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)).round(1)
    x[:, 1] = x[:, 0]
    path = f"{tmp_path}/m"
    spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(path)
    spark.createDataFrame([(i, f"g{i}") for i in range(4)], "var_id int, gene_ids string").write.parquet(f"{tmp_path}/names")
    (tmp_path / "puc.yml").write_text(f"h5ad_file: {path}\nrow_major_h5_file: {tmp_path}/packed\nhist_data_file: {tmp_path}/h\nmisi_data_file: {tmp_path}/m1\npuc_file: {tmp_path}/p\npidc_file: {tmp_path}/q\nnrounds: 2\nnsamples: 3\nnobs: 0\nnvars: 3\nmode:\n  - hist_nodes\n  - misi\n  - puc_lmr\ntbase: \"2\"\nsave_nodes: False\nsave_node_pairs: True\nlmr_only: True\nlog_level: info\n")
    run = PucWorkflow(spark, read_config(f"{tmp_path}/puc.yml", PucConfig)).run()
    assert run.read("puc").count() == 3 and run.read("pair_hist").count() and "si" not in run.read("ord_si").columns
    assert store.read_scalar(spark, f"{tmp_path}/h/meta", "npairs") == 3 and open_packed(spark, f"{tmp_path}/packed", 0, 9).count() == 180
    with pytest.raises(ValueError):
        run.mode_samples_ranges()
    (tmp_path / "tf.csv").write_text("gene\ng0\nother\ng3\n")
    (tmp_path / "gb.yml").write_text(f"h5ad_file: {path}\ntf_csv_file: {tmp_path}/tf.csv\nnames: {tmp_path}/names\ngene_id_col: gene_ids\noutput_file: {tmp_path}/gb\nmode: gb_grn\nskip_cv: true\nnum_iterations: 5\nimportance_filter: 0.5\ngbm_params:\n  verbose: 0\n  num_threads: 4\n  num_iterations: 9\n  bagging_fraction: 0.8\n  feature_fraction: 1.0\n  least_leaf: 5\n")
    config = read_config(f"{tmp_path}/gb.yml", BoostConfig)
    assert (config.params.iterations, config.params.bagging, config.mode) == (9, 0.8, ["gb_grn"])
    gb = BoostWorkflow(spark, config).run()
    edges = spark.read.parquet(f"{tmp_path}/gb/gb_edges").collect()
    assert gb.tfs == [0, 3] and all(r["importance"] > 0.5 and r["tf"] in (0, 3) for r in edges) and any((r["tf"], r["target"]) == (0, 1) for r in edges)
    assert config.params.iterations == 9
    (tmp_path / "odd.yml").write_text("h5ad_file: a\nmode: cv_gb\nodd: 1\n")
    with pytest.raises(ConfigError):
        read_config(f"{tmp_path}/odd.yml", BoostConfig)
    with pytest.raises(ConfigError):
        BoostConfig("m", "o", "cv_gb", gbm_params={"odd": 1})
    with pytest.raises(ConfigError):
        BoostConfig("m", "o", "cv_gb", tf_csv_file="x.csv")
    with pytest.raises(ConfigError):
        PucConfig("m", ["misi"]).path("puc")


def test_gains_of_one_round():
    """The first split of a tree against all splits by brute force."""
    rng = np.random.default_rng(6)
    q, y = rng.integers(0, 5, (60, 3)), rng.normal(size=60)
    p = boost.BoostParams(iterations=1, leaves=2, least_leaf=5, bagging=1.0, feature_fraction=1.0, bins=5)
    gains, _ = boost.boost(q, y, p)
    r = y - y.mean()
    want = {}
    for f in range(3):
        for cut in range(5):
            a = q[:, f] <= cut
            if 5 <= a.sum() <= 55:
                want[f, cut] = r[a].sum() ** 2 / a.sum() + r[~a].sum() ** 2 / (~a).sum()
    (f, _), best = max(want.items(), key=lambda x: x[1])
    assert math.isclose(gains[f], best) and np.count_nonzero(gains) == 1


def test_workflows(spark, expr, tmp_path):
    path = str(tmp_path / "m")
    expr.groupBy("obs_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("var_id", "value"))), lambda x: x["value"]).alias("v")).write.parquet(path)
    config = PucConfig(path, ["hist_nodes", "hist2misi_dist", "puc_lmr"], str(tmp_path / "out"), obs_col="obs_id", values_col="v", nrounds=0)
    assert PucWorkflow(spark, config).run().read("puc").count() == 10
    gb = BoostConfig(path, str(tmp_path / "gb"), ["cv_gb", "gb_grn"], tfs=[0, 3], obs_col="obs_id", values_col="v", folds=3, gbm_params={"iterations": 20, "feature_fraction": 1.0, "least_leaf": 5, "min_iterations": 2})
    BoostWorkflow(spark, gb).run()
    edges = spark.read.parquet(str(tmp_path / "gb/gb_edges")).collect()
    best = max((r for r in edges if r["target"] == 1), key=lambda r: r["importance"])
    assert best["tf"] == 0 and not any(r["tf"] == r["target"] for r in edges)


def test_boost_stops_early():
    rng = np.random.default_rng(0)
    q, y = rng.integers(0, 8, (80, 2)), rng.normal(size=80)
    p = boost.BoostParams(iterations=200, min_iterations=5, patience=3, feature_fraction=1.0)
    assert boost.boost(q, y, p, (np.arange(80) >= 60).astype(int), 1)[1] < 200


def test_queries_over_all_variables(spark, tmp_path):
    """Against brute force over 64 variables; boosting has a row for each variable and fold."""
    x = np.round(np.random.default_rng(4).normal(size=(30, 64)), 2)
    spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["var_id"]: r["values"] for r in run("packed_variables")} == dict(enumerate(x.T.tolist()))
    edges = [x.min(0) + i * (x.max(0) - x.min(0)) / 8 for i in range(9)]
    hot = np.eye(8)[np.clip(sum((e < x).astype(int) for e in edges) - 1, 0, 7)]  # observation, variable, bin
    n = np.einsum("oxa,oyb->xyab", hot, hot)
    size = hot.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cells = np.where(n > 0, n * np.log2(n * 30 / (size[:, None, :, None] * size[None, :, None, :])), 0)
        si = np.nan_to_num(cells.sum(3) / size[:, None, :])  # about, by, state
    mi = cells.sum((2, 3)) / 30
    redundancy = np.einsum("xs,xyzs->xyz", size / 30, np.minimum(si[:, :, None], si[:, None]))
    got = {(r["about"], r["by"], r["other"]): r["redundancy"] for r in run("redundancy_triples")}
    assert len(got) == 64 * 63 * 62 and all(abs(v - redundancy[k]) < 2e-6 for k, v in got.items())
    got = {(r["x"], r["y"]): r["puc"] for r in run("puc_direct")}
    assert len(got) == 2016
    for (a, b), v in got.items():
        third = [z for z in range(64) if z not in (a, b)]
        parts = [max(0, (mi[a, b] - r) / mi[a, b]) for r in (*redundancy[a, b, third], *redundancy[b, a, third])]
        assert abs(v - sum(parts)) < 1e-4
    rounds = [(r["target"], r["fold"]) for r in run("gb_cv_rounds")]
    assert sorted(rounds) == [(t, k) for t in range(64) for k in range(5)]
