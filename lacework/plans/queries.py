"""The registered queries over the driver's tables, with DuckDB's query for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import binning, boost, measures, pairs, puc, quantiles
from ..sources import matrix, store
from .config import PucConfig
from .workflow import PucWorkflow

QUERIES: dict = {}
SQL: dict[str, str] = {}
BINS = 8


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def micro(column: str) -> F.Column:
    """Six decimals, as the order of summation may differ."""
    return (F.round(F.col(column) * 1e6, 0) / 1e6 + 0.0).alias(column)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return matrix.from_arrays(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding")


def _expr(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).withColumn("value", scalars.around(F.col("value"), 2))


def _binned(spark: SparkSession, d: str) -> DataFrame:
    expr = _expr(spark, d)
    return binning.assign(expr, binning.uniform_edges(expr, BINS))


def _cells(spark: SparkSession, d: str, base: str = "2") -> DataFrame:
    return measures.log_ratios(pairs.joint_histogram_blocks(_binned(spark, d)), base)


def _genes(spark: SparkSession, d: str) -> DataFrame:
    """Names of variables: those of nations, of which the first 24 also name variables 25 to 48."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("gene"), F.col("n_nationkey").alias("var_id"))
    return n.unionByName(n.select("gene", (F.col("var_id") + 25).alias("var_id")).where("var_id < 49"))


EXPR = "SELECT vec_id AS obs_id, v AS var_id, round(val::DOUBLE * 100) / 100 + 0.0 AS value FROM (SELECT vec_id, unnest(range(0, 64))::INT AS v, unnest(embedding) AS val FROM embeddings)"
M = "round({} * 1e6) / 1e6 + 0.0 AS {}"


def _with(log: str = "log2") -> str:
    return f"""WITH m AS ({EXPR}),
s AS (SELECT var_id, min(value) AS lo, max(value) AS hi FROM m GROUP BY var_id),
e AS (SELECT var_id, CASE WHEN lo = hi THEN [lo, hi] ELSE list_transform(range(0, {BINS + 1}), lambda i: lo + i * (hi - lo) / {BINS}.0::DOUBLE) END AS edges FROM s),
b AS (SELECT obs_id, var_id, least(greatest(len(list_filter(edges, lambda x: x < value)) - 1, 0), len(edges) - 2)::INT AS bin FROM m JOIN e USING (var_id)),
{_tables(log)}"""


def _tables(log: str = "log2") -> str:
    return f"""h AS (SELECT var_id, bin, count(*) AS n FROM b GROUP BY ALL),
j AS (SELECT p.var_id AS x, q.var_id AS y, p.bin AS bx, q.bin AS "by", count(*) AS n FROM b p JOIN b q ON p.obs_id = q.obs_id AND p.var_id < q.var_id GROUP BY ALL),
w AS (SELECT count(DISTINCT obs_id)::DOUBLE AS w FROM b),
c AS (SELECT j.*, hx.n AS n_x, hy.n AS n_y, {log}(j.n * w.w / (hx.n::DOUBLE * hy.n)) AS lr, w.w FROM j JOIN h hx ON hx.var_id = x AND hx.bin = bx JOIN h hy ON hy.var_id = y AND hy.bin = j."by", w),
mi AS (SELECT x, y, sum(n * lr) / any_value(w) AS mi FROM c GROUP BY x, y),
o AS (SELECT x AS about, y AS t, bx AS state, any_value(n_x) AS n_state, sum(n * lr) / any_value(n_x) AS si, sum(n * lr) / any_value(w) AS lmr FROM c GROUP BY ALL
      UNION ALL SELECT y, x, "by", any_value(n_y), sum(n * lr) / any_value(n_y), sum(n * lr) / any_value(w) FROM c GROUP BY x, y, "by")"""


BLOCKS = f"""WITH RECURSIVE m AS ({EXPR}),
u AS (SELECT var_id, value AS x, count(*)::DOUBLE AS c FROM m GROUP BY ALL),
ua AS (SELECT var_id, list(x ORDER BY x) AS xs, list(c ORDER BY x) AS cs, count(*) AS n FROM u GROUP BY var_id),
ub AS (SELECT *, [xs[1]] || list_transform(range(1, n), lambda i: 0.5 * (xs[i] + xs[i + 1])) || [xs[n]] AS e FROM ua),
dp AS (
  SELECT var_id, 0::BIGINT AS k, []::DOUBLE[] AS best, []::BIGINT[] AS last FROM ub
  UNION ALL
  SELECT var_id, k + 1, best || [list_max(f)], last || [list_max(list_transform(range(1, k + 2), lambda i: CASE WHEN f[i] = list_max(f) THEN i - 1 ELSE -1 END))]
  FROM (SELECT dp.var_id, k, best, last, list_transform(range(1, k + 2), lambda i: list_sum(cs[i:k + 1]) * ln(list_sum(cs[i:k + 1]) / (e[k + 2] - e[i])) - (4 - ln(73.53 * 0.05 * pow(k + 1, -0.478))) + CASE WHEN i > 1 THEN best[i - 1] ELSE 0 END) AS f
        FROM dp JOIN ub USING (var_id) WHERE k < n)),
fin AS (SELECT var_id, last, n FROM dp JOIN ub USING (var_id) WHERE k = n),
bt AS (SELECT var_id, n AS ind FROM fin UNION ALL SELECT bt.var_id, last[ind] FROM bt JOIN fin USING (var_id) WHERE ind > 0),
e AS (SELECT var_id, list(e[ind + 1] ORDER BY ind) AS edges FROM bt JOIN ub USING (var_id) GROUP BY var_id)"""
BLOCKS_B = f"""{BLOCKS},
b AS (SELECT obs_id, var_id, least(greatest(len(list_filter(edges, lambda x: x < value)) - 1, 0), len(edges) - 2)::INT AS bin FROM m JOIN e USING (var_id))"""


@query("SELECT count(*) AS nobs, max(len(embedding))::BIGINT AS nvars, (max(len(embedding)) * (max(len(embedding)) - 1) // 2)::BIGINT AS npairs FROM embeddings")
def matrix_dims(spark, d):
    return matrix.Matrix(_raw(spark, d)).dims()


@query(f"SELECT * FROM ({EXPR})")
def round_values(spark, d):
    return _expr(spark, d)


@query(f"SELECT * FROM ({EXPR}) WHERE var_id >= 8 AND var_id < 20")
def column_range_scan(spark, d):
    return matrix.Matrix(_raw(spark, d)).read_range(8, 20, 2)


@query(f"SELECT var_id, list(value ORDER BY obs_id) AS values FROM ({EXPR}) GROUP BY var_id")
def packed_variables(spark, d):
    return matrix.Matrix(_expr(spark, d)).packed()


@query(f"SELECT obs_id, t.var_id, value, ord FROM ({EXPR}) t JOIN (SELECT unnest([5, 3, 60]) AS var_id, unnest([0, 1, 2]) AS ord) i ON i.var_id = t.var_id")
def submatrix(spark, d):
    return matrix.Matrix(_expr(spark, d)).read_indices([5, 3, 60]).select("obs_id", "var_id", "value", "ord")


GENES = "(SELECT n_name AS gene, n_nationkey AS var_id FROM nation UNION ALL SELECT n_name, n_nationkey + 25 FROM nation WHERE n_nationkey + 25 < 49)"


@query(f"SELECT gene, max(var_id) AS var_id FROM {GENES} GROUP BY gene")
def gene_index(spark, d):
    return matrix.Matrix(_raw(spark, d), _genes(spark, d)).gene_index()


@query(f"SELECT r_name AS gene, count(*) AS n, max(g.var_id) AS var_id FROM (SELECT r_name FROM region UNION SELECT n_name FROM nation) JOIN (SELECT gene, max(var_id) AS var_id FROM {GENES} GROUP BY gene) g ON gene = r_name JOIN ({EXPR}) t ON t.var_id = g.var_id GROUP BY r_name")
def gene_set_join(spark, d):
    names = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("gene")).union(spark.read.parquet(f"{d}/nation.parquet").select("n_name")).distinct()
    rows = matrix.Matrix(_raw(spark, d), _genes(spark, d)).gene_set(names.withColumn("ord", F.lit(0)), 2)
    return rows.groupBy("gene").agg(F.count("*").alias("n"), F.max("var_id").alias("var_id"))


@query(f"SELECT obs_id, value FROM ({EXPR}) WHERE var_id = (SELECT max(var_id) FROM {GENES} WHERE gene = (SELECT min(n_name) FROM nation))")
def gene_column(spark, d):
    """One variable by its name."""
    name = spark.read.parquet(f"{d}/nation.parquet").agg(F.min("n_name")).first()[0]
    return matrix.Matrix(_raw(spark, d), _genes(spark, d)).read_gene(name, 2).select("obs_id", "value")


@query(f"SELECT obs_id, t.var_id, value FROM ({EXPR}) t JOIN (SELECT max(var_id) AS var_id FROM {GENES} WHERE gene IN (SELECT n_name FROM nation WHERE n_regionkey = 1) GROUP BY gene) USING (var_id)")
def genes_by_name(spark, d):
    """Variables by a list of names, one of which is unknown."""
    names = [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 1").select("n_name").collect()]
    return matrix.Matrix(_raw(spark, d), _genes(spark, d)).read_genes([*names, "no such name"]).select("obs_id", "var_id", scalars.around(F.col("value"), 2).alias("value"))


@query(f"SELECT n_name AS gene, (SELECT max(var_id) FROM {GENES} g WHERE g.gene = n_name) AS var_id FROM nation")
def gene_set_from_csv(spark, d):
    """Names of a CSV file with their variables."""
    path = store.new_folder(spark)
    names = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("gene"), F.col("n_nationkey").alias("key"))
    names.orderBy("gene").coalesce(1).write.option("header", True).csv(path)
    return matrix.GeneSet(matrix.Matrix(_raw(spark, d), _genes(spark, d)), matrix.read_csv_column(spark, path, "gene")).members.select("gene", "var_id")


@query(f"SELECT var_id, (row_number() OVER (PARTITION BY var_id ORDER BY obs_id) - 1)::INT AS place, value FROM ({EXPR}) WHERE var_id >= 40 AND var_id < 48")
def packed_range_scan(spark, d):
    """A range of variables of a packed table, where the range reaches the scan."""
    path = store.new_folder(spark)
    matrix.Matrix(_raw(spark, d)).write_packed(path)
    return matrix.open_packed(spark, path, 40, 48, 2)


@query("SELECT t.v::INT AS target, f.v::INT AS var_id FROM (SELECT unnest(range(0, 64)) AS v) t JOIN (SELECT unnest(range(0, 64)) AS v) f ON t.v <> f.v")
def leave_one_out(spark, d):
    return matrix.leave_one_out(_raw(spark, d), _raw(spark, d))


@query(f"SELECT var_id, value, count(*) AS n FROM ({EXPR}) GROUP BY ALL")
def unique_counts(spark, d):
    return binning.unique_counts(_expr(spark, d))


@query(f"SELECT var_id, n, exclusive::BIGINT AS exclusive, (exclusive + n)::BIGINT AS inclusive, value FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY var_id ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS exclusive FROM (SELECT var_id, value, count(*) AS n FROM ({EXPR}) GROUP BY ALL))")
def prefix_sums(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("var_id").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    counts = binning.unique_counts(_expr(spark, d)).withColumn("inclusive", F.sum("n").over(w))
    return counts.withColumn("exclusive", F.col("inclusive") - F.col("n"))


@query(f"{BLOCKS} SELECT var_id, i AS place, round(edges[i + 1] * 1e6) / 1e6 + 0.0 AS edge FROM (SELECT var_id, edges, unnest(range(0, len(edges)))::INT AS i FROM e)")
def bb_edges(spark, d):
    e = binning.bayesian_edges(_expr(spark, d)).select("var_id", F.posexplode("edges").alias("place", "edge"))
    return e.select("var_id", "place", micro("edge"))


@query(f"{BLOCKS_B} SELECT var_id, bin, count(*) AS n FROM b GROUP BY ALL")
def bb_histogram(spark, d):
    expr = _expr(spark, d)
    nodes = binning.nodes(e := binning.bayesian_edges(expr), binning.assign(expr, e))
    return nodes.select("var_id", F.posexplode("hist").alias("bin", "n")).where("n > 0")


@query(f"{_with()} SELECT * FROM h")
def hist_1d(spark, d):
    return binning.histogram(_binned(spark, d))


@query(f"{_with()} SELECT * FROM j")
def hist_2d(spark, d):
    return pairs.joint_histogram(_binned(spark, d))


@query(f"{_with()} SELECT * FROM j")
def hist_2d_blocks(spark, d):
    return pairs.joint_histogram_blocks(_binned(spark, d))


@query(f'{_with()} SELECT x, y, bx, "by", n, n_x, n_y, w::BIGINT AS w FROM c')
def joint_marginals(spark, d):
    return measures.marginals(pairs.joint_histogram_blocks(_binned(spark, d)))


@query(f'{_with()} SELECT x, y, bx, "by", {M.format("lr", "lr")} FROM c')
def log_ratio(spark, d):
    return _cells(spark, d).select("x", "y", "bx", "by", micro("lr"))


def _mi(base):
    return lambda spark, d: measures.mutual_information(_cells(spark, d, base=base)).select("x", "y", micro("mi"))


for _name, _base, _log in (("mi_pairs", "2", "log2"), ("mi_pairs_ln", "e", "ln"), ("mi_pairs_log10", "10", "log10")):
    query(f"{_with(_log)} SELECT x, y, {M.format('mi', 'mi')} FROM mi", _name)(_mi(_base))


@query(f"{BLOCKS_B}, {_tables()} SELECT x, y, {M.format('mi', 'mi')} FROM mi")
def mi_pairs_bayesian(spark, d):
    expr = _expr(spark, d)
    joint = pairs.joint_histogram_blocks(binning.assign(expr, binning.bayesian_edges(expr)))
    return measures.mutual_information(measures.log_ratios(joint)).select("x", "y", micro("mi"))


@query(f"{_with()} SELECT x, y, {M.format('mi', 'mi')} FROM mi ORDER BY mi.mi DESC, x, y LIMIT 20")
def mi_top_pairs(spark, d):
    return measures.mutual_information(_cells(spark, d)).orderBy(F.desc("mi"), "x", "y").limit(20).select("x", "y", micro("mi"))


@query(f'{_with()} SELECT about, t AS "by", state, n_state, {M.format("si", "si")} FROM o')
def specific_information(spark, d):
    return measures.specific_information(_cells(spark, d)).select("about", "by", "state", "n_state", micro("si"))


@query(f'{_with()} SELECT about, t AS "by", state, {M.format("lmr", "lmr")} FROM o')
def lmr(spark, d):
    return measures.specific_information(_cells(spark, d)).select("about", "by", "state", micro("lmr"))


TRIPLES = f"""{_with()}, r AS (SELECT a.about, a.t, z.t AS other, sum(a.n_state / w.w * least(a.si, z.si)) AS redundancy FROM o a JOIN o z ON z.about = a.about AND z.state = a.state AND z.t <> a.t, w GROUP BY ALL)"""


def _nobs(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").count()


@query(f'{TRIPLES} SELECT about, t AS "by", other, {M.format("redundancy", "redundancy")} FROM r')
def redundancy_triples(spark, d):
    r = measures.redundancies(measures.specific_information(_cells(spark, d)), _nobs(spark, d))
    return r.select("about", "by", "other", micro("redundancy"))


@query(f"{TRIPLES} SELECT x, y, round(sum(CASE WHEN mi > 0 AND mi >= redundancy THEN (mi - redundancy) / mi ELSE 0 END) * 1e6) / 1e6 + 0.0 AS puc FROM r JOIN mi ON x = least(about, t) AND y = greatest(about, t) GROUP BY x, y")
def puc_direct(spark, d):
    return puc.puc_direct(measures.specific_information(_cells(spark, d)), _nobs(spark, d)).select("x", "y", micro("puc"))


#: By the triple join, which does not follow the window's way.
MS = "ms AS (SELECT a.about, a.t, sum(least(a.lmr, z.lmr)) AS ms FROM o a JOIN o z ON z.about = a.about AND z.state = a.state AND z.t <> a.t GROUP BY ALL)"


@query(f'{_with()}, {MS} SELECT about, t AS "by", round(ms * 1e6) / 1e6 + 0.0 AS min_sum FROM ms')
def minsum_window(spark, d):
    return puc.min_sums(measures.specific_information(_cells(spark, d))).select("about", "by", micro("min_sum"))


PUC = "SELECT least(about, t) AS x, greatest(about, t) AS y, round(sum(CASE WHEN mi > 0 THEN {n} - ms / mi ELSE 0 END) * 1e6) / 1e6 + 0.0 AS puc FROM ms JOIN mi ON x = least(about, t) AND y = greatest(about, t) GROUP BY ALL"


@query(f"{_with()}, {MS} {PUC.format(n='(SELECT count(DISTINCT var_id) - 2 FROM b)')}")
def puc_lmr(spark, d):
    cells = _cells(spark, d)
    nvars = _raw(spark, d).select("var_id").distinct().count()
    return puc.puc_lmr(measures.specific_information(cells), measures.mutual_information(cells), nvars).select("x", "y", micro("puc"))


SAMPLES = "sm AS (SELECT round, var_id FROM (SELECT r AS round, v AS var_id, row_number() OVER (PARTITION BY r ORDER BY md5(r || ':' || v || ':72')) AS rn FROM (SELECT unnest(range(0, 64))::INT AS v), (SELECT unnest(range(0, 4))::INT AS r)) WHERE rn <= 16)"
SUB = f"""{_with()}, {SAMPLES},
ms AS (SELECT round, a.about, a.t, sum(least(a.lmr, z.lmr)) FILTER (WHERE z.t <> a.t) AS ms FROM o a JOIN o z ON z.about = a.about AND z.state = a.state JOIN sm ON sm.var_id = z.t GROUP BY ALL),
ps AS (SELECT round, x, y, sum(CASE WHEN mi > 0 THEN 16 - (SELECT count(*) FROM sm s WHERE s.round = ms.round AND s.var_id IN (about, t)) - coalesce(ms, 0) / mi ELSE 0 END) AS puc FROM ms JOIN mi ON x = least(about, t) AND y = greatest(about, t) GROUP BY ALL)"""


def _sampled(spark, d):
    cells = _cells(spark, d)
    samples = puc.sample_rounds(_expr(spark, d).select("var_id").distinct(), 4, 16)
    return measures.specific_information(cells).select("about", "by", "state", "lmr"), measures.mutual_information(cells), samples


@query(f"{SUB} SELECT round, x, y, round(puc * 1e6) / 1e6 + 0.0 AS puc FROM ps")
def puc_lmr_subset(spark, d):
    return puc.puc_subsets(*_sampled(spark, d)).select("round", "x", "y", micro("puc"))


@query(f"{SUB} SELECT x, y, round(avg(puc) * 1e6) / 1e6 + 0.0 AS puc FROM ps GROUP BY x, y")
def puc_sampled(spark, d):
    return puc.puc_sampled(*_sampled(spark, d)).select("x", "y", micro("puc"))


@query(f"{TRIPLES}, {SAMPLES} SELECT x, y, round(sum(CASE WHEN mi > 0 AND mi >= redundancy THEN (mi - redundancy) / mi ELSE 0 END) / 4 * 1e6) / 1e6 + 0.0 AS puc FROM r JOIN sm ON sm.var_id = other JOIN mi ON x = least(about, t) AND y = greatest(about, t) GROUP BY x, y")
def puc_direct_sampled(spark, d):
    samples = puc.sample_rounds(_expr(spark, d).select("var_id").distinct(), 4, 16)
    return puc.puc_direct_sampled(measures.specific_information(_cells(spark, d)), _nobs(spark, d), samples).select("x", "y", micro("puc"))


def _information(spark, d):
    si = measures.specific_information(_cells(spark, d))
    return binning.uniform_edges(_expr(spark, d), BINS), measures.mutual_information_of(si), si, _nobs(spark, d)


@query(f'{_with()} SELECT about, t AS "by", state, {M.format("si", "si")} FROM o WHERE (about >= 4 AND about < 8) OR (about >= 30 AND about < 33)')
def information_of_ranges(spark, d):
    view = store.InformationView.of_ranges(*_information(spark, d), range(4, 8), range(30, 33))
    return view.ord_si.select("about", "by", "state", micro("si"))


@query(f"{TRIPLES} SELECT other, {M.format('redundancy', 'redundancy')} FROM r WHERE about = 9 AND t = 3 AND other <> 9")
def information_of_a_pair(spark, d):
    """Redundancies of a pair with every third variable."""
    view = store.InformationView.of_pair(*_information(spark, d), 3, 9)
    return view.redundancies(9, 3).select("other", micro("redundancy"))


@query(f"{TRIPLES}, {SAMPLES} SELECT other, {M.format('redundancy', 'redundancy')} FROM r WHERE about = 9 AND t = 3 AND other IN (SELECT var_id FROM sm WHERE round = 1)")
def redundancies_of_a_subset(spark, d):
    samples = puc.sample_rounds(_expr(spark, d).select("var_id").distinct(), 4, 16).where("round = 1")
    view = store.InformationView.of_pair(*_information(spark, d), 3, 9)
    return view.redundancies(9, 3, samples).select("other", micro("redundancy"))


@query(f"WITH {SAMPLES} SELECT * FROM sm")
def sample_rounds(spark, d):
    return puc.sample_rounds(_raw(spark, d).select("var_id").distinct(), 4, 16)


@query("WITH p AS (SELECT vec_id AS obs_id, row_number() OVER (ORDER BY md5(vec_id || ':72'), vec_id) - 1 AS place FROM embeddings), n AS (SELECT count(*) AS n FROM p) SELECT obs_id, place, max(k) AS fold FROM p, n, (SELECT unnest(range(0, 5)) AS k) WHERE (k * n) // 5 <= place GROUP BY ALL")
def kfold_assign(spark, d):
    return boost.kfold(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("obs_id")), 5)


@query(f"{_with()} SELECT x AS i, y AS j, row_number() OVER (ORDER BY x, y) - 1 AS k, x AS i2, y AS j2 FROM (SELECT DISTINCT x, y FROM j)")
def triu_index_roundtrip(spark, d):
    """Places of all pairs of the matrix's variables, and the pairs at these places."""
    every = pairs.joint_histogram_blocks(_binned(spark, d)).select(F.col("x").cast("long").alias("i"), F.col("y").cast("long").alias("j")).distinct()
    n = _raw(spark, d).select("var_id").distinct().count()
    placed = every.withColumn("k", scalars.triu_index(n, F.col("i"), F.col("j")))
    i2, j2 = scalars.triu_pair(n, F.col("k"))
    return placed.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "k", i2.cast("int").alias("i2"), j2.cast("int").alias("j2"))


@query("WITH p AS (SELECT l_orderkey AS o, row_number() OVER (ORDER BY md5(l_orderkey || ':72'), l_orderkey) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem)), r AS (SELECT unnest(range(0, 7)) AS rank) SELECT rank, min(place) AS low, max(place) AS high, count(*) AS size, (rank * any_value(n)) // 7 AS block_low FROM p JOIN r ON place >= (rank * n) // 7 AND place < ((rank + 1) * n) // 7 GROUP BY rank")
def block_ranges(spark, d):
    """Ranges of places that ranks own, as their owners are found for all orders, with each block's first place by itself."""
    orders = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("obs_id")).distinct()
    owned = boost.kfold(orders, 7)
    n = orders.count()
    ranks = owned.groupBy(F.col("fold").alias("rank")).agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("size"))
    return ranks.withColumn("block_low", scalars.block_low(F.col("rank"), 7, n))


STATS = "round(avg(v) * 1e6) / 1e6 + 0.0 AS mean, round(stddev_pop(v) * 1e6) / 1e6 + 0.0 AS stdev"


@query(f"WITH r AS (SELECT l_quantity::BIGINT AS v FROM lineitem), l AS (SELECT list(v ORDER BY v) AS l, count(*) AS n FROM r) SELECT mean, stdev, l[n // 2 + 1] AS median, l[n // 4 + 1] AS p25, l[3 * n // 4 + 1] AS p75, l[1] AS least, l[n] AS most FROM l, (SELECT {STATS} FROM r)")
def cv_stats(spark, d):
    """Statistics as of numbers of rounds, over a column of many ties."""
    rounds = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("long").alias("rounds"))
    s = boost.cv_stats(rounds)
    return s.select(micro("mean"), micro("stdev"), "median", "p25", "p75", "least", "most")


@query(f"WITH m AS (SELECT var_id, value AS v FROM ({EXPR})), l AS (SELECT var_id, list(v ORDER BY v) AS l, count(*) AS n, {STATS} FROM m GROUP BY var_id) SELECT var_id, mean, stdev, l[n // 2 + 1] AS median, l[n // 4 + 1] AS p25, l[3 * n // 4 + 1] AS p75, l[1] AS least, l[n] AS most FROM l")
def variable_statistics(spark, d):
    return quantiles.summary(_expr(spark, d), "value", ["var_id"]).select("var_id", micro("mean"), micro("stdev"), "median", "p25", "p75", "least", "most")


@query(f"WITH l AS (SELECT var_id, list(value ORDER BY value) AS l, count(*) AS n FROM ({EXPR}) GROUP BY var_id) SELECT DISTINCT var_id, l[n * i // 64 + 1] AS cut FROM l, (SELECT unnest(range(1, 64)) AS i)")
def quantile_cuts(spark, d):
    """The cuts by which boosting bins regulators."""
    return quantiles.quantile_cuts(_expr(spark, d), 64).select("var_id", F.explode("cuts").alias("cut"))


def _dense(spark, d):
    si = measures.specific_information(_cells(spark, d))
    return store.dense_rows(si.withColumn("si", micro("si")), "si", _raw(spark, d).select("var_id").distinct().count())


DENSE = f"{_with()}, dn AS (SELECT about, state, list(coalesce(si, 0.0) ORDER BY v) AS values FROM (SELECT k.about, k.state, v, {M.format('si', 'si')} FROM (SELECT DISTINCT about, state FROM o) k JOIN (SELECT DISTINCT var_id AS v FROM b) z ON true LEFT JOIN o ON o.about = k.about AND o.state = k.state AND o.t = v) GROUP BY ALL)"


@query(f"{DENSE} SELECT * FROM dn")
def dense_information(spark, d):
    """Specific information as packed rows over all variables, zeros filled in."""
    return _dense(spark, d)


@query(f"{DENSE} SELECT state, values[34] AS value FROM dn WHERE about = 7")
def dense_point(spark, d):
    return store.read_point(_dense(spark, d), 7, 33)


@query(f"{DENSE} SELECT state, values[21:40] AS values FROM dn WHERE about = 7")
def dense_slice(spark, d):
    return store.read_slice(_dense(spark, d), 7, 20, 40)


@query(f"WITH m AS ({EXPR}), z AS (SELECT m.var_id, (value - lo) / (hi - lo) * 5 AS z FROM m JOIN (SELECT var_id, min(value) AS lo, max(value) AS hi FROM m GROUP BY ALL) s ON s.var_id = m.var_id), p AS (SELECT var_id, i, avg(greatest(0, 1 - abs(z - i))) AS p FROM z, (SELECT unnest(range(0, 6)) AS i) GROUP BY ALL) SELECT var_id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) * 1e6) / 1e6 + 0.0 AS entropy FROM p GROUP BY var_id")
def spline_entropy(spark, d):
    return binning.spline_entropy(_expr(spark, d), 6, 2).select("var_id", micro("entropy"))


@query("WITH t AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem), u AS (SELECT 0 AS var_id, a AS value FROM t UNION ALL SELECT 1, b FROM t UNION ALL SELECT 2, c FROM t) SELECT var_id, value, count(*) AS n FROM u GROUP BY ALL")
def unpivot_counts(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return binning.unique_counts(matrix.from_columns(t, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]))


@query(f"{_with()} SELECT * FROM mi WHERE x < 32 UNION ALL SELECT * FROM mi WHERE x >= 32".replace("SELECT * FROM mi", f"SELECT x, y, {M.format('mi', 'mi')} FROM mi"))
def merge_results(spark, d):
    """Two shards, written one by one, as one table."""
    mi, base = measures.mutual_information(_cells(spark, d)).select("x", "y", micro("mi")), store.new_folder(spark)
    for name, part in (("a", "x < 32"), ("b", "x >= 32")):
        mi.where(part).write.parquet(f"{base}/{name}")
    return store.merge_shards(spark, [f"{base}/a", f"{base}/b"], ["x", "y"])


def _workflow(spark, d, modes, **more) -> PucWorkflow:
    return PucWorkflow(spark, PucConfig(matrix=f"{d}/embeddings.parquet", out=store.new_folder(spark), mode=modes, nroundup=2, **more)).run()


@query(f"{BLOCKS_B}, {_tables()}, {MS} {PUC.format(n=62)}")
def workflow_puc(spark, d):
    """The staged run, through its tables: hist_nodes, hist_dist, misi_dist, puc_lmr_dist."""
    return _workflow(spark, d, ["hist_nodes", "hist_dist", "misi_dist", "puc_lmr_dist"]).read("puc").select("x", "y", micro("puc"))


@query(f"{_with()}, {MS} {PUC.format(n=62)}")
def workflow_misi_puc_lmr(spark, d):
    """The staged run with uniform bins: hist_nodes, misi and puc_lmr without sampling."""
    return _workflow(spark, d, ["hist_nodes", "misi", "puc_lmr"], disc_method="uniform", nrounds=0).read("puc").select("x", "y", micro("puc"))


@query(SQL["puc_direct"])
def workflow_samples_ranges(spark, d):
    """The staged run by direct sums: hist_nodes, hist2misi_dist and samples_ranges without sampling."""
    return _workflow(spark, d, ["hist_nodes", "hist2misi_dist", "samples_ranges"], disc_method="uniform", nrounds=0).read("puc").select("x", "y", micro("puc"))


@query(f"{_with()}, {MS} SELECT x, y, {M.format('mi', 'mi')} FROM mi WHERE y < 20")
def workflow_first_variables(spark, d):
    """Information among the first 20 variables only."""
    return _workflow(spark, d, ["hist_nodes", "misi"], disc_method="uniform", nvars=20).read("pair_mi").select("x", "y", micro("mi"))


@query(f"{_with()}, t AS (SELECT count(DISTINCT obs_id) AS nobs, count(DISTINCT var_id) AS nvars FROM b), z AS (SELECT sum(len(edges) - 1) AS bins FROM e) SELECT unnest(['nobs', 'nvars', 'npairs', 'nsi']) AS name, unnest([nobs, nvars, nvars * (nvars - 1) // 2, bins * nvars])::BIGINT AS value FROM t, z")
def node_attributes(spark, d):
    """The scalars that are stored beside nodes."""
    return spark.read.parquet(_workflow(spark, d, ["hist_nodes"], disc_method="uniform").config.path("meta"))


@query(f"{_with()}, z AS (SELECT DISTINCT var_id FROM b) SELECT var_id, (SELECT len(edges) FROM e WHERE e.var_id = z.var_id)::INT AS n_edges, (SELECT sum(n) FROM h WHERE h.var_id = z.var_id)::BIGINT AS n FROM z")
def node_reload(spark, d):
    """Nodes as a later run reads them."""
    nodes = _workflow(spark, d, ["hist_nodes"], disc_method="uniform").nodes(reuse=True)
    return nodes.select("var_id", "n_edges", F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


def _boosted(spark, d):
    """The matrix, and all its variables as regulators and targets."""
    m = matrix.Matrix(_expr(spark, d))
    return m, sorted(r["var_id"] for r in m.expr.select("var_id").distinct().collect())


@query()
def gb_edges(spark, d):
    return boost.gb_network(*_boosted(spark, d), boost.BoostParams(iterations=32, leaves=8, feature_fraction=0.1))


@query()
def gb_edges_in_slabs(spark, d):
    """The same over slabs of observations, whose sums are summed in turn; few rounds, as each asks for several jobs."""
    return boost.gb_network(*_boosted(spark, d), boost.BoostParams(iterations=3, leaves=8, feature_fraction=0.1, slab_cells=20_000))


@query()
def gb_cv_rounds(spark, d):
    m, every = _boosted(spark, d)
    return boost.cv_rounds(m, every, every, 5, boost.BoostParams(iterations=60, leaves=8, feature_fraction=0.1, min_iterations=8))
