"""Run modes: each reads the tables that earlier ones wrote and writes its own."""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import around
from ..operators import binning, boost, measures, pairs, puc
from ..sources.matrix import GeneSet, Matrix, open_matrix, read_csv_column
from ..sources.store import discard, mark_of, mark_whole, read_clustered, unmark, write_clustered, write_scalars, written
from .config import BoostConfig, ConfigError, PucConfig

SI_ORDER = ["about", "state"]
ORDERS = {"nodes": ["var_id"], "pair_mi": ["x", "y"], "puc": ["x", "y"]}


class PucWorkflow:
    def __init__(self, spark: SparkSession, config: PucConfig):
        self.spark, self.config, self.mode, self.files = spark, config, None, None
        matrix = open_matrix(spark, config.matrix, config.obs_col, config.values_col, config.names, config.gene_id_col).first(config.nvars)
        self.expr = matrix.expr.withColumn("value", around(F.col("value"), config.nroundup))
        if config.packed_file:
            matrix.write_packed(config.packed_file)

    def _digest(self, name: str) -> str:
        """Of all that a table's rows follow from: the matrix's files and the settings that count up to it."""
        c = self.config
        settings = [c.obs_col, c.values_col, c.nroundup, c.nvars, c.disc_method, c.bins if c.disc_method == "uniform" else 0]
        if name in ("pair_mi", "ord_si", "puc"):
            settings += [c.tbase, c.lmr_only]
        if name == "puc":
            settings += [c.nrounds, c.nsamples, self.mode]
        if self.files is None:
            self.files = sorted(self.spark.read.parquet(c.matrix).inputFiles())
        return hashlib.sha256(json.dumps([name, self.files, settings]).encode()).hexdigest()

    def _write(self, name: str, frame: DataFrame) -> DataFrame:
        """Writes a table, and then says that it is whole; till then it counts as not there.

        Nodes, and tables of a row for each pair, are in order over all files, so that the statistics of row groups
        spare the scans of a few variables. They are written once before they are sorted, lest the sample that
        sorting takes make them twice.
        """
        path = self.config.path(name)
        unmark(self.spark, path)
        buckets = 0
        if name == "ord_si":
            buckets = self.config.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            write_clustered(frame, path, "about", buckets, SI_ORDER)
        else:
            once = None
            if order := ORDERS.get(name):
                once = written(frame)
                frame = once.repartitionByRange(*order).sortWithinPartitions(*order)
            frame.write.mode("overwrite").parquet(path)
            if once is not None:
                discard(once)
        mark_whole(self.spark, path, self._digest(name), buckets)
        return self.read(name)

    def whole(self, name: str) -> bool:
        """Whether a table is whole and was made from this matrix by these settings."""
        mark = mark_of(self.spark, self.config.path(name))
        return mark is not None and mark["digest"] == self._digest(name)

    def read(self, name: str) -> DataFrame:
        """A table of results; nodes are cut to the first nvars variables if more are stored. One that is not whole is an error."""
        path = self.config.path(name)
        mark = mark_of(self.spark, path)
        if mark is None:
            raise FileNotFoundError(f"there is no whole table {name} at {path}")
        if mark["buckets"]:
            return read_clustered(self.spark, path, "about", mark["buckets"], SI_ORDER)
        frame = self.spark.read.parquet(path)
        return frame.where(F.col("var_id") < self.config.nvars) if name == "nodes" and self.config.nvars else frame

    def _nobs(self) -> int:
        return self.expr.where(F.col("var_id") == 0).count()

    def nodes(self, reuse: bool = False, keep: bool = True) -> DataFrame:
        if reuse and self.whole("nodes"):
            return self.read("nodes")
        c = self.config
        edges = binning.bayesian_edges(self.expr) if c.disc_method == "bayesian_blocks" else binning.uniform_edges(self.expr, c.bins)
        made = binning.nodes(edges, binning.assign(self.expr, edges))
        if not keep:
            return made
        stored = self._write("nodes", made)
        sums = stored.agg(F.count("*").alias("nvars"), F.sum("n_bins").alias("bins")).first()
        nvars = sums["nvars"]
        write_scalars(self.spark, c.path("meta"), {"nobs": self._nobs(), "nvars": nvars, "npairs": nvars * (nvars - 1) // 2, "nsi": (sums["bins"] or 0) * nvars})
        return stored

    def joint(self, nodes: DataFrame) -> DataFrame:
        """By packed blocks: no row for each observation and pair."""
        return pairs.joint_histogram_blocks(binning.assign(self.expr, nodes.select("var_id", "edges")))

    def misi(self, joint: DataFrame) -> None:
        """Specific information first; mutual information is read off it, so that the cells are made once."""
        si = measures.specific_information(measures.log_ratios(joint, self.config.tbase))
        stored = self._write("ord_si", si.drop("si") if self.config.lmr_only else si)
        self._write("pair_mi", measures.mutual_information_of(stored))

    def run(self) -> "PucWorkflow":
        """Runs the modes in turn. With resume, those whose tables are whole already are passed over."""
        for self.mode in self.config.mode:
            if not (self.config.resume and all(self.whole(t) for t in self._tables(self.mode))):
                getattr(self, f"mode_{self.mode}")()
        return self

    def _tables(self, mode: str) -> list[str]:
        """The tables that a mode writes."""
        hist = ["pair_hist"] if self.config.save_node_pairs else []
        information = ["ord_si", "pair_mi"]
        return {"hist_nodes": ["nodes"], "hist_dist": ["nodes", "pair_hist"], "misi": ["nodes", *hist, *information], "misi_dist": information, "hist2misi_dist": [*hist, *information]}.get(mode, ["puc"])

    def mode_hist_nodes(self):
        self.nodes()

    def mode_hist_dist(self):
        self._write("pair_hist", self.joint(self.nodes()))

    def mode_misi(self):
        joint = self.joint(self.nodes(reuse=True))
        self.misi(self._write("pair_hist", joint) if self.config.save_node_pairs else joint)

    def mode_misi_dist(self):
        if self.config.lmr_only:
            raise ValueError("misi_dist does not go with lmr_only")
        self.misi(self.read("pair_hist"))

    def mode_hist2misi_dist(self):
        joint = self.joint(self.read("nodes"))
        self.misi(self._write("pair_hist", joint) if self.config.save_node_pairs else joint)

    def _samples(self) -> DataFrame | None:
        c = self.config
        if c.nrounds > 0 and c.nsamples > 0:
            return puc.sample_rounds(self.read("nodes"), c.nrounds, c.nsamples)
        return None

    def _nvars(self) -> int:
        return self.read("nodes").count()

    def mode_samples_ranges(self):
        """Direct sums; over sampled third variables, and their mean over rounds, where sampling is asked for."""
        if self.config.lmr_only:
            raise ValueError("samples_ranges needs specific information, which lmr_only leaves out")
        si, samples = self.read("ord_si"), self._samples()
        nobs = self._nobs()
        self._write("puc", puc.puc_direct(si, nobs) if samples is None else puc.puc_direct_sampled(si, nobs, samples))

    def mode_puc_lmr(self):
        lmr, mi, samples = self.read("ord_si").select("about", "by", "state", "lmr"), self.read("pair_mi"), self._samples()
        self._write("puc", puc.puc_lmr(lmr, mi, self._nvars()) if samples is None else puc.puc_sampled(lmr, mi, samples))

    def mode_puc_lmr_dist(self):
        self._write("puc", puc.puc_lmr(self.read("ord_si").select("about", "by", "state", "lmr"), self.read("pair_mi"), self._nvars()))


class BoostWorkflow:
    def __init__(self, spark: SparkSession, config: BoostConfig):
        self.spark, self.config = spark, config
        matrix = open_matrix(spark, config.matrix, config.obs_col, config.values_col, config.names, config.gene_id_col)
        self.matrix = Matrix(matrix.expr.withColumn("value", around(F.col("value"), config.nroundup)), matrix.genes)
        self.tfs = list(config.tfs)
        if config.tf_csv_file:
            named = GeneSet(self.matrix, read_csv_column(spark, config.tf_csv_file, "gene")).members
            self.tfs = list(dict.fromkeys(r["var_id"] for r in named.orderBy("ord").collect()))  # as many as regulators
        if not self.tfs:
            raise ConfigError("no regulator is among the variables")

    def cv(self) -> DataFrame:
        c = self.config
        variables = self.matrix.expr.select("var_id").distinct()
        targets = [r["var_id"] for r in puc.sample_rounds(variables, 1, c.n_sample_genes).collect()]
        rounds = boost.cv_rounds(self.matrix, self.tfs, targets, c.folds, c.params)
        rounds.write.mode("overwrite").parquet(f"{c.out}/cv_rounds")
        stats = boost.cv_stats(self.spark.read.parquet(f"{c.out}/cv_rounds"))
        stats.write.mode("overwrite").parquet(f"{c.out}/cv_stats")
        return self.spark.read.parquet(f"{c.out}/cv_stats")

    def run(self) -> "BoostWorkflow":
        """The network's number of rounds is the median of a cross-validation, of this run's if it made one already."""
        c, stats = self.config, None
        for mode in c.mode:
            if mode == "cv_gb" or not c.skip_cv and stats is None:
                stats = self.cv()
            if mode == "gb_grn":
                rounds = c.num_iterations if c.skip_cv else int(stats.first()["median"])
                edges = boost.gb_network(self.matrix, self.tfs, replace(c.params, iterations=rounds), c.importance_filter)
                edges.write.mode("overwrite").parquet(f"{c.out}/gb_edges")
        return self
