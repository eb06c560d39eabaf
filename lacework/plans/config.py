"""Runs described by YAML: data, modes and parameters."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml

from ..operators.boost import BoostParams

PUC_MODES = ("misi", "hist_nodes", "hist_dist", "misi_dist", "hist2misi_dist", "samples_ranges", "puc_lmr", "puc_lmr_dist")
#: Named by the configuration format, but without a meaning there.
UNDEFINED_MODES = ("sampled_puc_pairs", "samples_input", "samples_lmr_ranges", "samples_lmr_input", "puc_ranges", "puc2pidc", "puc_union", "cluster_union", "cluster_lmr_union")
GB_MODES = ("cv_gb", "gb_grn")

# Keys of the configuration format that have other names here.
KEYS = {"h5ad_file": "matrix", "row_major_h5_file": "packed_file", "output_file": "out"}
BOOST_KEYS = {"num_iterations": "iterations", "early_stopping_rounds": "patience", "bagging_fraction": "bagging"}
# Keys that may stand in a configuration and change nothing here. Spark logs, times and threads by its own
# settings, and npairs follows from the data; those without a meaning belong to modes that have none.
UNUSED = ("enable_timers", "log_level", "wflow_dir", "npairs")
WITHOUT_MEANING = ("nodes_pickle", "nodes_pairs_pickle", "samples_file", "sub_net_files", "quantile_filter")
UNUSED_BOOST = ("verbose", "num_threads")


class ConfigError(ValueError):
    pass


def _modes(mode: str | list[str]) -> list[str]:
    return [mode] if isinstance(mode, str) else list(mode)


@dataclass
class PucConfig:
    """The information pipeline. Paths are those of Parquet tables: the matrix, and folders that results go to.

    Tables of histograms go to hist_data_file, of information to misi_data_file and of scores to puc_file, or all
    to out. names is a table of the variables' names in gene_id_col. nvars: only the first so many variables, 0: all;
    nobs is taken from the data. buckets: into which specific information is clustered (0: as
    many as shuffles have partitions). resume: tables that an
    earlier run of like settings has finished are not made again. save_nodes and save_node_pairs: modes that make histograms on the way write them too.
    """

    matrix: str
    mode: list[str]
    out: str = ""
    hist_data_file: str = ""
    misi_data_file: str = ""
    puc_file: str = ""
    pidc_file: str = ""
    packed_file: str | None = None
    names: str | None = None
    gene_id_col: str = "gene_ids"
    obs_col: str = "vec_id"
    values_col: str | None = "embedding"
    save_nodes: bool = False
    save_node_pairs: bool = False
    nroundup: int | None = 4
    nrounds: int = 8
    nsamples: int = 200
    nobs: int = 0
    nvars: int = 0
    lmr_only: bool = False
    tbase: str = "2"
    disc_method: str = "bayesian_blocks"
    bins: int = 8
    buckets: int = 0
    resume: bool = False

    def __post_init__(self):
        self.tbase, self.mode = str(self.tbase), _modes(self.mode)
        for m in self.mode:
            if m in UNDEFINED_MODES:
                raise NotImplementedError(f"mode {m} is named but not defined")
            if m not in PUC_MODES:
                raise ConfigError(f"no mode is named {m}")
        if self.tbase not in ("2", "e", "10"):
            raise ConfigError(f"no log base {self.tbase}")
        if self.disc_method not in ("bayesian_blocks", "uniform"):
            raise ConfigError(f"no method {self.disc_method}")

    def path(self, table: str) -> str:
        """The folder of a table of results."""
        own = {"nodes": self.hist_data_file, "pair_hist": self.hist_data_file, "meta": self.hist_data_file, "pair_mi": self.misi_data_file, "ord_si": self.misi_data_file, "puc": self.puc_file}
        base = own.get(table) or self.out
        if not base:
            raise ConfigError(f"nothing says where the table {table} is")
        return f"{base.rstrip('/')}/{table}"


@dataclass
class BoostConfig:
    """The boosting pipeline. Regulators are variables by number (tfs) or by name, in the column gene of tf_csv_file.

    Names are looked up in names, a Parquet table of them in gene_id_col and var_id, or are the matrix's columns where values_col is null. Edges have importances over
    importance_filter; null: all edges.
    """

    matrix: str
    out: str
    mode: list[str]
    tfs: list[int] = field(default_factory=list)
    tf_csv_file: str | None = None
    names: str | None = None
    gene_id_col: str = "_index"
    obs_col: str = "vec_id"
    values_col: str | None = "embedding"
    nroundup: int | None = 4
    n_sample_genes: int = 200
    folds: int = 5
    skip_cv: bool = False
    num_iterations: int = 32
    importance_filter: float | None = 0.0
    gbm_params: dict = field(default_factory=dict)

    def __post_init__(self):
        self.mode = _modes(self.mode)
        for m in self.mode:
            if m not in GB_MODES:
                raise ConfigError(f"no mode is named {m}")
        if self.tf_csv_file and not self.names and self.values_col is not None:
            raise ConfigError("tf_csv_file needs names, a table of the variables' names, or a matrix of named columns (values_col: null)")
        given = {BOOST_KEYS.get(k, k): v for k, v in self.gbm_params.items() if k not in UNUSED_BOOST}
        try:
            self.params = BoostParams(**given)
        except (TypeError, ValueError) as e:
            raise ConfigError(str(e)) from None


def read_config(path: str, kind):
    """A configuration of a kind from a YAML file; unknown and missing keys are errors."""
    settings = yaml.safe_load(Path(path).read_text())
    if idle := sorted(k for k in settings if k in WITHOUT_MEANING):
        warnings.warn(f"these keys belong to modes without a meaning and change nothing: {idle}", stacklevel=2)
    given = {KEYS.get(k, k): v for k, v in settings.items() if k not in UNUSED and k not in WITHOUT_MEANING}
    known = {f.name for f in fields(kind)}
    if odd := set(given) - known:
        raise ConfigError(f"unknown keys: {sorted(odd)}")
    try:
        return kind(**given)
    except TypeError as e:
        raise ConfigError(str(e)) from None
