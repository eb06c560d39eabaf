"""Matrices as rows (obs_id, var_id, value), with names of variables, from Parquet and CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalars import around

#: Name and index tables up to this many rows are broadcast; beyond, joins shuffle.
MOST_BROADCAST = 200_000


def small_side(frame: DataFrame, most_rows: int = MOST_BROADCAST) -> DataFrame:
    """Marks a join side for broadcast only if counted to be small."""
    return F.broadcast(frame) if frame.limit(most_rows + 1).count() <= most_rows else frame


def from_arrays(frame: DataFrame, obs: str, values: str) -> DataFrame:
    """A row for each element of an array column; the element's place is its variable."""
    return frame.select(F.col(obs).cast("long").alias("obs_id"), F.posexplode(values).alias("var_id", "value")).select("obs_id", "var_id", F.col("value").cast("double").alias("value"))


def from_columns(frame: DataFrame, obs: str | list[str], columns: list[str]) -> DataFrame:
    """A row for each of some numeric columns; variables are numbered in their order."""
    key = F.col(obs) if isinstance(obs, str) else F.xxhash64(*obs)
    pairs = F.array(*[F.struct(F.lit(i).alias("var_id"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)])
    return frame.select(key.cast("long").alias("obs_id"), F.inline(pairs))


@dataclass
class Matrix:
    """A matrix and the names of its variables."""

    expr: DataFrame
    genes: DataFrame | None = None

    def dims(self) -> DataFrame:
        """nobs, nvars and npairs."""
        d = self.expr.agg(F.countDistinct("obs_id").alias("nobs"), F.countDistinct("var_id").alias("nvars"))
        return d.withColumn("npairs", F.floor(F.col("nvars") * (F.col("nvars") - 1) / 2).cast("long"))

    def gene_index(self) -> DataFrame:
        """gene, var_id; of equal names the last counts."""
        return self.genes.groupBy("gene").agg(F.max("var_id").alias("var_id"))

    def read_range(self, low: int, high: int, decimals: int | None = None) -> DataFrame:
        """Variables low to high - 1. Of arrays these are picked after the scan; see open_packed() for a range that reaches it."""
        rows = self.expr.where(F.col("var_id").between(low, high - 1))
        return rows.withColumn("value", around(F.col("value"), decimals))

    def read_indices(self, indices: list[int]) -> DataFrame:
        """Variables of a list, with their place in it (ord)."""
        places = self.expr.sparkSession.createDataFrame(list(enumerate(indices)), "ord int, var_id int")
        return self.expr.join(small_side(places), "var_id")

    def read_genes(self, names: list[str]) -> DataFrame:
        """Variables of a list of names; unknown names are dropped."""
        wanted = self.expr.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, gene string")
        return self.expr.join(small_side(wanted.join(self.gene_index(), "gene")), "var_id")

    def read_gene(self, name: str, decimals: int | None = None) -> DataFrame:
        """One variable; a name that is missing is an error."""
        found = self.gene_index().where(F.col("gene") == name).first()
        if found is None:
            raise KeyError(f"no variable is named {name!r}")
        return self.read_range(found["var_id"], found["var_id"] + 1, decimals)

    def gene_set(self, names: DataFrame, decimals: int | None = None) -> DataFrame:
        """Rows of the variables named in names (ord, gene), in whose order ord is."""
        known = names.join(self.gene_index(), "gene")
        return self.expr.join(small_side(known), "var_id").withColumn("value", around(F.col("value"), decimals))

    def first(self, nvars: int) -> "Matrix":
        """The first nvars variables; 0: all."""
        if not nvars:
            return self
        return Matrix(self.expr.where(F.col("var_id") < nvars), self.genes and self.genes.where(F.col("var_id") < nvars))

    def write_packed(self, path: str) -> None:
        """Rows (var_id, values), ranges of variables in files of their own and sorted, so that a range of variables reaches few row groups."""
        parts = int(self.expr.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.packed().repartitionByRange(parts, "var_id").sortWithinPartitions("var_id").write.mode("overwrite").parquet(path)

    def packed(self) -> DataFrame:
        """var_id, values: each variable's values in order of the observations."""
        each = F.array_sort(F.collect_list(F.struct("obs_id", "value")))
        return self.expr.groupBy("var_id").agg(F.transform(each, lambda x: x["value"]).alias("values"))


def open_matrix(spark: SparkSession, path: str, obs: str, values: str | None, names: str | None = None, gene_col: str = "gene") -> Matrix:
    """A matrix stored in Parquet, as arrays in the column values or, where that is None, as a numeric column for each variable.

    Columns' names are those of their variables. Else a table of names (var_id, gene_col) may be given.
    """
    rows = spark.read.parquet(path)
    if values is not None:
        return Matrix(from_arrays(rows, obs, values), names and read_names(spark, names, gene_col))
    columns = [f.name for f in rows.schema if isinstance(f.dataType, NumericType) and f.name != obs]
    genes = spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "gene string, var_id int")
    return Matrix(from_columns(rows, obs, columns), names and read_names(spark, names, gene_col) or genes)


def read_names(spark: SparkSession, path: str, gene_col: str = "gene") -> DataFrame:
    """gene, var_id: names of variables from Parquet; variables without a name have none."""
    rows = spark.read.parquet(path)
    if gene_col not in rows.columns:
        raise KeyError(f"{path} has no column {gene_col!r}")
    return rows.where(F.col(gene_col).isNotNull()).select(F.col(gene_col).alias("gene"), F.col("var_id").cast("int").alias("var_id"))


def open_packed(spark: SparkSession, path: str, low: int, high: int, decimals: int | None = None) -> DataFrame:
    """var_id, place, value of the variables low to high - 1 of a packed table; place is the observation's among all, in their order.

    The range is a filter on stored columns, so it reaches the scan and skips row groups.
    """
    rows = spark.read.parquet(path).where((F.col("var_id") >= low) & (F.col("var_id") < high))
    return rows.select("var_id", F.posexplode("values").alias("place", "value")).withColumn("value", around(F.col("value"), decimals))


class GeneSet:
    """The variables of a matrix that are named in names (ord, gene), in the order of ord; unknown names are dropped.

    members: ord, gene, var_id, a row for each known name; the driver holds none of them.
    """

    def __init__(self, matrix: Matrix, names: DataFrame, decimals: int | None = None):
        self.matrix, self.decimals = matrix, decimals
        self.members = names.join(matrix.gene_index(), "gene").select("ord", "gene", "var_id")

    def contains_gene(self, name: str) -> bool:
        return self.members.where(F.col("gene") == name).limit(1).count() > 0

    def contains(self, var_id: int) -> bool:
        return self.members.where(F.col("var_id") == var_id).limit(1).count() > 0

    def index_of(self, var_id: int) -> int:
        """The place of a variable in the set, from 0; of one that is named twice, the last."""
        found = self.members.where(F.col("var_id") == var_id).agg(F.max("ord")).first()[0]
        if found is None:
            raise KeyError(f"variable {var_id} is not in the set")
        return self.members.where(F.col("ord") < found).count()

    def column(self, var_id: int) -> DataFrame:
        """obs_id, value of a variable of the set."""
        if not self.contains(var_id):
            raise KeyError(f"variable {var_id} is not in the set")
        return self.matrix.read_range(var_id, var_id + 1, self.decimals).select("obs_id", "value")

    def column_for(self, name: str) -> DataFrame:
        """obs_id, value of the variable of a name in the set."""
        found = self.members.where(F.col("gene") == name).agg(F.max("var_id")).first()[0]
        if found is None:
            raise KeyError(f"no variable of the set is named {name!r}")
        return self.column(found)

    def rows(self) -> DataFrame:
        """obs_id, var_id, value, ord, gene of all variables of the set."""
        return self.matrix.gene_set(self.members.select("ord", "gene"), self.decimals)


def leave_one_out(features: DataFrame, targets: DataFrame) -> DataFrame:
    """target, var_id: for each target all features but itself."""
    t, f = targets.select(F.col("var_id").alias("target")).distinct(), features.select("var_id").distinct()
    return f.join(small_side(t), F.col("target") != F.col("var_id"))


def read_csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """ord, gene: a column of CSV files with headers; ord is dense, in the order of files by name and of rows in a file.

    Broken rows are skipped, a missing column is an error. A row's place is that of its piece of a file, plus the
    number of rows of the piece before it; only the pieces' sizes are collected.
    """
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("columnPruning", False).csv(path)
    if column not in rows.columns:
        raise KeyError(f"{path} has no column {column!r}")
    piece = ["_file", "_start"]
    rows = rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), F.col(column).alias("gene"))
    before, total = [], 0
    for r in rows.groupBy(*piece).count().orderBy(*piece).collect():
        before.append((r["_file"], r["_start"], total))
        total += r["count"]
    offsets = F.broadcast(spark.createDataFrame(before, "_file string, _start long, _before long"))
    inside = F.row_number().over(W.partitionBy(*piece).orderBy("_row")) - 1
    return rows.withColumn("_inside", inside).join(offsets, piece).select((F.col("_before") + F.col("_inside")).alias("ord"), "gene")
