"""Stored results: scalar attributes, shards, and views of some variables' information."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import small_side


def new_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in the session's checkpoint folder, or a local one where that is unset and the master local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lacework-')}"
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """A table as read back from a new shared folder: what follows neither makes it again nor depends on an executor."""
    path = new_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Deletes a table that written() made and that nothing reads any more."""
    spark = frame.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("run-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_clustered(frame: DataFrame, path: str, column: str, buckets: int, order: list[str]) -> None:
    """A table in buckets by a column, each one file and sorted; see read_clustered()."""
    name = f"lacework_{uuid.uuid4().hex}"
    writer = frame.repartition(buckets, column).write.mode("overwrite").bucketBy(buckets, column).sortBy(*order)
    writer.option("path", path).saveAsTable(name)
    frame.sparkSession.sql(f"DROP TABLE {name}")  # the catalogue's entry; files at a path of our own stay


def read_clustered(spark: SparkSession, path: str, column: str, buckets: int, order: list[str]) -> DataFrame:
    """The table as clustered by its column, so that joins, groupings and windows by it need no exchange."""
    schema = spark.read.parquet(path).schema
    name = f"lacework_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    keys = ", ".join(f"`{c}`" for c in order)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{column}`) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    frame = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # as above
    return frame


def _mark(spark: SparkSession, path: str):
    """The file that says a table is whole, and its file system."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.whole")
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def mark_whole(spark: SparkSession, path: str, digest: str, buckets: int = 0) -> None:
    """Says that the table at a path is whole, by what it was made, and how it is clustered. To be written after the table."""
    file, system = _mark(spark, path)
    out = system.create(file, True)
    out.write(bytearray(json.dumps({"digest": digest, "buckets": buckets}).encode()))
    out.close()


def unmark(spark: SparkSession, path: str) -> None:
    """To be called before a table is written anew: from here on it is not whole."""
    file, system = _mark(spark, path)
    system.delete(file, True)


def mark_of(spark: SparkSession, path: str) -> dict | None:
    """digest and buckets of a whole table; None if there is none or it is not whole."""
    file, system = _mark(spark, path)
    if not system.exists(file):
        return None
    stream = system.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:  # broken off while it was written
        return None


def dense_rows(si: DataFrame, value: str, nvars: int) -> DataFrame:
    """about, state, values: for each state of each variable a value for every other one, by its number; 0 where there is none.

    A row's array is made from its own entries, so the domain is never joined or exploded. It has nvars values.
    """
    held = si.groupBy("about", "state").agg(F.map_from_entries(F.collect_list(F.struct("by", value))).alias("_held"))
    return held.select("about", "state", F.transform(F.sequence(F.lit(0), F.lit(nvars - 1)), lambda i: F.coalesce(F.try_element_at("_held", i), F.lit(0.0))).alias("values"))


def read_point(dense: DataFrame, about: int, by: int) -> DataFrame:
    """state, value of a pair, by its offset in the dense rows of about."""
    return dense.where(F.col("about") == about).select("state", F.get("values", F.lit(by)).alias("value"))


def read_slice(dense: DataFrame, about: int, low: int, high: int) -> DataFrame:
    """state, values of the variables low to high - 1, by their offsets in the dense rows of about."""
    return dense.where(F.col("about") == about).select("state", F.slice("values", low + 1, high - low).alias("values"))


def write_scalars(spark: SparkSession, path: str, values: dict[str, int]) -> None:
    """A table (name, value) of whole numbers."""
    spark.createDataFrame(sorted(values.items()), "name string, value long").coalesce(1).write.mode("overwrite").parquet(path)


def read_scalar(spark: SparkSession, path: str, name: str) -> int:
    found = spark.read.parquet(path).where(F.col("name") == name).first()
    if found is None:
        raise KeyError(f"{path} has no value {name!r}")
    return found["value"]


def merge_shards(spark: SparkSession, paths: list[str], key: list[str]) -> DataFrame:
    """Rows of tables that several runs wrote, as one; a key that two of them hold, or one holds twice, is an error.

    The check counts keys in a grouping that combines before its shuffle; nothing is collected but one key.
    """
    if not paths:
        raise ValueError("there are no shards")
    rows = spark.read.parquet(*paths)
    twice = rows.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").first()
    if twice is not None:
        raise ValueError(f"shards overlap at {[twice[k] for k in key]}")
    return rows


@dataclass
class InformationView:
    """The stored information about some variables: their nodes, pairs among all and specific information."""

    nodes: DataFrame
    pair_mi: DataFrame
    ord_si: DataFrame
    nobs: int

    @classmethod
    def of_ranges(cls, nodes: DataFrame, pair_mi: DataFrame, ord_si: DataFrame, nobs: int, first: range, second: range) -> "InformationView":
        """Of two ranges of variables; the conditions are on stored columns, so they reach the scan."""
        inside = lambda c: ((F.col(c) >= first.start) & (F.col(c) < first.stop)) | ((F.col(c) >= second.start) & (F.col(c) < second.stop))
        return cls(nodes.where(inside("var_id")), pair_mi, ord_si.where(inside("about")), nobs)

    @classmethod
    def of_pair(cls, nodes: DataFrame, pair_mi: DataFrame, ord_si: DataFrame, nobs: int, i: int, j: int) -> "InformationView":
        """Of two variables, and of their pair's mutual information only."""
        x, y = sorted((i, j))
        pair = (F.col("x") == x) & (F.col("y") == y)
        return cls(nodes.where(F.col("var_id").isin(i, j)), pair_mi.where(pair), ord_si.where(F.col("about").isin(i, j)), nobs)

    def mutual_information(self, i: int, j: int) -> float:
        x, y = sorted((i, j))
        found = self.pair_mi.where((F.col("x") == x) & (F.col("y") == y)).first()
        if found is None:
            raise KeyError(f"no pair {x}, {y}")
        return found["mi"]

    def redundancies(self, about: int, by: int, others: DataFrame | None = None) -> DataFrame:
        """other, redundancy: of about's information on by and on each third variable, or on those of others (var_id)."""
        own = self.ord_si.where(F.col("about") == about)
        a = own.where(F.col("by") == by).select("state", "n_state", "si")
        b = own.where(~F.col("by").isin(about, by)).select("state", F.col("by").alias("other"), F.col("si").alias("si_other"))
        if others is not None:
            b = b.join(small_side(others.select(F.col("var_id").alias("other"))), "other", "left_semi")
        least = F.col("n_state") / F.lit(float(self.nobs)) * F.least("si", "si_other")
        return b.join(small_side(a), "state").groupBy("other").agg(F.sum(least).alias("redundancy"))
