"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The id that stands for a null document id: below every other.
NULL_ID = -(2**63)
#: Filters have up to so many slots, as a power of 2: 16 MB.
MOST_FILTER_BITS = 27
#: While a table is written, Arrow batches to and from Python workers have at most so many rows and bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: While this is set, Spark deletes the shuffle files of a query when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def id_or_lowest(column: str) -> Column:
    """The id as a long; a null id counts as the lowest one."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_or_null(column: str) -> Column:
    """Undoes id_or_lowest()."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


class Columns:
    """A table under column names of our own, so that none of its names clashes with those an operator adds.

    frame has the columns c0, c1 and so on; columns that operators add to it must be named otherwise.
    """

    def __init__(self, table: DataFrame):
        self.names = table.columns
        self.frame = table.toDF(*[f"c{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        """What a column of the table is called in frame: the first of that name, else the first that differs by case only."""
        lower = [n.lower() for n in self.names]
        return f"c{self.names.index(name) if name in self.names else lower.index(name.lower())}"

    def restore(self, frame: DataFrame, *added: str, **replaced: str) -> DataFrame:
        """The table's own columns under their names, replaced ones from other columns, and then the added ones.

        An added column whose name the table has already, in any case, gets underscores until it is free.
        """
        taken = {n.lower() for n in self.names}
        from_other = {self[n]: c for n, c in replaced.items()}
        out = [F.col(from_other.get(f"c{i}", f"c{i}")).alias(n) for i, n in enumerate(self.names)]
        for name in added:
            free = name
            while free.lower() in taken:
                free += "_"
            taken.add(free.lower())
            out.append(F.col(name).alias(free))
        return frame.select(*out)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows, and bytes in a column of texts if they have more than one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and (held + size > most_bytes or i - lo >= most_rows):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += int(size)
    if lo < batch.num_rows:
        yield batch.slice(lo)


class Scratch:
    """Intermediate tables in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, a temporary folder of this machine serves. A table that has been
    written does not depend on any executor: losing one repeats tasks, not the lineage.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        context = spark.sparkContext
        base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            given = context._jsc.sc().getCheckpointDir()
            base = given.get() if given.isDefined() else None
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lacework-")
            context.setCheckpointDir(base)
        self.base = f"{base.rstrip('/')}/lacework-{uuid.uuid4().hex}"
        self.written = 0

    def save(self, frame: DataFrame, **options: str) -> DataFrame:
        """Writes a table, in small Arrow batches where Python makes it, and returns it as read back.

        What was shuffled for it is deleted once it stands: nothing reads that again.
        """
        self.written += 1
        path = f"{self.base}/{self.written}"
        conf = self.spark.conf
        were = {k: conf.get(k) for k in (*BATCH, CLEAN)}
        try:
            for k, most in BATCH.items():
                given = int(were[k].rstrip("b"))
                conf.set(k, str(min(given, most) if given > 0 else most))
            conf.set(CLEAN, "true")
            frame.write.options(**options).parquet(path)
        finally:
            for k, v in were.items():
                conf.set(k, v)
        return self.spark.read.schema(frame.schema).parquet(path)

    def free(self) -> None:
        """Lets Spark delete the shuffle files of plans that no one holds any more, as those are whose tables have been written.

        Its cleaner learns of them by the driver's garbage collection, which may else be long in coming.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for frame in frames:
            for file in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
                if self.base.split("://")[-1].lstrip("/") in file:
                    path = jvm.org.apache.hadoop.fs.Path(file)
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(frame: DataFrame, most_rows: int) -> DataFrame:
    """Marks a join side for broadcast only if it has been counted to hold at most ``most_rows``.

    Beyond that the join stays a shuffled one, which adaptive execution splits where a key is hot.
    """
    return F.broadcast(frame) if frame.limit(most_rows + 1).count() <= most_rows else frame


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node that has an edge.

    The component is its smallest node. Each round, every node takes the smallest label in its
    neighbourhood and then its label's label, so the rounds grow with the logarithm of the longest
    path. Each round's labels are a written table; nothing is collected but a count.
    """
    both = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    both = scratch.save(both)
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component").unionByName(labels)
        # The root that a node points to also learns of the smaller label (hooking).
        step = near.groupBy("node").agg(F.min("component").alias("low")).join(labels, "node")
        hooks = step.where("low < component").select(F.col("component").alias("node"), "low").groupBy("node").agg(F.min("low").alias("hook"))
        new = step.select("node", "low").join(hooks, "node", "left").select("node", F.least("low", F.coalesce("hook", "low")).alias("low"))
        jump = new.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = scratch.save(new.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not changed:
            return labels


def joined_components(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after links (a, b) have been added; only the components that they touch are walked."""
    a, b = (labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b"))
    named = links.select("a", "b").join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    named = scratch.save(named)
    roots = components(scratch, named.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    ends = named.select(F.col("a").alias("node")).union(named.select("b")).distinct()
    nodes = labels.unionByName(ends.join(labels, "node", "left_anti").withColumn("component", F.col("node")))
    roots = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return scratch.save(nodes.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")))


def global_ranks(scratch: Scratch, frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """frame with the place of each row in an order, from 0, in column name; no task holds all rows.

    Rows are dealt in ranges of the order and sorted there, and written with their place in their range, as ranges
    may fall otherwise if they are made again. Only the sizes of the ranges, one for each partition, are collected.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows alike would all fall into one range; a random number tells them apart.
    tied = frame.withColumn("_tie", F.rand(7))
    dealt = tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_at", F.monotonically_increasing_id())
    dealt = scratch.save(dealt.drop("_tie"))
    part = F.shiftright("_at", 33)
    before, total = [], 0
    for row in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((row["part"], total))
        total += row["count"]
    offsets = F.broadcast(frame.sparkSession.createDataFrame(before, "_part long, _before long"))
    return dealt.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).drop("_part", "_before", "_at")


def bitmap(numbers: DataFrame, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits (15 at least) of the column number as set bits, packed from the lowest on.

    Tasks set the bits; the driver receives 2 ** (bits - 3) bytes at most, however many numbers there are.
    """
    slot = F.col("number").bitwiseAND(F.lit((1 << bits) - 1)).cast("long")
    low = (1 << 15) - 1
    rows = numbers.select(F.shiftright(slot, 15).alias("chunk"), slot.bitwiseAND(F.lit(low)).alias("at"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        part = np.frombuffer(row["bits"], np.uint8)
        out[row["chunk"] * len(part) : (row["chunk"] + 1) * len(part)] = part
    return out


class Filter:
    """A set of numbers that may hold others too; as large as the set asks for, up to MOST_FILTER_BITS."""

    def __init__(self, numbers: DataFrame):
        n = numbers.count()
        self.bits = min(MOST_FILTER_BITS, max(16, (32 * n).bit_length()))
        self.packed = bitmap(numbers, self.bits)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        slot = numbers & ((1 << self.bits) - 1)
        return (self.packed[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
