"""N-gram Jaccard join in the metric space of shingle sets (operator 6).

Jaccard distance is a metric. Documents of equal sets are one point. A region is a set of points that holds
both ends of every link that is still sought in it. The first regions are laid by rare shingles: of any two
linked sets, the shortest prefixes that cannot miss (in one order of all shingles, frequent ones last) share
a shingle. They are cut where neighbouring sizes, distances from the empty set, differ by more than a link's
ends can. Each round then

- picks pivots in every region and measures every point of the region against them in the space that the
  counts of a set in PARTS parts of all shingles span. Its metric (the L1 distance, made relative to the sizes
  as Jaccard's is) is never above Jaccard's, and needs no sets;
- compares the sets of a point and a pivot of unlike components that lie within the radius there: the links of
  pivots are so found, and the pivots leave the region;
- gives each point to the first pivot within INNER of it, or else to what is left of the region;
- replicates the boundary: by the triangle inequality both ends of a link lie within INNER + radius of a pivot
  if one lies within INNER, so points between INNER and INNER + radius of an earlier pivot go to it as well;
- drops regions whose points are all connected already, since no link in them can change a component.

Regions of up to LEAF points, and those that pivots replicate more than they split, are joined in tiles of LEAF
points: only pairs of unlike components within the radius by their counts leave a tile, and their sets are
compared. It ends when no region is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Columns, Filter, Scratch, bitmap, id_or_lowest, id_or_null, joined_components, slices, small_side
from .hashing import mix, shingle_sets

#: Words of a shingle, and the least similarity of a link in hundredths.
SHINGLE, SIMILARITY = 4, 85
INNER = 0.15
#: Parts of all shingles; a power of 2.
PARTS = 256
#: Points of a region that are held against one another by their counts before the first round.
PARTNERS = 64
#: Pivots of a region in the first round and in all later ones.
PIVOTS = (1, 16)
#: Points of a tile, copies of a point on average beyond which a region is not split by pivots, and rounds of pivots.
LEAF, MOST_COPIES, MOST_ROUNDS = 256, 2, 8
#: Buckets of the sketch of shingle frequencies, as a power of 2. Its size affects speed only.
SKETCH_BITS = 22
#: Slots of the filters over copies, as a power of 2. As above.
FILTER_BITS = 21
#: Nodes that a join by broadcast picks sets for, before they are dealt out: 8 bytes each.
MOST_WANTED = 500_000
#: Documents, and bytes of them, whose sets are made at once; and pairs of counts that are measured at once.
_ROWS, _BYTES, _PAIRS = 128, 1 << 19, 1024
#: Sketches that are summed in one group.
_SKETCHES = 32


def _sets(batch: pa.RecordBatch, k: int, seed: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batch, "text", _BYTES, _ROWS):
        yield part, shingle_sets(part.column("text").to_pylist(), k, seed)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _node(s: np.ndarray, salt: int) -> int:
    """A hash of a sorted set."""
    if not len(s):
        return 0
    weights = (np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)) | np.uint64(1)
    x = int((s * weights).sum(dtype=np.uint64)) ^ (len(s) << 40)
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ (x >> 29)) - (1 << 63)


def describe(given: DataFrame, k: int, seed: int) -> DataFrame:
    """_id, _text, n, node, check, parts: each row's set by size, hashes and counts in parts of all shingles; and rows (chunk, task, sums) of a sketch of how many sets hold shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["_id", "_text", "n", "node", "check", "parts", "chunk", "task", "sums"]
        task = TaskContext.get().partitionId()
        for b in batches:
            for part, sets in _sets(b, k, seed):
                found, n = np.unique((np.concatenate(sets) & np.uint64(len(sums) - 1)).astype(np.int64), return_counts=True)
                sums[found] += n.astype(np.int32)
                rows = len(sets)
                parts = [np.bincount((s >> np.uint64(65 - PARTS.bit_length())).astype(np.int64), minlength=PARTS) for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s, 0) for s in sets], pa.int64()), pa.array([_node(s, 1) for s in sets], pa.int64()), pa.array([_packed(x) for x in parts], pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_text"), *columns], names)
        if sums.any():
            chunks = [zlib.compress(c.tobytes(), 1) for c in sums.reshape(16, -1)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(16, pa.int64())] * 5, pa.nulls(16, pa.binary()), pa.array(range(16), pa.int32()), pa.array([task] * 16, pa.int32()), pa.array(chunks, pa.binary())], names)

    return given.mapInArrow(run, "_id long, _text long, n long, node long, check long, parts binary, chunk int, task int, sums binary")


def frequent_buckets(described: DataFrame, scratch: Scratch) -> np.ndarray:
    """Which buckets of shingle hashes many more sets hold than others.

    The tasks' sketches are summed in a tree, so that no group of rows holds more than _SKETCHES of them.
    """

    def add(table: pa.Table) -> pa.Table:
        sums = 0
        for x in table.column("sums"):
            sums = sums + np.frombuffer(zlib.decompress(x.as_py()), np.int32).astype(np.int64)
        sums = np.minimum(sums, 2**31 - 1).astype(np.int32)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "task": pa.array([table.column("task")[0].as_py() // _SKETCHES], pa.int32()), "sums": pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())})

    rows = described.where("chunk is not null").select("chunk", "task", "sums")
    most = rows.agg(F.max("task")).first()[0]
    if most is None:
        return np.zeros(1 << SKETCH_BITS, bool)
    while most:
        rows = scratch.save(rows.groupBy("chunk", F.floor(F.col("task") / _SKETCHES)).applyInArrow(add, "chunk int, task int, sums binary"))
        most //= _SKETCHES
    sums = np.concatenate([np.frombuffer(zlib.decompress(r["sums"]), np.int32) for r in sorted(rows.collect(), key=lambda r: r["chunk"])])
    return sums > sums.mean() + 6 * np.sqrt(sums.mean()) + 4


def _slots(column: DataFrame) -> np.ndarray:
    """A filter of fixed size over a column of slots."""
    return np.unpackbits(bitmap(column.toDF("number"), FILTER_BITS), bitorder="little").view(bool)


def first_regions(given: DataFrame, nodes: DataFrame, k: int, similarity: int, seed: int, hot: np.ndarray) -> DataFrame:
    """region, node: the points of regions of two points or more.

    Prefixes are made again for one document of each set, or a few: two filters of fixed size tell most copies.
    Rows are dealt by shingle once, sorted by shingle and size, and only those with a near neighbour pass on.
    """
    mask = (1 << FILTER_BITS) - 1
    slot = lambda c: c.bitwiseAND(F.lit(mask)).cast("int")
    copied_slots = _slots(nodes.where("copies > 1").select(slot(F.col("node"))))
    # Of all sets: one without copies may stand in a slot of copied ones, and its document must pass all the same.
    first_slots = _slots(nodes.select(slot(F.col("node").bitwiseXOR(F.xxhash64("first")))))
    shared = given.sparkSession.sparkContext.broadcast((hot, copied_slots, first_slots))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, copied, first = shared.value
        for b in batches:
            for part, sets in _sets(b, k, seed):
                out, owners, sizes = [], [], []
                for s, h in zip(sets, part.column("h").to_pylist(), strict=True):
                    if not len(s):
                        continue
                    node = _node(s, 0)
                    if copied[node & mask] and not first[(node ^ h) & mask]:
                        continue
                    often = hot[(s & np.uint64(len(hot) - 1)).astype(np.int64)]
                    prefix = np.concatenate([s[~often], s[often]])[: len(s) - -(-similarity * len(s) // 100) + 1]
                    out.append(_signed(prefix))
                    owners.append(node)
                    sizes.append(len(s))
                if out:
                    counts = [len(x) for x in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.repeat(np.array(owners, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts))], ["shingle", "node", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passes on the rows of runs of two or more. Of a run that goes on in the next batch, its region and its last row are held, however long it is."""
        held, region, sent = None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_numpy().astype(np.int64) for c in ("shingle", "node", "n")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            shingle, node, n = rows
            # Copies that the filters let pass stand beside one another only by chance: same node, same region.
            new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (100 * n[:-1] < similarity * n[1:])])
            starts, run = np.flatnonzero(new), np.cumsum(new) - 1
            size = np.diff(np.concatenate([starts, [len(shingle)]]))
            regions = mix(shingle[starts].astype(np.uint64) * np.uint64(31) + n[starts].astype(np.uint64)).view(np.int64)
            keep = size[run] > 1
            if held is not None:
                regions[0] = region
                if sent:
                    keep[: size[0]] = True
                    keep[0] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(regions[run][keep]), pa.array(node[keep])], ["region", "node"])
            held, region = [x[-1:] for x in rows], regions[-1]
            sent = bool(size[-1] > 1 or (sent and len(size) == 1))

    parts = int(given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = given.withColumn("h", F.xxhash64("_id")).select("text", "h").mapInArrow(prefixes, "shingle long, node long, n int")
    return rows.repartition(parts, "shingle").sortWithinPartitions("shingle", "n").mapInArrow(cut, "region long, node long").distinct()


def linked_groups(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """_id, _text (hash of the text), n_shingles and component_id, a row for each row of docs.

    component_id is the smallest id reachable over links, its own included. Null and empty texts have no
    shingles and link with nothing, one another included. A null id is the lowest. Rows that repeat an id are
    judged each by its own text; rows alike are linked as any equal sets are. Extra columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    given = docs.select(id_or_lowest("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("text"))
    radius = 1 - similarity / 100
    seed = 0
    while True:
        described = scratch.save(describe(given, k, seed))
        seen = described.where("chunk is null").select("_id", "_text", "n", "node", "check", "parts")
        # Sets are told apart by 128 bits: should 64 not do, all is hashed anew.
        nodes = seen.where("n > 0").groupBy("node").agg(F.min("_id").alias("first"), F.min("check").alias("low"), F.max("check").alias("high"), F.count("*").alias("copies"), F.first("parts").alias("parts"))
        nodes = scratch.save(nodes)
        if not nodes.where("low <> high").limit(1).count():
            break
        seed += 1
    live = scratch.save(first_regions(given, nodes, k, similarity, seed, frequent_buckets(described, scratch)))
    large = scratch.save(live.groupBy("region").count().where(F.col("count") > PARTNERS).select("region"))
    small = _with_partners(live.join(large, "region", "left_anti").join(nodes.select("node", "parts"), "node"), radius)
    live = scratch.save(small.unionByName(live.join(large, "region", "left_semi").select("region", "node")))
    sets = scratch.save(_needed_sets(given, live, nodes, k, seed, scratch))
    live = live.withColumn("component", F.col("node"))
    labels = nodes.select("node", F.col("node").alias("component")).limit(0)

    def compare(unknown: DataFrame) -> None:
        """Those of the pairs (node, pivot) that link join components."""
        nonlocal labels
        if not unknown.limit(1).count():
            return
        some_sets = _only(sets, scratch.save(unknown.select("node").union(unknown.select("pivot")).distinct()))
        a, b = (some_sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set")) for x in ("node", "pivot"))
        both = F.size(F.array_intersect("node_set", "pivot_set"))
        compared = unknown.join(a, "node").join(b, "pivot").select("node", "pivot", both.alias("both"), (F.size("node_set") + F.size("pivot_set")).alias("sum"))
        new = compared.where(F.lit(100) * F.col("both") >= similarity * (F.col("sum") - F.col("both"))).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        new = scratch.save(new)
        if new.limit(1).count():
            labels = joined_components(scratch, labels, new)

    def unlike(points: DataFrame) -> DataFrame:
        """The points of regions that hold unlike components, by the labels as they are now."""
        named = scratch.save(points.select("region", "node").join(labels, "node", "left").select("region", "node", F.coalesce("component", "node").alias("component")))
        open_regions = named.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("region", "n")
        out = scratch.save(named.join(open_regions, "region"))
        scratch.drop(named)
        return out

    for turn in range(MOST_ROUNDS):
        leaves = []
        if turn:
            leaves.append(live.where(F.col("n") <= LEAF))
            live = live.where(F.col("n") > LEAF)
        pivots = live.groupBy("region", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(PIVOTS[min(turn, len(PIVOTS) - 1)])).alias("slice"))
        pivots = pivots.agg(F.min(F.struct(F.xxhash64("node").alias("order"), F.col("node").alias("pivot"), F.col("component").alias("pivot_component"))).alias("p")).select("region", "p.*")
        met = scratch.save(live.select("region", "node", "component").join(pivots, "region"))
        pairs = met.where("node <> pivot").select("node", "pivot", (F.col("component") != F.col("pivot_component")).alias("apart")).distinct()
        a, b = (nodes.select(F.col("node").alias(x), F.col("parts").alias(f"{x}_parts")) for x in ("node", "pivot"))
        near = scratch.save(pairs.join(a, "node").join(b, "pivot").mapInArrow(_measure(INNER + radius), "node long, pivot long, apart boolean, distance double"))
        compare(near.where(F.col("apart") & (F.col("distance") <= radius + 1e-9)).select("node", "pivot"))
        at = met.join(near.drop("apart"), ["node", "pivot"], "left")
        points = at.groupBy("region", "node").agg(
            F.max(F.col("node") == F.col("pivot")).alias("is_pivot"),
            F.min(F.when(F.col("distance") <= INNER, F.struct("order", "pivot"))).alias("home"),
            F.collect_list(F.when((F.col("distance") > INNER) & (F.col("distance") <= INNER + radius + 1e-9), F.struct("order", "pivot"))).alias("band"),
        ).where(~F.col("is_pivot"))
        earlier = F.filter("band", lambda p: F.col("home").isNull() | (p < F.col("home")))
        to = F.concat(F.transform(earlier, lambda p: p["pivot"]), F.array(F.coalesce("home.pivot", F.lit(0).cast("long"))))
        points = scratch.save(points.select("region", "node", to.alias("to")))
        whole = points.groupBy("region").agg(F.avg(F.size("to")).alias("copies")).select("region", (F.col("copies") > MOST_COPIES).alias("whole"))
        points = points.join(whole, "region")
        leaves.append(unlike(points.where("whole")))
        live = unlike(points.where("not whole").select("node", F.explode(F.transform("to", lambda p: F.xxhash64("region", p))).alias("region")))
        if turn == MOST_ROUNDS - 1:
            leaves.append(live)
        found = scratch.save(_join_leaves(reduce(DataFrame.unionByName, [x.select("region", "node", "component", "n") for x in leaves]), nodes, radius))
        compare(found)
        scratch.drop(met, near)
        live = unlike(live)
        if not live.limit(1).count():
            break
    groups = nodes.select("node", "first").join(labels, "node").select("node", "first", "component")
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.save(nodes.select("node", "first").join(labels, "node", "left").join(least, "component", "left").select("node", F.coalesce("component_id", "first").alias("component_id")))
    out = seen.select("_id", "_text", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("_id", "_text", F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of counts: their L1 distance, relative as Jaccard's distance is to the symmetric difference.

    It is a metric (the biotope transform of L1), and at most Jaccard's distance, as the counts of two sets in
    a part differ by no more than the sets do there.
    """
    apart = np.abs(a - b).sum(-1)
    return 2 * apart / np.maximum(a.sum(-1) + b.sum(-1) + apart, 1)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as the smallest numbers that hold them all."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _counts(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), PARTS), np.int32)
    sizes = np.array([len(x) for x in rows]) // PARTS
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join([rows[i] for i in at]), f"u{size}").reshape(-1, PARTS)
    return out


def _measure(most: float):
    """The distance of pairs in the space of counts, where it is not above most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _PAIRS):
                part = batch.slice(lo, _PAIRS)
                distance = _distances(_counts(part.column("node_parts")), _counts(part.column("pivot_parts")))
                columns = [*(part.column(c) for c in ("node", "pivot", "apart")), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "pivot", "apart", "distance"]).filter(pa.array(distance <= most + 1e-9))

    return run


def _join_leaves(leaves: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """node, pivot: pairs of points (region, node, component, n) of unlike components whose counts do not exclude a link.

    A region of n points is dealt into tiles; any two tiles meet in one group of rows, of which one is held at a time.
    """
    tiles = F.ceil(F.col("n") / LEAF).cast("int")
    dealt = leaves.withColumns({"tile": F.pmod(F.xxhash64(F.lit(5), "node"), tiles).cast("int"), "with": F.explode(F.sequence(F.lit(0), tiles - 1))})
    key = F.xxhash64("region", F.least("tile", "with"), F.greatest("tile", "with"))
    rows = dealt.select(key.alias("key"), F.col("tile") <= F.col("with"), "node", "component").toDF("key", "left", "node", "component")
    # Both tiles of a group of a single tile are the same; else left tells which tile a row is of.
    rows = rows.join(nodes.select("node", "parts"), "node")

    def pairs_of(left, node, component, parts) -> list[np.ndarray]:
        a = np.flatnonzero(left)
        b = np.flatnonzero(~left) if not left.all() else a
        out = []
        for lo in range(0, len(a), 16):
            rows = a[lo : lo + 16]
            near = (_distances(parts[rows, None], parts[None, b]) <= radius + 1e-9) & (component[rows, None] != component[None, b])
            if b is a:
                near &= node[rows, None] < node[None, b]
            i, j = np.nonzero(near)
            out.append(np.stack([node[rows[i]], node[b[j]]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out(last):
            key, left, node, component, parts = held
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            whole = len(edge) - (1 if last else 2)
            found = [np.zeros((2, 0), np.int64)]
            for lo, hi in zip(edge[:whole], edge[1 : whole + 1], strict=True):
                found += pairs_of(*(x[lo:hi] for x in (left, node, component, parts)))
            held[:] = [x[edge[whole] :] for x in held]
            pairs = np.concatenate(found, 1)
            pairs.sort(0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["node", "pivot"])

        for b in batches:
            if b.num_rows:
                new = [*(b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "left", "node", "component")), _counts(b.column("parts"))]
                held[:] = new if not held else [np.concatenate(x) for x in zip(held, new, strict=True)]
                yield out(False)
        if held:
            yield out(True)

    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "node long, pivot long").distinct()


def _only(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of the nodes wanted; of more than MOST_WANTED nodes, those that a filter of fixed size lets pass."""
    known = small_side(wanted, MOST_WANTED)
    if known is not wanted:
        return sets.join(known, "node", "left_semi")
    shared = sets.sparkSession.sparkContext.broadcast(Filter(wanted.toDF("number")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value(b.column("node").to_numpy())))

    return sets.mapInArrow(run, "node long, set array<long>")


def _with_partners(points: DataFrame, radius: float) -> DataFrame:
    """region, node: without the points for which their counts exclude a link with any other of their region.

    A region is held whole: points are of regions of up to PARTNERS points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out(last):
            region, node, parts = held
            edge = np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]])
            whole = len(edge) - (1 if last else 2)
            keep = np.zeros(len(region), bool)
            for lo, hi in zip(edge[:whole], edge[1 : whole + 1], strict=True):
                near = _distances(parts[lo:hi, None], parts[None, lo:hi]) <= radius + 1e-9
                keep[lo:hi] = near.sum(1) > 1  # itself is one
            start = edge[whole]
            batch = pa.RecordBatch.from_arrays([pa.array(region[keep]), pa.array(node[keep])], ["region", "node"])
            held[:] = [x[start:] for x in held]
            return batch

        for b in batches:
            if b.num_rows:
                new = [b.column("region").to_numpy(), b.column("node").to_numpy(), _counts(b.column("parts"))]
                held[:] = new if not held else [np.concatenate(x) for x in zip(held, new, strict=True)]
                yield out(False)
        if held:
            yield out(True)

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(parts, "region").sortWithinPartitions("region").mapInArrow(run, "region long, node long")


def _needed_sets(given: DataFrame, live: DataFrame, nodes: DataFrame, k: int, seed: int, scratch: Scratch) -> DataFrame:
    """node, set: the sets of the points in regions, made again from their first documents.

    A filter spares most other documents; the sets of those that it lets pass do no harm.
    """
    points = scratch.save(live.select("node").distinct().join(nodes.select("node", "first"), "node"))
    shared = given.sparkSession.sparkContext.broadcast(Filter(points.select(F.xxhash64("first").alias("number")).distinct()))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(shared.value(b.column("h").to_numpy())))
            for part, sets in _sets(b, k, seed):
                full = [i for i, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(sets[i], 0) for i in full], pa.int64()), pa.array([_signed(sets[i]) for i in full], pa.list_(pa.int64()))], ["node", "set"])

    made = given.withColumn("h", F.xxhash64("_id")).select("text", "h").mapInArrow(make, "node long, set array<long>")
    return made.dropDuplicates(["node"])


def keep_one_of_each_group(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """The documents of the smallest id of each group (of rows alike, one), with their columns, whatever these are called.

    A null id is the lowest. Texts without shingles are groups by themselves. Of an empty table nothing is left.
    """
    marks = linked_groups(docs, k, similarity).where("_id = component_id").select("_id", "_text").distinct()
    own = Columns(docs)
    keyed = own.frame.withColumns({"_id": id_or_lowest(own["doc_id"]), "_text": F.xxhash64(own["text"])})
    return own.restore(keyed.join(marks, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(id_or_null("_id").alias("doc_id"), "n_shingles", id_or_null("component_id").alias("component_id"))


def jaccard_groups_sql(documents: str, k: int = SHINGLE, similarity: int = SIMILARITY) -> str:
    """Common table expressions for DuckDB that end in ``groups``: doc_id, n_shingles, component_id."""
    return rf"""
jw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
js AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {k} - 1], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k} + 2, 2))) AS i FROM jw WHERE len(w) > 0)),
jn AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
jp AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM js a JOIN js b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
jl AS MATERIALIZED (SELECT a, b FROM jp JOIN jn x ON x.doc_id = a JOIN jn y ON y.doc_id = b WHERE 100 * c >= {similarity} * (x.n + y.n - c)),
je AS MATERIALIZED (SELECT a, b FROM jl UNION SELECT b, a FROM jl),
jr(doc_id, root) AS (SELECT doc_id, doc_id FROM jw UNION SELECT je.b, jr.root FROM jr JOIN je ON je.a = jr.doc_id AND jr.root < je.b),
groups AS (SELECT jw.doc_id, coalesce(any_value(jn.n), 0) AS n_shingles, min(root) AS component_id FROM jw JOIN jr USING (doc_id) LEFT JOIN jn USING (doc_id) GROUP BY jw.doc_id)
"""


OP6_SQL = f"WITH RECURSIVE {jaccard_groups_sql('documents')} SELECT doc_id, n_shingles, component_id FROM groups"
