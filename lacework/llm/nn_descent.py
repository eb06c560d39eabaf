"""Near-duplicate embeddings by NN-descent (operator 9).

A neighbour graph is started from random hyperplanes, as vectors on one side of all of them are likely near, and
refined: the neighbours of a vector, and those that it is a neighbour of, are compared with one another, and
each keeps its nearest. A vector whose list is full of links is saturated; a link of two such may be in no list, so
components that hold saturated vectors are joined where any of their vectors link, and a saturated vector's list is
enlarged to its whole component, which is compared tile by tile. Recall is audited against
brute force on a sample that grows until it has seen enough vectors with links, and the graph started from more
hyperplanes if it falls short. If the most hyperplanes do not do, all vectors of a label are compared in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, id_or_lowest, id_or_null

THRESHOLD = 0.98
#: Neighbours in a list, and neighbours that a comparison may newly propose for one.
NEIGHBOURS, PROPOSED = 8, 4
#: Starting tables of hyperplanes; doubled while the audit finds too little.
TABLES, MOST_TABLES = 12, 96
#: Vectors of a bucket that are compared at once; buckets are expected to be about this large.
BUCKET = 128
#: Members of a neighbourhood that are compared at once; larger neighbourhoods are dealt into pieces.
PIECE = 64
ROUNDS, LEAST_CHANGE = 4, 0.01
#: Vectors of a tile of a saturated component.
TILE = 1024
#: Vectors of the audit's first sample, and the recall that it asks for.
AUDIT, LEAST_RECALL = 256, 0.99
#: Vectors with links that an audit sees if there are so many, and vectors that it compares with all at once.
AUDIT_LINKED, AUDIT_STEP = 256, 4096
_SLACK = 1e-5


def _matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _padded(column: pa.Array, least: int = 0) -> np.ndarray:
    """Vectors of several lengths in a matrix; zeros at the ends leave products as they are."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(least, int(lengths.max(initial=0)))), np.float32)
    out[np.arange(out.shape[1])[None] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(sims: np.ndarray, nodes: np.ndarray, keep: int, link: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, neighbour, similarity of the best of each row of a square matrix: keep, or as many links as fill a list."""
    np.fill_diagonal(sims, -2)
    most = min(max(keep, NEIGHBOURS), len(nodes) - 1)
    if most < 1:
        return nodes[:0], nodes[:0], sims[0, :0]
    best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(sims, best, 1), axis=1), 1)
    near = np.take_along_axis(sims, best, 1)
    row, place = np.nonzero((np.arange(most) < keep) | (near >= link))
    return nodes[row], nodes[best[row, place]], near[row, place]


def _compare(size: int, keep: int, link: float):
    """Of rows sorted by key: compares up to size neighbours of a key at once. Pieces of a longer key overlap by half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def groups(last):
            nonlocal held
            key, node, unit = held
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            whole = len(edge) - (1 if last else 2)
            out = []
            for lo, hi in zip(edge[:whole], edge[1 : whole + 1], strict=True):
                for at in range(lo, max(lo + 1, hi - size // 2), size // 2):
                    part = slice(at, min(hi, at + size))
                    names, first = np.unique(node[part], return_index=True)
                    if len(names) > 1:
                        v = unit[part][first]
                        out.append(_best(v @ v.T, names, keep, link))
            start = edge[whole]
            held = (key[start:], node[start:], unit[start:])
            if out:
                a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], ["node", "other", "sim"])
            return None

        for b in batches:
            if not b.num_rows:
                continue
            new = (b.column("key").to_numpy(), b.column("node").to_numpy(), _padded(b.column("unit"), 0 if held is None else held[2].shape[1]))
            if held is not None and held[2].shape[1] < new[2].shape[1]:
                held = (*held[:2], np.pad(held[2], ((0, 0), (0, new[2].shape[1] - held[2].shape[1]))))
            held = new if held is None or not len(held[0]) else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            if len(held[0]) and (batch := groups(False)):
                yield batch
        if held is not None and len(held[0]) and (batch := groups(True)):
            yield batch

    return run


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors at length 1, in doubles and floats; those of one length together."""
    for b in batches:
        v = b.column("v")
        lengths = np.diff(v.offsets.to_numpy())
        for length in np.unique(lengths):
            part = b.filter(pa.array(lengths == length))
            m = _matrix(part.column("v"), np.float64)
            # Relative to the largest, so that no square of a very small or large one is 0 or infinite.
            m /= np.abs(m).max(1, keepdims=True)
            m /= np.sqrt((m * m).sum(1, keepdims=True))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), int(length)).cast(pa.list_(kind)) for x, kind in ((m, pa.float64()), (m.astype(np.float32), pa.float32()))]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("space"), lists[0], part.column("copies"), part.column("least"), lists[1]], ["node", "space", "exact", "copies", "least", "unit"])


_EDGES = "node long, other long, sim float"


def _lists(edges: DataFrame, keep: int) -> DataFrame:
    """The nearest of each node among proposed edges."""
    each = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    nearest = each.groupBy("node").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("sim", "other")))), 1, keep).alias("near"))
    return nearest.select("node", F.explode("near").alias("n")).select("node", "n.other", "n.sim")


def _sorted(rows: DataFrame, order: list[str]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", *order).select("key", "node", "unit")


def start_graph(vectors: DataFrame, tables: int, seed: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Edges among vectors of like signs on random hyperplanes; in a large bucket, among those near on one more."""
    count = vectors.count()
    bits = max(1, int(np.ceil(np.log2(max(count / BUCKET, 2)))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            # Vectors of one batch may differ in length.
            lengths = np.array([len(u) for u in b.column("unit")])
            for length in np.unique(lengths):
                part = b.filter(pa.array(lengths == length))
                if length not in planes:
                    planes[length] = np.random.default_rng([seed, int(length)]).standard_normal((int(length), tables * (bits + 1)))
                side = (_matrix(part.column("unit"), np.float64) @ planes[length]).reshape(part.num_rows, tables, bits + 1)
                code = ((side[:, :, :bits] > 0) * (1 << np.arange(bits))).sum(2)
                take = pa.array(np.repeat(np.arange(part.num_rows), tables))
                table = np.tile(np.arange(tables), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("space").take(take), pa.array(table.astype(np.int32)), pa.array(code.ravel()), pa.array(side[:, :, bits].ravel()), part.column("node").take(take), part.column("unit").take(take)], ["space", "table", "code", "place", "node", "unit"])

    rows = vectors.select("space", "node", "unit").mapInArrow(sign, "space long, table int, code long, place double, node long, unit array<float>")
    keyed = rows.select(F.xxhash64("space", "table", "code").alias("key"), "place", "node", "unit")
    return _sorted(keyed, ["place"]).mapInArrow(_compare(BUCKET, PROPOSED, threshold - _SLACK), _EDGES)


def refine(scratch: Scratch, vectors: DataFrame, graph: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """NN-descent: neighbourhoods, dealt into pieces, propose nearer neighbours until few lists change."""
    units = vectors.select(F.col("node").alias("member"), "unit")
    for _ in range(rounds):
        both = graph.select(F.col("node").alias("center"), F.col("other").alias("member")).unionByName(graph.select(F.col("other").alias("center"), F.col("node").alias("member"))).distinct()
        sizes = both.groupBy("center").agg(F.count("*").alias("n"))
        dealt = both.join(sizes, "center").withColumn("key", F.xxhash64("center", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / PIECE))))
        rows = dealt.join(units, "member").select("key", F.col("member").alias("node"), "unit")
        proposed = _sorted(rows, ["node"]).mapInArrow(_compare(2 * PIECE, PROPOSED, threshold - _SLACK), _EDGES)
        new = scratch.save(_lists(graph.unionByName(proposed), NEIGHBOURS))
        changed = new.join(graph, ["node", "other"], "left_anti").count()
        total = new.count()
        scratch.drop(graph)
        graph = new
        if changed <= LEAST_CHANGE * max(total, 1):
            break
    return graph


def find_links(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES) -> DataFrame:
    """_id, n_links, component_id and kept, a row for each row of vectors (vec_id, embedding, label).

    Vectors are compared only with those of the same label and length. Null labels and null, empty or zero
    vectors, and those with null or non-finite components, link with nothing. A null id is the lowest. Equal
    vectors of one label are one node of the graph that counts once for each row, so rows alike link; they are told
    from others by a 64-bit hash. Extra columns are not read. Of an empty table there is no row.
    """
    scratch = Scratch(vectors.sparkSession)
    e = F.col("embedding")
    raw = vectors.select(id_or_lowest("vec_id").alias("_id"), F.col("label").cast("long").alias("label"), F.transform(e, lambda x: x.cast("double")).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = raw.withColumn("node", F.when(fit, F.xxhash64("label", "v")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("_id").alias("least"))
    nodes = nodes.select("node", F.xxhash64("label", F.size("v")).alias("space"), "v", "copies", "least")
    nodes = scratch.save(nodes.mapInArrow(_normalised, "node long, space long, exact array<double>, copies long, least long, unit array<float>"))
    while True:
        graph = scratch.save(_lists(start_graph(nodes, tables, threshold=threshold), NEIGHBOURS))
        graph = refine(scratch, nodes, graph, threshold=threshold)
        near = graph.where(F.col("sim") >= threshold - _SLACK).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        x, y = (nodes.select(F.col("node").alias(c), F.col("exact").alias(f"v{c}"), F.col("copies").alias(f"n{c}")) for c in ("a", "b"))
        dot = F.aggregate(F.zip_with("va", "vb", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        links = scratch.save(near.join(x, "a").join(y, "b").where(dot >= threshold).select("a", "b", "na", "nb"))
        labels = scratch.save(components(scratch, links))
        full = graph.groupBy("node").agg(F.count(F.when(F.col("sim") >= threshold - _SLACK, 1)).alias("n")).where(F.col("n") >= NEIGHBOURS)
        full = scratch.save(full.select("node"))
        large = scratch.save(labels.join(full, "node").select("component").distinct())
        between = scratch.save(_between(scratch, nodes, labels.join(large, "component"), threshold))
        if between.limit(1).count():
            labels = scratch.save(components(scratch, links.select("a", "b").unionByName(between)))
            large = scratch.save(labels.join(full, "node").select("component").distinct())
        tiles = _tile_counts(nodes, labels.join(large, "component"), threshold)
        small = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))
        small = small.join(labels.withColumnRenamed("node", "a"), "a").join(large, "component", "left_anti")
        counts = scratch.save(tiles.unionByName(small.select(F.col("a").alias("node"), F.col("nb").alias("links"))).groupBy("node").agg(F.sum("links").alias("links")))
        if audit_recall(nodes, counts, threshold) >= LEAST_RECALL:
            break
        if tables >= MOST_TABLES:
            labels, counts = _exact(scratch, nodes, threshold)
            break
        tables *= 2
    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").join(counts, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("_id", "node").join(named, "node", "left")
    return out.select("_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id")).withColumn("kept", F.col("_id") == F.col("component_id"))


def _dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def _angle(a: str, b: str) -> F.Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b))))


def _between(scratch: Scratch, nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between saturated components (node, component), one at least of any two that have some.

    A link whose ends are both saturated may be in no list. A component is a ball around the node that names it:
    of two balls no further apart than a link, the members within reach of the other's ball are compared in tiles.
    """
    reach = float(np.arccos(threshold)) + 1e-6
    sides = members.select("node", "component").join(nodes.select("node", "space", "exact"), "node")
    centers = sides.where("node = component").select("component", "space", F.col("exact").alias("center"))
    sizes = sides.join(centers.drop("space"), "component").groupBy("component").agg(F.max(_angle("exact", "center")).alias("radius"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    balls = scratch.save(centers.join(sizes, "component"))
    blocks = balls.groupBy("space").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    dealt = balls.join(blocks, "space").withColumn("block", F.pmod(F.xxhash64("component"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("space", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "component", "center", "radius")

    def touching(table: pa.Table) -> pa.Table:
        block, name, radius = (table.column(c).to_numpy() for c in ("block", "component", "radius"))
        v = _matrix(table.column("center").combine_chunks(), np.float64)
        a, b = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("i", "j"))
        near = np.arccos(np.clip(v[a] @ v[b].T, -1, 1)) <= radius[a][:, None] + radius[b][None] + reach
        if table.column("i")[0].as_py() == table.column("j")[0].as_py():
            near &= name[a][:, None] < name[b][None]
        x, y = np.nonzero(near)
        return pa.table({"mine": name[a[x]], "theirs": name[b[y]]})

    pairs = scratch.save(met.groupBy("space", "i", "j").applyInArrow(touching, "mine long, theirs long"))
    both = pairs.withColumn("left", F.lit(True)).unionByName(pairs.select(F.col("theirs").alias("mine"), F.col("mine").alias("theirs"), F.lit(False).alias("left")))
    own = balls.select(F.col("component").alias("mine"), F.col("tiles").alias("own_tiles"))
    other = balls.select(F.col("component").alias("theirs"), "center", "radius", "tiles")
    rows = sides.select("node", "exact", F.col("component").alias("mine")).join(both, "mine").join(own, "mine").join(other, "theirs").where(_angle("exact", "center") <= F.col("radius") + reach)
    rows = rows.withColumns({"tile": F.pmod(F.xxhash64("node"), F.col("own_tiles")).cast("int"), "with": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))})
    sided = lambda x, y: F.when(F.col("left"), F.col(x)).otherwise(F.col(y))
    rows = rows.select(sided("mine", "theirs").alias("p"), sided("theirs", "mine").alias("q"), sided("tile", "with").alias("i"), sided("with", "tile").alias("j"), "left", "node", "exact")

    def first_link(table: pa.Table) -> pa.Table:
        left, node = table.column("left").to_numpy(), table.column("node").to_numpy()
        v = _matrix(table.column("exact").combine_chunks(), np.float64)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        x, y = np.nonzero(v[a] @ v[b].T >= threshold)
        return pa.table({"a": node[a[x[:1]]], "b": node[b[y[:1]]]})

    return rows.groupBy("p", "q", "i", "j").applyInArrow(first_link, "a long, b long")


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    seen, a, b = np.zeros(len(near), bool), [], []
    for root in np.flatnonzero(near.any(1)):
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & ~seen)
            seen[new] = True
            a += [x] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _tile_rows(nodes: DataFrame, members: DataFrame, threshold: float, forest: bool = False) -> DataFrame:
    """node, links, other: copies that nodes of a component link with, from pairs of tiles; if wanted, also links that join all that link (links is 0)."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.join(nodes.select("node", "exact", "copies"), "node")
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("component", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "node", "exact", "copies")

    def count(table: pa.Table) -> pa.Table:
        tile = table.column("tile").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        v = _matrix(table.column("exact").combine_chunks(), np.float64)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        near = v[a] @ v[b].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            names, links = node[a], near @ copies[b]
        else:
            names, links = np.concatenate([node[a], node[b]]), np.concatenate([near @ copies[b], copies[a] @ near])
        others = np.zeros(len(names), np.int64)
        if forest:
            x, y = _forest(near if i == j else np.block([[np.zeros((len(a), len(a)), bool), near], [near.T, np.zeros((len(b), len(b)), bool)]]))
            linked = links > 0
            names, links, others = (np.concatenate(c) for c in ((names[linked], names[x]), (links[linked], np.zeros(len(x), np.int64)), (others[linked], names[y])))
        return pa.table({"node": names, "links": links, "other": others})

    return met.groupBy("component", "i", "j").applyInArrow(count, "node long, links long, other long")


def _tile_counts(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """node, links: copies that nodes of large components link with, from pairs of tiles; only counts leave a task."""
    return _tile_rows(nodes, members, threshold).select("node", "links")


def _exact(scratch: Scratch, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Components and counts of links from comparing all vectors of each space."""
    rows = scratch.save(_tile_rows(nodes, nodes.select("node", F.col("space").alias("component")), threshold, forest=True))
    labels = components(scratch, rows.where("links = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    return labels, scratch.save(rows.where("links > 0").groupBy("node").agg(F.sum("links").alias("links")))


def audit_recall(nodes: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, sample: int = AUDIT) -> float:
    """The lesser of links found over links there are, and of nodes whose links are all found over nodes with links.

    A sample is compared with all, and doubled until AUDIT_LINKED nodes with links were seen, or all nodes. 1 if
    none has any; in a label of which a tenth of AUDIT_LINKED were seen, the recall of that label counts by itself.
    """
    total = nodes.count()
    if not total:
        return 1.0
    shares = -(-total // sample)
    share = F.pmod(F.xxhash64(F.lit(11), "node"), F.lit(shares))
    seen: dict[int, np.ndarray] = {}  # of each space: links, links found, nodes with links, those found whole
    done = 0
    while done < shares and sum(x[2] for x in seen.values()) < AUDIT_LINKED:
        to = min(shares, done + max(1, min(done, AUDIT_STEP // sample)))
        for row in _audited(nodes, counts, nodes.where((share >= done) & (share < to)), threshold):
            seen[row["space"]] = seen.get(row["space"], 0) + np.array([row[c] for c in ("truth", "found", "linked", "whole")])
        done = to
    whole = [sum(seen.values())] if seen else []
    parts = [x for x in [*whole, *(x for x in seen.values() if x[2] >= AUDIT_LINKED / 10)] if x[0]]
    return min([1.0, *(float(min(x[1] / x[0], x[3] / x[2])) for x in parts)])


def _audited(nodes: DataFrame, counts: DataFrame, picked: DataFrame, threshold: float) -> list:
    """For each space of the picked nodes with links: truth, found (links), linked, whole (nodes)."""
    table = picked.select("node", "space", "exact").toArrow().combine_chunks()
    if not table.num_rows:
        return []
    home = table.column("space").to_numpy()
    spaces = {}
    for s in np.unique(home):
        part = table.filter(pa.array(home == s))
        spaces[s] = part.column("node").to_numpy(), _matrix(part.column("exact").combine_chunks(), np.float64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros(len(names), np.int64) for s, (names, _) in spaces.items()}
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                space, node, copies = (part.column(c).to_numpy() for c in ("space", "node", "copies"))
                for s in np.unique(space):
                    if s in spaces:
                        at = np.flatnonzero(space == s)
                        names, v = spaces[s]
                        near = v @ _matrix(part.column("exact").take(pa.array(at)), np.float64).T >= threshold
                        near &= names[:, None] != node[at][None, :]
                        sums[s] += near @ copies[at]
        for s, links in sums.items():
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(linked), s)), pa.array(spaces[s][0][linked]), pa.array(links[linked])], ["space", "node", "truth"])

    truth = nodes.select("space", "node", "copies", "exact").mapInArrow(compare, "space long, node long, truth long").groupBy("space", "node").agg(F.sum("truth").alias("truth"))
    found = truth.join(counts, "node", "left").withColumn("found", F.least("truth", F.coalesce("links", F.lit(0))))
    return found.groupBy("space").agg(F.sum("truth").alias("truth"), F.sum("found").alias("found"), F.count("*").alias("linked"), F.count(F.when(F.col("found") == F.col("truth"), 1)).alias("whole")).collect()


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(id_or_null("_id").alias("vec_id"), "n_links", id_or_null("component_id").alias("component_id"), "kept")
