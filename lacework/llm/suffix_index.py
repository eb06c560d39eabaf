"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays (operator 10).

An array holds the suffixes that start at anchors. The anchor of a window of LENGTH bytes is its run of GRAM bytes
of the least hash (the leftmost, of equals), which the window's content alone decides: equal windows have their
anchors at the same offset. So two windows can be equal only if their anchors' leading bytes are, and an array of a
hundredth of all suffixes misses none. With an anchor goes the hash of the span of all the windows that share it.

An array is sorted, part by part: by the hash of the leading GRAM bytes, then by that of the whole span. Suffixes that agree for
GRAM bytes, and among them those that agree for all that matters, so stand beside one another, as in an array in the
order of the bytes; the hashes take 16 bytes a suffix in place of 200 and more. Suffixes of equal span share an entry.

A new batch gets an array of its own. It is compared with all levels: an exchange by the leading hash brings equal
ones of the batch and of the levels together, where a grouping finds those that have met; sorted files are not read
side by side. Then arrays of equal rank merge into one of the next, so that n batches leave log n levels and each
entry is rewritten log n times.

Of leading bytes that have met, an anchor whose whole span occurs twice lies in repeats only; where anchors are alike
and their spans are not, spans are cut into cells of CELL windows, which are compared in the same way by what all
their windows hold and by all that they hold together; and where cells are alike in the one and not in the
other, window by window. One of equal spans stands for all of them, so copies are compared once.

Bytes are compared by 64-bit hashes. Texts that differ in their leading GRAM bytes are taken for equal wrongly only
if two such hashes agree by chance; texts that share these bytes, if the one of their span does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, Scratch, id_or_lowest, id_or_null, slices
from .hashing import Powers, mix, prefix_sums

LENGTH, GRAM = 200, 48
#: Batches in which a table is inserted.
BATCHES = 3
#: Bits for positions beside a hash in one number; enough for texts of 16 GiB.
_PLACE = np.uint64(34)
#: Bytes of text hashed at a time.
_CHUNK = 1 << 20
#: Windows of a cell.
CELL = 16
_STEP = 2147483629


class Texts:
    """The anchors of a run of texts, and hashes of any part of them.

    text, anchor, low, high: for each anchor its text's number, its place and those of the first and last window
    that it is the anchor of, in all texts' bytes together; begin: the texts' own beginnings there.
    """

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length = length
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        windows = np.maximum(sizes - length + 1, 0)
        self.text = self.anchor = self.low = self.high = np.zeros(0, np.int64)
        if not windows.sum():
            return
        self.sums = prefix_sums(data)
        up, down = Powers.to(len(data) + 1)
        at = len(data) - gram + 1
        key = (self.sums[gram:] - self.sums[:at]) * down[:at]
        key *= np.uint64(0xD6E8FEB86659FD93)
        key >>= _PLACE
        key <<= _PLACE
        key |= np.arange(at, dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have * 2 <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
        place = (key & np.uint64((1 << 34) - 1)).astype(np.int64)
        # Windows that lie in one text, with the text's number.
        text = np.repeat(np.arange(len(texts)), windows)
        start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + self.begin[text]
        anchor = place[start]
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(text) != 0)]))
        self.text, self.anchor, self.low = text[edge], anchor[edge], start[edge]
        self.high = start[np.concatenate([edge[1:], [len(start)]]) - 1]

    def hash(self, start: np.ndarray, end: np.ndarray, *salts: np.ndarray) -> np.ndarray:
        """Of the bytes from start to end, and of some small numbers."""
        _, down = Powers.to(len(self.sums))
        x = (self.sums[end] - self.sums[start]) * down[start]
        for i, salt in enumerate(salts):
            x = x + salt.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25 + 2 * i)
        return mix(x).view(np.int64)

    def spans(self) -> np.ndarray:
        return self.hash(self.low, self.high + self.length, self.anchor - self.low, self.high - self.low)

    def cells(self, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """text, first and last window, common, whole: the cells of some anchors; equal windows fall into cells of one number, at equal places.

        common is the hash of the bytes that all windows of such a cell hold, whole that of all that its windows hold.
        """
        a, low, high = self.anchor[of], self.low[of], self.high[of]
        last, first = (a - low) // CELL, (a - high) // CELL
        n = last - first + 1
        row = np.repeat(np.arange(len(of)), n)
        cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        a = a[row]
        one = a - CELL * cell  # the last window of a whole cell
        s0, s1 = np.maximum(one - CELL + 1, low[row]), np.minimum(one, high[row])
        common = self.hash(one, one - CELL + 1 + self.length, cell)
        whole = self.hash(s0, s1 + self.length, a - s0, a - s1)
        return self.text[of][row], s0, s1, common, whole


def own_hash(h, low):
    """A number for a place in a text, of the text's hash; the same in Spark (columns) and numpy."""
    if isinstance(h, np.ndarray):
        return h ^ (low.astype(np.int64) * _STEP)
    return h.bitwiseXOR(low.cast("long") * F.lit(_STEP))


def _scan(given: DataFrame, make, schema: str, filters: tuple = (), length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs make(texts, hashes of the texts, filters) over runs of texts; it returns (text numbers, columns).

    The first filter, if any, tells the texts that matter.
    """
    shared = given.sparkSession.sparkContext.broadcast(filters)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for b in batches:
            if filters:
                b = b.filter(pa.array(filters[0](b.column("h").to_numpy())))
            for part in slices(b, "text", _CHUNK, b.num_rows):
                texts = Texts([t or b"" for t in part.column("text").to_pylist()], length, gram)
                if len(texts.text):
                    text, columns = make(texts, part.column("h").to_numpy(), filters)
                    take = pa.array(text)
                    yield pa.RecordBatch.from_arrays([part.column("_id").take(take), part.column("_text").take(take), *map(pa.array, columns)], names)

    return given.select("_id", "_text", "text", F.xxhash64("_id", "_text").alias("h")).mapInArrow(run, schema)


def index_batch(given: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """_id, _text, low, high, gram, span: the anchors of a table of texts."""

    def make(t: Texts, h, filters):
        begin = t.begin[t.text]
        grams = t.hash(t.anchor, t.anchor + gram)
        return t.text, [(t.low - begin).astype(np.int32), (t.high - begin).astype(np.int32), grams, t.spans()]

    return _scan(given, make, "_id long, _text long, low int, high int, gram long, span long", (), length, gram)


class IndexFamily:
    """Levels (rank, array): sorted (gram, span, n, first), how often each span occurs at anchors and the place that stands for it.

    met: tables of the leading bytes (gram) that a batch, when it was inserted, shared with another suffix.
    """

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.levels: list[tuple[int, DataFrame]] = []
        self.met: list[DataFrame] = []

    def _array(self, entries: DataFrame) -> DataFrame:
        """Entries of equal span as one, dealt out by both hashes, as many spans may share their leading bytes, and each part sorted."""
        whole = entries.groupBy("gram", "span").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        return self.scratch.save(whole.sortWithinPartitions("gram", "span"))

    def insert(self, batch: DataFrame) -> None:
        """A batch of anchors becomes a level, is scanned against all others, and levels of equal rank merge."""
        own = self._array(batch.select("gram", "span", F.lit(1).cast("long").alias("n"), own_hash(F.xxhash64("_id", "_text"), F.col("low")).alias("first")))
        scanned = reduce(DataFrame.unionByName, [t.select("gram", "n", F.lit(t is own).alias("new")) for t in (own, *(t for _, t in self.levels))])
        beside = scanned.groupBy("gram").agg(F.sum("n").alias("n"), F.max("new").alias("new")).where("new and n > 1")
        self.met.append(self.scratch.save(beside.select("gram")))
        self.levels.append((0, own))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self._array(a.unionByName(b))))
            self.scratch.drop(a, b)

    def alike(self) -> DataFrame:
        """gram, span, n, first and kinds (spans of that gram) of all entries that have met another and are not its like alone."""
        met = reduce(DataFrame.unionByName, self.met).distinct()
        entries = reduce(DataFrame.unionByName, [t for _, t in self.levels]).join(met, "gram", "left_semi")
        return _alike(entries.groupBy("gram", "span").agg(F.sum("n").alias("n"), F.min("first").alias("first")), "gram")

    def drop(self) -> None:
        self.scratch.drop(*(t for _, t in self.levels), *self.met)


def _alike(level: DataFrame, key: str) -> DataFrame:
    """The rows of a level that occur more than once, or whose key has more than one kind (kinds)."""
    kinds = level.groupBy(key).agg(F.count("*").alias("kinds"))
    return level.join(kinds, key).where("n > 1 or kinds > 1")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """_id, _text, spans (low, high): for each text that has any, windows that occur elsewhere too.

    The windows are those that start from low to high; each is length bytes long.
    """
    scratch = Scratch(docs.sparkSession)
    given = docs.select(id_or_lowest("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("text"))
    h = F.xxhash64("_id", "_text")
    family = IndexFamily(scratch)
    parts = scratch.save(index_batch(given, length, gram).withColumn("_batch", F.pmod(F.xxhash64(F.lit(9), "_id"), F.lit(batches))))
    for i in range(batches):
        family.insert(parts.where(F.col("_batch") == i))
        scratch.free()
    met = scratch.save(parts.drop("_batch").join(family.alike(), ["gram", "span"]).select("_id", "_text", "low", "high", "n", "kinds", (own_hash(h, F.col("low")) == F.col("first")).alias("stands")))
    found = [met.where("n > 1").select("_id", "_text", "low", "high")]
    scratch.drop(parts)
    family.drop()
    scratch.free()

    def members(rows: DataFrame) -> tuple[Filter, Filter]:
        """Filters over the texts and places of the rows that stand for a kind which is not the only one."""
        rows = scratch.save(rows.where("kinds > 1 and stands").select(h.alias("h"), own_hash(h, F.col("low")).alias("own")))
        return Filter(rows.select(F.col("h").alias("number")).distinct()), Filter(rows.select(F.col("own").alias("number")))

    def cells(t: Texts, h, filters):
        of = np.flatnonzero(filters[1](own_hash(h[t.text], t.low - t.begin[t.text])))
        text, s0, s1, common, whole = t.cells(of)
        return text, [(s0 - t.begin[text]).astype(np.int32), (s1 - t.begin[text]).astype(np.int32), common, whole]

    of_spans = members(met)
    cut = scratch.save(_scan(given, cells, "_id long, _text long, low int, high int, common long, whole long", of_spans, length, gram))
    level = cut.groupBy("common", "whole").agg(F.count("*").alias("n"), F.min(own_hash(h, F.col("low"))).alias("first"))
    alike = cut.join(_alike(level, "common"), ["common", "whole"]).select("_id", "_text", "low", "high", "n", "kinds", (own_hash(h, F.col("low")) == F.col("first")).alias("stands"))
    alike = scratch.save(alike)
    scratch.drop(cut)
    scratch.free()
    found.append(alike.where("n > 1").select("_id", "_text", "low", "high"))

    def windows(t: Texts, h, filters):
        of = np.flatnonzero(filters[1](own_hash(h[t.text], t.low - t.begin[t.text])))
        text, s0, s1, common, _ = t.cells(of)
        keep = filters[2](own_hash(h[text], s0 - t.begin[text]))
        text, s0, s1, common = text[keep], s0[keep], s1[keep], common[keep]
        n = s1 - s0 + 1
        row = np.repeat(np.arange(len(n)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + s0[row]
        return text[row], [(start - t.begin[text[row]]).astype(np.int32), common[row], t.hash(start, start + t.length)]

    of_texts, of_cells = members(alike)
    single = scratch.save(_scan(given, windows, "_id long, _text long, low int, common long, window long", (of_texts, of_spans[1], of_cells), length, gram))
    twice = single.groupBy("common", "window").agg(F.count("*").alias("n")).where("n > 1").select("common", "window")
    found.append(single.join(twice, ["common", "window"]).select("_id", "_text", "low", F.col("low").alias("high")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("_id", "_text").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """_id, n_bytes, n_removed, n_spans and kept (binary), a row for each row of docs.

    A null text is empty and a null id the lowest. Rows alike are each other's repeats, whatever their ids.
    Removed bytes need not end at character borders. A task takes some 75 bytes for each
    byte of its longest text, so texts of some 40 MB ask for 3 GB. Of an empty table
    there is no row. Extra columns are not read.
    """
    found = repeats(docs, length, gram, batches)
    given = docs.select(id_or_lowest("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                rows = []
                for r in b.slice(lo, 200).to_pylist():
                    text = r["text"]
                    step = np.zeros(len(text) + 1, np.int64)
                    for m in r["spans"] or ():
                        step[m["low"]] += 1
                        step[m["high"] + length] -= 1
                    gone = np.cumsum(step)[:-1] > 0
                    runs = int(gone[0] if len(gone) else 0) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    rows.append((r["_id"], len(text), int(gone.sum()), runs, text if not runs else np.frombuffer(text, np.uint8)[~gone].tobytes()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = given.join(found, ["_id", "_text"], "left").select("_id", "text", "spans")
    return both.mapInArrow(run, "_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(id_or_null("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes | None], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """What op10 returns, by a dictionary of all windows; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts.values():
        for i in range(len(t or b"") - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = {}
    for key, t in texts.items():
        t = t or b""
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        out[key] = (len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out
