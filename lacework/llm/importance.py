"""Importance resampling towards a target distribution by hashed runs of words (operator 13).

All runs of 1 to n words fall into buckets by a checksum; a bucket's gain is the log ratio of its share in the target
and in the corpus, smoothed by one. A document's weight is its mean gain, and a Gumbel draw from its id turns weights
into a sample without replacement: the highest scores. Texts longer than a chunk are cut at word boundaries into
chunks that carry the next n-1 words; a chunk owns the runs that start in its own words, so no run is lost or counted
twice. Chunks are dealt over the cluster, and their counts and gains are summed by document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, global_ranks, id_or_lowest, id_or_null, slices

RUNS, BUCKETS = 2, 10_000
#: Documents of fewer words are not drawn; the share of the others that is, in percent; the seed of the draw.
LEAST_WORDS, PERCENT, SEED = 20, 25, "7"
#: Texts of more bytes are cut into chunks of about so many.
CHUNK = 64 << 10
#: Bytes of text, and texts, that are hashed at once.
AT_ONCE, TEXTS_AT_ONCE = 1 << 20, 2_000
#: Distinct words whose checksums a task remembers.
REMEMBERED = 200_000
#: Longer words are not shifted by table but hashed anew for each run.
LONGEST = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD, _OTHER = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


class _Checksums(dict):
    """The checksum of a word, its length above the lowest 32 bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = zlib.crc32(word) | len(word) << 32
        return value


def _shifts() -> np.ndarray:
    """What a checksum's bytes become when 0 to LONGEST further bytes follow: [bytes that follow, byte's place, byte]."""
    byte = np.arange(256, dtype=np.uint32)
    # As zlib's checksum of one byte, without what it adds before and after.
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
    out = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    for place in range(4):
        out[0, place] = byte << np.uint32(8 * place)
    for more in range(1, LONGEST + 1):
        out[more] = step[out[more - 1] & 255] ^ (out[more - 1] >> np.uint32(8))
    return out


_SHIFTS = _shifts()
_SPACE = np.uint32(zlib.crc32(b" "))


def _followed(sums: np.ndarray, by: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Checksums of texts with the given sums when texts of other sums and lengths follow."""
    at = _SHIFTS[length] if isinstance(length, int) else None
    if at is not None:
        return at[0][sums & 255] ^ at[1][(sums >> 8) & 255] ^ at[2][(sums >> 16) & 255] ^ at[3][sums >> 24] ^ by
    flat = _SHIFTS.reshape(-1)
    base = length.astype(np.int64) * 1024
    return flat[base + (sums & 255)] ^ flat[base + 256 + ((sums >> 8) & 255)] ^ flat[base + 512 + ((sums >> 16) & 255)] ^ flat[base + 768 + (sums >> 24)] ^ by


class Features:
    """Checksums of the runs of 1 to n words of many texts at once."""

    def __init__(self, n: int = RUNS):
        self.n, self.known = n, _Checksums()

    def __call__(self, texts: list[bytes | None], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Checksums of all runs, the text that each is of, and each text's number of words; own: first words that a text's runs start in."""
        words = [_WORD.findall(t.translate(_LOWER)) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        own = sizes if own is None else np.minimum(own, sizes)
        flat = [w for part in words for w in part]
        packed = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sums, length = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out, of = [], []
        run = sums
        for k in range(1, self.n + 1):
            if k > 1:
                new, spaced = sums[k - 1 :], _followed(run[: len(sums) - k + 1], _SPACE, 1)
                long = length[k - 1 :]
                run = _followed(spaced, new, np.minimum(long, LONGEST))
                for i in np.flatnonzero(long > LONGEST):
                    run[i] = zlib.crc32(flat[i + k - 1], int(spaced[i]))
            whole = slice(0, max(len(sums) - k + 1, 0))
            starts = (place[whole] < own[text[whole]]) & (place[whole] + k <= sizes[text[whole]])
            out.append(run[: whole.stop][starts])
            of.append(text[whole][starts])
        return np.concatenate(out), np.concatenate(of), own


def cut(text: bytes, chunk: int = CHUNK, n: int = RUNS) -> Iterator[tuple[bytes, int]]:
    """Chunks of about chunk bytes that begin with a word, the next n-1 words with them, and the number of own words."""
    low = text.translate(_LOWER)
    start = 0
    while start < len(low):
        end = start + chunk
        if end < len(low) and _WORD.match(low, end - 1, end) and (after := _OTHER.search(low, end)):
            end = after.start()
        elif end < len(low) and _WORD.match(low, end - 1, end):
            end = len(low)
        carried = end
        for _ in range(n - 1):
            word = _WORD.search(low, carried)
            if not word:
                break
            carried = word.end()
        yield low[start:carried], sum(1 for _ in _WORD.finditer(low, start, min(end, len(low))))
        start = end


def _pieces(texts: DataFrame, n: int, chunk: int) -> DataFrame:
    """key, doc_id, text, own: the chunks of long texts, dealt over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, doc, text in zip(*(b.column(c) for c in ("key", "doc_id", "text")), strict=True):
                for low, own in cut(text.as_py(), chunk, n):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([doc.as_py()]), pa.array([low], pa.binary()), pa.array([own])], ["key", "doc_id", "text", "own"])

    long = texts.where(F.octet_length("text") > chunk).withColumn("key", F.monotonically_increasing_id())
    cuts = long.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, text binary, own long")
    return cuts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _counts(rows: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, n: runs of rows (text, own) by bucket; a task hands on one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(n), np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices(b, "text", AT_ONCE, TEXTS_AT_ONCE):
                checksums, _, _ = features(part.column("text").to_pylist(), part.column("own").to_numpy())
                sums += np.bincount(checksums % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["bucket", "n"])

    return rows.select("text", "own").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(rows: DataFrame, n: int, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for bucket, count in _counts(rows, n, buckets).collect():
        out[bucket] = count
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of B buckets."""
    b, t_all, s_all = len(target), float(target.sum()), float(corpus.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for t, s in zip(target, corpus, strict=True)], np.int64)


def _summed(rows: DataFrame, n: int, gain: np.ndarray, by: str) -> DataFrame:
    """by, doc_id, n_words, n_features, gain: sums over the runs of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gain = Features(n), shared.value
        for b in batches:
            for part in slices(b, "text", AT_ONCE, TEXTS_AT_ONCE):
                checksums, of, words = features(part.column("text").to_pylist(), part.column("own").to_numpy())
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, of, gain[checksums % np.uint32(len(gain))])
                counts = np.bincount(of, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(words), pa.array(counts), pa.array(total)], ["key", "doc_id", "n_words", "n_features", "gain"])

    return rows.select("key", "doc_id", "text", "own").mapInArrow(run, "key long, doc_id long, n_words long, n_features long, gain long")


def resample(docs: DataFrame, target: DataFrame, n: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of each row of docs.

    Drawn are percent of the documents with least_words or more, those of the highest scores; of equal scores the
    smaller id. Null texts, and empty ones, have no words: no features, weight 0. A null id is the lowest, and comes
    back null. Rows that repeat an id are judged each by its own text, share its random number, and rank in any
    order if they are all alike. An empty target gives each bucket a share of one. Of empty docs there is no row.
    Extra columns are not read. Texts are taken whole: a task holds one batch of them, and hashes by AT_ONCE bytes.
    """
    scratch = Scratch(docs.sparkSession)
    own = F.lit(2**62).cast("long").alias("own")
    body = F.col("text").cast("binary")
    texts = docs.select(id_or_lowest("doc_id").alias("doc_id"), body.alias("text"))
    short = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk).select(F.lit(0).cast("long").alias("key"), "doc_id", "text", own)
    long = scratch.save(_pieces(texts, n, chunk))
    wanted = target.select(F.lit(0).cast("long").alias("doc_id"), body.alias("text"))
    wanted = wanted.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk).select("text", own).unionByName(_pieces(wanted, n, chunk).select("text", "own"))
    gain = gains(_vector(wanted, n, buckets), _vector(short.select("text", "own").unionByName(long.select("text", "own")), n, buckets))

    sums = ("n_words", "n_features", "gain")
    chunks = _summed(long, n, gain, "key").groupBy("key").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in sums])
    weighed = _summed(short, n, gain, "key").unionByName(chunks)
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_or_null("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((number + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = scratch.save(weighed.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + gumbel))
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = global_ranks(scratch, fit, [F.desc("score"), F.asc("doc_id")], "place")
    place = F.when(F.col("place") < drawn, F.col("place") + 1)
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = ranked.withColumn("rank", place).drop("place").unionByName(others)
    return out.select(id_or_null("doc_id").alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
