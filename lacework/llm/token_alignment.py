"""Alignment of two tokenizers' tokens on the same bytes (operator 11).

Both tokenizers cut the bytes of a space and the text. The union of both arrays of token ends gives the elementary
intervals; searchsorted names the owner of each on either side, so an interval is one overlap of an A and a B token.
An end that both have closes a group: the smallest runs of A and B tokens that cover the same bytes. All texts of a
batch are laid end to end and aligned in one go, as a text's end is shared. Linked id pairs are then counted over
the corpus, and each document's links are held against these counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Where the vocabulary files are, and what they are called.
TOKENIZERS, BYTE_LEVEL, PIECES = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text, and texts, that are aligned at once.
AT_ONCE, TEXTS_AT_ONCE = 2 << 20, 2_000
#: Longer texts (in characters) are encoded in parts of about so many.
PART = 1 << 20
#: The commonest id pairs, up to so many (of 16 bytes), go to all tasks; all others are joined by a shuffle.
MOST_COMMON = 500_000
#: How a byte-level vocabulary splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LINKS = ("ends", "overlaps", "products")


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevelTokenizer:
    """Encodes space and text by a byte-level BPE vocabulary in the tokenizers library's format.

    A plain vocabulary, whose merges stand in the order of their ids, is run by tiktoken, which cuts alike at four
    times the speed; any other by the tokenizers library itself.
    """

    def __init__(self, data: bytes):
        given = json.loads(data)
        byte_of = _byte_of()
        special = {t["id"] for t in given.get("added_tokens") or []}
        vocab = {i: bytes(byte_of[c] for c in t) for t, i in given["model"]["vocab"].items() if i not in special}
        self.tokens = [vocab.get(i, b"") for i in range(max([*vocab, *special], default=-1) + 1)]
        for t in given.get("added_tokens") or []:
            self.tokens[t["id"]] = t["content"].encode()
        self.fast = self._plain(given, vocab)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(data.decode())
            self.slow.encode_special_tokens = True

    @staticmethod
    def _plain(given: dict, vocab: dict[int, bytes]):
        model, before = given["model"], given.get("pre_tokenizer") or {}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
        rising = all(a < b for a, b in zip(merged, merged[1:], strict=False)) and set(merged) | {i for i, t in vocab.items() if len(t) == 1} == set(vocab)
        odd = [given.get("normalizer"), *(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
        if not rising or any(odd) or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={t: i for i, t in vocab.items()}, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        out = []
        for part, _ in _parts(" " + text):
            out += self.fast.encode_ordinary(part) if self.fast else self.slow.encode(part, add_special_tokens=False).ids
        return out


class PieceTokenizer:
    """Encodes a text, before which it puts a space itself, by a sentencepiece model."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.tokens = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: No piece goes on after a space that follows something else, so words are cut each by itself.
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)

    def __call__(self, text: str) -> list[int]:
        if not self.by_word:
            return self.model.encode(text)
        out = []
        for part, first in _parts(text):
            out += self.model.encode(part if first else part[1:])
        return out


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a long text, cut where a space stands between two ASCII letters: no token of either kind crosses that."""
    start, at = 0, PART
    while at < len(text):
        cut = text.find(" ", at)
        if cut < 0:
            break
        at = cut + 1
        around = text[cut - 1] + text[cut + 1 : cut + 2]
        if len(around) == 2 and around.isascii() and around.isalpha():
            yield text[start:cut], start == 0
            start, at = cut, cut + PART
    yield text[start:], start == 0


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rising token ends that finish together: the elementary intervals' A owners, B owners, groups, and whether both end there."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = ends_a[a] == ends_b[b]
    return a, b, np.cumsum(shared) - shared, shared


def links_of(kind: str, a: np.ndarray, b: np.ndarray, group: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B tokens that are linked: those that end together, those that overlap, or all of a group with each other."""
    if kind == "ends":
        return a[shared], b[shared]
    if kind == "overlaps":
        return a, b
    first = np.flatnonzero(np.concatenate([[True], shared[:-1]])) if len(shared) else np.zeros(0, np.int64)
    last = np.flatnonzero(shared)
    wide_a, wide_b = a[last] - a[first] + 1, b[last] - b[first] + 1
    sizes = wide_a * wide_b
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a[first][of] + at // wide_b[of], b[first][of] + at % wide_b[of]


def aligner(tokens_a: list[bytes], tokens_b: list[bytes], kind: str = "ends") -> Callable:
    """A function of texts and their ids by A and B that gives a table of n_a, n_b, n_groups, n_links, groups, links."""
    size_a, size_b = (np.array([len(t) for t in ts], np.int64) for ts in (tokens_a, tokens_b))
    # Of A and B: an id within a group, and one that ends its side of the group.
    inner = np.array([f"{i}," for i in range(max(len(tokens_a), len(tokens_b)))], object)
    close_a, close_b = (np.array([f"{i}{end}" for i in range(len(ts))], object) for ts, end in ((tokens_a, "|"), (tokens_b, ";")))

    def align(texts: list[str | None], ids_a: list[list[int]], ids_b: list[list[int]]) -> pa.RecordBatch:
        use = []
        for text, x, y in zip(texts, ids_a, ids_b, strict=True):
            whole = (" " + text).encode("utf-8", "replace") if text else None
            use.append(bool(text) and b"".join([tokens_a[i] for i in x]) == whole and b"".join([tokens_b[i] for i in y]) == whole)
        n_a, n_b = (np.array([len(i) if u else 0 for i, u in zip(ids, use, strict=True)], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter((i for part, u in zip(ids, use, strict=True) if u for i in part), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        own_a, own_b, group, shared = overlaps(np.cumsum(size_a[a]), np.cumsum(size_b[b]))
        # A token's group is that of the last interval that it owns.
        of_a, of_b = (np.zeros(len(ids), np.int64) for ids in (a, b))
        of_a[own_a], of_b[own_b] = group, group
        text_of_a = np.repeat(np.arange(len(texts)), n_a)
        ends_of_a = text_of_a[own_a[shared]]
        n_groups = np.bincount(ends_of_a, minlength=len(texts))
        strings = _strings(a, b, of_a, of_b, text_of_a, np.repeat(np.arange(len(texts)), n_b), inner, close_a, close_b, len(texts))
        x, y = links_of(kind, own_a, own_b, group, shared)
        links = np.bincount(text_of_a[x], minlength=len(texts))
        # 11 bits of the text, 26 of either id.
        codes, times = np.unique(text_of_a[x] << 52 | a[x] << 26 | b[y], return_counts=True)
        offsets = np.searchsorted(codes >> 52, np.arange(len(texts) + 1)).astype(np.int32)
        codes &= (1 << 52) - 1
        each = pa.StructArray.from_arrays([pa.array(codes >> 26, pa.int32()), pa.array(codes & ((1 << 26) - 1), pa.int32()), pa.array(times, pa.int32())], ["a", "b", "n"])
        return pa.RecordBatch.from_arrays([*(pa.array(n) for n in (n_a, n_b, n_groups, links)), pa.array(strings, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), each)], ["n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return align


def _strings(a, b, of_a, of_b, text_of_a, text_of_b, inner, close_a, close_b, texts: int) -> list[str]:
    """The groups of each text, as in ``a1,a2|b1;a3|b2,b3``."""
    ends_a, ends_b = (np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool) for of in (of_a, of_b))
    words = np.concatenate([np.where(ends_a, close_a[a], inner[a]), np.where(ends_b, close_b[b], inner[b])])
    words = words[np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")].tolist()
    edge = np.concatenate([[0], np.cumsum(np.bincount(text_of_a, minlength=texts) + np.bincount(text_of_b, minlength=texts))]).tolist()
    return ["".join(words[lo:hi])[:-1] for lo, hi in zip(edge, edge[1:], strict=False)]


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int,n:int>>"


def align_tokens(docs: DataFrame, folder: str = TOKENIZERS, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, links: str = "ends") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups and links (id pairs a, b with their number n) of each row of docs.

    links: "ends" links tokens that end at one byte, "overlaps" those that share a byte, "products" all A tokens of a
    group with all B tokens of it. A null or empty text, and one whose bytes a tokenizer does not give back, has no
    tokens: zeros, an empty string and no links. Special tokens' strings are plain text. Texts are taken whole; long
    ones are encoded in parts between which no token can stand, and a batch is aligned in pieces of AT_ONCE bytes or
    one text, so a task's memory grows with its longest text only. Rows that repeat are aligned each by itself; a
    null id stays null; of an empty table there is no row; extra columns are not read. The files are read on the
    driver, whose size does not grow with the data, and sent to all tasks.
    """
    if links not in LINKS:
        raise ValueError(f"links is one of {LINKS}")
    files = docs.sparkSession.sparkContext.broadcast([Path(folder, name).read_bytes() for name in (byte_level, pieces)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ByteLevelTokenizer(files.value[0]), PieceTokenizer(files.value[1])
        align = aligner(first.tokens, second.tokens, links)
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE, TEXTS_AT_ONCE):
                texts = [t.decode("utf-8", "replace") if t else None for t in part.column("text").cast(pa.binary()).to_pylist()]
                out = align(texts, *([code(t) if t else [] for t in texts] for code in (first, second)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out.columns], ["doc_id", *out.schema.names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id long, {_ALIGNED}")


def count_links(scratch: Scratch, aligned: DataFrame) -> DataFrame:
    """aligned, but for links, with n_best and count_sum added: its links held against the counts of the corpus.

    A pair's count is the number of links that hold it in all rows; n_best are a row's links whose pair has the
    highest count of all pairs with its B id, ties included; count_sum is the sum of its links' counts. What is
    aligned is written once. Pairs are summed within tasks before they are shuffled. The commonest pairs, which
    would make hot keys, go to all tasks in a table of bounded size; rows of rarer pairs are shuffled, each pair
    of them being a small part of all.
    """
    kept = [c for c in aligned.columns if c != "links"]
    rows = scratch.save(aligned.withColumn("_row", F.monotonically_increasing_id()))
    pair = F.shiftleft(F.col("l.a").cast("long"), 32).bitwiseOR(F.col("l.b").cast("long"))
    each = rows.select("_row", F.explode("links").alias("l")).select("_row", pair.alias("pair"), F.col("l.n").alias("n"))
    counts = scratch.save(each.groupBy("pair").agg(F.sum("n").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    counts = scratch.save(counts.withColumn("b", b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))

    common, rare = counts, None
    if counts.count() > MOST_COMMON:
        # The least power of two such that the pairs counted more often fit.
        sizes = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("size")).count().orderBy(F.desc("size")).collect()
        held, least = 0, sizes[0]["size"] + 1
        for size, n in sizes:
            if held + n > MOST_COMMON:
                break
            held, least = held + n, size
        common, rare = counts.where(F.col("count") >= 2**least), counts.where(F.col("count") < 2**least)
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    if rare is None:
        found = each.join(F.broadcast(common), "pair").groupBy("_row").agg(*sums)
    else:
        met = each.join(F.broadcast(common), "pair", "left")
        known = met.where("count is not null").groupBy("_row").agg(*sums)
        others = met.where("count is null").select("_row", "pair", "n").join(rare, "pair").groupBy("_row").agg(*sums)
        found = known.unionByName(others).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(found, "_row", "left").select(*kept, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    aligned = align_tokens(docs)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    counted = count_links(Scratch(spark), aligned.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
