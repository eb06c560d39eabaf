"""Language-model scoring by a probabilistic suffix tree (operator 1).

Symbols are the V tokens known from training and one for all others. The tree's states are suffixes of what
has been read: sequences of up to DEPTH tokens (the edge of a text is one), kept as states if their next-symbol
distribution diverges from their parent's, the longest state among the shorter suffixes. A text is scored by the
longest suffix state at each of its tokens.

The tree has two parts. Contexts with a share of LEAST_CONTEXT of the training tokens form its top, which has at
most 1 / LEAST_CONTEXT states of a depth and 1 / LEAST_PAIR entries whatever the corpus' size, and goes to all
tasks. All other contexts, of one token and of more, that training holds at least twice are tested in buckets, with
exact counts of all symbols after them; they grow with the corpus. A token is sent once, to the bucket of the shortest
context before it that is not in the top, along with what tells the longer ones: they all lie in that bucket, as
longer contexts are parts of shorter ones. None of these contexts holds more than that share (or 20 occurrences), so no
bucket is hot. Nothing of them is sent to the driver or to all tasks: a bucket receives the tokens to be scored along
with those to learn from, and returns sums for each text.

A state of the top holds the probabilities of the symbols seen often after it, smoothed towards the parent's; all
other symbols share what is left in the parent's proportions. A state in a bucket adds PRIOR_RARE times its parent's
distribution to its counts, and is kept if it tells each of its own occurrences better than its parent does when that
occurrence is left out; else the next longer context has the same parent. So every distribution sums to 1. Infrequent
words are one symbol to the states, though contexts tell them apart; within that class the root's distribution holds,
from counts over all training documents, discounted to leave mass for what is unknown. Those counts are looked up by a join.

Texts are hashed twice: to count words, and to write their symbols to a table, which all later passes read.
Words are told apart by 64-bit hashes; contexts in buckets by 47 bits and what the bucket's number tells, each further
token of a longer one by 32 bits within the shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_or_lowest, id_or_null, slices
from .hashing import U, mix, word_hashes

#: Longest context in tokens.
DEPTH = 3
#: Tokens with a symbol of their own in the tree; at most 2^17 - 2.
FREQUENT = 100_000
#: Least share of the training tokens that a context in the top has, and a context followed by a symbol.
LEAST_CONTEXT, LEAST_PAIR = 1e-5, 5e-7
#: How often, however small the corpus, a context in the top stands at least; buckets hold all rarer ones.
LEAST_TOP = 20
#: Times the parent's distribution is counted among what was seen, in the top and in buckets.
PRIOR, PRIOR_RARE = 30.0, 2.0
#: In the top, bits for each entry that a state must save, and bits for each time it is met.
ENTRY_BITS, LEAST_BITS = 8.0, 0.02
#: In buckets, how often training holds a context at least, and the bits that it must save.
LEAST_RARE, LEAST_RARE_BITS = 2, 8.0
#: Tokens, and pairs, that a task counts before it hands them on.
FLUSH_WORDS, FLUSH_PAIRS = 2_000_000, 3_000_000
#: Tokens of a bucket, about; there are at most 2^16 buckets, dealt in so many turns, so that a turn's share lies on disk at a time.
BUCKET, TURNS = 1_500_000, 3
#: Texts, about, whose scores one task adds up over the buckets of a turn.
PART = 2_000
#: Bytes and rows of texts that are read at once.
READ_BYTES, READ_ROWS = 2 << 20, 2_000
BITS = 17
MASK = (1 << BITS) - 1
#: The edge of a text where contexts are hashed.
EDGE = U(0xB5297A4D3C6EF35B)
#: Keys of contexts have so many bits in a bucket.
KEY = U((1 << 47) - 1)


def _sums(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often they occur, or the sums of their counts."""
    key = np.concatenate(keys)
    if counts is None:
        return np.unique(key, return_counts=True)
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def count_tokens(texts: DataFrame) -> DataFrame:
    """word (its hash), n: how often each word occurs in the column text (binary) of a table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            words, n = _sums(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for b in batches:
            for part in slices(b, "text", READ_BYTES, READ_ROWS):
                held.append(word_hashes(part.column("text").to_pylist())[0])
                size += len(held[-1])
                if size > FLUSH_WORDS:
                    yield out()
                    size = 0
        if held:
            yield out()

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Tree:
    """The root over symbols and the states of the top over it.

    Symbols: 0 .. k-1 the frequent words, given by their hashes, k the class of all others, k + 1 the edge of a text.
    states[d]: sorted keys of the contexts of d + 1 symbols; a context's number is its place in the list, its
    key its first symbols' number (or, at depth 1, nothing) and its last symbol. links[d]: the number, one depth
    less, of the context without its first symbol. entries[d]: sorted keys (state's number << BITS) + symbol, and the
    natural log of the entry's probability over the parent's; rest[d]: the same for all symbols without an entry.
    """

    def __init__(self, words: np.ndarray, root: np.ndarray):
        self.order = np.argsort(words)
        self.by_symbol, self.words = words, words[self.order]
        self.other, self.edge = len(words), len(words) + 1
        self.log_root = np.log(root)
        self.states: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.kept: list[np.ndarray] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []
        self.rest: list[np.ndarray] = []

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Of words, given by their hashes."""
        if not len(self.words):
            return np.full(len(hashes), self.other)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.order[at], self.other)

    def lay(self, symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Texts' symbols one after the other, each text between edges that neighbours share; the text's number of all symbols but the first."""
        sizes = np.array([len(x) // 4 for x in symbols], np.int64)
        words = np.frombuffer(b"".join(symbols), "<i4")
        flat = np.full(len(words) + len(sizes) + 1, self.edge)
        flat[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = words
        return flat, np.repeat(np.arange(len(sizes)), sizes + 1)

    def hashes(self, flat: np.ndarray, rare: list[bytes]) -> np.ndarray:
        """The hashes of laid symbols, EDGE at edges; rare: those of each text's infrequent words."""
        out = np.append(self.by_symbol, [U(0), EDGE])[flat]
        out[flat == self.other] = np.frombuffer(b"".join(rare), "<u8")
        return out

    def contexts(self, flat: np.ndarray) -> list[np.ndarray]:
        """For each depth, the number of the counted context before each symbol but the first; -1: none.

        A context does not reach beyond an edge.
        """
        out: list[np.ndarray] = []
        last = flat[:-1]
        for d, keys in enumerate(self.states):
            at = np.full(len(last), -1)
            if d == 0:
                numbers = np.full(self.edge + 1, -1)
                numbers[keys] = np.arange(len(keys))
                at = numbers[last]
            elif len(keys):
                before = np.concatenate([[-1], out[d - 1][:-1]])  # the context before the last symbol
                live = np.flatnonzero((before >= 0) & (last != self.edge))
                at[live] = self._find(d, (before[live] << BITS) + last[live])
            out.append(at)
        return out

    def _find(self, d: int, key: np.ndarray) -> np.ndarray:
        """Numbers of the contexts with these keys; -1: none."""
        keys = self.states[d]
        if not len(keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, at, -1)

    def log_of(self, symbol: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """The natural log of the probability of symbols after contexts, read from the longest suffix state."""
        out = self.log_root[symbol]
        for d, at in enumerate(contexts[: len(self.kept)]):
            live = np.flatnonzero(at >= 0)
            live = live[self.kept[d][at[live]]]
            keys, logs = self.entries[d]
            if len(keys) and len(live):
                key = (at[live] << BITS) + symbol[live]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                out[live] += np.where(keys[place] == key, logs[place], self.rest[d][at[live]])
        return out

    def candidates(self, keys: np.ndarray) -> None:
        """Counts may now be taken for the contexts of the next depth."""
        d, keys = len(self.states), np.sort(keys.astype(np.int64))
        self.states.append(keys)
        last = keys & MASK
        if d == 0:
            self.links.append(np.full(len(keys), -1))
        elif d == 1:
            self.links.append(self._find(0, last))
        else:
            shorter = self.links[d - 1][keys >> BITS]
            self.links.append(np.where(shorter >= 0, self._find(d - 1, (shorter << BITS) + last), -1))

    def grow(self, keys: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> None:
        """Tests the last candidates: keys and counts of what follows them, and how often each is followed by anything."""
        d = len(self.states) - 1
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.float64)
        state, symbol = keys >> BITS, keys & MASK
        count = len(self.states[d])
        parent = np.exp(self.log_of(symbol, self._shorter(d, state)))
        p = (n + PRIOR * parent) / (sizes[state] + PRIOR)
        taken = np.bincount(state, p, count)
        were = np.bincount(state, parent, count)
        rest = np.log(np.maximum(1 - taken, 1e-12) / np.maximum(1 - were, 1e-12))
        gain = np.log(p / parent)
        bits = (np.bincount(state, n * gain, count) + (sizes - np.bincount(state, n, count)) * rest) / np.log(2)
        self.kept.append(bits > np.maximum(ENTRY_BITS * (1 + np.bincount(state, minlength=count)), LEAST_BITS * sizes))
        live = self.kept[d][state] if len(state) else np.zeros(0, bool)
        self.entries.append((keys[live], gain[live]))
        self.rest.append(rest)

    def _shorter(self, d: int, state: np.ndarray) -> list[np.ndarray]:
        """The numbers of the shorter suffixes of contexts of d + 1 symbols, the shortest first; -1: none."""
        out: list[np.ndarray] = []
        for k in range(d, 0, -1):
            state = np.where(state >= 0, self.links[k][state], -1)
            out.insert(0, state)
        return out


def encode(given: DataFrame, tree: Tree) -> DataFrame:
    """_id, _text, _train, and of each text: symbols (4 bytes each, its edges left out), rare (the hashes, 8 bytes each, of its infrequent words)."""
    shared = given.sparkSession.sparkContext.broadcast(tree)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            for part in slices(b, "text", READ_BYTES, READ_ROWS):
                hashes, first = word_hashes(part.column("text").to_pylist())
                symbol = tree.symbols(hashes).astype("<i4")
                other = symbol == tree.other
                hashes, before = hashes[other], np.concatenate([[0], np.cumsum(other)])[first]
                packed = [[x[lo:hi].tobytes() for lo, hi in zip(at, at[1:], strict=False)] for x, at in ((symbol, first), (hashes, before))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_id", "_text", "_train")), *(pa.array(x, pa.binary()) for x in packed)], ["_id", "_text", "_train", "symbols", "rare"])

    return given.select("_id", "_text", "_train", "text").mapInArrow(code, "_id long, _text long, _train boolean, symbols binary, rare binary")


def count_pairs(texts: DataFrame, tree: Tree) -> DataFrame:
    """key, n: how often each symbol follows each candidate context of the tree's last depth, in texts as encode() gives them. Symbol MASK: any."""
    shared = texts.sparkSession.sparkContext.broadcast(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, size = shared.value, [], 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            heads, first = np.unique(keys >> BITS, return_index=True)
            sums = np.add.reduceat(n, first) if len(n) else n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys, (heads << BITS) + MASK])), pa.array(np.concatenate([n, sums]))], ["key", "n"])

        for b in batches:
            for part in slices(b, "symbols", READ_BYTES, READ_ROWS):
                flat, _ = tree.lay(part.column("symbols").to_pylist())
                at = tree.contexts(flat)[-1]
                keys = (at[at >= 0] << BITS) + flat[1:][at >= 0]
                held.append(keys)
                size += len(keys)
                if size > FLUSH_PAIRS:
                    yield out()
                    size = 0
        if size:
            yield out()

    return texts.select("symbols").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _numbers(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = frame.select("key", "n").toArrow()
    return table.column("key").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.int64)


def grow_tree(texts: DataFrame, tree: Tree, n_train: int, depth: int = DEPTH) -> Tree:
    """Adds the top's states of each depth in turn; the driver receives their entries, which are bounded."""
    least, most = max(2, LEAST_PAIR * n_train), max(LEAST_TOP, LEAST_CONTEXT * n_train)
    heads = np.flatnonzero(np.exp(tree.log_root) * n_train >= most)
    tree.candidates(heads[heads != tree.other])
    for d in range(depth):
        if not len(tree.states[d]):
            break
        keys, n = _numbers(count_pairs(texts, tree).where((F.col("n") >= least) | (F.col("key").bitwiseAND(MASK) == MASK)))
        whole = (keys & MASK) == MASK
        sizes = np.zeros(len(tree.states[d]))
        sizes[keys[whole] >> BITS] = n[whole]
        keys, n = keys[~whole], n[~whole]
        tree.grow(keys, n, sizes)
        if d + 1 < depth:
            symbol = keys & MASK
            tree.candidates(keys[(n >= most) & (symbol != tree.other) & (symbol != tree.edge)])
    return tree


def rare_keys(around: np.ndarray, top: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Of each token but the first: a 64-bit key of the shortest context before it that is not in the top, 0 where there is none,
    and, in a row for each longer one, 32 bits of the hash of the token that it has in addition, 0 where there is none.

    around: the hashes of the tokens, EDGE at edges, of which a context may have one as its first token alone.
    top: how many of the contexts before a token, the shortest first, are in the top.
    """
    n = len(around) - 1
    before = np.zeros((depth, n), U)  # the tokens of the contexts; 0: no context reaches so far
    reach, key, out = np.ones(n, bool), np.zeros(n, U), np.zeros(n, U)
    for d in range(min(depth, n)):
        before[d, d:] = np.where(reach[d:], around[: n - d], U(0))
        reach[:d] = False
        key = mix(key + before[d])
        key[(key & KEY) == 0] += U(1)
        here = reach & (top == d)
        out[here] = key[here]
        reach &= before[d] != EDGE
    more = np.zeros((depth - 1, n), np.uint32)
    for d in range(depth - 1):
        at = top + d + 1
        live = np.flatnonzero((out != 0) & (at < depth))
        further = before[at[live], live]
        more[d, live] = np.where(further != 0, np.maximum(further >> U(32), U(1)), U(0))
    return out, more


def refine(key: np.ndarray, symbol: np.ndarray, known: np.ndarray, parent_log: np.ndarray) -> np.ndarray:
    """Natural logs of the probabilities of symbols after contexts of one depth, given by keys of 47 bits, from their parents'.

    known: which of them are there to learn from.
    """
    entries = (key << U(BITS)) | symbol
    order = np.argsort(entries)
    entry = entries[order]
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
    context = entry[first] >> U(BITS)
    heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    follows = np.diff(np.append(heads, len(first)))
    n = np.add.reduceat(known[order].astype(np.float64), first)
    whole = np.add.reduceat(n, heads)
    parent = np.exp(parent_log[order[first]])
    without = n * np.log((np.maximum(n - 1, 0) + PRIOR_RARE * parent) / parent)
    saved = np.add.reduceat(without, heads) - whole * np.log(np.maximum(whole - 1, 0) + PRIOR_RARE)
    kept = (whole >= LEAST_RARE) & (saved > LEAST_RARE_BITS * np.log(2))
    gain = np.log((n + PRIOR_RARE * parent) / ((np.repeat(whole, follows) + PRIOR_RARE) * parent))
    gain[~np.repeat(kept, follows)] = 0
    out = parent_log.copy()
    out[order] += np.repeat(gain, np.diff(np.append(first, len(order))))
    return out


def weigh(entries: np.ndarray, more: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Natural logs of the probabilities of tokens in a bucket.

    entries: the shortest context's key << BITS, and the symbol; without a key there is no context here. more: what
    tells the longer ones, as of rare_keys(). logs: by the top's states, below 0 for tokens to learn from; for others
    with the sign changed.
    """
    known, out = logs < 0, -np.abs(logs.astype(np.float64))
    key, symbol = entries >> U(BITS), entries & U(MASK)
    live = np.flatnonzero(key)
    for further in [None, *more]:
        if further is not None:
            live = live[further[live] != 0]
            key[live] = mix((key[live] << U(BITS)) ^ mix(further[live].astype(U))) & KEY
        if not len(live):
            break
        out[live] = refine(key[live], symbol[live], known[live], out[live])
    return out


def score_in_buckets(given: DataFrame, shared: Broadcast[Tree], n_train: int, turn: int, n_texts: int, depth: int = DEPTH) -> DataFrame:
    """_id, _text, score: log10 probabilities of the texts' symbols in a turn's buckets, a row for each text that has any there.

    given: texts as encode() gives them. The class of infrequent words counts as one symbol. A bucket hands its sums on
    packed, a row for each part of the texts; there is at most one sum for each of a text's tokens. n_texts: how many there are, about.
    """
    parts = n_texts // PART + 1
    buckets = min(max(-(-n_train // BUCKET), TURNS), 1 << 16)
    low, high = (buckets * t // TURNS for t in (turn, turn + 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            for part in slices(b, "symbols", READ_BYTES, READ_ROWS):
                flat, text = tree.lay(part.column("symbols").to_pylist())
                symbol, contexts = flat[1:], tree.contexts(flat)
                top = np.sum([at >= 0 for at in contexts[:depth]], axis=0, dtype=np.int64) if contexts else np.zeros(len(symbol), np.int64)
                key, more = rare_keys(tree.hashes(flat, part.column("rare").to_pylist()), top, depth)
                bucket = (((key >> U(47)) * U(buckets)) >> U(17)).astype(np.uint16)
                none = np.flatnonzero(key == 0)
                bucket[none] = none % buckets
                order = np.flatnonzero((bucket >= low) & (bucket < high))
                order = order[np.argsort(bucket[order], kind="stable")]
                ends = np.cumsum(np.bincount(bucket[order], minlength=buckets))
                entries, more, text = (key[order] << U(BITS)) | symbol[order].astype(U), more[:, order], text[order]
                logs = np.minimum(tree.log_of(symbol[order], [c[order] for c in contexts]), -1e-7).astype(np.float32)
                train = part.column("_train").to_numpy(zero_copy_only=False).astype(bool)
                logs = np.where(train[text], logs, -logs)
                ids, hashes = (part.column(c).to_numpy() for c in ("_id", "_text"))
                rows = []
                for k, (lo, hi) in enumerate(zip(np.append(0, ends), ends, strict=False)):
                    if hi > lo:
                        which, n = np.unique(text[lo:hi], return_counts=True)
                        rows.append((k, ids[which].tobytes(), hashes[which].tobytes(), n.astype(np.int32).tobytes(), entries[lo:hi].tobytes(), more[:, lo:hi].T.tobytes(), logs[lo:hi].tobytes()))
                types = [pa.int32(), *[pa.binary()] * 6]
                names = ["bucket", "ids", "hashes", "times", "entries", "more", "logs"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def score(table: pa.Table) -> pa.Table:
        ids, hashes, times, entries, more, logs = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("ids", "i8"), ("hashes", "i8"), ("times", "i4"), ("entries", "u8"), ("more", "u4"), ("logs", "f4"))
        )
        more = more.reshape(len(entries), depth - 1).T
        text = np.repeat(np.arange(len(ids)), times)
        ids, hashes, sums = add(ids, hashes, np.bincount(text, weigh(entries, more, logs), len(ids)) / np.log(10))
        part = (mix(ids.view(U) ^ hashes.view(U)) % U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        which, first = np.unique(part[order], return_index=True)
        packed = [[x.tobytes() for x in np.split(c[order], first[1:])] for c in (ids, hashes, sums)]
        return pa.table([pa.array(which, pa.int32()), *(pa.array(c if len(which) else [], pa.binary()) for c in packed)], ["part", "ids", "hashes", "sums"])

    def unpack(table: pa.Table) -> pa.Table:
        columns = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("ids", "i8"), ("hashes", "i8"), ("sums", "f8")))
        return pa.table(dict(zip(("_id", "_text", "score"), add(*columns), strict=True)))

    def add(ids: np.ndarray, hashes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sum for each id and hash, once."""
        order = np.lexsort((hashes, ids))
        ids, hashes = ids[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])])[: len(ids)])
        return ids[first], hashes[first], np.add.reduceat(sums[order], first) if len(first) else sums

    sent = given.mapInArrow(send, "bucket int, ids binary, hashes binary, times binary, entries binary, more binary, logs binary")
    summed = sent.groupBy("bucket").applyInArrow(score, "part int, ids binary, hashes binary, sums binary")
    return summed.groupBy("part").applyInArrow(unpack, "_id long, _text long, score double")


def score_texts(docs: DataFrame, training: F.Column, frequent: int = FREQUENT, depth: int = DEPTH) -> DataFrame:
    """_id, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs.

    training: which rows the model learns from. score is the log10 probability of the text's symbols, its end
    included. A null text is empty: one end token. A null id is the lowest id. Rows that repeat an id are
    scored each by its own text and count each in training. Without training rows every count is 0, base_score
    is 0 and score takes every token for unknown, of probability 1/2. Texts are scored whole; of an empty table there
    is no row. Extra columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    given = docs.select(id_or_lowest("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("_train"))
    words = scratch.save(count_tokens(given.where("_train").select("text")))
    counts = given.agg(F.count("*").alias("all"), F.count_if("_train").alias("train")).first()
    n_texts = counts["train"]
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2")).first()
    n_train = int(sums["n"] or 0) + n_texts
    v = sums["v"] + (n_texts > 0)
    discount = min(max(sums["n1"] / max(sums["n1"] + 2 * sums["n2"], 1), 0.05), 0.95)
    unknown = discount * v / n_train if n_train else 0.5
    top = words.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    top_words, top_counts = top.column("word").to_numpy().astype(np.int64).view(U), top.column("n").to_numpy().astype(np.float64)
    whole = max(n_train, 1)
    root = np.concatenate([(top_counts - discount) / whole, [0.0], [(n_texts - discount) / whole if n_texts else 0.5]])
    root[len(top_words)] = other = max(1 - root.sum(), 1e-9)
    coded = scratch.save(encode(given, Tree(top_words, root)), compression="zstd")
    tree = grow_tree(coded.where("_train"), Tree(top_words, root), n_train, depth)
    denominator = float(np.log10(n_train + 0.5 * (v + 1)))
    bases = np.log10(np.concatenate([top_counts, [0.0], [n_texts]]) + 0.5) - denominator
    bases[len(top_words)] = 0.0
    scores, top_tree = [], spark.sparkContext.broadcast(tree)
    for turn in range(TURNS):
        scratch.free()
        scores.append(scratch.save(score_in_buckets(coded, top_tree, n_train, turn, counts["all"], depth)))
    scratch.free()
    reader = Tree(top_words, root)
    shared = spark.sparkContext.broadcast((reader, bases))
    ends = int(n_texts > 0)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what its symbols sum to, and one for each word in it that is not frequent."""
        tree, bases = shared.value
        for b in batches:
            for part in slices(b, "symbols", READ_BYTES, READ_ROWS):
                flat, text = tree.lay(part.column("symbols").to_pylist())
                n, symbol = part.num_rows, flat[1:]
                base = np.bincount(text, bases[symbol], n)
                known = np.bincount(text, symbol < tree.other, n).astype(np.int64) + ends
                rare = np.flatnonzero(symbol == tree.other)
                word, owner = np.frombuffer(b"".join(part.column("rare").to_pylist()), "<u8"), text[rare]
                order = np.lexsort((word, owner))
                word, owner = word[order], owner[order]
                new = np.flatnonzero((np.diff(word, prepend=U(0)) != 0) | (np.diff(owner, prepend=-1) != 0))
                times = np.diff(np.append(new, len(word)))
                take = pa.array(np.concatenate([np.arange(n), owner[new]]).astype(np.int64))
                zero = np.zeros(len(new))
                # A text's own row looks nothing up: any key will do that spreads the rows.
                own = mix(part.column("_id").to_numpy().view(U) ^ part.column("_text").to_numpy().view(U))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id").take(take),
                        part.column("_text").take(take),
                        pa.array(np.concatenate([own, word[new]]).view(np.int64)),
                        pa.array(np.arange(len(take)) < n),
                        pa.array(np.concatenate([np.bincount(text, minlength=n), times]).astype(np.int64)),
                        pa.array(np.concatenate([known, zero]).astype(np.int64)),
                        pa.array(np.concatenate([base, zero])),
                    ],
                    ["_id", "_text", "word", "whole", "times", "known", "base"],
                )

    seen = coded.select("_id", "_text", "symbols", "rare").mapInArrow(look_up, "_id long, _text long, word long, whole boolean, times long, known long, base double")
    c = F.when(F.col("whole"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("double")
    # Of a word that is not frequent: its share of the class's mass at the root.
    within = F.when(c > 0, (c - discount) / whole).otherwise(unknown) / other
    found = seen.join(words, "word", "left").select(
        "_id",
        "_text",
        F.when(F.col("whole"), F.col("times")).alias("n_tokens"),
        F.when(F.col("whole"), F.col("known")).when(c > 0, F.col("times")).otherwise(0).alias("n_known"),
        F.when(F.col("whole"), F.col("base")).otherwise(F.col("times") * (F.log10(c + 0.5) - F.lit(denominator))).alias("base_score"),
        F.when(~F.col("whole"), F.col("times") * F.log10(within)).otherwise(0).alias("score"),
        F.when(F.col("whole"), 1).alias("_rows"),
    )
    for part in scores:
        found = found.unionByName(part, allowMissingColumns=True)
    sums = found.groupBy("_id", "_text").agg(*[F.sum(k).alias(k) for k in ("n_tokens", "n_known", "base_score", "score", "_rows")])
    # Rows that are wholly alike were summed together; each gets its share.
    each = sums.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    share = lambda c: F.col(c) / F.col("_rows")
    return each.select(
        "_id",
        share("n_tokens").cast("long").alias("n_tokens"),
        share("n_known").cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        share("base_score").alias("base_score"),
        share("score").alias("score"),
    )


def remainder(modulus: int = 5) -> F.Column:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_texts(docs, remainder() != 1).withColumn("doc_id", id_or_null("_id"))
    return out.select("doc_id", (remainder() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
