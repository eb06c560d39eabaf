"""Toxicity by a weighted finite-state pattern grammar (operator 3).

A lexical transducer maps words to classes: insults (whole words, or stems with any ending) are learned from labels,
with a weight each, and so are threats, which are words that mark toxic documents only where their clause has a target.
Some threats are given, with weight 1; targets, negation and reported speech are closed lists of the grammar. A clause is the
string of its classes. Transducers over classes mark the insults and threats in it: one for reported speech, one for
negation and one for targets, composed into one machine that reads the clause from the left; and that for targets
again from the right, as what follows is aimed at, too. What an arc of the composed machine emits, by kind
and mark, is summed over the clause; the weights of the arcs are learned by logistic regression. So matched clauses are
scored and no isolated words.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_or_lowest, id_or_null

#: The lexicon is learned on at most this many labelled training documents, those whose ids hash lowest.
SAMPLE = 30_000
STEMS = (4, 5, 6, 7)
#: A threat's log odds in clauses with a target exceed those of the word anywhere by so much.
LEAST_AIM = 1.0

# Closed word classes of the grammar, in English, German, French and Spanish.
THREATS = "kill hurt destroy beat shoot stab burn murder töten umbringen verletzen schlagen tuer tuerai frapper détruire matar matarte golpear quemar".split()
TARGETS = "you your yours u he she they them these those du dich dir ihr euch sie tu te toi vous ils elles tú ti usted ustedes ellos ellas".split()
NEGATIONS = "not never isn't aren't don't won't cannot nicht kein keine keinen niemals ne jamais aucun nunca jamás tampoco".split()
REPORTS = "said says wrote called quoted claimed reported sagte schrieb nannte behauptete dit écrit disait affirmait dijo escribió llamó afirmó".split()

_SPACE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 or c == 39 else (c + 32 if 65 <= c < 91 else 32) for c in range(256))
_CLAUSE = re.compile(rb"[.!?;:\n]+")
_CLASS = {w.encode(): k for k, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
N_FEATURES = 11
#: What an insult or threat is marked with, and the words that a negation reaches.
REPORTED, NEGATED, TARGETED = 4, 2, 1
REACH = 5
#: What is emitted by marks: 0 plain, 1 targeted, 2 negated, 3 reported; the stronger mark counts.
_EMITS = [3 if m & REPORTED else 2 if m & NEGATED else 1 if m & TARGETED else 0 for m in range(8)]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPACE).split()


class Machine:
    """A deterministic transducer over symbols (class, marks): arcs[state][symbol] is the next state and what replaces the symbol."""

    def __init__(self, start, step, symbols):
        self.arcs, number, todo = [], {start: 0}, [start]
        for state in todo:
            arcs = {}
            for symbol in symbols:
                to, out = step(state, symbol)
                if to not in number:
                    number[to] = len(todo)
                    todo.append(to)
                arcs[symbol] = (number[to], out)
            self.arcs.append(arcs)

    def then(self, other: "Machine") -> "Machine":
        """The composition: what this one puts out, the other reads."""

        def step(states, symbol):
            to, out = self.arcs[states[0]][symbol]
            to_other, out = other.arcs[states[1]][out]
            return (to, to_other), out

        return Machine((0, 0), step, self.arcs[0])

    def run(self, symbols) -> list:
        state, out = 0, []
        for symbol in symbols:
            state, replaced = self.arcs[state][symbol]
            out.append(replaced)
        return out


_SYMBOLS = [(k, m) for k in ("other", "insult", "threat", "target", "negation", "report") for m in range(8)]


def _marked(symbol, mark, inside):
    kind, marks = symbol
    return (kind, marks | mark) if inside and kind in ("insult", "threat") else symbol


#: After a reporting verb all is reported, to the end of the clause.
REPORT = Machine(False, lambda s, x: (s or x[0] == "report", _marked(x, REPORTED, s)), _SYMBOLS)
#: A negation reaches REACH words, and is spent by what it meets.
NEGATION = Machine(0, lambda s, x: (REACH if x[0] == "negation" else 0 if x[0] in ("insult", "threat") else max(0, s - 1), _marked(x, NEGATED, s > 0)), _SYMBOLS)
#: A target holds to the end of the clause, in the direction of reading.
TARGET = Machine(False, lambda s, x: (s or x[0] == "target", _marked(x, TARGETED, s)), _SYMBOLS)
CLAUSE = REPORT.then(NEGATION).then(TARGET)


class Grammar:
    """The lexical transducer, and what clauses emit through it and the machines over classes."""

    def __init__(self, words: dict[bytes, float], stems: dict[bytes, float], threats: dict[bytes, float] | None = None):
        self.words, self.stems = words, stems
        self.threats = {w: 1.0 for w, k in _CLASS.items() if k == "threat"} | (threats or {})
        self.lengths = sorted({len(s) for s in stems})

    def insult(self, word: bytes) -> float:
        """The weight of a word as an insult; 0: none."""
        if word in self.words:
            return self.words[word]
        return max((self.stems.get(word[:n], 0.0) for n in self.lengths if len(word) >= n), default=0.0)

    def clause(self, words: list[bytes]) -> tuple[float, ...]:
        """What a clause emits: weights of plain, targeted, negated and reported insults, and the same of threats.

        A threat in a clause without a target emits nothing, whatever else stands there.
        """
        out, symbols, weights = [0.0] * 8, [], []
        for word in words:
            weight = self.insult(word)
            kind = "insult" if weight else "threat" if word in self.threats else _CLASS.get(word, "other")
            symbols.append((kind, 0))
            weights.append(weight or self.threats.get(word, 0.0))
        if any(weights):
            marked = TARGET.run(reversed(CLAUSE.run(symbols)))
            for (kind, marks), weight in zip(marked, reversed(weights), strict=True):
                if weight and (kind == "insult" or marks & TARGETED):
                    out[_EMITS[marks] + 4 * (kind == "threat")] += weight
        return tuple(out)

    def features(self, text: bytes | None) -> np.ndarray:
        """Sums over clauses by kind and mark, the largest clause, matched clauses and their density; zeros without a match."""
        f = np.zeros(N_FEATURES)
        if not text or not self.any(set(words_of(text))):
            return f
        clauses = [words_of(c) for c in _CLAUSE.split(text)]
        emitted = [self.clause(c) for c in clauses if c]
        e = np.array([x for x in emitted if any(x)])
        if len(e):
            f[:8] = np.log1p(e.sum(0))
            f[8] = np.log1p((e @ np.array([1.0, 1.2, 0.3, 0.3] * 2)).max())
            f[9] = np.log1p(len(e))
            f[10] = len(e) / len(emitted)
        return f

    def any(self, distinct: set[bytes]) -> bool:
        if not self.words.keys().isdisjoint(distinct):
            return True
        if any(not self.stems.keys().isdisjoint({w[:n] for w in distinct}) for n in self.lengths):
            return True
        return not self.threats.keys().isdisjoint(distinct)


def aimed_words(text: bytes) -> set[bytes]:
    """The distinct words of the clauses that have a target, but for words of the closed classes."""
    clauses = [set(words_of(c)) for c in _CLAUSE.split(text)]
    return {w for c in clauses if any(_CLASS.get(w) == "target" for w in c) for w in c if w not in _CLASS}


def learn_lexicon(rows: list[tuple[bytes, bytes, int]]) -> Grammar:
    """Words, stems and words beside a target that mark toxic documents, chosen one by one for the toxic documents they newly explain.

    rows: each document's distinct words, and those of clauses with a target, joined by spaces, and its label; one is
    split at a time, which keeps memory low. Choosing for what is not explained yet keeps out words that merely stand
    beside an insult. A word beside a target, a threat, may be chosen only if it tells more there than anywhere. A term
    must newly explain three toxic documents, so a lexicon has no more than a third of these.
    """
    toxic = [(w, aimed) for w, aimed, y in rows if y]
    n0, n1 = max(1, len(rows) - len(toxic)), max(1, len(toxic))
    holders: dict[tuple[int, bytes], array] = {}
    clean: Counter[tuple[int, bytes]] = Counter()

    parts = [lambda words, _: {(0, w) for w in words.split() if len(w) > 2}, lambda _, aimed: {(2, w) for w in aimed.split() if len(w) > 2}]
    parts += [lambda words, _, n=n: {(1, w[:n]) for w in words.split() if len(w) > n} for n in STEMS]

    def terms(*words):
        return set().union(*(part(*words) for part in parts))

    for part in parts:  # one at a time, so that not all terms that are too rare are held at once
        often: Counter = Counter()
        for words in toxic:
            often.update(part(*words))
        holders |= {t: array("i") for t, n in often.items() if n >= 3}
    del often
    for i, words in enumerate(toxic):
        for t in terms(*words):
            if t in holders:
                holders[t].append(i)
    for words, aimed, y in rows:
        if not y:
            clean.update(t for t in terms(words, aimed) if t in holders)

    def weight(t):
        return float(np.log((len(holders[t]) + 0.5) / (n1 + 1) / ((clean[t] + 0.5) / (n0 + 1))))

    good = {t: w for t in holders if (w := weight(t)) > 1.5 and (t[0] < 2 or w > weight((0, t[1])) + LEAST_AIM)}
    left, chosen = set(range(len(toxic))), {}
    gain = {t: len(holders[t]) for t in good}
    while good:
        best = max(gain, key=lambda t: (gain[t] * good[t], good[t], -len(t[1]), t), default=None)
        if best is None or gain[best] < 3:
            break
        new = left.intersection(holders[best])
        if len(new) < gain[best]:  # the gain was stale: put it right and look again
            gain[best] = len(new)
            continue
        chosen[best] = good[best]
        left -= new
        del gain[best]
    # Then all terms about as strong as those chosen that hold in many documents each.
    if chosen:
        floor = max(3, 0.02 * n1)
        for t, w in sorted(good.items(), key=lambda x: (-x[1], x[0])):
            if t[0] < 2 and len(holders[t]) >= floor and clean[t] == 0:
                chosen.setdefault(t, w)
    return Grammar(*({t: w for (k, t), w in chosen.items() if k == kind} for kind in range(3)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Grammar, np.ndarray]:
    """Grammar and weights (intercept last) from a bounded sample of labelled training rows.

    Exact copies of a text count once, so that a group of copies cannot teach its incidental words.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("y"))
    known = known.where(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(5)) != 0).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    picked = docs.select(id_or_lowest("doc_id").alias("_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(known), "_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            words, aimed = (pa.array([b" ".join(sorted(of(t))) for t in texts], pa.binary()) for of in (lambda t: set(words_of(t)), aimed_words))
            yield pa.RecordBatch.from_arrays([b.column("_id"), words, aimed, b.column("y")], ["_id", "words", "aimed", "y"])

    # Of an id with several texts the least counts, so there are no more rows than labels.
    rows = picked.mapInArrow(words, "_id long, words binary, aimed binary, y int").groupBy("_id").agg(F.min(F.struct("words", "aimed")).alias("words"), F.max("y").alias("y")).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r["_id"]):
        seen.setdefault((bytes(r["words"]["words"]), bytes(r["words"]["aimed"])), r["y"])
    del rows
    grammar = learn_lexicon([(*k, y) for k, y in seen.items()])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [grammar.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(f, pa.list_(pa.float64())), b.column("y")], ["_id", "f", "y"])

    rows = picked.mapInArrow(parse, "_id long, f array<double>, y int").groupBy("_id").agg(F.min("f").alias("f"), F.max("y").alias("y")).collect() if seen else []
    counts: Counter = Counter((tuple(r["f"]), r["y"]) for r in rows)
    if not counts:
        return grammar, np.array([0.0] * N_FEATURES + [-2.0])
    keys = sorted(counts)
    x = np.array([[*k[0], 1.0] for k in keys])
    y = np.array([float(k[1]) for k in keys])
    n = np.array([float(counts[k]) for k in keys])
    w = np.zeros(x.shape[1])
    ridge = np.array([0.3] * N_FEATURES + [0.01])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return grammar, w


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and the matched clauses' features, a row for each row of docs.

    A null text is empty and scores as a text without a match, as empty ones do. A null id counts as held out
    (its crc32 is taken of the empty text). Labels of an id that differ: 1 wins. Rows that repeat an id are
    scored each. Without labels every score is that of the intercept -2. Texts are read whole, however long; of an
    empty table there is no row. Extra columns are not read.
    """
    grammar, w = fit(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([grammar.features(t) for t in b.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(f @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(p), pa.array(np.rint(np.expm1(f[:, 9])).astype(np.int32))], ["_id", "score", "n_clauses"])

    given = docs.select(id_or_lowest("doc_id").alias("_id"), F.col("text").cast("binary").alias("text"))
    out = given.mapInArrow(score, "_id long, score double, n_clauses int")
    crc = F.crc32(F.coalesce(id_or_null("_id").cast("string"), F.lit("")).cast("binary"))
    return out.select(id_or_null("_id").alias("doc_id"), (F.pmod(crc, F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
