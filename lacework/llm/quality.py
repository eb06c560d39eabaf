"""Quality classification by hierarchical empirical Bayes (operator 7).

A document's own evidence is a log likelihood ratio from a logistic model of its shape. Evidence of its host
(``source``) and of its path on the host (``lang``, the next level of these tables) comes from the mean
posterior of the documents there, shrunk: a path's prior towards its host's, a host's towards the global one,
by strengths estimated from how much hosts (paths) differ beyond chance. Sparse sites so keep the global prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Columns, Scratch, id_or_lowest, id_or_null, small_side, slices

#: The model is fitted on at most this many labelled documents, those whose ids hash lowest.
SAMPLE = 20_000
#: Host and path tables up to this many rows are broadcast, larger ones shuffled.
MOST_SITES = 50_000
ROUNDS = 2

_KIND = np.zeros(256, np.uint8)  # 1 lower-case letter, 2 upper-case letter, 3 digit, 4 sentence mark, 5 other mark, 6 space, 0 beyond ASCII
for _chars, _kind in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b".,;:?'\"()-", 4), (b"!#$%&*+/<=>@[\\]^_`{|}~", 5), (b" \t\n\x0b\x0c\r", 6)):
    _KIND[list(_chars)] = _kind
N_FEATURES = 13


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row of shape features for each text; null is empty."""
    out = np.zeros((len(texts), N_FEATURES))
    for i, text in enumerate(texts):
        if not text:
            continue
        kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7)
        words = text.split()
        n = len(words)
        letters = max(1, kinds[0] + kinds[1] + kinds[2])
        size = len(text)
        distinct = len(set(words)) / max(n, 1)
        repeats = sum(map(bytes.__eq__, words, words[1:])) / max(n - 1, 1)
        lines = text.count(b"\n") + 1
        logn = np.log1p(n)
        out[i] = (logn, distinct, distinct * logn, repeats, kinds[2] / letters, kinds[5] / size, kinds[3] / size, kinds[4] / size, text.count(b"|") / max(n, 1), np.log1p(size / max(n, 1)), np.log1p(n / lines), kinds[0] / size, kinds[6] / size)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (intercept last) of a ridge logistic regression on features and their squares."""
    x = np.hstack([x, x**2])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def logit_of(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return np.clip((np.hstack([x, x**2]) - mean) / scale, -20, 20) @ w[:-1] + w[-1]


def _mapped(frame: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(make, slices(batch, "text", 1 << 21, 2000))

    return frame.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model and the prior of quality 1, from a bounded sample of labelled documents.

    Without labels of both kinds there is no evidence: None, and the prior with one pseudo-label of each.
    """
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("y"))
    known = known.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    picked = docs.select(id_or_lowest("doc_id").alias("_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(known), "_id").select("text", "y")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    rows = _mapped(picked, make, "x array<double>, y int").limit(sample).collect()
    y = np.array([float(r["y"]) for r in rows])
    prior = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return None, prior
    # Rows in a fixed order: the fit does not depend on how tasks ended.
    x = np.array([r["x"] for r in rows])
    order = np.lexsort(np.column_stack([x, y]).T)
    return fit_logistic(x[order], y[order]), prior


def _site(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\0null"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """_id, _text (hash of the text), host, path, evidence, host_prior, path_prior, quality (posterior) and keep (quality >= 0.5), a row for each row of docs.

    A null id is the lowest id; a null or empty text has the features of emptiness; null hosts and paths are
    sites of their own. Rows of one id are classified each by its own text. Without usable labels evidence is
    0 and everything is kept. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    model, prior = fit(docs, labels, sample)
    base = float(np.log(prior / (1 - prior)))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column("text").to_pylist())
        evidence = np.clip(logit_of(model, x) - base, -15, 15) if model else np.zeros(len(x))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_text", "host", "path")), pa.array(evidence, pa.float64())], ["_id", "_text", "host", "path", "evidence"])

    given = docs.select(id_or_lowest("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), _site(host).alias("host"), _site(path).alias("path"), F.col("text").cast("binary").alias("text"))
    scored = scratch.save(_mapped(given, make, "_id long, _text long, host string, path string, evidence double"))

    def posterior(log_prior):
        return 1 / (1 + F.exp(-(F.col("evidence") + log_prior)))

    priors = None
    for _ in range(rounds):
        now = scored if priors is None else scored.join(small_side(priors, MOST_SITES), ["host", "path"])
        log_prior = F.lit(base) if priors is None else F.log(F.col("path_prior") / (1 - F.col("path_prior")))
        paths = scratch.save(now.withColumn("p", posterior(log_prior)).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
        hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
        strength = _strength(hosts, "hn", "hs")
        total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
        mean = min(max((total["s"] or 0.0) / max(total["n"] or 0, 1), 1e-3), 1 - 1e-3) if total["n"] else prior
        hosts = hosts.select("host", ((F.lit(strength * mean) + F.col("hs")) / (F.lit(strength) + F.col("hn"))).alias("host_prior"))
        within = _strength(paths, "n", "s")
        shrunk = (F.lit(within) * F.col("host_prior") + F.col("s")) / (F.lit(within) + F.col("n"))
        priors = paths.join(small_side(hosts, MOST_SITES), "host").select("host", "path", "host_prior", F.least(F.greatest(shrunk, F.lit(1e-3)), F.lit(1 - 1e-3)).alias("path_prior"))
        priors = scratch.save(priors)
    out = scored.join(small_side(priors, MOST_SITES), ["host", "path"])
    quality = posterior(F.log(F.col("path_prior") / (1 - F.col("path_prior"))))
    keep = quality >= 0.5 if model else F.lit(True)
    return out.select("_id", "_text", "host", "path", "evidence", "host_prior", "path_prior", quality.alias("quality")).withColumn("keep", keep)


def _strength(sites: DataFrame, n: str, s: str) -> float:
    """Pseudo-count of a Beta prior over site rates, by the method of moments; 2 to 10,000."""
    row = sites.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("q"), F.sum(F.col(n).cast("double") * F.col(n)).alias("nn"), F.count("*").alias("k")).first()
    if not row["n"] or row["k"] < 2:
        return 10.0
    m = row["s"] / row["n"]
    between = (row["q"] - row["n"] * m * m - (row["k"] - 1) * m * (1 - m)) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(min(max(m * (1 - m) / max(between, 1e-9) - 1, 2.0), 10_000.0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that classify() keeps, with their columns, whatever these are called.

    Rows of one id, text, host and path share a verdict. Of an empty table nothing is left.
    """
    marks = classify(docs, labels).where("keep").select("_id", "_text", "host", "path").distinct()
    own = Columns(docs)
    keyed = own.frame.withColumns({"_id": id_or_lowest(own["doc_id"]), "_text": F.xxhash64(own["text"]), "host": _site(own["source"]), "path": _site(own["lang"])})
    return own.restore(keyed.join(marks, ["_id", "_text", "host", "path"], "left_semi"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(id_or_null("_id").alias("doc_id"), "evidence", "host_prior", "path_prior", "quality", "keep")
