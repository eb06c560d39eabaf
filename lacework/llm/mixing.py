"""Mixing sources to target weights by Poisson replication (operator 8), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Columns, Scratch, small_side

#: The largest mean that one draw inverts; larger ones are sums of equal draws.
MOST_MEAN = 500
#: Source tables up to this many rows are broadcast, larger ones shuffled.
MOST_SOURCES = 10_000
#: Copies of a row that one task makes at a time; rows that may have more are dealt out in pieces of so many.
PIECE = 1_000
_NULL = "\0null"


def uniform(seed: str, *columns) -> F.Column:
    """A number in [0, 1) of 52 bits from the md5 of a seed and some columns."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson(mean: F.Column, u: F.Column) -> F.Column:
    """The Poisson variate of a mean up to MOST_MEAN at the uniform number u, by inversion.

    The series is followed to where less than 2^-53 of the mass remains, beyond any value of u.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    p0 = F.exp(-mean)
    start = F.struct(p0.alias("p"), p0.alias("c"), F.lit(0).alias("n"))

    def step(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["n"] + (u >= s["c"]).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["n"])


def _mixed(docs: DataFrame, weights: dict[str, float] | None, seed: str, size_factor: float) -> tuple[Columns, DataFrame]:
    """The columns of docs, and their rows with what mix() adds."""
    scratch = Scratch(docs.sparkSession)
    own = Columns(docs)
    doc_id, text = F.col(own["doc_id"]).cast("string"), F.col(own["text"])
    given = own.frame.withColumn("source", F.coalesce(own["source"], F.lit(_NULL)))
    sizes = given.groupBy("source").agg(F.sum(F.greatest(F.octet_length(F.coalesce(text, F.lit(""))), F.lit(1)).cast("long")).alias("size"))
    sizes = scratch.save(sizes)
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        shares = docs.sparkSession.createDataFrame([(_NULL if k is None else k, float(v)) for k, v in weights.items()] or [("", 0.0)], "source string, weight double")
        sizes = sizes.join(F.broadcast(shares), "source", "left").fillna(0.0, ["weight"])
    total = sizes.agg(F.sum("size").alias("bytes"), F.sum("weight").alias("weights"), F.max(F.col("weight") / F.col("size")).alias("most")).first()
    factor = size_factor * (total["bytes"] or 0) / total["weights"] if total["weights"] else 0.0
    rates = sizes.select("source", (F.lit(float(factor)) * F.col("weight") / F.col("size")).alias("rate"))
    rated = given.join(small_side(rates, MOST_SOURCES), "source").drop("source")
    draws = F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("int")
    rated = rated.withColumn("mean", F.col("rate") / draws)
    each = F.transform(F.sequence(F.lit(1), draws), lambda i: poisson(F.col("mean"), uniform(seed, doc_id, i.cast("string"))))
    counted = rated.withColumn("n_copies", F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)).where("n_copies > 0")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if factor * (total["most"] or 0.0) <= PIECE / 2:
        copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    else:
        pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_copies") - 1) / PIECE))))
        pieces = pieces.repartition(parts, F.xxhash64(doc_id, "piece"))
        first = F.col("piece") * PIECE
        copies = pieces.withColumn("copy_no", F.explode(F.sequence(first + 1, F.least(first + PIECE, F.col("n_copies")))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(doc_id, F.lit("null")), F.col("copy_no").cast("string"))))
    return own, keyed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix", size_factor: float = 1.0) -> DataFrame:
    """The documents, each repeated so that every source holds its target share of the bytes in the mean.

    weights: source -> share of the output (scaled to sum to 1; a source that is not named gets none); None:
    equal shares. size_factor: bytes out per byte in. Adds rate (mean repetitions), n_copies, copy_no (from
    1) and shuffle_key, by whose random order rows are dealt over the cluster.

    A null source is a source of its own, named by None in weights. A null or empty text counts as one
    byte. Rows that repeat an id are repeated alike. Extra columns pass through, and one that has the name of an
    added column keeps it (see Columns). Copies of a row that has very many are made by many tasks, so neither one
    task nor one array holds them all. An empty table gives an empty result.
    """
    own, mixed = _mixed(docs, weights, seed, size_factor)
    return own.restore(mixed, "rate", "n_copies", "copy_no", "shuffle_key")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs)
    return out.select("doc_id", "source", "lang", "n_chars", "text", F.round(F.col("rate") * 1e6, 0).cast("long").alias("rate_millionths"), "n_copies", "copy_no", "shuffle_key")


def mixing_sql(table: str) -> str:
    """DuckDB's query for op8 over a table of documents; weights are equal, the seed is "mix"."""
    return f"""
WITH s AS (SELECT coalesce(source, chr(1)) AS src, sum(greatest(octet_length(encode(coalesce(text, ''))), 1)) AS size FROM {table} GROUP BY 1),
r AS (SELECT src, ((SELECT sum(size) FROM s)::DOUBLE / (SELECT count(*) FROM s)::DOUBLE) / size::DOUBLE AS rate FROM s),
t AS (SELECT src, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, (SELECT unnest(range(0, 800)) AS k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
c AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS cdf FROM t),
d AS (SELECT *, coalesce(source, chr(1)) AS src, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM {table}),
n AS (SELECT doc_id, src, (SELECT count(*) FROM c WHERE c.src = d.src AND d.u >= c.cdf) AS n_copies FROM d),
e AS (SELECT doc_id, n_copies, unnest(range(1, n_copies + 1)) AS copy_no FROM n)
SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, round(r.rate * 1e6)::BIGINT AS rate_millionths, e.n_copies, e.copy_no,
       md5('mix:order:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || e.copy_no::VARCHAR) AS shuffle_key
FROM d JOIN r USING (src) JOIN e ON e.doc_id = d.doc_id
"""


OP8_SQL = mixing_sql("documents")
