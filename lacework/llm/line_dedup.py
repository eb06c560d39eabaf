"""Line deduplication (operator 4), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, Columns, Scratch, id_or_lowest, lower_ascii


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, salts: int = 16) -> DataFrame:
    """Which lines of each document stay, as run-length compressed bitmaps.

    Returns (_id, _text, n_dropped, keep_runs): a row for each document that loses a line, _id being its id
    (null as the lowest), _text a hash of its text and keep_runs the runs (start, len) of kept lines.

    Line hashes are range-partitioned together with a salt of the document, so that no hash fills a
    partition; within a partition the rows are sorted by hash, document (largest first) and position, and the
    first occurrence in each document is streamed into a count and the largest document of each hash. Only
    hashes of 128 bits, ids and positions travel, never a text.

    A null or empty text is one empty line. Repeated rows of an id count as one document. Rows of one id
    with different texts count as one document too, and each keeps its own bitmap.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(id_or_lowest("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = own.select("_id", "_text", "pos", F.btrim("line", F.lit(SPACES)).alias("line")).where(F.char_length("line") >= min_chars)
    key = key.withColumn("line", lower_ascii(F.col("line")))
    rows = scratch.save(key.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "_id", "_text", "pos"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(max(salts, parts))))
    sorted_rows = salted.repartitionByRange(parts, "h1", "salt").sortWithinPartitions("h1", "salt", "h2", F.desc("_id"), "pos")
    # Read in that order, a row that follows one of the same hash and document is no first occurrence.
    order = Window.partitionBy("h1", "salt", "h2").orderBy(F.desc("_id"), "pos")
    first = sorted_rows.select("h1", "salt", "h2", "_id", F.lag("_id").over(order).alias("before")).where("before is null or before <> _id")
    part = first.groupBy("h1", "salt", "h2").agg(F.count("*").alias("docs"), F.max("_id").alias("keeper"))
    # A verdict for each salt of a hash, so that the join that follows deals a frequent hash by salt as well.
    whole = Window.partitionBy("h1", "h2")
    verdict = part.select("h1", "salt", "h2", F.sum("docs").over(whole).alias("docs"), F.max("keeper").over(whole).alias("keeper")).where(F.col("docs") >= min_docs)
    lost = salted.join(verdict.drop("docs"), ["h1", "h2", "salt"]).where("_id <> keeper")
    lost = lost.groupBy("_id", "_text").agg(F.array_sort(F.collect_set("pos")).alias("lost"))
    # Kept runs lie between neighbours of the lost positions; the last run is open and cut by slice().
    edges = F.concat(F.array(F.lit(-1)), F.col("lost"))
    starts = F.transform(edges, lambda p: p + 1)
    ends = F.concat(F.col("lost"), F.array(F.lit(2**31 - 1)))
    runs = F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda r: r["end"] > r["start"])
    runs = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), (r["end"] - r["start"]).alias("len")))
    return lost.select("_id", "_text", F.size("lost").cast("long").alias("n_dropped"), runs.alias("keep_runs"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents with their repeated lines taken out of ``text``, and n_lines, n_dropped and keep_runs.

    Extra columns pass through; one that has the name of an added column keeps it (see Columns). The text of a document that loses nothing stays as it is (null stays null).
    """
    marks = line_keep_bitmaps(docs, min_chars, min_docs)
    own = Columns(docs)
    text = own["text"]
    keyed = own.frame.withColumns({"_id": id_or_lowest(own["doc_id"]), "_text": F.xxhash64(text)})
    both = keyed.join(marks, ["_id", "_text"], "left")
    lines = _lines(F.col(text))
    kept = F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["len"]))), "\n")
    both = both.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("long")),
        "kept_text": F.when(F.col("keep_runs").isNull(), F.col(text)).otherwise(kept),
    })
    return own.restore(both, "n_lines", "n_dropped", "keep_runs", text="kept_text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
v AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, v.key IS NOT NULL AND k.doc_id <> v.keeper AS lost FROM k LEFT JOIN v USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
