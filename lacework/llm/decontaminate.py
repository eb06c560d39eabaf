"""Benchmark decontamination by winnowing (operator 5), in DataFrame functions only.

The hashes of all runs of GRAM words are taken; of each window of as many neighbouring hashes as fit into SPAN
words, the least is kept as a fingerprint (the leftmost, of equals). So any span of SPAN words that two texts
share has a fingerprint in both, at the same place in the span. Where a document's fingerprint is one of the
benchmark's, it is extended to all windows of SPAN words around it, and those whose words are a window of the
benchmark hit. A repetitive text meets a repetitive item's few distinct windows, not each of its places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Columns, Scratch, id_or_lowest, id_or_null, small_side

#: Words that a window has.
SPAN = 10
GRAM = 5
#: Benchmark fingerprints (of 8 bytes and a place) up to this many rows are broadcast, more are shuffled.
MOST_PRINTS = 200_000
#: Documents with fingerprints of the benchmark are broadcast with their places up to this many places (of some 40 bytes).
MOST_PLACES = 1_000_000
_MARKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased; null has none."""
    spaced = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER + _MARKS, LOWER + " " * len(_MARKS)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +", -1))


def fingerprints(words: Column, span: int, gram: int) -> Column:
    """For each window of span words: the least hash of its runs of gram words, their offset in the low bits.

    Of an array of word hashes; empty where there are fewer words than span.
    """
    width = span - gram + 1
    bits = max(1, (width - 1).bit_length())
    clear = F.lit(-(1 << bits))
    n = F.size(words)

    def gram_at(i):
        return F.xxhash64(*[F.get(words, i + j) for j in range(gram)]).bitwiseAND(clear)

    grams = F.transform(F.sequence(F.lit(0), n - gram), gram_at)
    if width == 1:
        return F.when(n >= span, grams).otherwise(F.array().cast("array<long>"))
    return F.when(n >= span, _windows(grams, n - span, width)).otherwise(F.array().cast("array<long>"))


def _windows(grams: Column, last: Column, width: int) -> Column:
    # An aggregate() of no steps binds the hashes to a name, so that they are made once for each text.
    def windows(g):
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(g, i + j).bitwiseOR(F.lit(j)) for j in range(width)]))

    return F.aggregate(F.array().cast("array<int>"), grams, lambda g, _: g, windows)


def _prints(table: DataFrame, keys: list[str], span: int, gram: int) -> DataFrame:
    """keys, hash, at: fingerprints of a table with word hashes in ``hashes``, and their places.

    Neighbouring windows that keep the same one give it once.
    """
    width = span - gram + 1
    mask = (1 << max(1, (width - 1).bit_length())) - 1

    def thinned(kept):
        def place(h, i):
            return i + h.bitwiseAND(F.lit(mask)).cast("int")

        each = F.transform(kept, lambda h, i: F.struct(place(h, i).alias("at"), F.xxhash64(F.lit(span), h.bitwiseAND(F.lit(~mask))).alias("hash")))
        return F.filter(each, lambda p, i: (i == 0) | (p["at"] != place(F.get(kept, i - 1), i - 1)))

    # As above: fingerprints get a name.
    found = F.aggregate(F.array().cast("array<int>"), fingerprints(F.col("hashes"), span, gram), lambda g, _: g, thinned)
    return table.select(*keys, F.explode(found).alias("_p")).select(*keys, F.col("_p.hash").alias("hash"), F.col("_p.at").alias("at"))


def _windows_of(items: DataFrame, span: int) -> DataFrame:
    """gram, items: the distinct windows of items (words, item) as text, and the sorted ids of all items that hold each."""
    size = F.least(F.size("words"), F.lit(span))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    rows = items.select("items", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("words", i, size), " ")))).alias("gram"))
    return rows.select("gram", F.explode("items").alias("item")).groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _few_places(frame: DataFrame, places: str) -> DataFrame:
    """Marks rows with arrays of places for broadcast only if counted to have at most MOST_PLACES, and as many rows."""
    total = frame.agg(F.sum(F.size(places) + 1)).first()[0] or 0
    return F.broadcast(frame) if total <= MOST_PLACES else frame


def _found(docs: DataFrame, benchmark: DataFrame, span: int, gram: int) -> tuple[Columns, DataFrame]:
    """The columns of docs, and their rows with what find_contamination() adds."""
    scratch = Scratch(docs.sparkSession)
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words"))
    items = scratch.save(items.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("item").alias("items")))
    short = sorted(r[0] for r in items.where(F.size("words") < span).select(F.size("words")).distinct().collect())
    kinds = [(span, gram), *((n, n) for n in short)]
    known = items.select(F.size("words").alias("n"), hashed.alias("hashes"))
    prints = reduce(DataFrame.unionByName, [_prints(known.where(F.col("n") >= s if s == span else F.col("n") == s), [], s, g).select("hash").distinct() for s, g in kinds])
    prints, windows = scratch.save(prints), scratch.save(_windows_of(items, span))

    own = Columns(docs)
    text = F.col(own["text"])
    keys = ["_id", "_text"]
    keyed = own.frame.withColumns({"_id": id_or_lowest(own["doc_id"]), "_text": F.xxhash64(text)})
    texts = keyed.select(*keys, words_of(text).alias("words")).select(*keys, hashed.alias("hashes"))
    # A window that begins at start has its fingerprint at most span - gram words on.
    code = span + 1
    seen = [_prints(texts, keys, s, g).withColumns({"low": F.greatest(F.col("at") - (s - g), F.lit(0)), "size": F.lit(s)}) for s, g in kinds]
    met = reduce(DataFrame.unionByName, seen).join(small_side(prints, MOST_PRINTS), "hash", "left_semi")
    spots = scratch.save(met.groupBy(*keys).agg(F.collect_set(F.struct("low", "at", "size")).alias("spots")))

    def candidates(words):
        ends = lambda p: F.least(p["at"], F.size(words) - p["size"])
        starts = F.transform(F.filter("spots", lambda p: p["low"] <= ends(p)), lambda p: F.transform(F.sequence(p["low"], ends(p)), lambda s: s.cast("long") * code + p["size"]))
        each = F.array_distinct(F.flatten(starts))
        start, size = lambda c: F.floor(c / code).cast("int"), lambda c: F.pmod(c, F.lit(code)).cast("int")
        return F.transform(each, lambda c: F.struct(start(c).alias("start"), size(c).alias("size"), F.array_join(F.slice(words, start(c) + 1, size(c)), " ").alias("gram")))

    # As above: the words get a name, lest they be split anew for each window.
    spotted = keyed.join(_few_places(spots, "spots"), keys).select(*keys, F.explode(F.aggregate(F.array().cast("array<int>"), words_of(text), lambda w, _: w, candidates)).alias("c"))
    hits = spotted.select(*keys, "c.start", "c.size", "c.gram").join(small_side(windows, MOST_PRINTS), "gram")
    hits = scratch.save(hits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))

    both = keyed.join(_few_places(hits, "_hits"), keys, "left")
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    # Windows come by their start, so each adds what lies beyond all before it.
    add = lambda a, h: F.struct(F.greatest(a["end"], h["start"] + h["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), h["start"] + h["size"] - F.greatest(a["end"], h["start"]))).alias("n"))
    both = both.withColumns({
        "n_words": F.size(words_of(text)).cast("long"),
        "n_hit": F.coalesce(F.aggregate("_hits", none, add, lambda a: a["n"]), F.lit(0).cast("long")),
        "items": F.coalesce("items", F.array().cast("array<string>")),
        "starts": F.coalesce(F.array_distinct(F.transform("_hits", lambda h: h["start"])), F.array().cast("array<int>")),
    })
    return own, both


def find_contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids, as strings) and starts (where hit windows begin) added.

    An item of fewer words than span, but not none, is a window by itself. Null or empty texts have no words; a
    null item_id is named "null"; items of the same words share one fingerprint set; ids that repeat count
    once. A null doc_id is the lowest; rows that repeat an id are judged each by its own text. Extra columns of
    docs pass through, and one that has the name of an added column keeps it (see Columns); those of the benchmark
    are not read. Of empty documents there is no row; with an empty benchmark nothing is hit. Texts are taken whole;
    the work and the arrays of a row grow with its own length, whatever the items repeat.
    """
    own, found = _found(docs, benchmark, span, gram)
    return own.restore(found, "n_words", "n_hit", "items", "starts")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit word, with their columns, whatever these are called."""
    own, found = _found(docs, benchmark, SPAN, GRAM)
    return own.restore(found.where("n_hit = 0"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def contamination_sql(documents: str, where: str = "") -> str:
    """Common table expressions for DuckDB that end in ``found``: doc_id, n_words, n_hit, n_items, items."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    return rf"""
bw AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words} AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), 10) AS k FROM bw WHERE len(w) > 0),
g AS (SELECT DISTINCT item, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bi)),
dw AS (SELECT doc_id, {words} AS w FROM {documents}),
dg AS (SELECT doc_id, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS gram
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT doc_id, dg.k, i, item FROM dg JOIN g ON g.gram = dg.gram AND g.k = dg.k),
hp AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
found AS (SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
          FROM dw LEFT JOIN hp USING (doc_id) LEFT JOIN hi USING (doc_id))
"""


OP5_SQL = f"WITH {contamination_sql('documents')} SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, n_hit > 0 AS contaminated FROM found"
