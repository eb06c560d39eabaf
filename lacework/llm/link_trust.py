"""URL filters with trust that spreads over links (operator 12), in DataFrame functions only.

Rules judge urls by host and path. Where none fits, the host is judged: urls that a rule allows are seeds of trust,
which personalised PageRank carries along links between hosts; urls that a rule blocks are seeds of distrust, which
it carries against them, as who links to blocked sites is suspect. A host with more distrust than trust is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, small_side


@dataclass(frozen=True)
class Rule:
    """Urls of a host and its subdomains whose path starts with path."""

    verdict: str
    host: str
    path: str


RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
#: The share of a host's trust that its links carry on, and the most times that it is carried.
DAMPING, ROUNDS = 0.85, 20
#: Trust of one seed. Trust is a whole number, so that sums do not depend on their order.
UNIT = 1_000_000
#: Distrust over trust from which on a host is blocked.
RATIO = 1.0
#: Tables of hosts up to so many rows are broadcast, larger ones shuffled.
MOST_HOSTS = 200_000
LINK = r"""(?i)href[\t\n\f\r ]*=[\t\n\f\r ]*["']?[\t\n\f\r ]*((?:https?:)?//[^"'<>\t\n\f\r ]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def judge(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null where none does. Of equal length, the longer host's."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.host, r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """source, host, path, n: links between hosts (source, host), by the path that they lead to.

    pages: host, html. Links within a host are left out. Links of a page are counted before they are shuffled.
    """
    links = pages.select(F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    host, path = url_parts(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    return links.select("source", host.alias("host"), path.alias("path")).where("source <> '' and host <> '' and source <> host")


def spread(scratch: Scratch, edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, mass: seeds (host, mass) spread over edges (a, b, share), of which a host's shares sum to 1.

    Each round, a host has the part of its seed's mass that stays, and what its neighbours pass on; shares of it
    are rounded down to whole numbers. It ends when nothing changes, or after the given rounds. A round's masses
    are a written table. Hosts with very many links have them summed within tasks first.
    """
    mass = scratch.save(seeds.select("host", F.floor(F.col("mass") * F.lit(1 - damping)).cast("long").alias("mass")))
    own = mass
    for _ in range(rounds):
        passed = edges.join(small_side(mass, MOST_HOSTS).withColumnRenamed("host", "a"), "a").select(F.col("b").alias("host"), F.floor(F.col("mass").cast("double") * F.col("share") * F.lit(damping)).cast("long").alias("mass"))
        new = scratch.save(own.unionByName(passed.where("mass > 0")).groupBy("host").agg(F.sum("mass").alias("mass")))
        changed = new.join(mass, ["host", "mass"], "left_anti").limit(1).count()
        if mass is not own:
            scratch.drop(mass)
        mass = new
        if not changed:
            break
    return mass


def host_trust(scratch: Scratch, pages: DataFrame, rules: list[Rule], damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust: of hosts that have some. pages: host, path, html."""
    links = host_links(pages)
    linked = scratch.save(links.groupBy("source", "host", judge(F.col("host"), F.col("path"), rules)[1].alias("verdict")).agg(F.count("*").alias("n")))
    own = pages.where("host <> ''").groupBy("host", judge(F.col("host"), F.col("path"), rules)[1].alias("verdict")).agg(F.count("*").alias("n"))
    urls = own.unionByName(linked.select("host", "verdict", "n")).where("verdict is not null")
    seeds = scratch.save(urls.groupBy("host", "verdict").agg((F.sum("n") * UNIT).cast("long").alias("mass")))
    edges = scratch.save(linked.groupBy("source", "host").agg(F.sum("n").alias("n")))
    found = []
    for verdict, a, b, name in (("allow", "source", "host", "trust"), ("block", "host", "source", "distrust")):
        total = edges.groupBy(a).agg(F.sum("n").alias("total"))
        shares = edges.join(small_side(total, MOST_HOSTS), a).select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col("n").cast("double") / F.col("total").cast("double")).alias("share"))
        mass = spread(scratch, scratch.save(shares), seeds.where(F.col("verdict") == verdict).select("host", "mass"), damping, rounds)
        found.append(mass.withColumnRenamed("mass", name))
    zero = F.lit(0).cast("long")
    return found[0].join(found[1], "host", "full").select("host", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES, ratio: float = RATIO, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """page_id, url, host, path, rule, verdict, trust and distrust of each row of pages.

    The verdict is the rule's; without one, "block" if the host's distrust is over ratio times its trust, else "allow". So
    hosts of which nothing is known are allowed. A null url, or one without ``://``, has an empty host and path,
    takes part in nothing and is allowed. Null html has no links. Rows that repeat count each. An empty table gives
    an empty result, no rules allow everything. Extra columns are not read. rules are a list in code, made into one
    expression; a table of hosts is sent to all tasks only if counted to be small.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    trust = scratch.save(host_trust(scratch, parsed.select("host", "path", "html"), rules, damping, rounds))
    rule, verdict = judge(F.col("host"), F.col("path"), rules)
    out = parsed.drop("html").join(small_side(trust, MOST_HOSTS), "host", "left").fillna(0, ["trust", "distrust"])
    mine = F.when(F.col("distrust") > F.col("trust") * F.lit(ratio), "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, mine).alias("verdict"), "trust", "distrust")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def url_filter_sql(table: str, rules: list[Rule] = RULES) -> str:
    """DuckDB's query for op12 over a table of pages; every round is a common table expression."""
    ordered = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host), r.host, r.path))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in ordered]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r.host}{r.path}'" for c, r in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    parts = f"{lower.format('''regexp_extract(rest, '^[^/?#]*')''')} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path"
    link = LINK.replace("'", "''")

    def masses(name: str, verdict: str, a: str, b: str) -> str:
        steps = [f"{name}0 AS (SELECT host, floor(sum(n) * {UNIT} * {1 - DAMPING!r}::DOUBLE)::BIGINT AS mass FROM seeds WHERE verdict = '{verdict}' GROUP BY host)"]
        steps.append(f"{name}s AS (SELECT {a} AS a, {b} AS b, n::DOUBLE / (sum(n) OVER (PARTITION BY {a}))::DOUBLE AS share FROM (SELECT source, host, sum(n) AS n FROM linked GROUP BY ALL))")
        for k in range(ROUNDS):
            passed = f"SELECT b AS host, floor(mass::DOUBLE * share * {DAMPING!r}::DOUBLE)::BIGINT AS mass FROM {name}s JOIN {name}{k} ON host = a"
            steps.append(f"{name}{k + 1} AS (SELECT host, sum(mass)::BIGINT AS mass FROM (SELECT * FROM {name}0 UNION ALL SELECT * FROM ({passed}) WHERE mass > 0) GROUP BY host)")
        return ", ".join(steps)

    return f"""
WITH p AS (SELECT page_id, html, {parts} FROM (SELECT page_id, html, coalesce({rest.format('url')}, '') AS rest FROM {table})),
l AS (SELECT host AS source, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p),
t AS (SELECT source, {parts} FROM (SELECT source, {rest.format('link')} AS rest FROM (SELECT source, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM l))),
linked AS (SELECT source, host, {verdict} AS verdict, count(*) AS n FROM t WHERE source <> '' AND host <> '' AND source <> host GROUP BY ALL),
seeds AS (SELECT host, {verdict} AS verdict, count(*) AS n FROM p WHERE host <> '' GROUP BY ALL UNION ALL SELECT host, verdict, n FROM linked),
{masses('t', 'allow', 'source', 'host')}, {masses('d', 'block', 'host', 'source')}
SELECT page_id, host, path, {rule} AS rule, coalesce(t{ROUNDS}.mass, 0) AS trust, coalesce(d{ROUNDS}.mass, 0) AS distrust,
       coalesce({verdict}, CASE WHEN coalesce(d{ROUNDS}.mass, 0) > coalesce(t{ROUNDS}.mass, 0) * {RATIO!r} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN t{ROUNDS} USING (host) LEFT JOIN d{ROUNDS} USING (host)
"""


OP12_SQL = url_filter_sql("pages")
