"""Token alignment, url filters and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lacework.llm import common, importance, link_trust, token_alignment

TEXTS = [
    (1, "The cat sat on the mat, and the cat's hat fell."),
    (2, "  leading  spaces\tand\n\nlines  "),
    (3, "größer straße 猫が好き 🙂🙂 naïve"),
    (4, ""),
    (5, None),
    (6, "<|endoftext|> <s> </s> <unk> <0x41> a▁b"),
    (7, "The cat sat on the mat, and the cat's hat fell."),
    (7, "other text of an id that repeats 12345 67"),
    (None, "a null id"),
    (9, "word " * 700 + "x" * 300),
]


def _tokens(text, first, second):
    """Ids and end offsets on both sides, or None, by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    t = Tokenizer.from_file(first)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=second)
    of = token_alignment._byte_of()
    whole = (" " + text).encode()
    a = [(i, bytes(of[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()) for i in s.encode(text) for p in [s.id_to_piece(i)]]
    if any(b"".join(x for _, x in side) != whole for side in (a, b)):
        return None
    return [[(i, sum(len(x) for _, x in side[: k + 1])) for k, (i, _) in enumerate(side)] for side in (a, b)]


def _groups(a, b):
    """Runs of A and B ids between shared ends."""
    shared = sorted({e for _, e in a} & {e for _, e in b})
    return [([i for i, e in a if lo < e <= hi], [i for i, e in b if lo < e <= hi]) for lo, hi in zip([0, *shared], shared, strict=False)]


def _linked(kind, a, b):
    spans = [[(i, e0, e) for (i, e), e0 in zip(side, [0, *[e for _, e in side]], strict=False)] for side in (a, b)]
    if kind == "ends":
        return [(i, j) for i, _, e in spans[0] for j, _, f in spans[1] if e == f]
    if kind == "overlaps":
        return [(i, j) for i, s, e in spans[0] for j, r, f in spans[1] if max(s, r) < min(e, f)]
    return [(i, j) for x, y in _groups(a, b) for i in x for j in y]


@pytest.mark.parametrize("kind", token_alignment.LINKS)
def test_alignment_is_that_of_plain_search(spark, kind, monkeypatch):
    first, second = (f"{token_alignment.TOKENIZERS}/{n}" for n in (token_alignment.BYTE_LEVEL, token_alignment.PIECES))
    monkeypatch.setattr(token_alignment, "PART", 100)
    docs = spark.createDataFrame([(i, t, "extra") for i, t in TEXTS], "doc_id long, text string, links string")
    want, counts = [], Counter()
    for doc, text in TEXTS:
        got = _tokens(text, first, second)
        links = _linked(kind, *got) if got else []
        counts.update(links)
        want.append((doc, got, links))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    rows = []
    for doc, got, links in want:
        groups = _groups(*got) if got else []
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((doc, *(len(s) for s in got or ((), ())), len(groups), len(links), text, sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links)))
    for common_pairs in (token_alignment.MOST_COMMON, 20):
        monkeypatch.setattr(token_alignment, "MOST_COMMON", common_pairs)
        out = token_alignment.count_links(common.Scratch(spark), token_alignment.align_tokens(docs, links=kind))
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, rows))


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.count_links(common.Scratch(spark), token_alignment.align_tokens(docs)).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, text string")
    (row,) = token_alignment.count_links(common.Scratch(spark), token_alignment.align_tokens(nulls)).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, "", 0, 0)


def test_both_byte_level_encoders_cut_alike():
    from pathlib import Path

    data = Path(token_alignment.TOKENIZERS, token_alignment.BYTE_LEVEL).read_bytes()
    fast = token_alignment.ByteLevelTokenizer(data)
    slow = token_alignment.ByteLevelTokenizer(data.replace(b'"dropout":null', b'"dropout":0.0000000001').replace(b'"dropout": null', b'"dropout": 0.0000000001'))
    assert fast.fast is not None
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data.decode())
    t.encode_special_tokens = True
    for lo in range(0, 0x30000, 61):
        text = "".join(f" a{chr(c)} {chr(c)}{chr(c)}'s1" for c in range(lo, lo + 3) if not 0xD800 <= c < 0xE000)
        assert fast(text) == t.encode(" " + text, add_special_tokens=False).ids, lo
    assert slow.fast is None


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _resampled(docs, target, n=2, buckets=10_000, least=20, percent=25, seed="7"):
    def runs(text):
        w = _words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(text))
    for text in target:
        t.update(runs(text))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    rows = []
    for doc, text in docs:
        f = runs(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(_words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -(2**63) if r[0] is None else r[0]))
    for place, r in enumerate(fit[: percent * len(fit) // 100]):
        r.append(place + 1)
    return sorted(repr(tuple(r + [None] * (6 - len(r)))) for r in rows)


def test_resampling_is_that_of_plain_python(spark):
    docs = [(i, " ".join(f"w{(i * k * k) % 37}" for k in range(i))) for i in range(1, 90)]
    docs += [(None, "Null ids " * 15), (5, None), (6, ""), (7, "..."), (8, "Größe " * 30), (100, "y" * 300 + " " + "z" * 200 + " end"), (101, "long text of words " * 400), (102, "long text of words " * 400)]
    target = ["w1 w4 w9 long text", None, "", "Größe größe words " * 60, "q" * 100]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, rank int")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for n, chunk in ((2, importance.CHUNK), (2, 50), (3, 64), (1, 40)):
        out = importance.resample(frame, wanted, n=n, chunk=chunk)
        assert sorted(repr(tuple(r)) for r in out.collect()) == _resampled(docs, target, n=n)


def test_chunks_own_each_start_once():
    text = ("Some words and " + "x" * 90 + " größe, " * 7) .encode() * 5
    for chunk in (1, 2, 7, 33, 100, 5_000):
        for n in (1, 2, 3):
            parts = list(importance.cut(text, chunk, n))
            sums = sorted(int(x) for x in importance.Features(n)([p for p, _ in parts], importance.np.array([own for _, own in parts]))[0])
            assert sums == sorted(int(x) for x in importance.Features(n)([text])[0])


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 30), (1, "a b " * 30)] * 4, "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    rows = importance.resample(some, none).collect()
    assert len(rows) == 8 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2]


PAGES = [
    (1, "https://A.example.org/es/1?x", None),
    (2, "https://example.org/en/12", '<a href="https://good.net/x">'),
    (3, "https://example.org/en/2", '<a HREF = "//good.net/y"><a href="/own">'),
    (4, "http://shop.com/fr/", "<a href='https://shady.net/'>"),
    (5, "http://shop.com/de/", None),
    (6, "http://shop.com/en/", ""),
    (7, "https://shady.net/p", '<a href="http://bad.com/de/1"><a href=http://bad.com/de/2>'),
    (8, "https://good.net/x#y", '<a href="https://next.net">'),
    (9, "https://next.net", None),
    (10, "https://notorg/", None),
    (11, "ftp://x.org", None),
    (12, "no scheme", '<a href="http://good.net/">'),
    (13, None, '<a href="http://good.net/">'),
    (14, "https://deeper.net/a", '<a href="https://shady.net/q">'),
    (14, "https://deeper.net/a", '<a href="https://shady.net/q">'),
    (None, "https://unknown.net/?a/b", "<p>"),
    (15, "https://example.org?/es/", None),
]


def test_url_filters_are_those_of_the_sql(spark):
    schema = "page_id long, url string, html string"
    for pages in (PAGES, []):
        found = link_trust.filter_urls(spark.createDataFrame([(*p, "own") for p in pages], schema + ", verdict string"))
        got = found.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect()
        db = duckdb.connect()
        db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        if pages:
            db.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
        want = db.sql(f"SELECT page_id, host, path, rule, verdict, trust, distrust FROM ({link_trust.OP12_SQL})").fetchall()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    by_id = {(r["page_id"], r["path"]): r for r in link_trust.filter_urls(spark.createDataFrame(PAGES, schema)).collect()}
    assert by_id[1, "/es/1"]["rule"] == "example.org/es/" and by_id[1, "/es/1"]["verdict"] == "block"
    assert by_id[2, "/en/12"]["verdict"] == "block" and by_id[3, "/en/2"]["rule"] == "org/"
    assert by_id[7, "/p"]["verdict"] == "block", "links to blocked urls"
    assert by_id[8, "/x"]["verdict"] == "allow" and by_id[9, ""]["trust"] > 0, "trust comes along links"
    assert by_id[14, "/a"]["distrust"] > 0 and by_id[14, "/a"]["verdict"] == "block", "distrust goes back two links"
    assert by_id[10, "/"]["rule"] is None and by_id[11, ""]["rule"] is None


def test_trust_is_personalised_pagerank(spark):
    """Against repeated multiplication in plain Python, in reals."""
    links = {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 2, ("c", "a"): 1, ("c", "d"): 1, ("e", "a"): 5}
    seeds = {"a": 10.0, "e": 4.0}
    out_of = defaultdict(float)
    for (x, _), n in links.items():
        out_of[x] += n
    want = {h: 0.15 * m for h, m in seeds.items()}
    for _ in range(20):
        new = defaultdict(float, {h: 0.15 * m for h, m in seeds.items()})
        for (x, y), n in links.items():
            new[y] += 0.85 * want.get(x, 0.0) * n / out_of[x]
        want = new
    edges = spark.createDataFrame([(x, y, n / out_of[x]) for (x, y), n in links.items()], "a string, b string, share double")
    given = spark.createDataFrame([(h, int(m * link_trust.UNIT)) for h, m in seeds.items()], "host string, mass long")
    got = {r["host"]: r["mass"] / link_trust.UNIT for r in link_trust.spread(common.Scratch(spark), edges, given).collect()}
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-3 for h in want)
