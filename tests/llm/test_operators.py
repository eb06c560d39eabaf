import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacework.llm import decontaminate, jaccard_join, licenses, line_dedup, mixing, nn_descent, quality, suffix_index, suffix_tree, toxicity
from lacework.llm.common import Scratch, bitmap, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, label string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ed", "is"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, 80) for _ in range(12)]
    near = [b.replace(b.split()[40], "changed", 1) for b in base[:4]]
    shared = "This line is shared by many documents."
    out = [*base, *base[:3], *near, None, "", "one two", "one two", f"{shared}\nown a", f" {shared.upper()}\nown b\n", f"{shared}\n\n{shared}", prose(rng, 9000), "the " * 500]
    return dict(enumerate(out)) | {100: base[5][:260] + prose(rng, 5)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, 1, "x") for i, t in texts.items()], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 45)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(Scratch(spark), edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 45: 40, 50: 40}


def test_line_dedup(docs, empty, texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    lines = {i: (t or "").split("\n") for i, t in texts.items()}
    held = {}
    for i, ls in lines.items():
        for k in {key(x) for x in ls if len(key(x)) >= 20}:
            held.setdefault(k, set()).add(i)
    for r in line_dedup.dedup_lines(docs).collect():
        kept = [x for x in lines[r["doc_id"]] if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == r["doc_id"]]
        assert (r["text"] or "") == "\n".join(kept) and r["n_dropped"] == len(lines[r["doc_id"]]) - len(kept)
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 5, 8])
def test_suffix_index(docs, empty, texts, batches):
    want = suffix_index.brute_force({i: t.encode() if t else None for i, t in texts.items()})
    got = {r["_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_index.remove_repeats(docs, batches=batches).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000
    assert suffix_index.remove_repeats(empty).count() == 0


def test_suffix_arrays_form_a_logarithmic_family(spark):
    """Levels are sorted, have ranks as the bits of the number of batches, and batches meet levels when they come."""
    family, inserted = suffix_index.IndexFamily(Scratch(spark)), Counter()
    rng = random.Random(31)
    for i in range(7):
        batch = [(i, i, low, rng.randint(0, 40), rng.randint(0, 2)) for low in range(12)]
        before = {g for g, _ in inserted}
        inserted.update((g, s) for *_, g, s in batch)
        family.insert(spark.createDataFrame(batch, "_id long, _text long, low int, gram long, span long"))
        own = Counter(g for *_, g, _ in batch)
        assert {r["gram"] for r in family.met[-1].collect()} == {g for g, n in own.items() if n > 1 or g in before}
        assert [rank for rank, _ in family.levels] == [k for k in (2, 1, 0) if (i + 1) >> k & 1]
    levels = [t.withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()}).sort("at").collect() for _, t in family.levels]
    for rows in levels:
        for file in {r["file"] for r in rows}:
            part = [(r["gram"], r["span"]) for r in rows if r["file"] == file]
            assert sorted(set(part)) == part
    assert sum(r["n"] for rows in levels for r in rows) == 84
    kinds = Counter(g for g, _ in inserted)
    assert {(r["gram"], r["span"]): (r["n"], r["kinds"]) for r in family.alike().collect()} == {(g, s): (n, kinds[g]) for (g, s), n in inserted.items() if n > 1 or kinds[g] > 1}


def jaccard_brute_force(texts, k=4, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(docs, empty, texts):
    got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_groups(docs).collect()}
    assert got == jaccard_brute_force(texts)
    assert jaccard_join.linked_groups(empty).count() == 0


#: Every name that the operators add or use within, beside the columns of documents.
CLASHING = "_id _text keep_runs n_lines n_dropped kept_text lost pos h1 h2 salt keeper laid hashes words items starts n_words n_hit c1 c2 rate mean weight size piece n_copies copy_no shuffle_key evidence host path keep quality component_id node c0 c7 _judged _found".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Null ids, rows that repeat, ids with two texts, and columns of all names that the operators use."""
    rng = random.Random(21)
    line = "A line that many of the documents share, word by word."
    a, b = prose(rng, 60), prose(rng, 70)
    rows = [(None, a), (None, a), (None, f"{line}\n{a}"), (1, f"{line}\n{b}"), (1, f"{line}\nshort"), (2, f"{line}\n{b}"), (2, f"{line}\n{b}"), (3, None), (4, ""), (5, f"{line} "), (6, a + " " + b)]
    rows = [(i, t, None if k % 3 else "de", f"s{k % 2}" if k % 4 else None, None, *[f"{k}:{c}" for c in CLASHING]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))


def test_clashing_columns(spark, clashing, texts):
    whole = {tuple(r) for r in clashing.collect()}
    names = clashing.columns
    values = lambda frame, *less: Counter(tuple(r[c] for c in names if c not in less) for r in frame.select(*names).collect())
    given = values(clashing, "text")
    lines = line_dedup.dedup_lines(clashing)
    assert values(lines, "text") == given and lines.columns[len(names) :] == ["n_lines_", "n_dropped_", "keep_runs_"]
    assert {(r["doc_id"], r["n_dropped_"]) for r in lines.collect()} == {(None, 0), (None, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0)} | {(6, 0)}
    bench = spark.createDataFrame([(None, " ".join((texts[0] or "").split()[:12])), (1, " ".join(clashing.where("doc_id = 2").first()["text"].split()[20:40]))], "item_id long, text string")
    found = decontaminate.find_contamination(clashing, bench)
    assert values(found) == values(clashing) and {r["doc_id"] for r in found.where("n_hit_ > 0").collect()} == {1, 2, 6}
    clean = decontaminate.drop_contaminated(clashing, bench)
    assert clean.columns == names and {tuple(r) for r in clean.collect()} <= whole and clean.count() == 7
    mixed = mixing.mix(clashing)
    assert {tuple(r) for r in mixed.select(*names).collect()} <= whole and mixed.columns[len(names) :] == ["rate_", "n_copies_", "copy_no_", "shuffle_key_"]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for frame in (quality.keep_good(clashing, labels), jaccard_join.keep_one_of_each_group(clashing)):
        assert frame.columns == names and {tuple(r) for r in frame.collect()} <= whole
    assert {r["_id"] for r in quality.classify(clashing, labels).collect()} == {-(2**63), 1, 2, 3, 4, 5, 6}
    # Of rows alike and of groups one stays: the null id's text, 1's texts, 3, 4, 5 and 6.
    kept = Counter(r["doc_id"] for r in jaccard_join.keep_one_of_each_group(clashing).collect())
    assert kept[3] == kept[4] == 1 and kept[None] >= 1 and kept[2] == 0


@pytest.mark.parametrize("piece", [2, 1000])
def test_mixing_of_a_source_of_next_to_nothing(spark, monkeypatch, piece):
    """Few bytes in one source: their copies are made in pieces, and are those of the closed form."""
    monkeypatch.setattr(mixing, "PIECE", piece)
    rows = [(1, "x", "small"), (1, "x", "small"), (2, "y" * 400, "large"), (None, None, None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed="s").collect()
    rates = {"small": 403 / 3 / 2, "large": 403 / 3 / 400, None: 403 / 3}
    want = Counter()
    for i, _, source in rows:
        u = int(hashlib.md5(f"s:{'null' if i is None else i}:1".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rates[source])
        c = p
        while u >= c:
            n += 1
            p *= rates[source] / n
            c += p
        for k in range(n):
            want[(i, source, n, k + 1)] += 1
    assert Counter((r["doc_id"], r["source"], r["n_copies"], r["copy_no"]) for r in out) == want
    assert all(r["shuffle_key"] == hashlib.md5(f"s:order:{'null' if r['doc_id'] is None else r['doc_id']}:{r['copy_no']}".encode()).hexdigest() for r in out)


def test_bitmap(spark):
    rng = random.Random(11)
    numbers = [rng.randint(-(2**63), 2**63 - 1) for _ in range(500)] + [0, -1, 0]
    got = np.unpackbits(bitmap(spark.createDataFrame([(x,) for x in numbers], "number long"), 17), bitorder="little")
    assert set(np.flatnonzero(got)) == {x % 2**17 for x in numbers}
    assert not bitmap(spark.createDataFrame([], "number long"), 16).any()


@pytest.mark.parametrize("wanted", [0, 500_000])
def test_jaccard_join_in_small_batches(docs, texts, spark, monkeypatch, wanted):
    """Runs and regions go on over batches; sets are picked by a filter, and by a join."""
    monkeypatch.setattr(jaccard_join, "MOST_WANTED", wanted)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_groups(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == jaccard_brute_force(texts)


def test_jaccard_join_with_crowded_filters(spark, monkeypatch):
    """Single sets that share a filter's slot with copied ones keep their links."""
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", 15)
    rng = random.Random(13)
    texts = [t for t in (prose(rng, 8) for _ in range(400)) for _ in range(2)]
    for _ in range(400):
        text = prose(rng, 40)
        texts += [text, f"{text} changed"]
    texts = dict(enumerate(texts))
    got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == jaccard_brute_force(texts)


@pytest.mark.parametrize("leaf", [8, 256])
def test_jaccard_join_of_a_group_of_near_copies(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rng = random.Random(7)
    base, texts = prose(rng, 130).split(), {}
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(130), rng.randint(0, 7)):
            words[at] = f"w{rng.randint(0, 10**6)}"
        texts[i] = " ".join(words)
    got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = jaccard_brute_force(texts)
    assert got == want and 10 < len({c for _, c in want.values()}) < 150


def test_decontamination(spark, docs, empty, texts):
    bench = spark.createDataFrame([(1, " ".join(texts[2].split()[10:30]), "x"), (2, "One, TWO!", None), (3, None, ""), (4, "absent words here", "")], "item_id long, text string, start string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got[2] == (20, ["1"]) and got[21] == (2, ["2"]) and got[0] == (0, []) and got[19] == (0, [])
    assert decontaminate.find_contamination(empty, bench).count() == 0


def test_suffix_tree_is_a_distribution(docs, empty, texts):
    out = {r["_id"]: r for r in suffix_tree.score_texts(docs, suffix_tree.remainder() != 1).collect()}
    assert len(out) == len(texts) and out[19]["n_tokens"] == 1
    assert all(r["score"] < 0 for r in out.values())
    assert suffix_tree.score_texts(empty, suffix_tree.remainder() != 1).count() == 0
    tree = suffix_tree.Tree(np.array([11, 7], np.uint64), np.array([0.4, 0.3, 0.1, 0.2]))
    tree.candidates(np.array([0]))
    tree.grow(np.array([1, 0]), np.array([500, 10]), np.array([600.0]))
    assert tree.kept[0][0]
    total = sum(math.exp(tree.log_of(np.array([s]), tree.contexts(np.array([0, s])))[0]) for s in range(4))
    assert math.isclose(total, 1.0)


def test_suffix_tree_in_buckets_by_brute_force():
    """States of a bucket: sums to 1, the test with each occurrence left out, and nothing learned from held-out tokens."""
    rng = np.random.default_rng(5)
    parent = np.array([0.4, 0.3, 0.2, 0.1])
    context, symbol, train = rng.integers(1, 60, 400), rng.choice(4, 400, p=[0.1, 0.1, 0.1, 0.7]), rng.random(400) < 0.7
    symbol[context < 20] = context[context < 20] % 4
    entries = (context.astype(np.uint64) << np.uint64(17)) | symbol.astype(np.uint64)
    logs = np.log(parent)[symbol].astype(np.float32)
    more = np.zeros((2, len(entries)), np.uint32)
    got = suffix_tree.weigh(entries, more, np.where(train, logs, -logs))
    a, kept = suffix_tree.PRIOR_RARE, 0
    for c in set(context.tolist()):
        n = np.bincount(symbol[(context == c) & train], minlength=4)
        bits = sum(math.log2((n[s] - 1 + a * parent[s]) / (n.sum() - 1 + a) / parent[s]) for s in symbol[(context == c) & train])
        state = n.sum() >= 2 and bits > suffix_tree.LEAST_RARE_BITS
        kept += state
        p = (n + a * parent) / (n.sum() + a) if state else parent
        assert math.isclose(p.sum(), 1.0)
        for s, g in zip(symbol[context == c], got[context == c], strict=True):
            assert math.isclose(g, math.log(p[s]), rel_tol=1e-4, abs_tol=1e-5)
    assert 0 < kept < len(set(context.tolist()))
    assert np.allclose(suffix_tree.weigh(np.arange(4, dtype=np.uint64), more[:, :4], logs[:4]), logs[:4])


def test_suffix_tree_keys_of_contexts():
    """The shortest context beyond the top has the key, longer ones a part each; the first token alone may be the edge of a text."""
    hashes = np.array([5, 6, 7, 5, 6, 7, 9], np.uint64) << np.uint64(40)
    tree = suffix_tree.Tree(hashes[:2], np.array([0.2, 0.2, 0.3, 0.3]))
    symbols = tree.symbols(hashes).astype("<i4")
    flat, text = tree.lay([symbols[:3].tobytes(), b"", symbols[3:].tobytes()])
    assert flat.tolist() == [3, 0, 1, 2, 3, 3, 0, 1, 2, 2, 3] and text.tolist() == [0, 0, 0, 0, 1, 2, 2, 2, 2, 2]
    around = tree.hashes(flat, [hashes[2:3].tobytes(), b"", hashes[5:].tobytes()])
    assert (around[flat != 3] == hashes).all() and (around[flat == 3] == suffix_tree.EDGE).all()
    none = np.zeros(len(text), np.int64)
    keys, more = suffix_tree.rare_keys(around, none, 3)
    assert (keys != 0).all() and len(set(keys.tolist())) == 5  # the edge, 5, 6, 7, 9
    assert [bool(x) for x in more[0]] == [False, True, True, True, False, False, True, True, True, True]
    assert [bool(x) for x in more[1]] == [False, False, True, True, False, False, False, True, True, True]
    assert more[:, 3].tolist() == more[:, 8].tolist() and more[0, 1] == more[0, 6] != more[0, 2]
    keys, more = suffix_tree.rare_keys(around, none + 2, 3)
    assert [bool(k) for k in keys] == [False, False, True, True, False, False, False, True, True, True] and not more.any()
    assert keys[2] == keys[7] and keys[3] == keys[8] and len(set(keys.tolist())) == 4
    keys, more = suffix_tree.rare_keys(around, none + 3, 3)
    assert not keys.any() and not more.any()


def _plain_scores(rows, training, depth=3):
    """Scores by a plain suffix tree: contexts in dictionaries, one after the other."""
    s = suffix_tree
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    texts = [split(t) for t in rows]
    counts = Counter(w for t, k in zip(texts, training, strict=True) if k for w in t)
    n_texts, v = sum(training), len(counts) + 1
    n = sum(counts.values()) + n_texts
    ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = min(max(ones / max(ones + 2 * twos, 1), 0.05), 0.95)
    root = {w: (c - discount) / n for w, c in counts.items()} | {"</s>": (n_texts - discount) / n}
    other = max(1 - sum(root.values()), 1e-9)
    base = lambda w: root.get(w, other)
    symbol = lambda w: w if w in root else None
    places = []  # text, learned from, the contexts from the shortest on, the next symbol
    for i, t in enumerate(texts):
        line = ["</s>", *t, "</s>"]
        for j in range(1, len(line)):
            places.append((i, training[i], [tuple(line[j - d : j]) for d in range(1, min(depth, j) + 1)], symbol(line[j])))
    follow = {}
    for _, learned, contexts, x in places:
        if learned:
            for c in contexts:
                follow.setdefault(c, Counter())[x] += 1
    least, most = max(2, s.LEAST_PAIR * n), max(s.LEAST_TOP, s.LEAST_CONTEXT * n)
    known = {}

    def state(context):
        """The distribution after a context, as a function of the symbol."""
        if not context:
            return base
        if context in known:
            return known[context]
        parent, seen = state(context[1:]), follow.get(context, Counter())
        whole, out = sum(seen.values()), state(context[1:])
        if whole - discount * (len(context) == 1) >= most:
            seen = {x: c for x, c in seen.items() if c >= least}
            p = {x: (c + s.PRIOR * parent(x)) / (whole + s.PRIOR) for x, c in seen.items()}
            rest = max(1 - sum(p.values()), 1e-12) / max(1 - sum(parent(x) for x in p), 1e-12)
            bits = sum(c * math.log2(p[x] / parent(x)) for x, c in seen.items()) + (whole - sum(seen.values())) * math.log2(rest)
            if bits > max(s.ENTRY_BITS * (1 + len(p)), s.LEAST_BITS * whole):
                out = lambda x: p.get(x, parent(x) * rest)
        elif whole >= s.LEAST_RARE:
            saved = sum(c * math.log2((c - 1 + s.PRIOR_RARE * parent(x)) / (whole - 1 + s.PRIOR_RARE) / parent(x)) for x, c in seen.items())
            if saved > s.LEAST_RARE_BITS:
                out = lambda x: (seen[x] + s.PRIOR_RARE * parent(x)) / (whole + s.PRIOR_RARE)
        known[context] = out
        return out

    unknown, out = discount * v / n, [0.0] * len(rows)
    for i, _, contexts, x in places:
        out[i] += math.log10(state(contexts[-1])(x)) + (math.log10(unknown / other) if x is None else 0)
    return out


def test_suffix_tree_scores_by_brute_force(spark, monkeypatch):
    """Whole scores, from contexts of all lengths, are those of a plain tree; in many buckets as in few."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(120)]
    after = {w: [rng.choice(words) for _ in range(3)] for w in words}
    texts = []
    for _ in range(150):
        line = [rng.choice(words)]
        for _ in range(rng.randrange(60)):
            line.append(rng.choice(after.get(line[-1], words)) if rng.random() < 0.7 else rng.choice(words) if rng.random() < 0.9 else f"u{rng.randrange(10**6)}")
        texts.append(" ".join(line))
    texts += ["", None, "u1", *texts[:5], *[texts[9]] * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _plain_scores(texts, [i % 5 != 1 for i in range(len(texts))])
    for bucket in (400, 10**9):
        monkeypatch.setattr(suffix_tree, "BUCKET", bucket)
        got = {r["_id"]: r["score"] for r in suffix_tree.score_texts(docs, F.col("doc_id") % 5 != 1).collect()}
        assert len(got) == len(texts)
        for i, w in enumerate(want):
            assert math.isclose(got[i], w, rel_tol=1e-5), (i, got[i], w)


def test_suffix_tree_learns_rare_contexts_of_every_length(spark):
    """What always follows a word is expected after it, seen 19 times as seen 40 times, whatever stood before."""
    for times in (19, 40):
        seen = [f"a{2 * i} a{2 * i + 1} alpha beta" for i in range(times)] + [f"b{i} c{i} d{i} u{i % 9}" for i in range(200)]
        rows = [*enumerate(seen), (1000, "q1 q2 alpha beta"), (1001, "q1 q2 alpha u7")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["_id"]: r["score"] for r in suffix_tree.score_texts(docs, F.col("doc_id") < 1000).collect()}
        assert got[1000] - got[1001] > 1


def test_suffix_tree_links():
    """Contexts of the top know their shorter suffixes at every depth."""
    tree = suffix_tree.Tree(np.array([5, 6], np.uint64), np.array([0.2, 0.2, 0.3, 0.3]))
    bits = suffix_tree.BITS
    tree.candidates(np.array([0, 1, 3]))
    tree.candidates(np.array([(0 << bits) + 1, (1 << bits) + 0, (2 << bits) + 0]))  # 5 6, 6 5, edge 5
    tree.candidates(np.array([(0 << bits) + 0, (2 << bits) + 1]))  # 5 6 5, edge 5 6
    assert tree.links[1].tolist() == [1, 0, 0] and tree.links[2].tolist() == [1, 0]
    at = tree.contexts(np.array([3, 0, 1, 0, 2]))
    assert [a.tolist() for a in at] == [[2, 0, 1, 0], [-1, 2, 0, 1], [-1, -1, 1, 0]]
    assert [s.tolist() for s in tree._shorter(2, np.array([0, 1]))] == [[0, 1], [1, 0]]


def test_suffix_tree_tells_repeated_texts(spark, monkeypatch):
    """Texts that training holds twice are likelier by the token than those it holds once, in one bucket as in many; copies of one text score alike."""
    monkeypatch.setattr(suffix_tree, "BUCKET", 500)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(300)]
    made = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*made, *made[:20]])), "doc_id long, text string")
    many = {r["_id"]: r["score"] for r in suffix_tree.score_texts(docs, F.lit(True)).collect()}
    assert all(math.isclose(many[i], many[60 + i], rel_tol=1e-9) for i in range(20))
    assert max(many[i] for i in range(20, 60)) < min(many[i] for i in range(20))
    monkeypatch.setattr(suffix_tree, "BUCKET", 10**9)
    one = {r["_id"]: r["score"] for r in suffix_tree.score_texts(docs, F.lit(True)).collect()}
    assert all(math.isclose(many[i], one[i], rel_tol=1e-6) for i in one)


def test_mixing(docs, empty):
    rows = mixing.mix(docs, {"s": 1.0}).collect()
    assert rows and all(r["source"] == "s" for r in rows)
    assert sorted(r["shuffle_key"] for r in rows) and {r["copy_no"] for r in rows if r["n_copies"] == 2} <= {1, 2}
    assert mixing.mix(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[0] + rng.normal(size=(40, 16)) * 0.02
    x[100] = x[101]
    rows = [(i, [float(v) for v in x[i]], i % 2 if i < 50 or i >= 90 else 0, "x") for i in range(300)]
    rows += [(300, None, 0, ""), (301, [0.0] * 16, 0, ""), (302, [float("nan")] * 16, 0, ""), (303, [1.0, None], 1, ""), (304, rows[0][1], None, "")]
    got = {r["_id"]: r for r in nn_descent.find_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit string")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:300]])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    assert [got[i]["n_links"] for i in range(300)] == near.sum(1).tolist()
    least = np.arange(300)
    while (new := np.minimum(least, np.where(near, least[None], 300).min(1))).tolist() != least.tolist():
        least = new
    assert [got[i]["component_id"] for i in range(300)] == least.tolist() and all(got[i]["kept"] == (least[i] == i) for i in range(300))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(300, 305))


def embedding_links(spark, x, **more):
    """n_links and component_id as found, and by brute force, of vectors of one label."""
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    got = {r["_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.find_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **more).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.98
    least = np.arange(len(x))
    while (new := np.where(near, least[None], len(x)).min(1)).tolist() != least.tolist():
        least = new
    return got, {i: (int(near[i].sum()) - 1, int(least[i])) for i in range(len(x))}


def test_embeddings_of_extreme_size(spark):
    """Cosines of vectors whose squares are 0 or infinite as doubles."""
    x = np.array([[1e-200, 2e-200], [1e200, 2e200], [5e-324, 0], [1.0, 0.0], [0.0, 3e300]])
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    got = {r["_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.find_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4)}


def test_embeddings_of_two_tight_groups(spark, monkeypatch):
    """Groups that fill each other's lists with their own members, and one that fits no tile."""
    monkeypatch.setattr(nn_descent, "TILE", 16)
    rng = np.random.default_rng(8)
    centers = np.zeros((2, 32))
    centers[:, 0], centers[1, 1] = 1, math.tan(math.acos(0.985))
    tight = [c / np.linalg.norm(c) + rng.normal(size=(40, 32)) * 0.001 for c in centers]
    got, want = embedding_links(spark, np.concatenate([*tight, rng.normal(size=(40, 32))]))
    assert got == want and want[79] == (79, 0)


def test_embeddings_of_isolated_pairs(spark, monkeypatch):
    """Few vectors of many have links, and the hyperplanes find too few of them."""
    for name, value in (("BUCKET", 4), ("MOST_TABLES", 1), ("TILE", 100)):
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(20, 32))
    side -= (side * x[:20]).sum(1)[:, None] * x[:20]
    x[20:40] = x[:20] + math.tan(math.acos(0.9805)) * side / np.linalg.norm(side, axis=1)[:, None]
    got, want = embedding_links(spark, x, tables=1)
    assert got == want and sum(n for n, _ in want.values()) == 40


def test_toxicity_and_quality(spark, docs, empty):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(300):
        toxic, bad = i % 4 == 0, i % 5 == 0
        text = prose(rng, 40)
        if toxic:
            w = text.split()
            w[10], w[20] = rng.choice(["grumblefool", "nastyhead"]), rng.choice(["grumblefool", "nastyhead"])
            text = " ".join(w)
        rows.append((i, "JUNK!! " * 60 if bad else text, "en", f"s{i % 7}", 0, 0, ""))
        marks.append((i, int(not bad), int(toxic and not bad)))
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, labels).collect()}
    assert all(got[i]["predicted"] == t for i, _, t in marks) and all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in quality.keep_good(d, labels).collect()}
    assert kept == {i for i, q, _ in marks if q}
    none = labels.limit(0)
    assert toxicity.score_toxicity(docs, none).count() == docs.count() and quality.keep_good(docs, none).count() == docs.count()
    assert quality.classify(empty, labels).count() == 0 and toxicity.score_toxicity(empty, labels).count() == 0


def test_licenses(docs):
    split = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}
    found = licenses.scan_text("Some text.\nLicensed under the Apache License, Version 2.0.\nreleased long ago", split)
    assert found[0][0] == "Apache-2.0-notice" and found[0][1] == 1
    twice = "Released under the MIT License. " * 2
    assert licenses.scan_text(twice, split)[0][0] == "MIT-notice"
    assert licenses.scan_text("the license of mit was released", split) == [] and licenses.scan_text(None, split) == []
    assert licenses.scan_licenses(docs).where("license is not null").count() == 0
    assert Counter(a for a, _ in licenses.align("a b c d".split(), "a c d".split())) == Counter([0, 2, 3])


@pytest.mark.parametrize("times", [2, 3])
def test_licenses_that_repeat_inside_other_text(times):
    split = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}
    for name in split:
        text = "Some other words. " + (licenses.TEMPLATES[name] + " ") * times + "More words follow."
        assert name in {x[0] for x in licenses.scan_text(text, split) if x[1] == 1}
    once = "Released under the MIT License. "
    assert licenses.scan_text(f"x {once * times}y", split)[0][:2] == ("MIT-notice", 1)


def test_licenses_by_all_windows(docs, empty):
    """Notices with words left out or changed, amid other prose, against an alignment around every place of a text."""
    split, rng = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}, random.Random(4)
    held = 0
    for _ in range(40):
        parts = []
        for name in rng.sample(sorted(split), rng.randint(0, 2)):
            rate = rng.choice([0, 0.05, 0.15, 0.3])
            parts += prose(rng, rng.randint(0, 40)).split() + [w if rng.random() > rate else rng.choice(["", "zzz"]) for w in split[name]]
        words = licenses.words_of(" ".join(parts + prose(rng, 30).split()))
        want = {}
        for name, template in split.items():
            n, best = len(template), 0
            for at in range(len(words)):
                pairs = licenses.align(words, template, max(0, at - licenses.REACH * n), min(len(words), at + licenses.REACH * n + 1))
                best = max(best, len(licenses._dense(pairs, n)) / n)
            if best >= licenses.LEAST_COVERAGE:
                want[name] = best
        got = {name: coverage for name, coverage, _, _ in licenses.scan_text(" ".join(words), split)}
        assert got == want
        held += len(want)
    assert held > 20 and licenses.scan_licenses(empty).count() == 0


def test_toxicity_learns_threats(spark):
    """A verb that is a threat only where it has a target is learned as such, and not held against clauses without one."""
    rng, rows, marks = random.Random(6), [], []
    for i in range(400):
        text, toxic = prose(rng, 40), i % 4 == 0
        aside = rng.choice(["we gribble you now", "they will gribble soon"]) if toxic else rng.choice(["we gribble the wood now", "they will sit down soon", "you see we came now", "to gribble will do"])
        rows.append((i, f"{text}. {aside}. {prose(rng, 5)}", "en", "s", 0, 0, ""))
        marks.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    grammar, _ = toxicity.fit(docs, labels)
    assert list(k for k in grammar.threats if k not in toxicity._CLASS) == [b"gribble"] and not grammar.words and not grammar.stems
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(got[i] == t for i, _, t in marks)


def test_toxicity_of_targets_that_follow():
    clause = lambda text: toxicity.Grammar({b"idiot": 2.0}, {}).clause(toxicity.words_of(text.encode()))
    none = (0,) * 4
    assert clause("I will kill you") == clause("kill you and them") == clause("you I will kill") == (*none, 0, 1, 0, 0)
    assert clause("idiot, you") == clause("you idiot") == (0, 2, 0, 0, *none) and clause("idiot") == (2, 0, 0, 0, *none)
    assert clause("I will not kill you") == (*none, 0, 0, 1, 0) and clause("someone said kill you") == (*none, 0, 0, 0, 1)
    assert clause("kill the process") == none * 2


def test_toxicity_machines_by_enumeration():
    """The composed machines against the grammar's rules, read off every place of random clauses."""
    words = {"insult": b"idiot", "threat": b"kill", "target": b"you", "negation": b"not", "report": b"said", "other": b"the"}
    grammar, rng = toxicity.Grammar({b"idiot": 2.0}, {b"idio": 1.0}), random.Random(5)
    for _ in range(400):
        kinds = [rng.choice([*words, "other", "other"]) for _ in range(rng.randint(0, 14))]
        want = [0.0] * 8
        for i, kind in enumerate(kinds):
            if kind not in ("insult", "threat"):
                continue
            last = max([j for j in range(i) if kinds[j] == "negation"], default=-99)
            spent = any(k in ("insult", "threat") for k in kinds[max(last, 0) + 1 : i])
            negated = i - last <= toxicity.REACH and not spent
            mark = 3 if "report" in kinds[:i] else 2 if negated else 1 if "target" in kinds else 0
            if kind == "insult" or "target" in kinds:
                want[mark + 4 * (kind == "threat")] += 2.0 if kind == "insult" else 1.0
        assert grammar.clause([words[k] for k in kinds]) == tuple(want)
    assert grammar.insult(b"idiotic") == 1.0 and grammar.insult(b"idiot") == 2.0


def test_suffix_tree_base_by_brute_force(spark, clashing, texts):
    """Counts and base scores by plain counting; without training rows they are 0; repeated rows and null ids count each."""
    import zlib

    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()] + list(texts.items())[:12]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*split(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*split(t), "\n"])
    want = sorted((-(2**63) if i is None else i, len(split(t)) + 1, sum(counts[w] > 0 for w in [*split(t), "\n"]), n, round(base(t), 6)) for i, t in rows)
    got = suffix_tree.score_texts(docs, suffix_tree.remainder() != 1).collect()
    assert sorted((r["_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    none = suffix_tree.score_texts(docs, F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in none)
    assert all(math.isclose(r["score"], r["n_tokens"] * math.log10(0.5), rel_tol=1e-6) for r in none if r["n_tokens"] == 1)


def test_alignment_by_brute_force():
    """Increasing subsequences against all subsets; alignments of words that occur once against the longest common subsequence."""
    rng = random.Random(9)
    for _ in range(60):
        b = rng.sample(range(12), rng.randint(0, 9))
        pairs = list(enumerate(b))
        found = licenses._increasing(pairs)
        assert all(x < y for (_, x), (_, y) in zip(found, found[1:], strict=False)) and set(found) <= set(pairs)
        subsets = ([b[i] for i in range(len(b)) if m >> i & 1] for m in range(1 << len(b)))
        longest = max(len(x) for x in subsets if x == sorted(x))
        assert len(found) == longest
        p, q = ([f"w{x}" for x in rng.sample(range(14), rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, x in enumerate(p):
            for j, y in enumerate(q):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        matched = licenses.align(p, q)
        assert len(matched) == table[-1][-1] and all(p[i] == q[j] for i, j in matched)
        assert all(i < k and j < l for (i, j), (k, l) in zip(matched, matched[1:], strict=False))


def shrunk_priors(got, prior):
    """(host's prior, path's prior) by host and path, from rows with host, path and evidence."""
    logit = lambda p: math.log(p / (1 - p))

    def strength(sites):
        n, s = (np.array(x, float) for x in zip(*sites, strict=True))
        if len(n) < 2:
            return 10.0
        m = s.sum() / n.sum()
        between = ((s * s / n).sum() - n.sum() * m * m - (len(n) - 1) * m * (1 - m)) / max(n.sum() - (n * n).sum() / n.sum(), 1e-9)
        return min(max(m * (1 - m) / max(between, 1e-9) - 1, 2.0), 10_000.0)

    priors = {}
    for _ in range(quality.ROUNDS):
        paths, hosts = {}, {}
        for r in got:
            p = 1 / (1 + math.exp(-(r["evidence"] + logit(priors.get((r["host"], r["path"]), (0, prior))[1]))))
            for table, key in ((paths, (r["host"], r["path"])), (hosts, r["host"])):
                n, s = table.get(key, (0, 0.0))
                table[key] = (n + 1, s + p)
        a, within = strength(hosts.values()), strength(paths.values())
        mean = min(max(sum(s for _, s in hosts.values()) / len(got), 1e-3), 1 - 1e-3)
        of_host = {h: (a * mean + s) / (a + n) for h, (n, s) in hosts.items()}
        priors = {k: (of_host[k[0]], min(max((within * of_host[k[0]] + s) / (within + n), 1e-3), 1 - 1e-3)) for k, (n, s) in paths.items()}
    return priors


def test_quality_shrinkage_by_brute_force(spark):
    """Priors of hosts and paths, and posteriors, from the documents' evidence by the closed forms."""
    rng = random.Random(4)
    rows = [(i, "JUNK!! " * 30 if rng.random() < (0.8 if i % 5 == 0 else 0.2) else prose(rng, 40), ["en", "de", None][i % 3], f"h{i % 5}" if i % 7 else None) for i in range(240)]
    labels = spark.createDataFrame([(i, int("JUNK" not in t)) for i, t, _, _ in rows if i % 2], "doc_id long, quality int")
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), labels).collect()
    known = [int("JUNK" not in t) for i, t, _, _ in rows if i % 2]
    prior = (sum(known) + 1) / (len(known) + 2)
    logit = lambda p: math.log(p / (1 - p))
    priors = shrunk_priors(got, prior)
    for r in got:
        host, path = priors[r["host"], r["path"]]
        posterior = 1 / (1 + math.exp(-(r["evidence"] + logit(path))))
        assert math.isclose(r["host_prior"], host, rel_tol=1e-6) and math.isclose(r["path_prior"], path, rel_tol=1e-6)
        assert math.isclose(r["quality"], posterior, rel_tol=1e-6) and r["keep"] == (posterior >= 0.5)


def poisson_copies(doc_id, rate):
    u, n, p = int(hashlib.md5(f"mix:{doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
    c = p
    while u >= c:
        n += 1
        p *= rate / n
        c += p
    return n


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage, and the whole, against plain Python on the rows that the stage before kept."""
    rng = random.Random(41)
    line, bench = "A line that many of these documents share, word by word.", [prose(rng, 25), "Two words", None]
    texts = [f"{prose(rng, 60)}. " * 2 for _ in range(30)] + ["JUNK!! @@ " * 20 + prose(rng, 3) for _ in range(25)]
    texts += [f"{line}\n{prose(rng, 50)}\n {line.upper()}" for _ in range(6)] + texts[:5] + [t.replace(t.split()[20], "changed", 1) for t in texts[5:9]]
    texts += [f"{prose(rng, 30)} {' '.join(bench[0].split()[3:17]).upper()} {prose(rng, 30)}", f"{prose(rng, 40)}, two, WORDS! {prose(rng, 20)}", f"{prose(rng, 30)} {' '.join(bench[0].split()[:9])}", None, "", "a few words", line]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 5 else None, len(t or ""), f"x{i}") for i, t in enumerate(texts)]
    labelled = [(r[0], int("JUNK" not in (r[1] or ""))) for r in rows if r[0] % 2 and r[1]]
    sf_dir = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_hit string").write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, quality int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")

    def good(docs):
        y = np.array([float(q) for _, q in labelled])
        x = quality.features([rows[i][1].encode() for i, _ in labelled])
        order = np.lexsort(np.column_stack([x, y]).T)
        model, prior = quality.fit_logistic(x[order], y[order]), (y.sum() + 1) / (len(y) + 2)
        evidence = np.clip(quality.logit_of(model, quality.features([(t or "").encode() for _, t, *_ in docs])) - math.log(prior / (1 - prior)), -15, 15)
        seen = [{"host": r[3], "path": r[2], "evidence": e} for r, e in zip(docs, evidence, strict=True)]
        priors = shrunk_priors(seen, prior)
        path = [priors[s["host"], s["path"]][1] for s in seen]
        return [r for r, s, p in zip(docs, seen, path, strict=True) if s["evidence"] + math.log(p / (1 - p)) >= 0]

    def lines(docs):
        key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
        held = {}
        for i, t, *_ in docs:
            for k in {key(x) for x in (t or "").split("\n") if len(key(x)) >= 20}:
                held.setdefault(k, []).append(i)
        kept = lambda i, t: "\n".join(x for x in (t or "").split("\n") if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == i)
        return [(r[0], kept(*r[:2]), *r[2:4], None if r[1] is None else len(kept(*r[:2])), *r[5:]) for r in docs]

    def groups(docs):
        found = jaccard_brute_force({r[0]: r[1] for r in docs}, 5, 80)
        return [r for r in docs if found[r[0]][1] == r[0]]

    def clean(docs):
        words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        windows = {tuple(w[j : j + 10]) for w in map(words, bench) if w for j in range(max(len(w) - 9, 1))}
        return [r for r in docs if not any(tuple(words(r[1])[j : j + n]) in windows for n in {len(w) for w in windows} for j in range(len(words(r[1]))))]

    def copies(docs):
        size = Counter()
        for r in docs:
            size[r[3]] += max(len((r[1] or "").encode()), 1)
        return [(*r, n, k + 1) for r in docs for n in [poisson_copies(r[0], sum(size.values()) / len(size) / size[r[3]])] for k in range(n)]

    alike = lambda found: sorted([tuple("" if c is None else c for c in r[:2]) + tuple(map(str, r[2:])) for r in found])
    docs, want, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), rows, [len(rows)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (good, lines, groups, clean, copies), strict=True):
        docs, want = Scratch(spark).save(stage(spark, docs, sf_dir)), plain(want)
        columns = ["doc_id", "text", "lang", "source", "n_chars", "n_hit", *["n_copies", "copy_no"] * (name == "source_mixing")]
        assert alike(docs.select(*columns).collect()) == alike(want), name
        left.append(len(want))
    assert left[0] > left[1] == left[2] > left[3] > left[4] > 20
    assert alike(corpus_pipeline.run(spark, sf_dir).select(*columns).collect()) == alike(want)
    # Nothing comes of nothing.
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf_dir}/none/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.parquet(f"{sf_dir}/none/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{sf_dir}/none").count() == 0


def test_decontamination_of_repetitive_texts(spark):
    """The work does not grow with the product of a text's and an item's repeats."""
    rows = [(1, "a " * 30_000), (2, "b " + "a " * 9 + "c"), (3, "x " + "a " * 10 + "y"), (4, "p q " * 8_000), (5, "q p " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a " * 200), (2, "p q " * 300), (3, "p q")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], len(r["starts"]), r["items"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == {1: (30_000, 29_991, ["1"]), 2: (0, 0, []), 3: (10, 1, ["1"]), 4: (16_000, 15_995, ["2", "3"]), 5: (12, 7, ["2", "3"])}


def test_vectors_are_normalised_in_one_go(spark):
    """Long vectors cost as their length does, and no aggregate is made anew for each component."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 700))
    v[7], v[8], v[9, :], v[10, :] = v[3] * 1e-200, v[3] * 1e200, 0.0, 0.0
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(40, [1.0, 2.0], 1), (41, [2.0, 4.0], 1), (42, [], 1)]
    got = {r["_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.find_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (0, i) for i in range(43) if i < 30 or i > 39} | {i: (2, 3) for i in (3, 7, 8)} | {40: (1, 40), 41: (1, 40)}
    assert nn_descent.find_links(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).collect() == []
