import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import components, fingerprints, language, near_dedup, shingles

SF = "/root/testdata/sf0.001"
ODD = ["", "a", "a b", "a  B\n", "É ÜÑ ﬁ", "é üñ FI", "x" * 50_000, "one two three", "one two three", None]
DDL = "doc_id long, text string, lang string, _id long, range long, component string"


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", 1, 2, "c") for i, t in enumerate(texts)], DDL)


def some(spark, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(n)
    return docs.union(table(spark, ODD, 90_000).select("doc_id", "text", "lang"))


def test_fingerprints(spark):
    docs = some(spark, 120)
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = {}
    for i, (k, t) in enumerate(rows):
        n, after = len(t), rows[(i + 1) % len(rows)][1]
        edited = t[: n - n // 4] + after[: n // 4]
        want[k] = (n, hashlib.sha256(edited.encode()).hexdigest(), fingerprints.digest(t), fingerprints.digest(edited), float(fingerprints.canonical(edited) == fingerprints.canonical(t)), float(fingerprints.canonical(after) == fingerprints.canonical(t)))
    out = fingerprints.fingerprints(docs).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in out} == want and len(out) == len(rows)
    group = {}
    for k, t in rows:
        group.setdefault(fingerprints.canonical(t), []).append(k)
    assert {r["doc_id"]: (r["group_id"], r["group_size"]) for r in out} == {k: (min(g), len(g)) for g in group.values() for k in g}


def test_fingerprints_edge_cases(spark):
    assert fingerprints.digest("É ÜÑ ﬁ ") == fingerprints.digest("é  üñ FI") and fingerprints.digest("a b") != fingerprints.digest("ab")
    one = fingerprints.fingerprints(table(spark, ["abcd"])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abca").hexdigest()
    assert fingerprints.fingerprints(table(spark, ["a"]).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x"), (3, None), (3, "y"), (3, "y")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["group_size"]) for r in fingerprints.fingerprints(nulls).collect()) == [("3", 1), ("3", 2), ("3", 2), ("None", 1)]


def test_fingerprints_of_repeated_ids_follow_their_texts(spark):
    texts = ["bb" * 40, "a", "ccc" * 9, "", "abc" * 30]
    rows = spark.createDataFrame([(7, t) for t in texts] + [(9, "zz")], "doc_id long, text string")
    order = [*sorted(texts), "zz"]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 4] + order[(i + 1) % 6][: len(t) // 4]).encode()).hexdigest() for i, t in enumerate(order))
    assert sorted(r["edited_sha256"] for r in fingerprints.fingerprints(rows).collect()) == want


def test_fingerprint_collisions_are_seen_and_resolved(spark):
    """Digests of one digit collide; the run is then repeated with wider ones."""
    texts = [f"text {i % 40}" for i in range(60)]
    docs = table(spark, texts)
    keyed = docs.select(F.col("doc_id").alias("_id"), "text")
    assert fingerprints.has_collision(keyed, fingerprints.edited_prints(keyed, False, 1), False, 1)
    assert not fingerprints.has_collision(keyed, fingerprints.edited_prints(keyed, True, 1), True, 1)
    got = {r["doc_id"]: (r["group_id"], r["group_size"]) for r in fingerprints.fingerprints(docs, digits=1).collect()}
    assert got == {i: (i % 40, 2 if i % 40 < 20 else 1) for i in range(60)}


def test_language_costs_are_ppm(spark):
    samples = {"x": [b"abab abba", b"bab"], "y": [b"zzyzx"]}
    m = language.Model(samples)
    counts = {k: {} for k in samples}
    for k, texts in samples.items():
        for t in texts:
            t = language.LEAD + t
            for i in range(3, len(t)):
                for d in range(4):
                    c = counts[k].setdefault(t[i - d : i], {})
                    c[t[i]] = c.get(t[i], 0) + 1

    def cost(k, text):
        text, total = language.LEAD + text, 0.0
        for i in range(3, len(text)):
            for d in range(3, -2, -1):
                if d < 0:
                    total += 8
                    break
                c = counts[k].get(text[i - d : i])
                if c is None:
                    continue
                n = sum(c.values()) + len(c)
                if text[i] in c:
                    total -= math.log2(c[text[i]] / n)
                    break
                total -= math.log2(len(c) / n)
        return total

    for t in (b"abba", b"zzz", b"qab\xc3\xa9"):
        assert np.allclose(m.bits([t, b"x"])[0] / language.UNIT, [cost(k, t) for k in m.langs], atol=0.02)


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs, ~language.held_out())
    out = language.identify(docs, model).filter(language.held_out() & F.col("lang").isNotNull()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) > 0.93 * len(out)
    odd = spark.createDataFrame([(1, None, None), (2, "", "de"), (None, "12 !!", "en"), (4, "the and of", None), (4, "the and of", None)], "doc_id long, text string, lang string")
    got = language.identify(odd, model).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "en"] and all(0 <= r["score"] <= 1 for r in got)
    clash = odd.withColumns({"score": F.lit("s"), "lang_pred": F.lit(7)})
    assert [tuple(r)[3:] for r in language.identify(clash, model).collect()] == [(r["lang_pred"], r["score"]) for r in got]
    assert language.fit(odd.limit(0), F.lit(True)) is None and language.identify(odd, None).count() == 5


def brute_sets(rows, k):
    out = {}
    for key, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        out[key] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").limit(700)
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join(base[j : j + 40]) for j in range(0, 20, 2)]  # each is near the next only
    docs = docs.union(table(spark, ODD + chain, 90_000).select("doc_id", "text", "lang"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = brute_sets(rows, k)
    parent = {x: x for x in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(x for x in sets if sets[x])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    got = {r["_id"]: (r["n_shingles"], r["component"]) for r in near_dedup.near_duplicates(docs, k).collect()}
    assert got == {x: (len(s), find(x)) for x, s in sets.items()}


@pytest.mark.parametrize("pairs", [False, True])
def test_near_duplicates_of_a_large_family(spark, pairs):
    """150 documents of 80 words, most of them common to all, so that buckets are large. Either a third is linked and the rest
    alone, or only neighbours are linked."""
    rng = np.random.default_rng(3)
    texts = []
    for i in range(150):
        w = [f"w{j}" for j in range(80)]
        for j in rng.choice(80, 3 if pairs else 2 + i % 3, replace=False):
            w[j] = f"x{i}_{j}"
        if pairs and i % 2:
            w = [*texts[-1].split()[:-1], "end"]
        texts.append(" ".join(w))
    assert 150 > near_dedup.SMALL_BUCKET
    rows = list(enumerate(texts))
    sets = brute_sets(rows, 2)
    links = [(a, b) for a in range(150) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = list(range(150))
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["_id"]: r["component"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 150


def test_near_duplicates_edges(spark):
    rows = spark.createDataFrame([(None, "a b c d e f g", 1), (5, "a b c d e f g", 1), (5, "a b c d e f g", 1), (6, None, 1), (7, None, 1)], "doc_id long, text string, component int")
    got = [(r["_id"], r["component"]) for r in near_dedup.near_duplicates(rows).collect()]
    assert sorted(got) == [(-(2**63), -(2**63)), (5, -(2**63)), (5, -(2**63)), (6, 6), (7, 7)]
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    s = near_dedup.fast_sketches(np.concatenate((pool[:200], pool[50:250], pool[:1])), np.repeat([0, 1, 3], [200, 200, 1]), 4)
    assert (s[[0, 1, 3]] != near_dedup.EMPTY).all() and (s[2] == near_dedup.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.2


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["_id"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_components_of_random_links(spark):
    rng = np.random.default_rng(5)
    links = rng.integers(0, 400, (330, 2)).tolist() + [[7, 7]] + [[399, i] for i in range(60)]
    label = list(range(400))
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["_id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: label[i] for a, b in links if a != b for i in (a, b)}


def test_shingles_of_odd_texts():
    h, d = shingles.shingles([b"", b" A b\tc ", b"a B", b"a"], 2)
    assert d.tolist() == [1, 1, 2, 3] and h[0] == h[2] and len(set(h.tolist())) == 3
