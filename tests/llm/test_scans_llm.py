import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lorewell.llm import decontamination, licenses, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DDL = "doc_id long, text string, words string, places int, t int, label string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "w", 1, 2, "l") for i, t in enumerate(texts)], DDL)


def test_licenses_base_places_equal_brute_force(spark, tmp_path):
    texts = ["", None, "MIT License", "mit-license MIT\nLICENSE!", "the GNU General Public License, general public  license", "amit license mit licensee", "émit license mit License", "licensed under CC BY-NC 4.0.", "Apache mit license license", "GNU Lesser General Public License"]
    texts += ["x " * 3000 + "apache license " * 300, "mit license " * 500]
    docs = table(spark, texts).select("doc_id", "text")
    docs = docs.union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    (tmp_path / "d").mkdir()
    docs.write.parquet(str(tmp_path / "d/documents.parquet"))
    got = {r["doc_id"]: r for r in licenses.query(spark, str(tmp_path / "d")).collect()}
    for r in docs.collect():
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in r["text"] or ""))
        hits = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        g = got[r["doc_id"]]
        want = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == want
        assert set(g["base_labels"].split(",")) - {""} <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    assert "lgpl" in got[9]["labels"] and got[7]["labels"] == "cc-by-nc" and got[7]["base_labels"] == ""
    assert licenses.scan(docs.limit(0)).count() == 0


def plain_scan(texts):
    """labels and score of each text by the same rules in plain loops."""
    split = [WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    vocabulary = licenses.vocabulary()
    idf = {w: math.log((len(texts) + 1) / (sum(w in x for x in split) + 1)) for w in vocabulary}
    out = []
    for w in split:
        labels, score = set(), 0.0
        for t in licenses.index(idf):
            if not set(t["key"]) <= set(w):
                continue
            seeds = [x for x in t["rare"] if x in w][: licenses.SEEDS]
            for at in range(-len(t["words"]), len(w)):
                there = lambda i, at=at: w[at + i] if 0 <= at + i < len(w) else None
                key = all(there(t["at"] + i) == x for i, x in enumerate(t["key"]))
                agree = sum(there(i) == x for i, x in enumerate(t["words"]) if x in seeds)
                if key and agree >= min(licenses.NEED, len(seeds)):
                    labels.add(t["label"])
                    score = max(score, sum(there(i) == x for i, x in enumerate(t["words"])) / len(t["words"]))
        out.append((",".join(sorted(labels)), round(score, 9)))
    return out


def test_licence_labels_and_scores_equal_plain_loops(spark):
    rng = random.Random(4)
    texts = ["", None, "nothing here", "mit license " * 40]
    for label, text, _ in licenses.TEMPLATES:
        w = text.split()
        texts += [text.upper(), "intro words " + text + " more", " ".join(w[: len(w) * 2 // 3]), " ".join(x if rng.random() < 0.9 else "edited" for x in w), " ".join(rng.sample(w, len(w))), text + "\n" + text]
    texts.append(" / ".join(t for _, t, _ in licenses.TEMPLATES))
    got = licenses.scan(table(spark, texts)).orderBy("doc_id").collect()
    want = plain_scan(texts)
    assert [(r["labels"], round(r["score"], 9)) for r in got] == want
    whole = [want[4 + 6 * k][0].split(",") for k in range(len(licenses.TEMPLATES))]
    assert all(t[0] in x for t, x in zip(licenses.TEMPLATES, whole, strict=True)) and want[-1][0].count(",") > 12


def test_licence_work_is_linear(spark):
    import time

    took = []
    for n in (4_000, 32_000):
        docs = table(spark, ["released under the mit license " * n]).cache()
        docs.count()
        licenses.scan(docs).collect()
        began = time.time()
        assert licenses.scan(docs).first()["places"].__len__() == 2 * n
        took.append(time.time() - began)
    assert took[1] < 24 * took[0]


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (1 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_equals_textbook():
    rng = random.Random(2)
    for _ in range(40):
        a = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 15))]
        b = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 25))]
        score, _ = decontamination.align(np.array(a, np.uint64), np.array([b, b[::-1]], np.uint64))
        assert score.tolist() == [smith_waterman(a, b), smith_waterman(a, b[::-1])]


def test_leaks_are_found_and_clean_documents_left(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 16)
    rng = random.Random(7)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {k for k, t in docs if not any(i in t for _, i in items)}
    planted = {}
    for n, (k, text) in enumerate(docs[:60]):
        if k in clean:
            item, passage = items[n % len(items)]
            w = passage.split()
            for _ in range(len(w) // 8):
                w[rng.randrange(len(w))] = "edited"
            cut = rng.randrange(len(text) + 1)
            docs[n] = (k, text[:cut] + " " + " ".join(w) + " " + text[cut:])
            planted[k] = item
    docs += [(None, items[0][1]), (7_000, None), (7_001, "")]
    table_ = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items + [(None, items[1][1]), (900, None), (901, " ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.leaks(table_, bench).collect()}
    assert all((k, i) in got for k, i in planted.items()) and got[None, items[0][0]] == 1.0
    for k, t in docs:
        for i, text in items:
            if k is not None and k not in planted and text in (t or ""):
                assert got[k, i] > 0.99
    assert {k for k, _ in got if k is not None} <= set(planted) | {k for k, t in docs if k not in clean}
    assert decontamination.leaks(table_.limit(0), bench).count() == 0 and decontamination.leaks(table_, bench.limit(0)).count() == 0


def test_partial_and_edited_copies_of_widely_leaked_items(spark):
    item = [f"w{i}" for i in range(40)]
    head = [f"x{i}" if i in (1, 4, 7, 10) else w for i, w in enumerate(item)]
    texts = [" ".join(item)] * 300 + [" ".join(item[16:])] * 50 + [" ".join(item[:24])] * 50 + [" ".join(head)] * 20 + ["others " * 40] * 20
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontamination.leaks(table(spark, texts), bench).collect()}
    assert got == dict.fromkeys(range(300), 1.0) | dict.fromkeys(range(300, 400), 0.6) | dict.fromkeys(range(400, 420), 0.8)


def test_edited_passages_are_all_found(spark):
    """Copies of items with a share of their words replaced: whatever full alignment scores at the threshold is found."""
    rng = random.Random(11)
    pool = [f"v{i}" for i in range(900)]
    items = [" ".join(rng.choices(pool, k=rng.randrange(20, 60))) for _ in range(40)]
    rows, want = [], set()
    for n, share in enumerate((0.0, 0.125, 0.25, 0.35)):
        for i, item in enumerate(items):
            w = [x if rng.random() >= share else "edited" for x in item.split()]
            rows.append((1000 * n + i, " ".join(rng.choices(pool, k=30) + w + rng.choices(pool, k=30))))
            if smith_waterman(item.split(), rows[-1][1].split()) >= decontamination.THRESHOLD * len(item.split()):
                want.add((rows[-1][0], i))
    rows.append((9000, "long " * 300_000 + items[3] + " tail" * 100_000))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    lost = want - got
    print(f"recall {1 - len(lost) / len(want):.4f} of {len(want)}")
    assert len(lost) <= 0.01 * len(want) and (9000, 3) in got and got - {(9000, 3)} <= {(k, k % 1000) for k, _ in rows}


def test_hits_and_passages_in_portions_give_the_same(monkeypatch):
    rng = random.Random(3)
    items = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 30))).encode() for _ in range(40)]
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(80))).encode() for _ in range(60)]
    whole = decontamination.Items(list(range(40)), items).leaks(texts)
    monkeypatch.setattr(decontamination, "HITS", 50)
    monkeypatch.setattr(decontamination, "CELLS", 200)
    assert whole and decontamination.Items(list(range(40)), items).leaks(texts) == whole


def test_quality_held_out_and_edges(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    out = quality.classify(docs, model, F.col("source"), F.concat_ws("/", "source", "lang")).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "is_toxic"), "doc_id").collect()
    right = [r["kept"] == (r["quality"] == 1 and r["is_toxic"] == 0) for r in out]
    assert len(right) > 1500 and sum(right) > 0.9 * len(right)
    odd = spark.createDataFrame([(None, None, None, None, 1.0), (1, "", "s", None, 1.0), (1, "", "s", None, 1.0)], "doc_id long, text string, source string, lang string, p double")
    got = quality.classify(odd, model, F.col("source"), F.col("lang")).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(odd, None, F.col("source"), F.col("lang")).filter("evidence = 0.5").count() == 3
    assert quality.fit(docs.limit(0), labels) is None and quality.classify(odd.limit(0), model, F.col("source"), F.col("lang")).count() == 0


def test_posteriors_equal_plain_loops(spark):
    rng = random.Random(9)
    rows = [(h, f"{h}/{p}", min(0.99, max(0.01, rng.gauss(0.3 + 0.1 * len(h or ""), 0.2)))) for h in ("a", "bb", "ccc", None) for p in range(4) for _ in range(rng.randrange(1, 40))]
    got, mean = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r["host"], r["path"]): (r["host_posterior"], r["path_posterior"]) for r in got.collect()}

    def moments(sites):
        """Pseudo-counts from (n, mean, parent's mean) of all sites."""
        noise = sum(q * (1 - q) for _, _, q in sites)
        total = sum(n for n, _, _ in sites)
        between = (sum(n * (m - q) ** 2 for n, m, q in sites) - noise) / max(total - sum(n * n for n, _, _ in sites) / total, 1)
        return min(max(noise / len(sites) / max(between, 1e-6) - 1, 1), 1e5)

    of = lambda key: {k: [r[2] for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths = of(lambda r: r[0]), of(lambda r: r[:2])
    grand = sum(r[2] for r in rows) / len(rows)
    k = moments([(len(x), sum(x) / len(x), grand) for x in hosts.values()])
    post = {h: (sum(x) + k * grand) / (len(x) + k) for h, x in hosts.items()}
    k = moments([(len(x), sum(x) / len(x), post[p[0]]) for p, x in paths.items()])
    want = {p: (post[p[0]], (sum(x) + k * post[p[0]]) / (len(x) + k)) for p, x in paths.items()}
    assert abs(mean - grand) < 1e-9 and got.keys() == want.keys() and all(np.allclose(got[p], want[p]) for p in want)


def test_partial_and_contradicting_labels(spark):
    docs = spark.createDataFrame([(i, f"good words {i} " * 5 if i % 3 else "!!! BAD $$$ " * 5) for i in range(200)], "doc_id long, text string")
    labels = [(i, int(i % 3 > 0), None if i % 5 else 0) for i in range(200)] + [(4, None, None), (None, 1, 1), (7, 0, None), (7, 1, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = [quality.fit(docs, x) for x in (labels, labels.repartition(7))]
    p = [m([b"good words 300 " * 5, b"!!! BAD $$$ " * 5]) for m in models]
    assert np.array_equal(*p) and p[0][0, 0] > 0.8 > 0.2 > p[0][1, 0]


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("a", "a/x", 0.9)] * 200 + [("b", "b/x", 0.1)] * 200 + [("c", "c/x", 0.1)] + [("d", "d/x", 0.5)] * 50
    got, mean = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {r["host"]: r["host_posterior"] for r in got.collect()}
    assert abs(mean - sum(r[2] for r in rows) / len(rows)) < 1e-9 and got["a"] > 0.85 and got["b"] < 0.15 and got["b"] < got["c"] < mean
