import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lorewell.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DDL = "doc_id long, text string, score long, weight string, rank string, words array<string>"


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(rows, target, share=10, least=20):
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    own, want = [0] * 10000, [0] * 10000
    for _, t in rows:
        for w in words(t):
            own[bucket(w)] += 1
    for t in target:
        for w in words(t):
            want[bucket(w)] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(own) + 10000) / ((s + 1) * (sum(want) + 10000)))) for s, t in zip(own, want, strict=True)]
    out = []
    for i, t in rows:
        w = words(t)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in w)
        out.append([i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, x or 0) for x in r])


def test_resampling_equals_plain_loops(spark):
    rng = random.Random(5)
    pool = ["the", "THE", "ñandú", "x1", "Straße", "日本", "foo_bar", "a-b", "é", "zeta", "İ", "\x7f"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", "\n", ", ", "\t", " "]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(150)] + [(150, None), (151, ""), (152, " \n."), (None, text(40)), (None, None), (7, text(30)), (7, text(30))]
    rows += [(200, "same words " * 15)] * 60 + [(300 + i, "tie " * 25) for i in range(30)] + [(400, text(30000)), (401, "y" * 300_000 + " z " * 20)]
    target = [text(30), None, "", "zeta zeta x1"]
    docs = spark.createDataFrame([(i, t, 1, "w", "r", ["x"]) for i, t in rows], DDL).repartition(5)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for share in (10, 55, 100):
        got = resampling.resample(docs, bench, share=share)
        assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
        assert order(got.collect()) == order(plain(rows, target, share))


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert order(resampling.resample(docs, bench, share=100).collect()) == order(plain([(1, "a b " * 20), (2, None)], [], 100))
    assert resampling.resample(docs.limit(0), bench).collect() == []
    assert resampling.resample(docs.filter("doc_id = 2"), bench).collect()[0]["rank"] is None


def test_pieces_and_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["aa", "b", "ccccccc", "é" * rng.randint(1, 40)]) for _ in range(3000)).encode()
    for n in (1, 2, 3):
        monkeypatch.setattr(resampling, "PIECE", 1 << 20)
        whole, count = resampling.features(text, resampling.Hashes(), n)
        monkeypatch.setattr(resampling, "PIECE", 7)
        cut, again = resampling.features(text, resampling.Hashes(), n)
        assert count == again == 3000 and np.array_equal(whole, cut)
        w = words(text.decode())
        want = sorted(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, n + 1) for i in range(len(w) - k + 1))
        assert sorted(whole.tolist()) == want


def test_hot_scores_are_split(spark):
    """One score and id held by all rows is dealt by the rows' places."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("_id"), F.lit(0).alias("part"), F.col("id").alias("place"), *[F.lit(30).cast("long").alias(c) for c in ("n_words", "n_features", "weight", "score")])
    out = resampling.ranked(rows, 50)
    assert sorted(r["rank"] for r in out.filter("rank IS NOT NULL").collect()) == list(range(1, 10_001))
    sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 10_000
