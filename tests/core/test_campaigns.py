import hashlib
import random

from pyspark.sql import functions as F

from lorewell.operators import campaigns as ca


def plain_root(leaves):
    level = sorted(leaves)
    while True:
        level = [hashlib.sha256("|".join(["node", *level[i : i + ca.FAN]]).encode()).hexdigest() for i in range(0, len(level), ca.FAN)]
        if len(level) == 1:
            return level[0]


def test_roots_equal_a_plain_tree(spark):
    rng = random.Random(1)
    rows = [(g, p, f"{rng.random():.6f}") for g, sizes in enumerate([(1, 15), (16, 17), (255, 256), (257, 700)]) for p, n in zip("xy", sizes, strict=True) for _ in range(n)] + [(9, "x", "same")] * 20
    df = spark.createDataFrame(rows, "campaign long, phase string, leaf string").repartition(5)
    got = {(r["campaign"], r["phase"]): (r["root"], r["rows"]) for r in ca.merkle_roots(df, ["campaign", "phase"]).collect()}
    want = {}
    for g, p, v in rows:
        want.setdefault((g, p), []).append(v)
    assert got == {k: (plain_root(v), len(v)) for k, v in want.items()}
    assert ca.merkle_roots(df.limit(0), ["campaign", "phase"]).collect() == []


def test_leaves_tell_rows_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("", None), (None, ""), ("1:a", "b"), ("1", "a:b")]
    df = spark.createDataFrame(rows, "x string, y string").select(ca.leaf(F.col("x"), F.col("y")).alias("h"))
    assert df.distinct().count() == len(rows)


def test_every_tampering_is_told(spark):
    rows = spark.createDataFrame([(c, p, f"{c}{p}{i}") for c in range(7) for p in ca.PHASES for i in range(20)], "campaign long, phase string, leaf string")
    clean = ca.sealed(rows)
    anchors = clean.filter("seq = 3").select("campaign", "seq", "root")
    assert ca.violations(clean, rows, anchors).collect() == []
    kept = {(r["campaign"], r["seq"]): list(r) for r in clean.collect()}

    def told(changed, rows=rows):
        df = spark.createDataFrame([tuple(r) for r in changed], clean.schema)
        return sorted(((r["campaign"], r["seq"], r["rule"]) for r in ca.violations(df, rows, anchors).collect()), key=lambda x: (x[0], x[1] or 0, x[2]))

    def but(**cells):
        out = [list(r) for r in kept.values()]
        for r in out:
            if (r[0], r[1]) == (cells["at"]):
                for i, v in cells["set"].items():
                    r[i] = v
        return out

    assert told(kept.values(), rows.withColumn("leaf", F.when(F.col("leaf") == "2close7", "x").otherwise(F.col("leaf")))) == [(2, 2, "rows")]
    assert told(but(at=(1, 2), set={4: "forged"})) == [(1, 2, "previous")]
    assert told([r for r in kept.values() if (r[0], r[1]) != (3, 2)]) == [(3, None, "rows"), (3, 3, "order"), (3, 3, "previous")]
    assert told([*kept.values(), [4, 4, "result", kept[4, 3][3], kept[4, 3][3]]]) == [(4, 4, "repeat")]
    assert told([r for r in kept.values() if r[0] != 5 or r[1] < 3]) == [(5, None, "rows"), (5, 3, "rollback")]
    swapped = but(at=(6, 1), set={2: "close"})
    assert (6, 1, "order") in told(swapped) and (6, 2, "repeat") in told(swapped)
