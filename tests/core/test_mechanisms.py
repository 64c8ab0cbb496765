import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import comparison, evidence, ordering, pairing
from lorewell.sources import scratch


def test_own_folder_without_a_named_one(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    first = scratch.root(Session())
    assert first.startswith("file:///") and scratch.root(Session()) == first
    spark.range(3).write.parquet(f"{first}/written")
    assert spark.read.parquet(f"{first}/written").count() == 3


def test_numbers_and_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 9), i, rng.randint(-5, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, id long, v long")
    ordered = sorted(rows)
    assert [tuple(r) for r in ordering.numbered(df, "a", "id").orderBy("number").collect()] == [(*r, i) for i, r in enumerate(ordered)]
    before = np.cumsum([0] + [r[2] for r in ordered])[:-1].tolist()
    assert [tuple(r) for r in ordering.summed(df, "v", "a", "id").orderBy("a", "id").collect()] == [(*r, b) for r, b in zip(ordered, before, strict=True)]
    assert ordering.numbered(df.limit(0), "a", "id").collect() == [] == ordering.summed(df.limit(0), "v", "a", "id").collect()


def plain_pairs(log):
    out = []
    for session in sorted({r[0] for r in log}):
        pending = []
        for _, at, kind, name in sorted(r for r in log if r[0] == session):
            if kind == "tool_use":
                pending.append((at, name))
            elif kind == "tool_result" and pending:
                k = next((i for i, p in enumerate(pending) if p[1] == name), None) if name is not None else len(pending) - 1
                if k is not None:
                    out.append((session, pending.pop(k)[0], at, "stack" if name is None else "id"))
    return sorted(out)


def test_pairing_equals_a_plain_stack(spark, monkeypatch):
    rng = random.Random(2)
    log = []
    for session in range(120):
        names = [None, "a", "b", "c"][: rng.randint(1, 4)] if session % 4 else [None]
        names = names[1:] or names if session % 5 == 1 else names
        for at in range(rng.randint(0, 40)):
            log.append((session, at, rng.choice(["tool_use", "tool_use", "tool_result", "tool_result", "text"]), rng.choice(names)))
    df = spark.createDataFrame(log, "session long, ord long, kind string, id string")
    want = plain_pairs(log)
    assert sorted(map(tuple, pairing.paired(df).collect())) == want
    assert sorted(map(tuple, pairing.folded(df.filter("kind != 'text'")).collect())) == want
    called = []
    monkeypatch.setattr(pairing, "folded", lambda e: called.append(e.select("session").distinct().count()) or e.select("session", F.col("ord").alias("call"), F.col("ord").alias("result"), F.lit("").alias("by")).limit(0))
    calm = sorted(map(tuple, pairing.paired(df).collect()))
    assert 0 < called[0] < 120 and set(calm) < set(want) and len(calm) > 100  # most sessions need no fold
    assert pairing.paired(df.limit(0)).collect() == []


def greedy(items, target=None):
    strengths = {"assistant_summary": 0.36, "error_fix": 0.44, "phase": 0.5, "bash_pair": 0.88}

    def score(sources):
        if not sources or any(s not in strengths for s in sources):
            return -1
        return math.floor(min(1, max(strengths[s] for s in sources) + min(0.12, (len(sources) - 1) * 0.04) + min(0.08, (len(set(sources)) - 1) * 0.04)) * 100 + 0.5)

    best = {}
    for ref, source, h in sorted(items):
        if h not in best or strengths.get(source, -1) > strengths.get(best[h][1], -1):
            best[h] = (ref, source, h)
    left, chosen = list(best.values()), []
    target = score([x[1] for x in left]) if target is None else target
    while len(chosen) < 4 and left:
        left.sort(key=lambda x: (-score([c[1] for c in chosen] + [x[1]]), x[0]))
        chosen.append(left.pop(0))
        if score([c[1] for c in chosen]) == target:
            break
    return [(i + 1, *c, score([x[1] for x in chosen[: i + 1]])) for i, c in enumerate(chosen)]


def test_minimal_evidence_equals_a_plain_search(spark):
    rng = random.Random(3)
    kinds = ["assistant_summary", "error_fix", "phase", "bash_pair"]
    rows = [(fact, f"r{k:03d}", rng.choice(kinds if fact % 7 else [*kinds, "odd"]), f"h{rng.randint(0, 12)}") for fact in range(60) for k in range(rng.randint(1, 14))]
    rows += [(100, f"r{k:05d}", "phase", f"h{k}") for k in range(5000)] + [(101, "r", "phase", None), (None, "r", "phase", "h")]
    got = evidence.minimal_evidence(spark.createDataFrame(rows, "fact_id long, ref string, source string, hash string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["fact_id"], []).append((r["step"], r["ref"], r["source"], r["hash"], -1 if r["score"] is None else r["score"]))
    facts = {f for f, _, _, h in rows if f is not None and h is not None}
    assert set(by) == facts
    for fact in facts:
        assert sorted(by[fact]) == greedy([r[1:] for r in rows if r[0] == fact]), fact
    low = evidence.minimal_evidence(spark.createDataFrame([(1, "a", "bash_pair", "x"), (1, "b", "phase", "y")], "fact_id long, ref string, source string, hash string"), spark.createDataFrame([(1, 88)], "fact_id long, target long"))
    assert [tuple(r) for r in low.collect()] == [(1, 1, "a", "bash_pair", "x", 88)]


def plain_stream(seed, n):
    state, out = seed, []
    imul = lambda a, b: (a * b) & 0xFFFFFFFF
    for _ in range(n):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        v = imul(state ^ state >> 15, state | 1)
        v ^= (v + imul(v ^ v >> 7, v | 61)) & 0xFFFFFFFF
        out.append((v ^ v >> 14) / 4294967296)
    return out


def test_generator_and_draws(spark):
    for seed in (0, 1, 0xFFFFFFFF, comparison.seed_of("x")):
        got = [r[0] for r in spark.range(1, 2001).select(comparison.uniform(seed, F.col("id"))).collect()]
        assert got == plain_stream(seed, 2000)
    assert [r[0] for r in spark.range(2**33, 2**33 + 3).select(comparison.uniform(5, F.col("id"))).collect()] == [r[0] for r in spark.range(3).select(comparison.uniform(5, F.col("id"))).collect()]
    stream, want = plain_stream(7, 30 * 11), {}
    for i, u in enumerate(stream):
        key = (i // 11, math.floor(u * 11))
        want[key] = want.get(key, 0) + 1
    assert {(r["round"], r["number"]): r["times"] for r in comparison.draws(spark, 11, 30, 7).collect()} == want


def rows_for_fit(rng, n, d, signs):
    x = rng.normal(size=(n, d)) * [1, 5, 0.2][:d] + [3, 0, -1][:d]
    p = 1 / (1 + np.exp(-(x - x.mean(0)) / x.std(0) @ np.array(signs[:d])))
    return x, (rng.random(n) < p).astype(int), rng.integers(1, 4, n).astype(float)


def plain_fit(x, y, w, l2=1.0, non_negative=False, exact=False):
    """By long projected gradient ascent on the penalised likelihood (exact), or Newton steps cut at zero."""
    w = w * len(w) / w.sum()
    m = (w[:, None] * x).sum(0) / len(w)
    s = np.sqrt((w[:, None] * (x - m) ** 2).sum(0) / len(w))
    z = np.column_stack([np.ones(len(x)), (x - m) / s])
    share = ((w * y).sum() + 0.5) / (len(w) + 1)
    b = np.array([math.log(share / (1 - share)), *[0.0] * x.shape[1]])
    ridge = np.diag([1e-6, *[l2] * x.shape[1]])
    for _ in range(20000 if exact else 100):
        p = np.clip(1 / (1 + np.exp(-z @ b)), 1e-6, 1 - 1e-6)
        g = z.T @ (w * (y - p)) - np.array([0, *(l2 * b[1:])])
        if exact:
            new = b + g / len(w)
        else:
            new = b + np.linalg.solve(z.T @ (z * (w * np.maximum(1e-6, p * (1 - p)))[:, None]) + ridge, g)
        if non_negative:
            new[1:] = np.maximum(new[1:], 0)
        moved, b = np.abs(new - b).max(), new
        if moved < (1e-14 if exact else 1e-8):
            break
    return b


@pytest.mark.parametrize("mode", ["free", "cut", "exact"])
def test_logistic_fit_equals_numpy(spark, mode):
    x, y, w = rows_for_fit(np.random.default_rng(5), 400, 3, [1.0, -0.7, 0.4])
    df = spark.createDataFrame([(*map(float, a), int(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "p double, q double, r double, target long, weight double")
    f = comparison.logistic_fit(df, ["p", "q", "r"], non_negative=mode != "free", exact=mode == "exact")
    want = plain_fit(x, y, w, non_negative=mode != "free", exact=mode == "exact")
    assert f["converged"] and np.abs(np.array([f["intercept"], *f["coefficients"]]) - want).max() < 1e-6
    assert (min(f["coefficients"]) < 0) == (mode == "free")
    told = df.select(comparison.predicted(df, ["p", "q", "r"], f).alias("p"), "target").agg(F.corr("p", "target")).first()[0]
    assert told > 0.3


def test_fits_that_cannot_be(spark):
    empty = spark.createDataFrame([], "p double, target long, weight double")
    with pytest.raises(ValueError):
        comparison.logistic_fit(empty, ["p"])
    with pytest.raises(ValueError):
        comparison.logistic_fit(spark.createDataFrame([(None, 1, 1.0)], "p double, target long, weight double"), ["p"])
    one = comparison.logistic_fit(spark.createDataFrame([(2.0, 1, 1.0), (2.0, 0, 1.0)], "p double, target long, weight double"), ["p"])
    assert one["converged"] and one["coefficients"] == [0.0] and one["deviations"] == [1.0]


def test_comparison_of_few_rows(spark):
    ddl = "group_id string, candidate double, baseline double, target long, weight double"
    assert comparison.compare(spark.createDataFrame([], ddl)).collect() == []
    r = comparison.compare(spark.createDataFrame([("a", 0.9, 0.5, 1, 1.0), ("b", 0.2, 0.5, 0, 1.0)], ddl), 100).first()
    assert r["delta_brier"] == round((0.01 - 0.25 + 0.04 - 0.25) / 2, 6) and r["rounds"] == 100 and r["delta_false_promotion"] is None and r["false_promotion_low"] is None
