import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import whitening

DDL = "vec_id long, embedding array<float>, n string, x string, component string"


def plain(rows, k=4):
    """What query() is to return, by numpy's full decomposition."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in kept}), np.int64)
    n, s = len(fit), fit.sum(0)
    z = fit - s / n
    v = z.T @ z / n
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        far = sum((n * a - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        out.setdefault(i, []).append((n, far, (np.array(x) - s / n) @ vectors / np.sqrt(e), e / np.trace(v)))
    return out


def test_whitening_equals_full_decomposition(spark):
    rng = np.random.default_rng(2)
    d = 24
    mix = rng.standard_normal((d, d)) * np.linspace(2, 0.1, d)
    rows = [(i, (rng.standard_normal(d) @ mix * 0.1).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(None, rows[5][1]), (5000, rows[9][1]), (5000, rows[9][1])]
    bad = [(2000, None), (2001, [math.nan] * d), (2002, [1.0] * (d - 1) + [math.inf]), (2003, [None] + [0.5] * (d - 1)), (2004, [])]
    table = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows + bad], DDL).repartition(7)
    (got, want) = whitening.whiten(table).collect(), plain(rows)
    assert len(got) == 4 * len(rows)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for (i, c), rs in by.items():
        assert len(rs) == len(want[i])
        n, far, w, explained = want[i][0]
        for r in rs:
            assert (r["n"], r["deviation"]) == (n, far) and r["explained"] == pytest.approx(explained[c - 1], rel=1e-10)
            sign = signs.setdefault(c, 1 if r["whitened"] * w[c - 1] > 0 else -1)
            assert sign * r["whitened"] == pytest.approx(w[c - 1], abs=1e-8)
            assert r["identity_error"] < 1e-9 and r["residual"] <= whitening.TOLERANCE


def test_degenerate_tables(spark):
    one = lambda rows: whitening.whiten(spark.createDataFrame([(i, v, "", "", "") for i, v in rows], DDL))
    assert one([(1, [0.5, 0.25])]).collect() == [] and one([(1, [0.5, 0.25])] * 9).collect() == []
    assert one([]).collect() == [] and one([(1, None), (2, [])]).collect() == []
    line = one([(i, [0.1 * i, 0.2 * i, 0.0]) for i in range(50)]).collect()  # nearly one direction
    assert {r["component"] for r in line} <= {1, 2} and all(r["n"] == 50 for r in line)
    ragged = one([(i, [float(i), 1.0]) for i in range(5)] + [(9, [1.0, 2.0, 3.0])]).collect()
    assert {r["vec_id"] for r in ragged} == set(range(5)) and {r["component"] for r in ragged} == {1}
    zero = one([(1, [-0.0, 1.0]), (2, [0.0, 1.0]), (3, [-1e-9, 1.0])]).collect()
    assert {r["n"] for r in zero} == {2} and len(zero) == 3
    huge = one([(i, [1e30, 1.0]) for i in range(3)] + [(i, [float(i), 3e13]) for i in range(3, 6)]).collect()
    assert {r["vec_id"] for r in huge} == {3, 4, 5}


def test_equal_eigenvalues_and_many_dimensions():
    rng = np.random.default_rng(3)
    for d, values in ((6, [3.0, 3, 3, 1, 1, 0]), (300, [9.0, 9, 8.999, 8.9] + list(np.linspace(5, 0, 296)))):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        v = (q * values) @ q.T
        e, x, residual, passes = whitening.largest(lambda b, v=v: v @ b, d, 4, 8)
        assert np.allclose(e, values[:4], atol=1e-12 * 9) and residual <= whitening.TOLERANCE and passes < 150
        assert np.abs(x.T @ x - np.eye(4)).max() < 1e-13 and np.abs(v @ x - x * e).max() < 1e-10


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 0]], np.int64)
    assert whitening.deviations(x, 2, [1 << 40, 0]) == [None, None]
    assert whitening.deviations(x >> 30, 2, [1 << 10, 0]) == [1 << 20, 1 << 20]


def test_query_on_the_given_table(spark):
    got = whitening.query(spark, "/root/testdata/sf0.01").agg(F.count("*").alias("n"), F.max("identity_error").alias("e"), F.max("residual").alias("r")).first()
    assert got["n"] == 2000 and got["e"] < 1e-9 and got["r"] <= whitening.TOLERANCE
