import math
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lorewell import registry
from lorewell.operators import calibration, sessions
from lorewell.streaming import windows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.SQL[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([plain(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(cols)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_imports_without_the_optional_parts():
    code = "import sys; sys.modules['lorewell.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'semantic_search' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries()"
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})


def test_evidence_scores(spark):
    rows = [
        ("a", "assistant_summary", "1", None), ("b", "error_fix", "1", None), ("c", "phase", "1", None), ("d", "bash_pair", "1", None), ("e", "phase", "1", None), ("e", "error_fix", "2", None),
        ("f", "phase", "1", None), ("f", "error_fix", "1", None), ("g", "phase", "1", "o"), ("g", "error_fix", "2", "o"), ("h", "phase", "1", "o"), ("h", "error_fix", "2", "o"), ("h", "bash_pair", "2", "p"),
    ]
    got = {r["fact_id"]: (r["units"], r["score"]) for r in sessions.evidence_scores(spark.createDataFrame(rows, "fact_id string, source string, hash string, origin string")).collect()}
    assert got == {"a": (1, 36), "b": (1, 44), "c": (1, 50), "d": (1, 88), "e": (2, 58), "f": (1, 50), "g": (1, 50), "h": (1, 88)}


def test_mmr_is_greedy_and_deterministic(spark):
    from lorewell.operators import choices

    words = lambda t: (t or "").split()
    rows = [(1, "a", "cause", "alpha beta gamma delta", 90, 50), (1, "b", "cause", "alpha beta gamma delta", 80, 50), (1, "c", "decision", "other words here", 70, 50), (2, "z", "cause", None, 10, 1)]
    f = spark.createDataFrame([(s, i, k, t, words(t), 0, False, False, v, e) for s, i, k, t, v, e in rows], "session long, id string, kind string, statement string, tokens array<string>, polarity int, conflict boolean, interpreted boolean, salience long, evidence long")
    got = lambda d: [(r["session"], r["id"], r["selection"]) for r in choices.selected(d, 12, 0).orderBy("session", "rank").collect()]
    assert got(f) == [(1, "a", 0.715), (1, "c", 0.565), (2, "z", 0.115)] and got(f.repartition(3)) == got(f)
    choices.register(spark)
    f.createOrReplaceTempView("some_facts")
    told = spark.sql("SELECT session, id, selection FROM choose_facts(TABLE(some_facts) PARTITION BY (session), 12, least => 0) ORDER BY session, rank").collect()
    assert [(int(r["session"]), r["id"], r["selection"]) for r in told] == got(f)
    only = spark.sql("SELECT id FROM choose_facts(TABLE(some_facts) PARTITION BY (session), required => 'decision')").collect()
    assert [r["id"] for r in only] == ["c"]
    points = spark.sql("SELECT k, evidence_points(s) AS p FROM VALUES ('a', 'phase'), ('a', 'error_fix'), ('b', 'bash_pair'), ('c', NULL) AS t(k, s) GROUP BY k").collect()
    assert {r["k"]: r["p"] for r in points} == {"a": 58, "b": 88, "c": 0}


def test_logistic_line_recovers_slope(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    p = rng.uniform(0.05, 0.95, 4000)
    z = np.log(p / (1 - p))
    y = rng.uniform(size=4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * z)))
    df = spark.createDataFrame([(float(a), int(b), 1.0) for a, b in zip(p, y, strict=True)], "probability double, target long, weight double")
    r = calibration.fit_logistic(df).first()
    assert abs(r["slope"] - 1.5) < 0.2 and abs(r["intercept"] - 0.5) < 0.2


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    for k in range(3):
        e.filter(f"event_id >= {k * 334} AND event_id < {k * 334 + 334}").coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def test_stream_windows_equal_batch(spark, event_files):
    e = windows.read_events(spark, event_files)
    got = windows.drained(windows.tumbling(e, late="40 days"), "tumbling_out", "update")
    last = got.groupBy("start", "event_type").agg(F.max("n").alias("n"))
    want = windows.batch.tumbling(spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).select("start", "event_type", "n")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_stream_checkpoints_follow_policy(spark, event_files):
    got = windows.drained(windows.checkpoints(windows.read_events(spark, event_files, 10)), "checkpoints_out")
    assert got.groupBy("user_id").count().agg(F.max("count")).first()[0] <= windows.MOST
    assert windows.decide(0, 1, 0, None, 0, 1800) and not windows.decide(0, 1, 0, None, 0, 60) and windows.decide(0, 12, 0, None, 0, 60)
    assert not windows.decide(0, 50, 1, 1000, 0, 1100) and not windows.decide(0, 99, windows.MOST, None, 0, 99999)


def test_stream_upsert_and_once(spark, event_files, tmp_path):
    e = windows.read_events(spark, event_files, 1)
    windows.upsert_latest(e, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = windows.batch.last_writes(spark.read.parquet(f"{SF}/events.parquet"))
    got = windows.latest_state(spark, str(tmp_path / "out")).select("user_id", "event_type", "event_id", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len(list((tmp_path / "out").iterdir())) > 1
    once = windows.drained(windows.once(windows.read_events(spark, event_files, 10), "60 days"), "once_out")
    assert once.count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id", "props").distinct().count()
