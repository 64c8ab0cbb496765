import random

from pyspark.sql import functions as F

from lorewell.streaming import session_state as st

DDL = "project long, session string, ts timestamp, commands long"
HOUR = 3600


def plain(batches, keep, saved=()):
    """The policy over all events in order, without Spark: what is told, and what is kept."""
    known = {}
    for p, s, *v in saved:
        known.setdefault(p, st.Sessions({}, keep)).known[s] = tuple(v)
    out = []
    for rows in batches:
        for p, s, t, n in sorted(rows, key=lambda r: (r[2], r[1])):
            out += [(p, *x) for x in known.setdefault(p, st.Sessions({}, keep)).saw(s, float(t), n)]
    return sorted(out)


def run(spark, tmp_path, batches, keep, saved=None, name="told"):
    """The stream over one file a batch; what it told."""
    out = []
    for k, rows in enumerate(batches):
        folder = tmp_path / f"{name}-in"
        spark.createDataFrame(rows, "project long, session string, t long, commands long").select("project", "session", F.timestamp_seconds("t").alias("ts"), "commands").coalesce(1).write.mode("append").parquet(str(folder))
        stream = st.session_events(spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(folder)), keep=keep, saved=saved)
        with st.rocksdb_state(spark):
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
        q.awaitTermination()  # each batch is a restart of the query
    if (tmp_path / f"{name}-out").exists():
        out = spark.read.parquet(str(tmp_path / f"{name}-out")).select("project", "session", F.unix_micros("at").alias("at"), "event", "commands").collect()
    return [(r["project"], r["session"], r["at"] / 1e6, r["event"], r["commands"]) for r in out]


def test_stream_equals_the_policy_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    batches, now = [], 1_717_200_000
    for _ in range(3):
        rows = []
        for _ in range(150):
            now += rng.randint(10, 400)
            rows.append((rng.randint(0, 2), f"s{rng.randint(0, 11)}", now, rng.choice([1, 1, 2, 5])))
        batches.append(rows)
    got = [x for x in run(spark, tmp_path, batches, 6) if x[3] != "expired"]
    want = plain(batches, 6)
    assert sorted(got) == want and {x[3] for x in want} >= {"checkpoint", "evicted"} and len(want) > 50


def test_initial_state_silence_and_timers(spark, tmp_path):
    t0 = 1_717_200_000
    saved = [(1, "old", float(t0 - 50 * HOUR), 40, 2, None, 0, float(t0 - 30 * HOUR)), (1, "live", float(t0 - HOUR), 11, 0, None, 0, float(t0 - 60)), (2, "other", float(t0), 3, 0, None, 0, float(t0))]
    first = spark.createDataFrame(saved, st.SAVED)
    batches = [[(1, "live", t0, 1), (1, "old", t0 + 5, 1), (None, "x", t0, 1)], [(3, "late", t0 + 60 * HOUR, 1)], [(3, "late", t0 + 60 * HOUR + 1, 1)]]
    got = run(spark, tmp_path, batches, 50, first, "timed")
    assert [x for x in sorted(got) if x[3] != "expired"] == plain([[r for r in b if r[0] is not None] for b in batches], 50, saved)
    assert (1, "live", float(t0), "checkpoint", 12) in got and (1, "old", float(t0 + 5), "restarted", 40) in got
    assert {(x[0], x[1]) for x in got if x[3] == "expired"} >= {(1, "live"), (1, "old"), (2, "other")}


def test_keep_newest():
    s = st.Sessions({}, 2)
    assert s.saw("a", 0.0) == [] and s.saw("b", 1.0) == [] and s.saw("a", 2.0) == []
    assert s.saw("c", 3.0) == [("b", 3.0, "evicted", 1)] and set(s.known) == {"a", "c"}
    assert s.saw("d", 3.0) == [("a", 3.0, "evicted", 2)]
    assert s.saw("b", 3.0) == [("b", 3.0, "evicted", 1)] and set(s.known) == {"c", "d"}  # equal times: by name
