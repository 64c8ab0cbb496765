from pyspark.sql import functions as F

from lorewell.operators import health
from lorewell.sources.tables import parsed


def told(d):
    return {r["check"]: (r["status"], r["message"]) for r in d.collect()}


def test_health_tells_the_worst(spark):
    rows = [("Knowledge/_brain.md", "---\nquelle: brain-dashboard\n---\nx", "2024-05-31"), ("Knowledge/hot.md", "---\nquelle: other\n---\nx", "2024-05-31"), ("Knowledge/index.md", "---\nquelle: knowledge-index\n---\nx", "2024-05-01"), ("a.md", "x", "2024-05-01")]
    n = parsed(spark.createDataFrame(rows, "rel_path string, raw string, at string").select("rel_path", "raw", F.col("at").cast("timestamp_ntz").alias("last_modified")))
    manifest = spark.createDataFrame([("a.md", "h"), ("b.md", None)], "source string, hash string")
    log = spark.createDataFrame([(1,)], "x long")
    fresh = spark.createDataFrame([("fresh", 4)], "state string, n long")
    got = told(health.health(n, manifest, log, fresh))
    assert got["index"] == ("ok", "4") and got["surface:brain_dashboard"] == ("ok", "current") and got["surface:hot_cache"] == ("fail", "owner is other")
    assert got["surface:knowledge_index"] == ("warn", "old: 31") and got["surface:change_ledger"] == ("warn", "missing")
    assert got["manifest"] == ("fail", "without hash: 1") and got["action_log"] == ("ok", "1") and got["semantic_index"] == ("ok", "0") and got["overall"] == ("fail", "12")
    first = [r["check"] for r in health.next_actions(health.health(n, manifest, log, fresh), 2).collect()]
    assert first == ["manifest", "surface:hot_cache"]
    good = n.filter("rel_path = 'Knowledge/_brain.md'")
    got = told(health.health(good, manifest.filter("hash IS NOT NULL"), None, spark.createDataFrame([("stale", 2)], "state string, n long")))
    assert got["overall"] == ("warn", "12") and got["semantic_index"] == ("warn", "2") and got["manifest"] == ("ok", "1") and got["action_log"][0] == "warn"
    nothing = told(health.health(n.limit(0), None, None, None))
    assert nothing["index"] == ("warn", "0") and nothing["semantic_index"] == ("ok", "not built") and nothing["manifest"] == ("warn", "no run yet")
