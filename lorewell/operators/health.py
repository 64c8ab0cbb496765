"""Health of a vault: its index, generated surfaces, manifest, action log and term index as checks, and the worst of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import search
from lorewell.operators.notes_overview import age_days
from lorewell.sources.tables import AS_OF, notes, table

# Generated surfaces with their paths and owners, and the days after which one is old.
SURFACES = (
    ("brain_dashboard", "Knowledge/_brain.md", "brain-dashboard"), ("knowledge_index", "Knowledge/index.md", "knowledge-index"), ("hot_cache", "Knowledge/hot.md", "hot-cache"), ("capture_review", "Maintenance/Capture Review.md", "capture-review"),
    ("evidence_dashboard", "Knowledge/evidence.md", "evidence-dashboard"), ("knowledge_inbox", "Maintenance/Knowledge Inbox.md", "knowledge-inbox"), ("change_ledger", "Maintenance/Change Ledger.md", "change-ledger"), ("background_report", "Maintenance/Background Run Report.md", "brain-run-background"),
)
OLD_DAYS = 7
RANKS = {"ok": 0, "warn": 1, "fail": 2}


def surface_checks(n: DataFrame) -> DataFrame:
    """check, status, message of each surface: missing or old is a warning, one that another owner's mark is on a failure."""
    wanted = n.sparkSession.createDataFrame(SURFACES, "id string, path string, owner string")
    there = n.select(F.col("rel_path").alias("path"), F.col("frontmatter")["quelle"].alias("mark"), age_days(F.col("last_modified")).alias("age"))
    j = wanted.join(there.withColumn("there", F.lit(True)), "path", "left")
    mine = F.col("mark").eqNullSafe(F.col("owner"))
    status = F.when(F.col("there").isNull(), "warn").when(~mine, "fail").when(F.col("age") > OLD_DAYS, "warn").otherwise("ok")
    message = F.when(F.col("there").isNull(), "missing").when(~mine, F.concat(F.lit("owner is "), F.coalesce("mark", F.lit("nobody")))).when(F.col("age") > OLD_DAYS, F.concat(F.lit("old: "), F.col("age").cast("string"))).otherwise("current")
    return j.select(F.concat(F.lit("surface:"), "id").alias("check"), status.alias("status"), message.alias("message"))


def health(n: DataFrame, manifest: DataFrame | None, actions: DataFrame | None, freshness: DataFrame | None) -> DataFrame:
    """check, status (ok, warn, fail), message; the last check, overall, has the worst status and the number of checks.
    manifest: source, hash (a source without a hash spoils it); actions: logged writes; freshness: state and n of the term
    index. None stands for what does not exist yet: a warning, but for the term index, which is optional."""
    spark = n.sparkSession
    row = lambda d, name, status, message: d.select(F.lit(name).alias("check"), status.alias("status"), message.cast("string").alias("message"))
    lit = lambda name, status, message: spark.createDataFrame([(name, status, message)], "check string, status string, message string")
    count = F.col("n")
    parts = [row(n.agg(F.count("*").alias("n")), "index", F.when(count > 0, "ok").otherwise("warn"), count), surface_checks(n)]
    if manifest is None:
        parts.append(lit("manifest", "warn", "no run yet"))
    else:
        m = manifest.agg(F.count("*").alias("n"), F.count_if(F.col("hash").isNull() | F.col("source").isNull()).alias("bad"))
        parts.append(row(m, "manifest", F.when(F.col("bad") > 0, "fail").otherwise("ok"), F.when(F.col("bad") > 0, F.concat(F.lit("without hash: "), F.col("bad").cast("string"))).otherwise(count.cast("string"))))
    logged = actions.agg(F.count("*").alias("n")) if actions is not None else None
    parts.append(row(logged, "action_log", F.when(count > 0, "ok").otherwise("warn"), count) if logged is not None else lit("action_log", "warn", "0"))
    if freshness is None:
        parts.append(lit("semantic_index", "ok", "not built"))
    else:
        drift = freshness.agg(F.sum(F.when(F.col("state") == "fresh", 0).otherwise(F.col("n"))).alias("n")).select(F.coalesce("n", F.lit(0)).alias("n"))
        parts.append(row(drift, "semantic_index", F.when(count == 0, "ok").otherwise("warn"), count))
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col("status")]
    return each.unionByName(each.agg(F.lit("overall").alias("check"), F.max_by("status", rank).alias("status"), F.count("*").cast("string").alias("message")))


def next_actions(checks: DataFrame, most: int = 8) -> DataFrame:
    """The first checks that are not ok, failures first."""
    return checks.filter("status != 'ok' AND check != 'overall'").orderBy(F.col("status") != "fail", "check").limit(most)


def sample_vault(n: DataFrame) -> DataFrame:
    """The notes with six of their number in the surfaces' places, of right, wrong and no owners, old and new."""
    k = F.col("doc_id")
    places = n.filter(k.isin(10, 20, 30, 40, 50, 60))
    pick = lambda i: F.get(F.array(*[F.lit(s[i]) for s in SURFACES]), (k / 10 - 1).cast("int"))
    mark = F.when(k == 20, F.lit("someone")).when(k == 30, F.lit(None).cast("string")).otherwise(pick(2))
    fm: Column = F.map_from_arrays(F.array(F.lit("quelle")), F.array(mark))
    at = F.when(k == 40, F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 9 days")).otherwise(F.lit(AS_OF).cast("timestamp_ntz"))
    moved = places.withColumn("rel_path", pick(1)).withColumn("frontmatter", fm).withColumn("last_modified", at)
    return n.unionByName(moved)


def _health(s: SparkSession, d: str) -> DataFrame:
    n = notes(s, d)
    docs = table(s, d, "documents")
    manifest = docs.filter("doc_id % 9 = 0").select(F.col("doc_id").cast("string").alias("source"), F.when(F.col("doc_id") % 45 != 0, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"))
    stale = search.freshness(n.select("rel_path", search.note_hash().alias("hash")), search.perturbed(n).select("rel_path", search.note_hash().alias("hash")))
    return health(sample_vault(n), manifest, table(s, d, "events").filter("event_type = 'purchase'"), stale)


QUERIES = {"vault_health": _health}
_ROWS = ", ".join(f"({i}, '{a}', '{p}', '{o}')" for i, (a, p, o) in enumerate(SURFACES))
SQL = {
    "vault_health": f"""WITH s AS (SELECT * FROM (VALUES {_ROWS}) v(i, id, path, owner)),
      c AS (SELECT 'index' AS "check", 'ok' AS status, CAST((SELECT count(*) + count(*) FILTER (doc_id IN (10, 20, 30, 40, 50, 60)) FROM documents) AS VARCHAR) AS message
      UNION ALL SELECT 'surface:' || id, CASE i WHEN 0 THEN 'ok' WHEN 1 THEN 'fail' WHEN 2 THEN 'fail' WHEN 3 THEN 'warn' WHEN 4 THEN 'ok' WHEN 5 THEN 'ok' ELSE 'warn' END, CASE i WHEN 1 THEN 'owner is someone' WHEN 2 THEN 'owner is nobody' WHEN 3 THEN 'old: 9' WHEN 6 THEN 'missing' WHEN 7 THEN 'missing' ELSE 'current' END FROM s
      UNION ALL SELECT 'manifest', CASE WHEN b > 0 THEN 'fail' ELSE 'ok' END, CASE WHEN b > 0 THEN 'without hash: ' || b ELSE CAST(n AS VARCHAR) END FROM (SELECT count(*) AS n, count(*) FILTER (doc_id % 45 = 0) AS b FROM documents WHERE doc_id % 9 = 0)
      UNION ALL SELECT 'action_log', CASE WHEN n > 0 THEN 'ok' ELSE 'warn' END, CAST(n AS VARCHAR) FROM (SELECT count(*) AS n FROM events WHERE event_type = 'purchase')
      UNION ALL SELECT 'semantic_index', CASE WHEN n = 0 THEN 'ok' ELSE 'warn' END, CAST(CAST(n AS BIGINT) AS VARCHAR) FROM (SELECT coalesce(sum(n) FILTER (state <> 'fresh'), 0) AS n FROM ({search.SQL['semantic_index_freshness']})))
      SELECT * FROM c UNION ALL SELECT 'overall', (SELECT CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END FROM c), (SELECT CAST(count(*) AS VARCHAR) FROM c)""",
}
