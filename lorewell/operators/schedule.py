"""What to look at next, and when: due and coming checks, questions, and the dashboard if it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import notes_overview, reports
from lorewell.operators.ordering import numbered
from lorewell.sources.tables import AS_OF, notes

DASHBOARD = "Knowledge/_brain.md"
#: Due checks and questions that a proposal names; days that it looks ahead.
MOST_DUE, MOST_QUESTIONS, HORIZON = 20, 10, 30


def schedule(n: DataFrame, today: str = AS_OF[:10], horizon: int = HORIZON) -> DataFrame:
    """place, id, priority, due, rel_path, reason in order of due, priority as text, kind and path. Due checks of evidence come
    today, those of the next `horizon` days (1 to 365) at their date, whatever the kind of note; of the open questions the
    newest come today, contradictions first in rank. A date shorter than ten characters is none."""
    horizon = reports.clamped(horizon, 1, 365)
    row = lambda d, kind, priority, due, reason: d.select(F.lit(kind[0]).alias("kind"), F.concat(F.lit(f"{kind[1]}:"), "rel_path").alias("id"), priority.alias("priority"), due.alias("due"), "rel_path", F.lit(reason).alias("reason"))
    now = F.lit(today)
    checks = notes_overview.evidence_issues(n, today).filter("issue = 'due'").select("rel_path").orderBy("rel_path").limit(MOST_DUE)
    fm = F.col("frontmatter")
    last = F.date_format(F.date_add(now.cast("date"), horizon), "yyyy-MM-dd")
    near = lambda k: F.coalesce((F.length(fm[k]) >= 10) & (F.substring(fm[k], 1, 10) <= last), F.lit(False))
    coming = n.filter(near("recheck_at") | near("expires_at")).select("rel_path", F.substring(F.coalesce(fm["recheck_at"], fm["expires_at"]), 1, 10).alias("at"))
    questions = reports.open_questions(n).orderBy(F.desc("last_modified"), "rel_path").limit(MOST_QUESTIONS)
    lacks = n.agg(F.count_if(F.col("rel_path") == DASHBOARD).alias("n")).filter("n = 0").select(F.lit(DASHBOARD).alias("rel_path"))
    items = row(checks, (0, "evidence"), F.lit("high"), now, "recheck is due").union(row(coming, (1, "upcoming"), F.lit("medium"), F.col("at"), "recheck or end is near"))
    items = items.union(row(lacks, (2, "dashboard"), F.lit("low"), now, "no dashboard yet")).union(row(questions, (3, "question"), F.when(F.col("kind") == "contradiction", "high").otherwise("medium"), now, "open question"))
    return numbered(items, "due", "priority", "kind", "rel_path", number="place").select((F.col("place") + 1).alias("place"), "id", "priority", "due", "rel_path", "reason")


def asking(n: DataFrame) -> DataFrame:
    """The notes with some of them as open questions and contradictions."""
    k = F.col("doc_id")
    return n.withColumn("tags", F.when(k % 31 == 3, F.concat("tags", F.array(F.lit("open-question")), F.when(k % 2 == 0, F.array(F.lit("contradiction"))).otherwise(F.array().cast("array<string>")))).otherwise(F.col("tags")))


def _schedule(s: SparkSession, d: str) -> DataFrame:
    return schedule(asking(notes(s, d)))


QUERIES = {"schedule_proposal": _schedule}
SQL = {
    "schedule_proposal": notes_overview.EVIDENCE_SQL + """, i AS (
      SELECT 0 AS kind, 'evidence:' || rel_path AS id, 'high' AS priority, '2024-06-01' AS due, rel_path, 'recheck is due' AS reason FROM (SELECT rel_path FROM issues WHERE issue = 'due' ORDER BY rel_path LIMIT 20)
      UNION ALL SELECT 1, 'upcoming:' || rel_path, 'medium', recheck_at, rel_path, 'recheck or end is near' FROM notes WHERE recheck_at <= '2024-07-01'
      UNION ALL SELECT 2, 'dashboard:Knowledge/_brain.md', 'low', '2024-06-01', 'Knowledge/_brain.md', 'no dashboard yet' WHERE NOT EXISTS (SELECT 1 FROM notes WHERE rel_path = 'Knowledge/_brain.md')
      UNION ALL SELECT 3, 'question:' || rel_path, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'medium' END, '2024-06-01', rel_path, 'open question' FROM (SELECT * FROM notes WHERE k % 31 = 3 AND NOT starts_with(lower(rel_path), 'archiv/') ORDER BY last_modified DESC, rel_path LIMIT 10))
      SELECT row_number() OVER (ORDER BY due, priority, kind, rel_path) AS place, id, priority, due, rel_path, reason FROM i""",
}
