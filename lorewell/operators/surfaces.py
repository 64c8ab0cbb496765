"""Report queries: the review queue, the inbox, schedules, dashboards, client resolution, coverage and redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as tx
from lorewell.operators import links, notes_overview
from lorewell.sources.files import page_profile
from lorewell.sources.tables import NOTES_SQL, notes, table


def review_queue(n: DataFrame, q: DataFrame, broken: DataFrame) -> DataFrame:
    """All there is to review, as one queue: id, category, severity, path; in no order."""
    item = lambda df, category, severity, path="rel_path": df.select(F.concat(F.lit(f"{category}:"), F.col(path)).alias("id"), F.lit(category).alias("category"), (severity if not isinstance(severity, str) else F.lit(severity)).alias("severity"), F.col(path).alias("path"))
    parts = [
        item(notes_overview.lifecycle(q), "lifecycle", F.when(F.col("confidence") == "high", "high").when(F.col("confidence") == "medium", "medium").otherwise("low")), item(q.filter(~notes_overview.skippable(q) & (F.col("score") <= 69)), "quality", F.when(F.col("score") < 50, "high").otherwise("medium")),
        item(notes_overview.evidence_issues(n).groupBy("rel_path").agg(F.max(F.col("severity") == "high").alias("h")), "evidence", F.when(F.col("h"), "high").otherwise("medium")), item(broken.select(F.col("src").alias("rel_path")).distinct(), "links", "medium"),
    ]
    return reduce(DataFrame.unionByName, parts)  # reports.review_page puts it in order


def severity_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("category").pivot("severity", ["high", "medium", "low"]).agg(F.count(F.lit(1))).fillna(0)


def customer_dashboard(n: DataFrame) -> DataFrame:
    """Counts by customer folder."""
    client = F.split_part("rel_path", F.lit("/"), F.lit(2))
    n = n.filter(F.col("rel_path").startswith("Kunden/")).withColumn("client", client)
    return n.groupBy("client").agg(F.count("*").alias("notes"), F.sum(F.size(F.filter("todos", lambda t: ~t["done"])).cast("long")).alias("open_todos"), F.count_if(F.array_contains("tags", "decision")).alias("decisions"), F.date_format(F.max("last_modified"), "yyyy-MM-dd").alias("latest"))


def timeline(n: DataFrame) -> DataFrame:
    """Kind and day of each customer note: its date field, else its last change."""
    kind = F.when(F.array_contains("tags", "decision"), "decision").when(F.size("todos") > 0, "task").otherwise("note")
    return n.filter(F.col("rel_path").startswith("Kunden/")).select("rel_path", F.coalesce(F.col("frontmatter")["datum"], F.date_format("last_modified", "yyyy-MM-dd")).alias("day"), kind.alias("kind"))


def knowledge_index(n: DataFrame) -> DataFrame:
    """The twenty most frequent tags."""
    return notes_overview.tag_frequency(n).orderBy(F.desc("n"), "tag").limit(20)


def knowledge_metrics(n: DataFrame, e: DataFrame) -> DataFrame:
    """Scalar counts over notes and edges in one row each."""
    a = n.agg(
        F.count("*").alias("notes"), F.count_if(notes_overview.is_active_path(F.col("rel_path"))).alias("active"), F.count_if(F.array_contains("tags", "claim")).alias("claims"), F.count_if(F.array_contains("tags", "decision")).alias("decisions"),
        F.count_if(F.col("frontmatter")["confidence"].isNotNull()).alias("with_confidence"), F.sum(F.size("out_links").cast("long")).alias("links"), F.sum(F.size("todos").cast("long")).alias("todos"),
    )
    return a.crossJoin(e.agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("linked")))  # one row each


def fuzzy_clients(names: DataFrame, clients: DataFrame, least: float = 0.84) -> DataFrame:
    """The client that a name resolves to: the same in any case, else the only one of the largest similarity by edits and swaps;
    ties abstain. From 0.84 on up to 32 characters there are at most five edits, so that two of six even pieces of the longer
    text are in the other one; they meet on a shared piece of a sixth of their length, two characters at least."""
    similar = tx.osa_similarity()
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    n = names.select("name").distinct().withColumn("low", F.lower("name")).select("name", "low", F.explode(pieces(F.col("low"))).alias("piece"))
    c = clients.select("client").distinct().withColumn("own", F.lower("client")).select("client", "own", F.explode(pieces(F.col("own"))).alias("piece"))
    near = F.abs(F.length("low") - F.length("own")) <= (1 - least) * F.greatest(F.length("low"), F.length("own"))
    pairs = n.join(c, "piece").filter(near).groupBy("name", "low", "client", "own").agg(F.count("*").alias("shared"))
    s = pairs.withColumn("similarity", F.when(F.col("low") == F.col("own"), 1.0).otherwise(similar("low", "own"))).filter(F.col("similarity") >= least)
    best = F.max("similarity").over(Window.partitionBy("name"))
    top = s.withColumn("best", best).filter("similarity = best").groupBy("name").agg(F.count("*").alias("n"), F.min("client").alias("client"), F.round(F.max("similarity"), 6).alias("similarity"))
    return top.filter("n = 1").select("name", "client", "similarity")


def sample_names(s, d):
    c = table(s, d, "nation").select(F.col("n_name").alias("client"))
    typo = table(s, d, "nation").select(F.concat(F.substring("n_name", 2, 1), F.substring("n_name", 1, 1), F.substring("n_name", 3, 50)).alias("name"))
    return fuzzy_clients(typo.union(table(s, d, "nation").select("n_name")), c)


def redaction(docs: DataFrame) -> DataFrame:
    """Secrets by document: how many, and the length of the masked text."""
    text, n = tx.redacted(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", n.alias("secrets"), F.length(text).cast("long").alias("length")).filter("secrets > 0")


def f_beta(precision, recall, beta: float = 0.5):
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def claim_quality(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F0.5 of found keys against expected ones."""
    hit = found.join(expected, "key", "left_semi").agg(F.count("*").alias("hit"))
    both = hit.crossJoin(found.agg(F.count("*").alias("found"))).crossJoin(expected.agg(F.count("*").alias("expected")))  # one row each
    p, r = F.coalesce(F.try_divide("hit", "found"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "expected"), F.lit(1.0))
    return both.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f_beta(p, r), 6).alias("f05"))


def junk_quality(s, d):
    """How well a plain rule (no repeated punctuation) finds the documents labelled good."""
    docs = table(s, d, "documents").filter(~F.col("text").rlike(r"[!*#$%&]{2}")).select(F.col("doc_id").alias("key"))
    labels = table(s, d, "labels")
    return claim_quality(docs.join(labels.select(F.col("doc_id").alias("key")), "key"), labels.filter("quality = 1").select(F.col("doc_id").alias("key")))


def queue(s, d):
    return review_queue(notes(s, d), notes_overview.judged_notes(s, d), links.broken(links.resolved_of(s, d)))


QUERIES = {
    "review_queue": queue, "review_severity": lambda s, d: severity_counts(queue(s, d)), "customer_dashboard": lambda s, d: customer_dashboard(notes(s, d)), "customer_timeline": lambda s, d: timeline(notes(s, d)),
    "knowledge_index": lambda s, d: knowledge_index(notes(s, d)), "knowledge_metrics": lambda s, d: knowledge_metrics(notes(s, d), links.edges_of(s, d)), "client_fuzzy": sample_names, "secret_redaction": lambda s, d: redaction(table(s, d, "documents")), "page_profile": lambda s, d: page_profile(table(s, d, "pages")), "rule_quality": junk_quality,
}
LIFE = notes_overview.SQL["lifecycle_suggestions"]
QUEUE_SQL = LIFE[: LIFE.index("SELECT rel_path, rule.action")] + ", life AS (" + LIFE[LIFE.index("SELECT rel_path, rule.action") :] + ")" + notes_overview.EVIDENCE_SQL[notes_overview.EVIDENCE_SQL.index(", cand AS") :] + """, queue AS (
  SELECT 'lifecycle:' || rel_path AS id, 'lifecycle' AS category, confidence AS severity, rel_path AS path FROM life
  UNION ALL SELECT 'quality:' || rel_path, 'quality', CASE WHEN score < 50 THEN 'high' ELSE 'medium' END, rel_path FROM graded WHERE score <= 69 AND NOT starts_with(rel_path, 'Daily/') AND NOT starts_with(rel_path, 'Maintenance/') AND NOT list_contains(tags, 'daily')
  UNION ALL SELECT 'evidence:' || rel_path, 'evidence', CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END, rel_path FROM issues GROUP BY rel_path
  UNION ALL SELECT DISTINCT 'links:' || rel_path, 'links', 'medium', rel_path FROM (SELECT rel_path, unnest(out_links) AS target FROM notes) WHERE target NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM notes)) """
MASKED = "coalesce(text, '')"
for _name, _pattern in tx.SECRETS:
    MASKED = f"regexp_replace({MASKED}, '{_pattern}', '[REDACTED:{_name}]', 'g')"
FOUND = "coalesce(text, '')"
COUNTS = []
for _name, _pattern in tx.SECRETS:
    COUNTS.append(f"len(regexp_extract_all({FOUND}, '{_pattern}'))")
    FOUND = f"regexp_replace({FOUND}, '{_pattern}', '[REDACTED:{_name}]', 'g')"
SQL = {
    "secret_redaction": f"SELECT doc_id, secrets, length FROM (SELECT doc_id, CAST({' + '.join(COUNTS)} AS BIGINT) AS secrets, CAST(length({MASKED}) AS BIGINT) AS length FROM documents) WHERE secrets > 0",
    "review_queue": QUEUE_SQL + "SELECT * FROM queue", "review_severity": QUEUE_SQL + "SELECT category, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM queue GROUP BY 1",
    "customer_dashboard": NOTES_SQL + "SELECT source AS client, count(*) AS notes, CAST(sum(open_todos) AS BIGINT) AS open_todos, count(*) FILTER (list_contains(tags, 'decision')) AS decisions, strftime(max(last_modified), '%Y-%m-%d') AS latest FROM notes WHERE starts_with(rel_path, 'Kunden/') GROUP BY 1",
    "customer_timeline": NOTES_SQL + "SELECT rel_path, coalesce(datum, strftime(last_modified, '%Y-%m-%d')) AS day, CASE WHEN list_contains(tags, 'decision') THEN 'decision' WHEN open_todos + done_todos > 0 THEN 'task' ELSE 'note' END AS kind FROM notes WHERE starts_with(rel_path, 'Kunden/')",
    "knowledge_index": NOTES_SQL + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20",
    "knowledge_metrics": NOTES_SQL + "SELECT count(*) AS notes, count(*) FILTER (NOT starts_with(lower(rel_path), 'archiv/')) AS active, count(*) FILTER (list_contains(tags, 'claim')) AS claims, count(*) FILTER (list_contains(tags, 'decision')) AS decisions, count(confidence) AS with_confidence, CAST(sum(len(out_links)) AS BIGINT) AS links, CAST(sum(open_todos + done_todos) AS BIGINT) AS todos, (SELECT count(*) FROM links) AS edges, (SELECT count(DISTINCT dst) FROM links) AS linked FROM notes",
    "page_profile": "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<h[1-6]>')) AS BIGINT) AS n_headings, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links, CAST(len(list_filter(string_split_regex(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM pages",
    "rule_quality": "WITH f AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE NOT regexp_matches(text, '[!*#$%&]{2}')), e AS (SELECT doc_id FROM labels WHERE quality = 1), c AS (SELECT (SELECT count(*) FROM f WHERE doc_id IN (SELECT doc_id FROM e)) AS hit, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM e) AS expected) SELECT round(hit / found, 6) AS precision, round(hit / expected, 6) AS recall, round(1.25 * (hit / found) * (hit / expected) / (0.25 * hit / found + hit / expected), 6) AS f05 FROM c",
}
