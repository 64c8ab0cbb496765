"""Filters, rollups and rankings over notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import markdown as md
from lorewell.operators import links as links_of
from lorewell.sources.tables import AS_OF, NOTES_SQL, notes

DAY_MS = 86_400_000


def age_days(modified: Column, as_of: str = AS_OF) -> Column:
    return F.floor((F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis(modified.cast("timestamp"))) / DAY_MS)


def is_active_path(path: Column) -> Column:
    """Not in the archive folder, in whatever case."""
    return ~F.lower(path).startswith("archiv/")


def folder_counts(n: DataFrame) -> DataFrame:
    top = F.when(F.contains("rel_path", F.lit("/")), F.substring_index("rel_path", "/", 1)).otherwise("(root)")
    return n.groupBy(top.alias("folder")).agg(F.count("*").alias("n"))


def tag_frequency(n: DataFrame) -> DataFrame:
    return n.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def open_todos(n: DataFrame) -> DataFrame:
    """Open todos of each file that has any."""
    open_count = F.size(F.filter("todos", lambda t: ~t["done"])).cast("long")
    return n.select("rel_path", open_count.alias("open_todos")).filter("open_todos > 0")


def stale_notes(n: DataFrame, days: int = 180) -> DataFrame:
    """Active notes whose last change is longer ago than so many days, with whole days of age."""
    skip = F.col("rel_path").startswith("Archiv/") | F.col("rel_path").startswith("Daily/") | (md.basename(F.col("rel_path")) == "_MOC")
    old = F.unix_millis(F.lit(AS_OF).cast("timestamp")) - F.unix_millis(F.col("last_modified").cast("timestamp")) > days * DAY_MS
    return n.filter((F.col("frontmatter")["status"] == "aktiv") & old & ~skip).select("rel_path", age_days(F.col("last_modified")).alias("age"))


def filtered(n: DataFrame, folder: str | None = None, tags: tuple[str, ...] = (), status: str | None = None) -> DataFrame:
    if folder:
        n = n.filter(F.lower("rel_path").startswith(folder.lower()))
    if tags:
        n = n.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.col("tags"))) == 0)
    if status:
        n = n.filter(F.lower(F.col("frontmatter")["status"]) == status.lower())
    return n


def weekly_review(n: DataFrame, days: int = 7) -> DataFrame:
    """section, name, n: notes changed in the window, those of them also dated in it, todos, and notes of each active project."""
    since = F.lit(AS_OF).cast("timestamp") - F.expr(f"interval {days} days")
    fm = F.col("frontmatter")
    changed = F.col("last_modified").cast("timestamp") >= since
    dated = F.coalesce(F.try_to_timestamp(F.coalesce(fm["datum"], fm["erstellt"]), F.lit("yyyy-MM-dd")) >= since, F.lit(False))
    n_todos = lambda done: F.size(F.filter("todos", lambda t: t["done"] == F.lit(done))).cast("long")
    sections = [("modified", changed.cast("long")), ("new", (changed & dated).cast("long")), ("open_todos", n_todos(False)), ("completed_todos", n_todos(True))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.lit("").alias("name"), v.alias("n")) for k, v in sections], F.when(fm["projekt"].isNotNull() & (fm["status"] == "aktiv"), F.struct(F.lit("project").alias("section"), fm["projekt"].alias("name"), F.lit(1).cast("long").alias("n")))))
    return n.select(each.alias("x")).filter("x IS NOT NULL").groupBy("x.section", "x.name").agg(F.sum("x.n").alias("n"))


def ancestor_folders(n: DataFrame, depth: int = 3, least: int = 2) -> DataFrame:
    """Notes counted into every ancestor folder up to the depth; folders with at least `least` notes."""
    parts = F.split(md.folder(F.col("rel_path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return n.select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count("*").alias("n")).filter(f"n >= {least}")


def recent(n: DataFrame, k: int = 10) -> DataFrame:
    return n.orderBy(F.desc("last_modified"), "rel_path").limit(k).select("rel_path", "title", F.date_format("last_modified", "yyyy-MM-dd").alias("day"))


PENALTY_WORDS = ("notizen", "todo", "todos", "untitled", "problem")


def quality_penalties(n: DataFrame, degrees: DataFrame) -> DataFrame:
    """rel_path, title, penalties (dimension, points), score and grade of every note. degrees: rel_path, inbound."""
    fm, path, content = F.col("frontmatter"), F.col("rel_path"), F.col("content")
    n = n.join(degrees, "rel_path", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    n = n.withColumns({"words": md.word_count(content), "h1": md.heading_count(content, 1), "h2": md.heading_count(content, 2), "code": md.code_blocks(content), "items": md.list_lines(content), "age": age_days(F.col("last_modified"))})
    archived, outbound = path.startswith("Archiv/"), F.size("out_links")
    normal = F.transform("tags", lambda t: F.lower(F.trim(F.regexp_replace(t, "^#", ""))))
    rules = [
        ("title", F.when((F.length("title") < 6) | F.lower("title").isin(*PENALTY_WORDS), 35).when(F.length("title") > 80, 15)),
        ("frontmatter", F.when(fm["status"].isNull() & ~archived, 25)), ("frontmatter", F.when(F.coalesce(fm["datum"], fm["erstellt"], fm["aktualisiert"]).isNull(), 15)),
        ("tags", F.when(F.size("tags") == 0, 30).when(F.col("tags") != normal, 15)), ("tags", F.when(F.size("tags") > 10, 10)),
        ("links", F.when((F.col("inbound") == 0) & (outbound == 0), 30).when(F.col("inbound") == 0, 15).when(outbound == 0, 10)),
        ("todos", F.when(F.exists("todos", lambda t: ~t["done"] & (F.length(t["text"]) < 8)), 15)),
        ("structure", F.when(F.col("h1") == 0, 20).when(F.col("h1") > 1, 10)), ("structure", F.when((F.col("words") > 120) & (F.col("h2") == 0), 15)),
        ("content", F.when((F.col("words") < 20) & (F.size("todos") == 0), 25)), ("content", F.when((F.col("code") >= 2) & (F.col("words") < 80), 20)), ("content", F.when((F.col("items") > 20) & (F.col("h2") < 2), 10)),
        ("freshness", F.when((fm["status"] == "aktiv") & (F.col("age") > 180) & ~archived, 20)),
    ]
    issues = F.filter(F.array(*[F.struct(F.lit(d).alias("dimension"), p.alias("points")) for d, p in rules]), lambda x: x["points"].isNotNull())
    n = n.withColumn("issues", issues).withColumn("penalty", F.aggregate("issues", F.lit(0), lambda a, x: a + x["points"]))
    score = F.greatest(F.lit(0), F.lit(100) - F.col("penalty"))
    n = n.withColumn("score", score.cast("long"))
    return n.withColumn("grade", F.when(F.col("score") >= 85, "excellent").when(F.col("score") >= 70, "good").when(F.col("score") >= 50, "fair").otherwise("poor"))


def judged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_penalties(notes(spark, sf_dir), links_of.backlink_counts(links_of.edges_of(spark, sf_dir)))


def skippable(n: DataFrame) -> Column:
    path = F.col("rel_path")
    return path.startswith("Daily/") | path.startswith("Maintenance/") | (md.basename(path) == "_MOC") | F.array_contains("tags", "daily") | (F.coalesce(F.col("frontmatter")["quelle"], F.lit("")) == "vault-gardener")


def quality_summary(q: DataFrame) -> DataFrame:
    q = q.filter(~skippable(q))
    return q.agg(F.count("*").alias("total"), *[F.count_if(F.col("grade") == g).alias(g) for g in ("excellent", "good", "fair", "poor")], F.round(F.avg("score")).cast("long").alias("average_score"))


def lifecycle(q: DataFrame) -> DataFrame:
    """First matching rule of each note: action, recommended status, confidence."""
    status = F.lower(F.trim(F.col("frontmatter")["status"]))
    status = F.when(status != "", status)
    path, age, outbound, inbound = F.col("rel_path"), F.col("age"), F.size("out_links"), F.col("inbound")
    n_open = F.size(F.filter("todos", lambda t: ~t["done"]))
    usable = (F.col("score") >= 50) | (F.size("tags") > 0) | (inbound + outbound > 0)
    rule = lambda a, s, c: F.struct(F.lit(a).alias("action"), F.lit(s).alias("recommended"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"))
    found = (
        F.when(path.startswith("Archiv/") & (F.coalesce(status, F.lit("")) != "archiviert"), rule("archive", "archiviert", "high"))
        .when(status.isNull() & usable, rule("activate", "aktiv", "high")).when(status.isNull(), rule("review", "entwurf", "medium"))
        .when((status == "aktiv") & (age >= 365) & (n_open == 0), rule("archive", "archiviert", F.when(inbound == 0, "high").otherwise("medium")))
        .when((status == "aktiv") & (age >= 180), rule("review", "aktiv", "low"))
        .when(status.isin("planung", "entwurf") & (age >= 120) & (n_open == 0), rule("archive", "archiviert", "medium"))
        .when((status == "aktiv") & (F.col("score") < 40) & (inbound == 0) & (outbound == 0), rule("review", "entwurf", "low"))
    )
    generated = F.coalesce(F.col("frontmatter")["quelle"], F.lit("")).isin("moc-generator", "vault-gardener", "customer-dashboard")
    skip = path.startswith("Daily/") | path.startswith("Maintenance/") | (md.basename(path) == "_MOC") | generated
    return q.filter(~skip).withColumn("rule", found).filter("rule IS NOT NULL").select("rel_path", "rule.*", "age")


#: Tags that make a note carry evidence.
EVIDENCE_TAGS = ("insight", "decision", "answer", "claim", "source")


def evidence_candidates(n: DataFrame) -> DataFrame:
    """Active notes under Knowledge/ or with a tag of evidence."""
    return n.filter(is_active_path(F.col("rel_path")) & (F.col("rel_path").startswith("Knowledge/") | F.arrays_overlap("tags", F.array(*[F.lit(t) for t in EVIDENCE_TAGS]))))


def evidence_issues(n: DataFrame, today: str = AS_OF[:10]) -> DataFrame:
    """One row an issue of the notes that carry evidence."""
    fm = F.col("frontmatter")
    issue = lambda name, severity: F.struct(F.lit(name).alias("issue"), severity.alias("severity"))
    strong = F.when(F.arrays_overlap("tags", F.array(F.lit("decision"), F.lit("claim"))), "high").otherwise("medium")
    past = lambda c: F.coalesce(c < F.lit(today), F.lit(False))
    all_issues = F.array(
        F.when(fm["confidence"].isNull(), issue("confidence", strong)), F.when(F.coalesce(fm["quelle"], fm["source"]).isNull() & ~F.array_contains("tags", "source"), issue("source", F.lit("medium"))),
        F.when(past(fm["recheck_at"]) | past(fm["expires_at"]), issue("due", F.lit("high"))), F.when(F.size(md.list_value(F.coalesce(fm["contradicted_by"], F.lit("")))) > 0, issue("contradicted", F.lit("high"))),
    )
    return evidence_candidates(n).select("rel_path", F.explode(F.filter(all_issues, lambda x: x.isNotNull())).alias("i")).select("rel_path", "i.*")


#: Fixed values of the frontmatter profiles: required fields, recommended tags, statuses and date fields; and known fields.
PROFILES = {
    "Kunde": (("tags", "kunde"), ("kunde",)), "Referenz": (("tags",), ()), "Troubleshooting": (("tags",), ("troubleshooting",)), "Learning": (("tags",), ("learning",)), "Runbook": (("tags", "quelle"), ("runbook",)), "Daily": (("tags", "datum"), ("daily",)),
    "Maintenance-Report": (("tags", "aktualisiert", "quelle"), ("maintenance", "review-queue")), "Auto-Capture": (("tags", "datum", "quelle"), ("auto-capture",)), "MOC": (("tags", "quelle"), ("moc",)),
}
STATUSES = ("aktiv", "planung", "archiviert", "entwurf", "moc")
DATE_FIELDS = ("datum", "erstellt", "aktualisiert")


def normal_tag(tag: Column, aliases: dict[str, str] | None = None) -> Column:
    """Trimmed, lower case, hyphens for spaces; aliases by their canonical tag."""
    clean = F.regexp_replace(F.lower(F.trim(tag)), r"\s+", "-")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[clean], clean) if aliases else clean


def profile_of(path: Column, fm: Column, tags: Column) -> Column:
    """The profile that the note names, else that of its path, source and (normal, frontmatter) tags."""
    told = F.coalesce(fm["profile"], fm["typ"], fm["type"])
    has = lambda t: F.array_contains(tags, t)
    source = F.coalesce(fm["quelle"], F.lit(""))
    return (
        F.when(told.isin(*PROFILES), told).when(path.startswith("Daily/") | has("daily"), "Daily").when(path.startswith("Maintenance/") | (source == "vault-gardener") | has("maintenance"), "Maintenance-Report")
        .when(path.endswith("_MOC.md") | (F.coalesce(fm["status"], F.lit("")) == "moc") | has("moc"), "MOC").when((source == "knowledge-harvester") | has("auto-capture"), "Auto-Capture").when(path.startswith("Kunden/"), "Kunde")
        .when(has("runbook") | path.startswith("Runbooks/"), "Runbook").when(has("troubleshooting"), "Troubleshooting").when(has("learning"), "Learning").otherwise("Referenz")
    )


def frontmatter_lint(n: DataFrame, profile: str | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """rel_path, profile, field, severity, issue, auto_fixable: one row an issue of a note's frontmatter."""
    path, fm = F.col("rel_path"), F.col("frontmatter")
    n = n.withColumn("listed", md.listed_tags(fm["tags"])).withColumn("normal", F.transform("listed", lambda t: normal_tag(t, aliases)))
    n = n.withColumn("profile", F.lit(profile) if profile else profile_of(path, fm, F.col("normal")))
    issue = lambda field, severity, text, fix: F.struct((F.lit(field) if isinstance(field, str) else field).alias("field"), F.lit(severity).alias("severity"), (F.lit(text) if isinstance(text, str) else text).alias("issue"), (F.lit(fix) if isinstance(fix, bool) else fix).alias("auto_fixable"))
    of = lambda k: F.create_map(*[x for name, v in PROFILES.items() for x in (F.lit(name), F.array(*[F.lit(y) for y in v[k]]).cast("array<string>"))])[F.col("profile")]
    asks = ~path.startswith("Archiv/") & (F.col("profile") != "Daily")
    single = [F.when(asks & fm["status"].isNull(), issue("status", "warning", "status fehlt", True)), F.when(asks & ~F.lower(fm["status"]).isin(*STATUSES), issue("status", "warning", F.concat(F.lit('Unbekannter Status "'), fm["status"], F.lit('"')), False))]
    single += [F.when(~fm[d].rlike(r"^\d{4}-\d{2}-\d{2}$"), issue(d, "warning", F.concat(F.lit(f'{d}: "'), fm[d], F.lit('" ist kein ISO-Datum')), False)) for d in DATE_FIELDS]
    twice = F.size("normal") - F.size(F.array_distinct("normal"))
    single.append(F.when(twice > 0, issue("tags", "info", F.concat(twice.cast("string"), F.lit(" doppelte Tag(s)")), True)))
    pairs = F.filter(F.arrays_zip("listed", "normal"), lambda x: x["listed"] != x["normal"])
    tags = F.transform(pairs, lambda x: issue("tags", "info", F.concat(F.lit('Tag "'), x["listed"], F.lit('" sollte "'), x["normal"], F.lit('" sein')), True))
    names = F.transform(F.filter(F.map_keys(fm), lambda k: ~k.startswith("_") & (F.lower(k) != k)), lambda k: issue(k, "info", F.concat(F.lit('Feldname "'), k, F.lit('" sollte lowercase sein')), True))
    lacking = F.filter(of(0), lambda k: F.coalesce(F.element_at(fm, k), F.lit("")) == "")
    required = F.transform(lacking, lambda k: issue(k, "warning", F.concat(F.col("profile"), F.lit('-Profil benötigt "'), k, F.lit('"')), (k != "kunde") | path.rlike("^Kunden/[^/]+")))
    advised = F.transform(F.array_except(of(1), "normal"), lambda t: issue("tags", "info", F.concat(F.col("profile"), F.lit('-Profil empfiehlt Tag "'), t, F.lit('"')), True))
    issues = F.concat(F.filter(F.array(*single), lambda x: x.isNotNull()), tags, names, required, advised)
    return n.select("rel_path", "profile", F.explode(issues).alias("i")).select("rel_path", "profile", "i.*")


QUALITY_SQL = NOTES_SQL + """,
inbound AS (SELECT dst, count(*) AS n FROM links GROUP BY dst),
parts AS (SELECT n.*, coalesce(i.n, 0) AS inbound, CAST(floor((epoch_ms(TIMESTAMP '2024-06-01') - epoch_ms(last_modified)) / 86400000) AS BIGINT) AS age,
  len(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(content, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), '(?m)^#+\\s+.+$', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS words,
  len(regexp_extract_all(content, '(?m)^#\\s+\\S')) AS h1, len(regexp_extract_all(content, '(?m)^##\\s+\\S')) AS h2, len(regexp_extract_all(content, '(?s)```.*?```')) AS code,
  len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\\s*[-*]\\s+') OR regexp_matches(x, '^\\s*\\d+\\.\\s+'))) AS items,
  len(list_filter(tasks, lambda x: regexp_matches(x, '^\\s*- \\[ \\]') AND length(trim(regexp_extract(x, '^\\s*- \\[[ xX]\\]\\s+(.+)', 1))) < 8)) AS short_todos FROM notes n LEFT JOIN inbound i ON i.dst = n.rel_path),
graded AS (SELECT *, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS grade FROM (SELECT *, greatest(0, 100
  - CASE WHEN length(title) < 6 OR lower(title) IN ('notizen','todo','todos','untitled','problem') THEN 35 WHEN length(title) > 80 THEN 15 ELSE 0 END
  - CASE WHEN status IS NULL AND NOT starts_with(rel_path, 'Archiv/') THEN 25 ELSE 0 END - CASE WHEN datum IS NULL THEN 15 ELSE 0 END
  - CASE WHEN len(tags) = 0 THEN 30 WHEN len(list_filter(tags, lambda t: t <> trim(t) OR starts_with(t, '#'))) > 0 THEN 15 ELSE 0 END - CASE WHEN len(tags) > 10 THEN 10 ELSE 0 END
  - CASE WHEN inbound = 0 AND len(out_links) = 0 THEN 30 WHEN inbound = 0 THEN 15 WHEN len(out_links) = 0 THEN 10 ELSE 0 END
  - CASE WHEN short_todos > 0 THEN 15 ELSE 0 END - CASE WHEN h1 = 0 THEN 20 WHEN h1 > 1 THEN 10 ELSE 0 END - CASE WHEN words > 120 AND h2 = 0 THEN 15 ELSE 0 END
  - CASE WHEN words < 20 AND len(tasks) = 0 THEN 25 ELSE 0 END - CASE WHEN code >= 2 AND words < 80 THEN 20 ELSE 0 END - CASE WHEN items > 20 AND h2 < 2 THEN 10 ELSE 0 END
  - CASE WHEN status = 'aktiv' AND age > 180 AND NOT starts_with(rel_path, 'Archiv/') THEN 20 ELSE 0 END) AS score FROM parts))
"""

QUERIES = {
    "folder_counts": lambda s, d: folder_counts(notes(s, d)), "tag_frequency": lambda s, d: tag_frequency(notes(s, d)), "open_todos": lambda s, d: open_todos(notes(s, d)),
    "stale_notes": lambda s, d: stale_notes(notes(s, d)), "filtered_notes": lambda s, d: filtered(notes(s, d), "src", ("en",), "AKTIV").select("rel_path", "title", F.coalesce(F.col("frontmatter")["datum"], F.col("frontmatter")["erstellt"]).alias("datum")),
    "weekly_review": lambda s, d: weekly_review(notes(s, d)), "ancestor_folders": lambda s, d: ancestor_folders(notes(s, d)), "recent_notes": lambda s, d: recent(notes(s, d)),
    "note_quality": lambda s, d: judged_notes(s, d).select("rel_path", "score", "grade"), "quality_summary": lambda s, d: quality_summary(judged_notes(s, d)), "lifecycle_suggestions": lambda s, d: lifecycle(judged_notes(s, d)),
    "evidence_issues": lambda s, d: evidence_issues(notes(s, d)), "evidence_report": lambda s, d: evidence_issues(notes(s, d)).groupBy("issue", "severity").agg(F.count("*").alias("n")), "frontmatter_lint": lambda s, d: frontmatter_lint(notes(s, d)),
}

EVIDENCE_SQL = NOTES_SQL + """, cand AS (SELECT * FROM notes WHERE NOT starts_with(lower(rel_path), 'archiv/') AND (starts_with(rel_path, 'Knowledge/') OR list_has_any(tags, ['insight', 'decision', 'answer', 'claim', 'source']))),
issues AS (
  SELECT rel_path, 'confidence' AS issue, CASE WHEN list_has_any(tags, ['decision', 'claim']) THEN 'high' ELSE 'medium' END AS severity FROM cand WHERE confidence IS NULL
  UNION ALL SELECT rel_path, 'source', 'medium' FROM cand WHERE quelle IS NULL AND NOT list_contains(tags, 'source')
  UNION ALL SELECT rel_path, 'due', 'high' FROM cand WHERE recheck_at < '2024-06-01'
  UNION ALL SELECT rel_path, 'contradicted', 'high' FROM cand WHERE contradicted_by IS NOT NULL)
"""

SQL = {
    "folder_counts": NOTES_SQL + "SELECT split_part(rel_path, '/', 1) AS folder, count(*) AS n FROM notes GROUP BY 1",
    "tag_frequency": NOTES_SQL + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) GROUP BY 1",
    "open_todos": NOTES_SQL + "SELECT rel_path, CAST(open_todos AS BIGINT) AS open_todos FROM notes WHERE open_todos > 0",
    "stale_notes": NOTES_SQL + "SELECT rel_path, CAST(floor((epoch_ms(TIMESTAMP '2024-06-01') - epoch_ms(last_modified)) / 86400000) AS BIGINT) AS age FROM notes WHERE status = 'aktiv' AND last_modified < TIMESTAMP '2024-06-01' - to_days(180) AND NOT starts_with(rel_path, 'Archiv/') AND NOT starts_with(rel_path, 'Daily/')",
    "filtered_notes": NOTES_SQL + "SELECT rel_path, title, datum FROM notes WHERE starts_with(lower(rel_path), 'src') AND list_contains(tags, 'en') AND status = 'aktiv'",
    "weekly_review": NOTES_SQL + "SELECT section, name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'modified' AS section, '' AS name, CASE WHEN last_modified >= TIMESTAMP '2024-05-25' THEN 1 ELSE 0 END AS n FROM notes UNION ALL SELECT 'new', '', CASE WHEN last_modified >= TIMESTAMP '2024-05-25' AND regexp_matches(datum, '^....-') AND datum >= '2024-05-25' THEN 1 ELSE 0 END FROM notes UNION ALL SELECT 'open_todos', '', open_todos FROM notes UNION ALL SELECT 'completed_todos', '', done_todos FROM notes UNION ALL SELECT 'project', projekt, 1 FROM notes WHERE projekt IS NOT NULL AND status = 'aktiv') GROUP BY 1, 2",
    "ancestor_folders": NOTES_SQL + "SELECT folder, count(*) AS n FROM (SELECT unnest(list_transform(range(1, least(len(p), 3) + 1), lambda i: array_to_string(p[1:i], '/'))) AS folder FROM (SELECT list_slice(string_split(rel_path, '/'), 1, -2) AS p FROM notes)) GROUP BY 1 HAVING count(*) >= 2",
    "recent_notes": NOTES_SQL + "SELECT rel_path, title, strftime(last_modified, '%Y-%m-%d') AS day FROM notes ORDER BY last_modified DESC, rel_path LIMIT 10",
    "note_quality": QUALITY_SQL + "SELECT rel_path, CAST(score AS BIGINT) AS score, grade FROM graded",
    "quality_summary": QUALITY_SQL + "SELECT count(*) AS total, count(*) FILTER (grade = 'excellent') AS excellent, count(*) FILTER (grade = 'good') AS good, count(*) FILTER (grade = 'fair') AS fair, count(*) FILTER (grade = 'poor') AS poor, CAST(round(avg(score)) AS BIGINT) AS average_score FROM graded WHERE NOT starts_with(rel_path, 'Daily/') AND NOT starts_with(rel_path, 'Maintenance/') AND NOT list_contains(tags, 'daily') AND coalesce(quelle, '') <> 'vault-gardener'",
    "lifecycle_suggestions": QUALITY_SQL + """SELECT rel_path, rule.action AS action, rule.recommended AS recommended, rule.confidence AS confidence, age FROM (SELECT *, CASE
      WHEN starts_with(rel_path, 'Archiv/') AND coalesce(status, '') <> 'archiviert' THEN {'action': 'archive', 'recommended': 'archiviert', 'confidence': 'high'}
      WHEN status IS NULL THEN {'action': 'activate', 'recommended': 'aktiv', 'confidence': 'high'}
      WHEN status = 'aktiv' AND age >= 365 AND open_todos = 0 THEN {'action': 'archive', 'recommended': 'archiviert', 'confidence': CASE WHEN inbound = 0 THEN 'high' ELSE 'medium' END}
      WHEN status = 'aktiv' AND age >= 180 THEN {'action': 'review', 'recommended': 'aktiv', 'confidence': 'low'}
      WHEN status = 'planung' AND age >= 120 AND open_todos = 0 THEN {'action': 'archive', 'recommended': 'archiviert', 'confidence': 'medium'}
      WHEN status = 'aktiv' AND score < 40 AND inbound = 0 AND len(out_links) = 0 THEN {'action': 'review', 'recommended': 'entwurf', 'confidence': 'low'} END AS rule
      FROM graded WHERE NOT starts_with(rel_path, 'Daily/') AND NOT starts_with(rel_path, 'Maintenance/')) WHERE rule IS NOT NULL""",
    "evidence_issues": EVIDENCE_SQL + "SELECT * FROM issues",
    "evidence_report": EVIDENCE_SQL + "SELECT issue, severity, count(*) AS n FROM issues GROUP BY 1, 2",
    "frontmatter_lint": NOTES_SQL + """, t AS (SELECT *, list_transform(listed, lambda x: regexp_replace(lower(trim(x)), '\\s+', '-', 'g')) AS normal, regexp_matches(fm, '(?m)^tags:') AS tagged FROM (SELECT n.*, c.fm FROM notes n JOIN cut c USING (doc_id))),
      p AS (SELECT *, CASE WHEN starts_with(rel_path, 'Daily/') OR list_contains(normal, 'daily') THEN 'Daily' WHEN starts_with(rel_path, 'Maintenance/') OR list_contains(normal, 'maintenance') THEN 'Maintenance-Report' WHEN list_contains(normal, 'moc') THEN 'MOC'
        WHEN quelle = 'knowledge-harvester' OR list_contains(normal, 'auto-capture') THEN 'Auto-Capture' WHEN starts_with(rel_path, 'Kunden/') THEN 'Kunde' WHEN list_contains(normal, 'runbook') THEN 'Runbook' WHEN list_contains(normal, 'troubleshooting') THEN 'Troubleshooting' WHEN list_contains(normal, 'learning') THEN 'Learning' ELSE 'Referenz' END AS profile FROM t),
      need AS (SELECT * FROM (VALUES ('Kunde', 'kunde'), ('Runbook', 'quelle'), ('Daily', 'datum'), ('Maintenance-Report', 'aktualisiert'), ('Maintenance-Report', 'quelle'), ('Auto-Capture', 'datum'), ('Auto-Capture', 'quelle'), ('MOC', 'quelle')) v(profile, field)),
      advise AS (SELECT * FROM (VALUES ('Kunde', 'kunde'), ('Troubleshooting', 'troubleshooting'), ('Learning', 'learning'), ('Runbook', 'runbook'), ('Daily', 'daily'), ('Maintenance-Report', 'maintenance'), ('Maintenance-Report', 'review-queue'), ('Auto-Capture', 'auto-capture'), ('MOC', 'moc')) v(profile, tag))
      SELECT rel_path, profile, 'status' AS field, 'warning' AS severity, 'status fehlt' AS issue, true AS auto_fixable FROM p WHERE status IS NULL AND NOT starts_with(rel_path, 'Archiv/') AND profile <> 'Daily'
      UNION ALL SELECT rel_path, profile, 'datum', 'warning', 'datum: "' || datum || '" ist kein ISO-Datum', false FROM p WHERE NOT regexp_matches(datum, '^\\d{4}-\\d{2}-\\d{2}$')
      UNION ALL SELECT rel_path, profile, 'tags', 'info', 'Tag "' || l || '" sollte "' || m || '" sein', true FROM (SELECT rel_path, profile, unnest(listed) AS l, unnest(normal) AS m FROM p) WHERE l <> m
      UNION ALL SELECT rel_path, profile, 'tags', 'info', len(normal) - len(list_distinct(normal)) || ' doppelte Tag(s)', true FROM p WHERE len(normal) > len(list_distinct(normal))
      UNION ALL SELECT rel_path, profile, 'Owner', 'info', 'Feldname "Owner" sollte lowercase sein', true FROM p WHERE owner IS NOT NULL
      UNION ALL SELECT rel_path, profile, field, 'warning', profile || '-Profil benötigt "' || field || '"', true FROM p JOIN need USING (profile) WHERE CASE field WHEN 'quelle' THEN quelle IS NULL WHEN 'datum' THEN datum IS NULL ELSE true END
      UNION ALL SELECT rel_path, profile, 'tags', 'info', profile || '-Profil empfiehlt Tag "' || tag || '"', true FROM p JOIN advise USING (profile) WHERE NOT list_contains(normal, tag)""",
}
