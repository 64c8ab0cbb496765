"""Report queries over notes: inbox, open questions, hot cache, captures, health, maps of content, snippets, runbook sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import markdown as md
from lorewell.functions import text as tx
from lorewell.operators.notes_overview import is_active_path
from lorewell.operators.sessions import matches
from lorewell.sources.tables import AS_OF, NOTES_SQL, notes


def clamped(limit: int, low: int, high: int) -> int:
    return max(low, min(int(limit), high))


#: Folders whose notes the knowledge index counts.
INDEX_FOLDERS = ("Kunden/", "Technik/", "Knowledge/", "Daily/", "Maintenance/", "Archiv/")


def prefix_counts(n: DataFrame, prefixes: tuple[str, ...] = INDEX_FOLDERS) -> DataFrame:
    """Notes under each prefix, 0 included."""
    counts = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.col("rel_path").startswith(p).cast("long").alias("n")) for p in prefixes]))
    return n.select(counts.alias("c")).groupBy("c.prefix").agg(F.sum("c.n").alias("n"))


def open_questions(n: DataFrame) -> DataFrame:
    """rel_path, kind, context of unresolved gaps and contradictions of active notes."""
    path, tags = F.col("rel_path"), F.col("tags")
    asks = path.startswith("Knowledge/Gaps/") | path.startswith("Knowledge/Contradictions/") | F.array_contains(tags, "open-question")
    n = n.filter(is_active_path(path) & asks & (F.coalesce(F.col("frontmatter")["status"], F.lit("")) != "resolved"))
    kind = F.when(path.startswith("Knowledge/Contradictions/") | F.array_contains(tags, "contradiction"), "contradiction").otherwise("gap")
    return n.select("rel_path", kind.alias("kind"), F.trim(F.array_join(F.slice(F.split("content", "\n"), 1, 12), "\n")).alias("context"), "last_modified")


def hot_cache(n: DataFrame, most: int = 8, todos: int = 12) -> DataFrame:
    """The newest active notes and the open todos of the newest notes that have some: section, rel_path, item."""
    active = n.filter(is_active_path(F.col("rel_path")))
    new = active.orderBy(F.desc("last_modified"), "rel_path").limit(clamped(most, 1, 20)).select(F.lit("note").alias("section"), "rel_path", F.col("title").alias("item"))
    open_ = active.select("rel_path", "last_modified", F.explode(F.filter("todos", lambda t: ~t["done"])).alias("t"))
    open_ = open_.orderBy(F.desc("last_modified"), "rel_path", "t.line").limit(todos).select(F.lit("todo").alias("section"), "rel_path", F.col("t.text").alias("item"))
    return new.union(open_)


def is_capture(n: DataFrame) -> Column:
    """Written by the harvester: by source, stage, frontmatter tag or folder."""
    fm = F.col("frontmatter")
    return (F.coalesce(fm["quelle"], F.lit("")) == "knowledge-harvester") | (F.coalesce(fm["source_stage"], F.lit("")) == "stop_capture") | F.array_contains(md.list_value(F.coalesce(fm["tags"], F.lit(""))), "auto-capture") | F.col("rel_path").rlike("(^|/)Captures/")


def inbox_items(n: DataFrame) -> DataFrame:
    """item_id, kind, target, fingerprint of what waits for a decision: provisional claims (to confirm and to reject), session
    reports, doubtful client matches and captures that may become runbooks."""
    fm, path = F.col("frontmatter"), F.col("rel_path")
    n = n.filter(is_active_path(path)).withColumn("capture", is_capture(n))
    claim = F.array_contains("tags", "claim") & (F.coalesce(fm["claim_status"], F.lit("provisional")) == "provisional")
    impact = path.startswith("Maintenance/Session Impact/") | F.array_contains("tags", "session-impact")
    doubtful = F.col("capture") & F.coalesce(fm["client_match_method"], F.lit("")).isin("fuzzy_cwd", "exact_content", "unknown_cwd")
    ready = F.col("capture") & ((F.coalesce(F.try_to_number(fm["runbook_readiness"], F.lit("999")).cast("int"), F.lit(0)) >= 55) | F.contains(F.lower("content"), F.lit("## durchgeführte befehle")))
    kinds = F.array(F.when(claim, "confirm_claim"), F.when(claim, "reject_claim"), F.when(impact, "review_impact_report"), F.when(doubtful, "review_client_alias"), F.when(ready, "runbook_preview"))
    fingerprint = F.substring(F.sha2(F.concat_ws("\n", "title", "content"), 256), 1, 16)
    return n.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), path.alias("target"), fingerprint.alias("fingerprint")).select(F.concat_ws(":", F.lit("inbox"), "kind", "target").alias("item_id"), "kind", "target", "fingerprint")


def open_items(items: DataFrame, state: DataFrame, now: str = AS_OF) -> DataFrame:
    """items that no state (item_id, fingerprint, status, snoozed_until) settles: a state counts for the contents it was given
    for, and a snooze until its time."""
    s = state.select("item_id", F.col("fingerprint").alias("known"), "status", "snoozed_until")
    j = items.join(s, (items["item_id"] == s["item_id"]) & (items["fingerprint"] == s["known"]), "left").select(items["*"], "status", "snoozed_until")
    expired = (F.col("status") == "snoozed") & (F.col("snoozed_until") <= F.lit(now).cast("timestamp_ntz"))
    return j.filter(F.col("status").isNull() | (F.col("status") == "open") | expired).select(*items.columns)


def sample_state(items: DataFrame) -> DataFrame:
    """A made-up state of some items: settled, snoozed on and out, and settled for contents that have changed since."""
    k = F.pmod(F.length("target") + F.length("kind"), F.lit(5))
    status = F.when(k == 0, "done").when(k == 1, "snoozed").when(k == 2, "snoozed").when(k == 3, "done")
    until = F.when(k == 1, F.lit("2024-07-01 00:00:00")).when(k == 2, F.lit("2024-05-01 00:00:00")).cast("timestamp_ntz")
    return items.select("item_id", F.when(k == 3, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), status.alias("status"), until.alias("snoozed_until")).filter("status IS NOT NULL")


def capture_review(n: DataFrame) -> DataFrame:
    """Counts of captures, of those that may become runbooks, and of doubtful client matches."""
    c = n.filter(is_capture(n))
    promising = F.array_contains("tags", "prozedur") | matches("content", "## Durchgef.hrte (?:Befehle|Schritte)") | matches("content", "## Fehler und Workarounds") | (F.regexp_count("content", F.lit(r"(?m)^\d+\.\s+")) >= 3)
    return c.agg(F.count("*").alias("captures"), F.count_if(promising).alias("promising"), F.count_if(F.coalesce(F.col("frontmatter")["client_match_method"], F.lit("")).isin("fuzzy_cwd", "exact_content")).alias("doubtful"))


def content_maps(n: DataFrame, least: int = 2, depth: int = 3, roots: tuple[str, ...] = ("Kunden/", "Technik/")) -> DataFrame:
    """folder, notes, subfolders, action of the maps of content: each note counts in all its folders under the roots, three
    levels deep; folders with fewer notes than `least` are skipped, existing maps are updated."""
    parts = F.split("rel_path", "/")
    each = n.filter(md.basename(F.col("rel_path")) != "_MOC").withColumn("p", parts).filter(F.size("p") >= 2)
    at = F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda i: i <= depth)
    up = lambda i: F.array_join(F.slice("p", F.lit(1), i), "/")
    rows = each.select(F.explode(F.transform(at, lambda i: F.struct(up(i).alias("folder"), F.when(i + 1 < F.size("p"), up(i + 1)).alias("sub")))).alias("x"), "rel_path").select("x.*", "rel_path")
    under = F.lit(False)
    for root in roots:
        under = under | F.col("folder").startswith(root)
    g = rows.filter(under).groupBy("folder").agg(F.count("*").alias("notes"), F.array_join(F.array_sort(F.collect_set("sub")), ",").alias("subfolders"))
    maps = n.filter(md.basename(F.col("rel_path")) == "_MOC").select(md.folder(F.col("rel_path")).alias("folder"), F.lit(True).alias("there"))
    j = g.join(maps, "folder", "left")
    return j.select("folder", "notes", "subfolders", F.when(F.col("notes") < least, "skipped").when(F.col("there"), "updated").otherwise("created").alias("action"))


#: Names of sources whose text no report shows, files that hold secrets, and commands.
SENSITIVE = r"\b(zugangsdaten|credentials?|passw(?:ort|örter|oerter)?|secret|secrets|token|tokens|kennwort|auth)\b"
PROBED = r"\b(\.env|auth-user-pass|id_rsa|credentials?|secrets?|tokens?|passw(?:ort|örter|oerter)?)\b"
READS, SHELL = r"`|\b(cat|grep|find|sed|awk|tail|head|less)\b", r"`[^`]*(?:&&|;|\||\b(?:cat|grep|find|openssl|ssh|docker|systemctl|kubectl|nmap|curl|sed|awk|tail|head)\b)[^`]*`"


def safe_snippet(text: Column, path: Column, title: Column, tags: Column) -> Column:
    """A text as a report may show it: nothing of sensitive sources, no commands, secrets masked."""
    sensitive = matches(path, SENSITIVE) | matches(title, SENSITIVE) | F.exists(tags, lambda t: matches(t, SENSITIVE))
    t = F.trim(text)
    unsafe = matches(t, "<task-notification|toolu_") | (matches(t, PROBED) & matches(t, READS)) | ((F.length(t) > 140) & matches(t, SHELL))
    masked, _ = tx.redacted(text)
    return F.when(sensitive, "[REDACTED_SENSITIVE_NOTE_SNIPPET]").when((t != "") & unsafe, "[REDACTED_COMMAND_SNIPPET]").otherwise(masked)


def first_paragraph(content: Column, least: int = 20, most: int = 420) -> Column:
    """The first paragraph of more than `least` characters after the title."""
    parts = F.transform(F.split(F.regexp_replace(content, r"(?ms)\A(.*?)^#\s+[^\n]+$", "$1"), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.coalesce(F.substring(F.get(F.filter(parts, lambda p: F.length(p) > least), F.lit(0)), 1, most), F.lit(""))


def safe_snippets(n: DataFrame) -> DataFrame:
    return n.select("rel_path", safe_snippet(first_paragraph(F.col("content")), F.col("rel_path"), F.col("title"), F.col("tags")).alias("snippet"))


def file_name(text: Column, most: int = 60) -> Column:
    """A title as a file name: no path marks and control characters, white space folded, no dots at the ends."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\\/:*?\"<>|#^\[\]\x00-\x1f]", " "), r"\s+", " ")
    return F.rtrim(F.substring(F.trim(F.regexp_replace(F.trim(clean), r"^\.+|\.+$", "")), 1, most))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def runbook_sources(n: DataFrame, topic: str, most: int = 12) -> DataFrame:
    """rel_path, pass: captures and procedures that match a topic by path, title or tag, then other notes that do."""
    low = topic.lower()
    hit = F.contains(F.lower("rel_path"), F.lit(low)) | F.contains(F.lower("title"), F.lit(low)) | F.exists("tags", lambda t: F.contains(t, F.lit(low)))
    found = n.filter(is_active_path(F.col("rel_path")) & hit)
    first = found.filter(is_capture(n) | F.array_contains("tags", "prozedur")).select("rel_path", F.lit(1).cast("long").alias("pass"))
    rest = found.select("rel_path", F.lit(2).cast("long").alias("pass")).join(first.select("rel_path"), "rel_path", "left_anti")
    return first.union(rest).orderBy("pass", "rel_path").limit(most)


def review_page(queue: DataFrame, limit: int = 50) -> DataFrame:
    """The first items of a queue by severity, category and id, with their place."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    page = queue.withColumn("rank", rank).orderBy("rank", "category", "id").limit(clamped(limit, 1, 200))
    return page.withColumn("place", F.row_number().over(Window.orderBy("rank", "category", "id")).cast("long")).select("place", "id", "severity", "category")  # a page of 200 rows at most


def severity_cube(queue: DataFrame) -> DataFrame:
    """Items by category and severity, with subtotals."""
    return queue.cube("category", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def processing_queue(n: DataFrame, done: DataFrame, most: int = 25) -> DataFrame:
    """The oldest captures and inbox notes that are not done yet (rel_path), at most so many."""
    waiting = n.filter(is_active_path(F.col("rel_path")) & (is_capture(n) | F.col("rel_path").startswith("Daily/"))).join(done, "rel_path", "left_anti")
    return waiting.orderBy("last_modified", "rel_path").limit(clamped(most, 1, 500)).select("rel_path", "last_modified")


#: Roles of the intents in a capture's readiness.
HANDS_ON, UNDECIDED = ("implementation", "troubleshooting"), ("research", "planning")


def capture_scores_by_text(c: DataFrame) -> DataFrame:
    """rel_path, value, readiness, need of captures that were written without facts (rel_path, content, tags, intent, method,
    redactions): by headings, commands and client match."""
    t = F.col("content")
    commands = F.filter(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"(?s)```(?:bash|sh|shell)?\n(.*?)```"), F.lit(1)), lambda b: F.split(b, "\n"))), lambda x: F.trim(x) != "")
    changing = F.size(F.filter(commands, lambda x: matches(x, r"\b(?:sudo|systemctl|apt|install|restart|rm|mv|cp|tee|chmod|chown|docker|kubectl)\b")))
    has = lambda p: matches(t, p)
    add = lambda on, n: F.when(on, n).otherwise(0)
    summary, flow, fixes, checked = has("## Zusammenfassung"), has("## Ablauf"), has("## Fehler und Workarounds"), has(r"## Validierung|\b(validiert|geprüft|geprueft|erfolgreich getestet)\b")
    many = F.size(commands) >= 3
    value = 25 + add(summary, 15) + add(flow, 15) + add(many, 15) + add(fixes, 15) + add(F.array_contains("tags", "auto-capture"), 5)
    ready = add(F.col("intent").isin(*HANDS_ON), 25) + add(changing > 0, F.least(F.lit(30), 10 + changing * 8)) + add(flow, 15) + add(many, 15) + add(checked, 10) + add(fixes, 5)
    need = 10 + add(F.col("method").isin("fuzzy_cwd", "exact_content"), 30) + add(F.col("method") == "none", 20) + add(F.col("redactions") > 0, 35) + add(F.col("intent").isin(*UNDECIDED), 15) + add(~checked & (ready >= 55), 10)
    whole = lambda c: F.least(F.lit(100), F.greatest(F.lit(0), c)).cast("long")
    return c.select("rel_path", whole(value).alias("value"), whole(ready).alias("readiness"), whole(need).alias("need"))


def sample_captures(n: DataFrame) -> DataFrame:
    """Notes as captures, with headings, commands and routes by their number."""
    k = F.col("doc_id")
    part = lambda on, text: F.when(on, text).otherwise("")
    more = F.concat(part(k % 2 == 0, "\n## Zusammenfassung\n"), part(k % 3 == 0, "\n## Ablauf\n"), part(k % 5 == 0, "\n## Fehler und Workarounds\n"), part(k % 7 == 0, "\n## Validierung\n"), part(k % 4 == 1, "\n```bash\nsudo systemctl restart x\nls\ndocker ps\n```\n"))
    intent = F.get(F.array(*[F.lit(x) for x in ("implementation", "research", "unknown")]), (k % 3).cast("int"))
    method = F.get(F.array(*[F.lit(x) for x in ("fuzzy_cwd", "none", "exact_cwd", "")]), (k % 4).cast("int"))
    return n.select("rel_path", more.alias("content"), "tags", intent.alias("intent"), method.alias("method"), (k % 6 == 0).cast("int").alias("redactions"))


def _queue(s, d):
    from lorewell.operators.surfaces import queue

    return queue(s, d)


QUERIES = {
    "folder_prefix_counts": lambda s, d: prefix_counts(notes(s, d)), "open_questions": lambda s, d: open_questions(_asking(notes(s, d))).drop("last_modified"), "hot_cache": lambda s, d: hot_cache(notes(s, d)), "knowledge_inbox": lambda s, d: inbox_items(notes(s, d)),
    "knowledge_inbox_open": lambda s, d: open_items(i := inbox_items(notes(s, d)), sample_state(i)), "capture_review": lambda s, d: capture_review(notes(s, d)), "content_maps": lambda s, d: content_maps(notes(s, d)),
    "safe_snippets": lambda s, d: safe_snippets(notes(s, d)), "runbook_sources": lambda s, d: runbook_sources(notes(s, d), "src1"), "review_page": lambda s, d: review_page(_queue(s, d)), "severity_cube": lambda s, d: severity_cube(_queue(s, d)),
    "processing_queue": lambda s, d: processing_queue(notes(s, d), notes(s, d).filter("doc_id % 3 = 0").select("rel_path")), "capture_scores_by_text": lambda s, d: capture_scores_by_text(sample_captures(notes(s, d))),
    "file_names": lambda s, d: notes(s, d).select("rel_path", file_name(F.col("title")).alias("file_name"), slug(F.col("title")).alias("slug")),
}


def _asking(n: DataFrame) -> DataFrame:
    """Some notes as gaps and contradictions."""
    k = F.col("doc_id")
    return n.withColumn("rel_path", F.when(k % 25 == 3, F.concat(F.lit("Knowledge/Gaps/"), k.cast("string"), F.lit(".md"))).when(k % 25 == 4, F.concat(F.lit("Knowledge/Contradictions/"), k.cast("string"), F.lit(".md"))).otherwise(F.col("rel_path")))


ACTIVE, CAPTURE = "NOT starts_with(lower(rel_path), 'archiv/')", "(coalesce(quelle, '') = 'knowledge-harvester' OR list_contains(listed, 'auto-capture') OR regexp_matches(rel_path, '(^|/)Captures/'))"
from lorewell.operators import surfaces as _surfaces  # noqa: E402



def masked_sql(column: str) -> str:
    for name, pattern in tx.SECRETS:
        column = f"regexp_replace({column}, '{pattern}', '[REDACTED:{name}]', 'g')"
    return column


INBOX_SQL = NOTES_SQL + f", items AS (SELECT 'inbox:' || kind || ':' || rel_path AS item_id, kind, rel_path AS target, substr(sha256(title || chr(10) || content), 1, 16) AS fingerprint FROM (SELECT *, unnest(list_filter([CASE WHEN list_contains(tags, 'claim') THEN 'confirm_claim' END, CASE WHEN list_contains(tags, 'claim') THEN 'reject_claim' END, CASE WHEN list_contains(tags, 'session-impact') THEN 'review_impact_report' END, CASE WHEN {CAPTURE} AND contains(lower(content), '## durchgeführte befehle') THEN 'runbook_preview' END], lambda x: x IS NOT NULL)) AS kind FROM notes WHERE {ACTIVE}))"
QUESTION = "CASE k % 25 WHEN 3 THEN 'Knowledge/Gaps/' || k || '.md' WHEN 4 THEN 'Knowledge/Contradictions/' || k || '.md' ELSE rel_path END"
SQL = {
    "folder_prefix_counts": NOTES_SQL + "SELECT p AS prefix, CAST(sum(CASE WHEN starts_with(rel_path, p) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM notes, (SELECT unnest([" + ", ".join(f"'{p}'" for p in INDEX_FOLDERS) + "]) AS p) GROUP BY 1",
    "open_questions": NOTES_SQL + f"SELECT p AS rel_path, CASE WHEN starts_with(p, 'Knowledge/Contradictions/') OR list_contains(tags, 'contradiction') THEN 'contradiction' ELSE 'gap' END AS kind, trim(array_to_string(string_split(content, chr(10))[1:12], chr(10)), ' ') AS context FROM (SELECT *, {QUESTION} AS p FROM notes) WHERE NOT starts_with(lower(p), 'archiv/') AND (starts_with(p, 'Knowledge/Gaps/') OR starts_with(p, 'Knowledge/Contradictions/') OR list_contains(tags, 'open-question')) AND coalesce(status, '') <> 'resolved'",
    "hot_cache": NOTES_SQL + f"SELECT * FROM (SELECT 'note' AS section, rel_path, title AS item FROM notes WHERE {ACTIVE} ORDER BY last_modified DESC, rel_path LIMIT 8) UNION ALL SELECT * FROM (SELECT 'todo', rel_path, trim(regexp_extract(t, '^\\s*- \\[[ xX]\\]\\s+(.+)', 1)) FROM (SELECT rel_path, last_modified, unnest(tasks) AS t, generate_subscripts(tasks, 1) AS i FROM notes WHERE {ACTIVE}) WHERE regexp_matches(t, '^\\s*- \\[ \\]') ORDER BY last_modified DESC, rel_path, i LIMIT 12)",
    "knowledge_inbox": INBOX_SQL + " SELECT * FROM items",
    "knowledge_inbox_open": INBOX_SQL + " SELECT * FROM items WHERE (length(target) + length(kind)) % 5 NOT IN (0, 1)",
    "capture_review": NOTES_SQL + f"SELECT count(*) AS captures, count(*) FILTER (list_contains(tags, 'prozedur') OR regexp_matches(content, '(?i)## Durchgef.hrte (Befehle|Schritte)|## Fehler und Workarounds') OR len(regexp_extract_all(content, '(?m)^\\d+\\.\\s+')) >= 3) AS promising, CAST(0 AS BIGINT) AS doubtful FROM notes WHERE {CAPTURE}",
    "content_maps": NOTES_SQL + ", p AS (SELECT rel_path, string_split(rel_path, '/') AS p FROM notes), f AS (SELECT array_to_string(p[1:i], '/') AS folder, CASE WHEN i + 1 < len(p) THEN array_to_string(p[1:i + 1], '/') END AS sub FROM (SELECT p, unnest(range(1, least(len(p), 4))) AS i FROM p)) SELECT folder, count(*) AS notes, coalesce(array_to_string(list_sort(list(DISTINCT sub) FILTER (sub IS NOT NULL)), ','), '') AS subfolders, CASE WHEN count(*) < 2 THEN 'skipped' ELSE 'created' END AS action FROM f WHERE starts_with(folder, 'Kunden/') OR starts_with(folder, 'Technik/') GROUP BY 1",
    "safe_snippets": NOTES_SQL + ", f AS (SELECT rel_path, title, tags, coalesce(substr(list_filter(list_transform(string_split_regex(regexp_replace(content, '(?m)^#\\s+.+$', ''), '\\n\\s*\\n'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: length(p) > 20)[1], 1, 420), '') AS t FROM notes) SELECT rel_path, CASE WHEN " + " OR ".join(f"regexp_matches({c}, '(?i){SENSITIVE}')" for c in ("rel_path", "title", "array_to_string(tags, ' ')")) + f" THEN '[REDACTED_SENSITIVE_NOTE_SNIPPET]' WHEN trim(t) <> '' AND (regexp_matches(t, '(?i)<task-notification|toolu_') OR regexp_matches(t, '(?i){PROBED}') AND regexp_matches(t, '(?i){READS}') OR length(trim(t)) > 140 AND regexp_matches(t, '(?i){SHELL}')) THEN '[REDACTED_COMMAND_SNIPPET]' ELSE " + masked_sql("t") + " END AS snippet FROM f",
    "runbook_sources": NOTES_SQL + f", h AS (SELECT *, {CAPTURE} OR list_contains(tags, 'prozedur') AS first FROM notes WHERE {ACTIVE} AND (contains(lower(rel_path), 'src1') OR contains(lower(title), 'src1') OR len(list_filter(tags, lambda t: contains(t, 'src1'))) > 0)) SELECT rel_path, CAST(CASE WHEN first THEN 1 ELSE 2 END AS BIGINT) AS pass FROM h ORDER BY 2, 1 LIMIT 12",
    "review_page": _surfaces.QUEUE_SQL + ", r AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM queue) SELECT * FROM (SELECT row_number() OVER (ORDER BY rank, category, id) AS place, id, severity, category FROM r) WHERE place <= 50",
    "severity_cube": _surfaces.QUEUE_SQL + "SELECT category, severity, count(*) AS n, CAST(grouping(category, severity) AS BIGINT) AS level FROM queue GROUP BY CUBE (category, severity)",
    "processing_queue": NOTES_SQL + f"SELECT rel_path, last_modified FROM notes WHERE {ACTIVE} AND ({CAPTURE} OR starts_with(rel_path, 'Daily/')) AND k % 3 <> 0 ORDER BY last_modified, rel_path LIMIT 25",
    "capture_scores_by_text": NOTES_SQL + ", c AS (SELECT rel_path, k, k % 2 = 0 AS s, k % 3 = 0 AS f, k % 5 = 0 AS x, k % 7 = 0 AS v, k % 4 = 1 AS cmd, ['implementation', 'research', 'unknown'][k % 3 + 1] AS intent, ['fuzzy_cwd', 'none', 'exact_cwd', ''][k % 4 + 1] AS method, list_contains(tags, 'auto-capture') AS auto FROM notes), r AS (SELECT *, CASE WHEN intent = 'implementation' THEN 25 ELSE 0 END + CASE WHEN cmd THEN 26 + 15 ELSE 0 END + CASE WHEN f THEN 15 ELSE 0 END + CASE WHEN v THEN 10 ELSE 0 END + CASE WHEN x THEN 5 ELSE 0 END AS ready FROM c) SELECT rel_path, CAST(25 + CASE WHEN s THEN 15 ELSE 0 END + CASE WHEN f THEN 15 ELSE 0 END + CASE WHEN cmd THEN 15 ELSE 0 END + CASE WHEN x THEN 15 ELSE 0 END + CASE WHEN auto THEN 5 ELSE 0 END AS BIGINT) AS value, CAST(ready AS BIGINT) AS readiness, CAST(10 + CASE WHEN method = 'fuzzy_cwd' THEN 30 WHEN method = 'none' THEN 20 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 35 ELSE 0 END + CASE WHEN intent = 'research' THEN 15 ELSE 0 END + CASE WHEN NOT v AND ready >= 55 THEN 10 ELSE 0 END AS BIGINT) AS need FROM r",
    "file_names": NOTES_SQL + "SELECT rel_path, rtrim(substr(trim(regexp_replace(trim(regexp_replace(regexp_replace(title, '[\\\\/:*?\"<>|#^\\[\\]\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g')), '^\\.+|\\.+$', '', 'g')), 1, 60)) AS file_name, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM notes",
}
