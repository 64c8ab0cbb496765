"""Categories with subcategories, new topics that texts name, and the log of suggestions that leads to new subcategories."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.facts import let
from lorewell.operators.sessions import EDGE
from lorewell.sources.tables import NOTES_SQL, notes


@dataclass(frozen=True)
class Category:
    """A category's keywords, title hints and priority; its subcategories as (name, keywords, hints)."""

    name: str
    keywords: tuple[str, ...]
    hints: tuple[str, ...]
    priority: int = 0
    subs: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()

    def known(self) -> list[str]:
        """What names one of its subcategories already."""
        return sorted({x.lower() for name, keywords, hints in self.subs for x in (name, *keywords, *hints)})


def load_taxonomy(text: str) -> tuple[Category, ...]:
    """The categories of a JSON object by name: keywords, filenameHints, priority, subcategories; names with _ are comments."""
    raw = json.loads(text)
    words = lambda d, k: tuple(str(x).lower() for x in d.get(k, []))
    return tuple(
        Category(name, words(c, "keywords"), words(c, "filenameHints"), int(c.get("priority", 0)), tuple((n, words(s, "keywords"), words(s, "filenameHints")) for n, s in c.get("subcategories", {}).items()))
        for name, c in raw.items() if not name.startswith("_")
    )


# Points of tags, titles and contents, and least scores of a category and a subcategory.
TAG, TITLE, CONTENT, LEAST_HITS, LEAST = 10, 25, 2, 3, 5
SUB_PATH, SUB_TAG, SUB_TITLE, SUB_CONTENT, SUB_HITS, SUB_LEAST = 30, 10, 20, 3, 2, 10
# Names that a topic can have, what only looks like one, and how often a text must name it.
TOPIC = r"[a-zäöüß][a-z0-9äöüß]{3,}(?:-[a-zäöüß][a-z0-9äöüß]{2,}){1,2}"
NO_TOPIC = (
    r"^(add|del|get|set|put|post|update|create|remove|make|do|run|exec|cmd|opt|arg|env|var|val|key|str|num|int|bool|obj|arr|map|fn|func)-", r"-(json|yaml|yml|toml|txt|md|sh|py|ts|js|conf|cfg|ini|log|tmp|bak|old|new)$",
    r"^(disk|drive|part|fs|mnt|dir|file|path|node|host|addr|port|proto|dest|src|tgt|conn|sock|fd)-", r"-\d+$", r"^(my|your|our|the|a|an|some|any|all|none|each)-", r"^([a-z]{1,2})-",
)
SCANNED, MOST_NAMES, SHORTEST, LONGEST, LEAST_MENTIONS, MOST_TOPICS, MOST_LOGGED = 3000, 20, 8, 30, 3, 5, 3


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def _tagged(tags: Column, words: tuple[str, ...]) -> Column:
    return sum((F.when(F.array_contains(tags, w), 1).otherwise(0) for w in dict.fromkeys(words)), F.lit(0))


def classified(n: DataFrame, taxonomy: tuple[Category, ...]) -> DataFrame:
    """n with category, subcategory and confidence (the category's score; 0 without one). The first of equal scores counts."""
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    parents = F.transform(F.filter(tags, lambda t: F.contains(t, F.lit("/"))), lambda t: F.substring_index(t, "/", 1))
    d = n.select("*", F.inline(F.array(F.struct(title.alias("_title"), body.alias("_body"), tags.alias("_tags"), F.array_union(tags, parents).alias("_all")))))
    found = []
    for i, c in enumerate(taxonomy):
        score = _tagged(F.col("_all"), c.keywords) * TAG + _hits(F.col("_title"), c.hints) * TITLE + let(_hits(F.col("_body"), c.keywords), lambda h: F.when(h >= LEAST_HITS, h * CONTENT).otherwise(0))
        subs = []
        for j, (name, keywords, hints) in enumerate(c.subs):
            own = F.when(F.array_contains("_tags", f"{c.name.lower()}/{name.lower()}"), SUB_PATH).otherwise(0) + _tagged(F.col("_tags"), keywords) * SUB_TAG + _hits(F.col("_title"), hints) * SUB_TITLE
            own = own + let(_hits(F.col("_body"), keywords), lambda h: F.when(h >= SUB_HITS, h * SUB_CONTENT).otherwise(0))
            subs.append(_sub(own, j, name))
        best = F.array_max(F.filter(F.array(*subs), lambda x: x.isNotNull()))["n"] if subs else F.lit(None).cast("string")
        found.append(_main(score, c, i, best))
    best = F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))
    d = d.select(*n.columns, F.inline(F.array(F.struct(best.alias("_best")))))
    return d.select(*n.columns, F.col("_best.category").alias("category"), F.col("_best.subcategory").alias("subcategory"), F.coalesce("_best.score", F.lit(0.0)).alias("confidence"))


def _sub(score: Column, order: int, name: str) -> Column:
    return let(score, lambda s: F.when(s >= SUB_LEAST, F.struct(s.alias("s"), F.lit(-order).alias("o"), F.lit(name).alias("n"))))


def _main(score: Column, c: Category, order: int, sub: Column) -> Column:
    return let(score, lambda s: F.when(s >= LEAST, F.struct(F.round(s + c.priority * 0.1, 6).alias("score"), F.lit(-order).alias("o"), F.lit(c.name).alias("category"), sub.alias("subcategory"))))


def topics(n: DataFrame, taxonomy: tuple[Category, ...]) -> DataFrame:
    """rel_path, category, subcategory, place, topic: names with hyphens in the title and the first 3000 characters that neither
    look like commands, files or numbered things nor name what the note's category knows, and that the whole text says
    three times; the first five. Notes without a category have none."""
    c = classified(n, taxonomy).filter("category IS NOT NULL")
    head = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, SCANNED))
    names = F.transform(F.regexp_extract_all(head, F.lit(f"(?iu){EDGE}({TOPIC}){EDGE}"), F.lit(1)), F.lower)
    noise = "|".join(NO_TOPIC)
    names = F.filter(names, lambda t: F.length(t).between(SHORTEST, LONGEST) & ~F.regexp_like(t, F.lit(noise)) & F.forall(F.split(t, "-"), lambda p: F.length(p) >= 3))
    known = F.create_map(*[x for t in taxonomy for x in (F.lit(t.name), F.array(*[F.lit(k) for k in t.known()]).cast("array<string>"))])[F.col("category")]
    body = F.lower(F.coalesce("content", F.lit("")))
    d = c.select("rel_path", "category", "subcategory", F.inline(F.array(F.struct(F.slice(F.array_distinct(names), 1, MOST_NAMES).alias("names"), known.alias("known"), body.alias("body")))))
    new = F.filter("names", lambda t: ~F.exists("known", lambda k: (k == t) | ((F.length(k) > 4) & (F.contains(t, k) | F.contains(k, t)))))
    often = F.filter(new, lambda t: (F.length("body") - F.length(F.replace(F.col("body"), t, F.lit("")))) / F.length(t) >= LEAST_MENTIONS)
    return d.select("rel_path", "category", "subcategory", F.posexplode(F.slice(often, 1, MOST_TOPICS)).alias("place", "topic"))


def suggestion_log(t: DataFrame, titles: DataFrame, at: str) -> DataFrame:
    """The log's blocks (value) for the first three topics of notes without a subcategory: a head line, a path, a context."""
    t = t.filter(F.col("subcategory").isNull() & (F.col("place") < MOST_LOGGED)).join(titles, "rel_path")
    lines = F.concat(F.lit(f'{at} VORSCHLAG Unterkategorie: "'), "topic", F.lit('" unter '), "category", F.lit("\n  Pfad: Technik/"), "category", F.lit("/"), F.initcap("topic"), F.lit("/\n  Kontext: "), F.substring(F.regexp_replace("title", r"\s+", " "), 1, 150), F.lit("\n  → In den Kategorien hinzufügen"))
    return t.select(lines.alias("value"))


HEAD = r"(\d{4}-\d{2}-\d{2}T[\d:.Z]+) VORSCHLAG"
TOPIC_LINE = rf'^{HEAD} Unterkategorie: "([^"]+)" unter (\S+)\s+Pfad:[^\n]+\n\s+Kontext: ([^\n]+)'
CLIENT_LINE = rf'^{HEAD}: "([^"]+)" als Kunde registrieren\? \(Pfad: ([^)]+)\)'


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a suggestion log, a row each: they are parted by an empty line, so that Spark splits large logs between them."""
    return spark.read.option("lineSep", "\n\n").text(path)


def suggestions(blocks: DataFrame) -> DataFrame:
    """kind (topic or client), parent, candidate, context, at of the blocks (value); what is no suggestion goes. A topic needs
    all three lines, each at its place."""
    text = F.regexp_replace(F.col("value"), r"^\n+", "")
    cut = lambda p, k: F.regexp_extract(text, f"(?m){p}", k)
    topic, client = F.regexp_like(text, F.lit(f"(?m){TOPIC_LINE}")), F.regexp_like(text, F.lit(f"(?m){CLIENT_LINE}"))
    rows = F.when(topic, F.struct(F.lit("topic").alias("kind"), cut(TOPIC_LINE, 3).alias("parent"), cut(TOPIC_LINE, 2).alias("candidate"), cut(TOPIC_LINE, 4).alias("context"), cut(TOPIC_LINE, 1).alias("at"))).when(
        client, F.struct(F.lit("client").alias("kind"), F.lit(None).cast("string").alias("parent"), cut(CLIENT_LINE, 2).alias("candidate"), cut(CLIENT_LINE, 3).alias("context"), cut(CLIENT_LINE, 1).alias("at")))
    return blocks.select(F.inline(F.filter(F.array(rows), lambda x: x.isNotNull())))


def buckets(s: DataFrame) -> DataFrame:
    """kind, parent, candidate (as written first), count, contexts (distinct), last_seen; names in any case are one."""
    g = s.groupBy("kind", "parent", F.lower("candidate").alias("key")).agg(F.min_by("candidate", F.struct("at", "candidate")).alias("candidate"), F.count("*").alias("count"), F.countDistinct("context").alias("contexts"), F.max("at").alias("last_seen"))
    return g.select("kind", "parent", "candidate", "count", "contexts", "last_seen")


def promotion_plan(b: DataFrame, taxonomy: tuple[Category, ...], least: int = 3) -> DataFrame:
    """parent, subcategory, keyword, existed, decision of the topics that were suggested `least` times: what would become of the
    taxonomy. A topic of an unknown category, or whose name is no safe label of at most 120 characters, is rejected."""
    t = b.filter((F.col("kind") == "topic") & (F.col("count") >= least))
    name = F.array_join(F.transform(F.split(F.trim("candidate"), r"[-_\s]+"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "-")
    subs = F.create_map(*[x for c in taxonomy for x in (F.lit(c.name), F.array(*[F.lit(s[0]) for s in c.subs]).cast("array<string>"))])[F.col("parent")]
    safe = (F.length(name) <= 120) & (name != "") & ~F.regexp_like(name, F.lit(r"[/\\:*?\"<>|\x00-\x1f]|^\.{1,2}$"))
    decision = F.when(subs.isNull(), "unknown category").when(~safe, "unsafe name").otherwise("promote")
    return t.select("parent", name.alias("subcategory"), F.lower("candidate").alias("keyword"), F.coalesce(F.array_contains(subs, name), F.lit(False)).alias("existed"), decision.alias("decision"), "count", "contexts")


#: A taxonomy for the invented prose of the driver's tables.
SAMPLE = (
    Category("Alpha", ("en", "the", "and", "of", "ing"), ("the", "an"), 3, (("Reports", ("thing", "src1", "ation"), ("tion",)), ("Plans", ("src2", "ering"), ("sh",)))),
    Category("Beta", ("fr", "que", "la", "de", "le"), ("que", "le"), 2, (("Notes", ("elle", "oui", "src3"), ("la",)),)),
    Category("Gamma", ("de", "der", "die", "und", "sch"), ("sch", "der"), 1),
)
NEW_NAMES = ("neues-werkzeug", "Backup-Server-Pool", "src-test-datei", "nightly-reports", "host-gruppen", "zweites-werkzeug")


def sample_notes(n: DataFrame) -> DataFrame:
    """Notes some of which name new topics three times or twice."""
    k = F.col("doc_id")
    name = F.get(F.array(*[F.lit(x) for x in NEW_NAMES]), (k % len(NEW_NAMES)).cast("int"))
    more = F.when(k % 3 == 0, F.concat(F.repeat(F.concat(F.lit(" "), name), F.when(k % 4 == 0, 2).otherwise(3)), F.lit(". "))).otherwise("")
    return n.withColumn("content", F.concat(more, "content"))


AT = "2024-06-01T00:00:00.000Z"


def _suggested(s: SparkSession, d: str) -> DataFrame:
    n = sample_notes(notes(s, d))
    return buckets(suggestions(suggestion_log(topics(n, SAMPLE), n.select("rel_path", "title"), AT)))


QUERIES = {
    "taxonomy_classes": lambda s, d: classified(notes(s, d), SAMPLE).select("rel_path", "category", "subcategory", "confidence"), "topic_candidates": lambda s, d: topics(sample_notes(notes(s, d)), SAMPLE).withColumn("place", F.col("place").cast("long")),
    "suggestion_buckets": _suggested, "suggestion_plan": lambda s, d: promotion_plan(_suggested(s, d), SAMPLE),
}
_IN = lambda col, words: " + ".join(f"CASE WHEN contains({col}, '{w}') THEN 1 ELSE 0 END" for w in words) or "0"
_TAGS = lambda col, words: f"len(list_intersect({col}, [{', '.join(repr(w) for w in dict.fromkeys(words))}]))"
_SUBS = lambda c: ", ".join(f"{{'s': CASE WHEN list_contains(tags, '{c.name.lower()}/{n.lower()}') THEN 30 ELSE 0 END + 10 * {_TAGS('tags', k)} + 20 * ({_IN('t', h)}) + CASE WHEN {_IN('b', k)} >= 2 THEN 3 * ({_IN('b', k)}) ELSE 0 END, 'o': {j}, 'n': '{n}'}}" for j, (n, k, h) in enumerate(c.subs))
_CLASS = lambda body: ("""m AS (SELECT doc_id, rel_path, title, tags, """ + body + """ AS content, lower(title) AS t, lower(""" + body + """) AS b, list_concat(tags, list_transform(list_filter(tags, lambda x: contains(x, '/')), lambda x: split_part(x, '/', 1))) AS every FROM notes),
    v AS (SELECT rel_path, unnest([""" + ", ".join(f"{{'s': 10 * {_TAGS('every', c.keywords)} + 25 * ({_IN('t', c.hints)}) + CASE WHEN {_IN('b', c.keywords)} >= 3 THEN 2 * ({_IN('b', c.keywords)}) ELSE 0 END, 'p': {c.priority}, 'o': {i}, 'n': '{c.name}', 'u': list_filter([{_SUBS(c)}]::STRUCT(s BIGINT, o BIGINT, n VARCHAR)[], lambda x: x.s >= 10)}}" for i, c in enumerate(SAMPLE)) + """]) AS v FROM m),
    w AS (SELECT rel_path, arg_max(v, [v.s + v.p * 0.1::DOUBLE, -v.o]) AS v FROM v WHERE v.s >= 5 GROUP BY 1),
    k AS (SELECT m.*, v.n AS category, list_sort(list_transform(v.u, lambda x: {'a': -x.s, 'o': x.o, 'n': x.n}))[1].n AS subcategory, coalesce(round(v.s + v.p * 0.1::DOUBLE, 6), 0) AS confidence FROM m LEFT JOIN w USING (rel_path))""")  # noqa: E731
_MORE = "CASE WHEN doc_id % 3 = 0 THEN repeat(' ' || [" + ", ".join(f"'{x}'" for x in NEW_NAMES) + f"][doc_id % {len(NEW_NAMES)} + 1], CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 3 END) || '. ' ELSE '' END || content"
_KNOWN = "CASE category " + " ".join(f"WHEN '{c.name}' THEN {c.known()}::VARCHAR[]" for c in SAMPLE) + " END"
_TOPICS = _CLASS(_MORE) + f""", x AS (SELECT *, list_transform(regexp_extract_all(title || chr(10) || substr(content, 1, 3000), '(?i)\\b({TOPIC})\\b', 1), lambda x: lower(x)) AS l FROM k WHERE category IS NOT NULL),
    y AS (SELECT *, list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: length(x) BETWEEN 8 AND 30 AND NOT regexp_matches(x, '{"|".join(NO_TOPIC)}') AND len(list_filter(string_split(x, '-'), lambda p: length(p) < 3)) = 0)[1:20] AS names FROM x),
    z AS (SELECT *, list_filter(names, lambda x: len(list_filter({_KNOWN}, lambda q: q = x OR length(q) > 4 AND (contains(x, q) OR contains(q, x)))) = 0 AND (length(lower(content)) - length(replace(lower(content), x, ''))) / length(x) >= 3)[1:5] AS kept FROM y),
    topics AS (SELECT rel_path, title, category, subcategory, unnest(range(0, len(kept))) AS place, unnest(kept) AS topic FROM z)"""
_BUCKETS = _TOPICS + f""", s AS (SELECT category AS parent, topic, trim(substr(regexp_replace(title, '\\s+', ' ', 'g'), 1, 150), chr(10)) AS context FROM topics WHERE subcategory IS NULL AND place < 3),
    buckets AS (SELECT 'topic' AS kind, parent, min(topic) AS candidate, count(*) AS count, count(DISTINCT context) AS contexts, '{AT}' AS last_seen FROM s GROUP BY parent, lower(topic))"""
SQL = {
    "taxonomy_classes": NOTES_SQL + ", " + _CLASS("content") + " SELECT rel_path, category, subcategory, confidence FROM k", "topic_candidates": NOTES_SQL + ", " + _TOPICS + " SELECT rel_path, category, subcategory, place, topic FROM topics",
    "suggestion_buckets": NOTES_SQL + ", " + _BUCKETS + " SELECT * FROM buckets",
    "suggestion_plan": NOTES_SQL + ", " + _BUCKETS + " SELECT parent, array_to_string(list_transform(string_split_regex(candidate, '[-_\\s]+'), lambda p: upper(p[1:1]) || p[2:]), '-') AS subcategory, candidate AS keyword, false AS existed, 'promote' AS decision, count, contexts FROM buckets WHERE count >= 3",
}
