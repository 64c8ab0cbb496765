"""The driver's tables as the knowledge base's: documents become Markdown notes and are parsed back.

Fields that documents do not have (status, dates, links, todos) are derived from doc_id. Spark and DuckDB build the same
Markdown and parse it, each with its own expressions. Parsed notes and resolved links are indexes: each session builds
them once for a table, all queries read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import markdown as md
from lorewell.sources import scratch

#: All times are judged as of this one.
AS_OF = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, dealt over all cores if it is one small file, for expressions that are worth more than reading it."""
    return scratch.spread(spark, table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet")


#: Frontmatter and tail of a note as SQL texts that Spark and DuckDB both read; k is doc_id.
SHARED = {
    "head": """concat('---', chr(10),
      CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 <= 2 THEN concat('status: aktiv', chr(10)) WHEN k % 5 = 3 THEN concat('status: planung', chr(10)) ELSE concat('status: archiviert', chr(10)) END,
      CASE WHEN k % 4 = 0 THEN '' WHEN k % 29 = 5 THEN concat('datum: "01.02.2024"', chr(10)) ELSE concat('datum: ', day_before, chr(10)) END,
      CASE WHEN k % 6 = 1 THEN concat('tags:', chr(10), '  - ', lang, chr(10), '  - ', source, chr(10)) ELSE concat('tags: [', lang, ', ', source, CASE WHEN k % 23 = 4 THEN ', Big Topic, big-topic' ELSE '' END, CASE WHEN k % 7 = 0 THEN ', decision' ELSE '' END, CASE WHEN k % 10 = 3 THEN ', claim' ELSE '' END, CASE WHEN k % 9 = 0 THEN ', daily' ELSE '' END, CASE WHEN k % 21 = 2 THEN ', insight' ELSE '' END, ']', chr(10)) END,
      CASE WHEN k % 3 = 0 THEN concat('confidence: high', chr(10)) ELSE '' END, CASE WHEN k % 6 = 0 THEN concat('recheck_at: ', day_around, chr(10)) ELSE '' END,
      CASE WHEN k % 8 = 0 THEN concat('quelle: import', chr(10)) WHEN k % 37 = 9 THEN concat('quelle: knowledge-harvester', chr(10)) ELSE '' END, CASE WHEN k % 4 = 1 THEN concat('projekt: P', k % 7, chr(10)) ELSE '' END,
      CASE WHEN k % 41 = 6 THEN concat('contradicted_by: [', k + 1, '.md]', chr(10)) ELSE '' END, CASE WHEN k % 43 = 8 THEN concat('Owner: "team ', k % 3, '"', chr(10)) ELSE '' END,
      CASE WHEN k % 47 = 2 THEN concat('aliases: [the alias ', k % 5, ', und]', chr(10)) ELSE '' END, '---', chr(10))""",
    "tail": """concat(CASE WHEN k % 2 = 0 THEN concat(chr(10), '[[', k * 7 + CASE WHEN k % 11 = 0 THEN 1000000007 ELSE 3 END, '|see]]') ELSE '' END, CASE WHEN k % 3 = 0 THEN concat(chr(10), '[[', (k - k % 2) / 2, ']]') ELSE '' END,
      CASE WHEN k % 13 = 3 THEN concat(chr(10), '[[old/place/', k + 1, ']]') ELSE '' END, CASE WHEN k % 17 = 5 THEN concat(chr(10), '[[', k + 2, ' backup|copy]]') ELSE '' END,
      CASE WHEN k % 5 = 0 THEN concat(chr(10), '- [ ] check the source', chr(10), '- [x] done', chr(10), '* [ ] no task') WHEN k % 5 = 1 THEN concat(chr(10), '- [ ] fix') ELSE '' END,
      CASE WHEN k % 14 = 1 THEN concat(chr(10), 'filed under #ops/net and #Überblick') ELSE '' END)""",
    "folder": "CASE WHEN k % 10 = 0 THEN 'Archiv' WHEN k % 10 = 1 THEN 'Daily' WHEN k % 10 = 2 THEN 'Maintenance' WHEN k % 10 = 3 THEN 'Knowledge/Claims' WHEN k % 10 = 4 THEN concat('Kunden/', source) ELSE source END",
}
SHARED["tail"] = SHARED["tail"].replace("(k - k % 2) / 2", "half")


def rendered(docs: DataFrame) -> DataFrame:
    """rel_path, raw (Markdown with frontmatter), last_modified, doc_id of every document."""
    k, day = F.col("k"), F.lit(AS_OF[:10]).cast("date")
    d = docs.withColumns({"k": F.col("doc_id"), "half": F.floor(F.col("doc_id") / 2).cast("long"), "day_before": F.date_format(F.date_sub(day, (F.col("doc_id") * 13 % 400).cast("int")), "yyyy-MM-dd"), "day_around": F.date_format(F.date_add(day, (F.col("doc_id") % 61).cast("int") - 30), "yyyy-MM-dd")})
    first = F.trim(F.substring(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1), 1, 60))
    title = F.when(first == "", F.concat(F.lit("Note "), k.cast("string"))).otherwise(first)
    raw = F.concat(F.expr(SHARED["head"]), F.lit("# "), title, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(SHARED["tail"]))
    modified = F.expr(f"timestamp_ntz'{AS_OF}' - make_dt_interval(cast(doc_id * 37 % 500 as int), cast(doc_id % 5 as int))")
    return d.select("doc_id", F.concat_ws("/", F.expr(SHARED["folder"]), "lang", F.concat(k.cast("string"), F.lit(".md"))).alias("rel_path"), raw.alias("raw"), modified.alias("last_modified"), "lang", "source")


def parsed(raw: DataFrame, frontmatter=md.flat_frontmatter) -> DataFrame:
    """Notes from rel_path, raw and last_modified: title, frontmatter map, tags, out_links, todos, content. frontmatter: what
    makes the map of scalars and [lists]; sources.files.yaml_frontmatter knows all of YAML."""
    d = raw.withColumn("frontmatter", frontmatter(F.col("raw"))).withColumn("content", md.body(F.col("raw")))
    d = d.withColumn("inline", md.inline_tags(F.col("content"))).withColumn("listed", md.listed_tags(F.col("frontmatter")["tags"]))
    return d.select(
        *[c for c in d.columns if c not in ("raw", "frontmatter", "content", "inline", "listed")], "frontmatter", "content", md.title(F.col("content"), md.basename(F.col("rel_path"))).alias("title"),
        F.array_distinct(F.concat(F.transform("listed", F.lower), "inline")).alias("tags"), md.wikilinks(F.col("content")).alias("out_links"), md.todos(F.col("content")).alias("todos"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note index of the documents table."""
    source = f"{sf_dir}/documents.parquet"
    return scratch.index(spark, "notes", source, lambda: parsed(rendered(scratch.spread(spark, table(spark, sf_dir, "documents"), source))))


#: The same notes in DuckDB: the Markdown is built and parsed there too.
NOTES_SQL = (
    """
WITH base AS (
  SELECT *, k // 2 AS half, strftime(DATE '2024-06-01' - CAST(k * 13 % 400 AS INT), '%Y-%m-%d') AS day_before, strftime(DATE '2024-06-01' + CAST(k % 61 - 30 AS INT), '%Y-%m-%d') AS day_around
  FROM (SELECT doc_id AS k, doc_id, text AS own, lang, source FROM documents)),
markdown AS MATERIALIZED (
  SELECT k, doc_id, lang, source, concat_ws('/', """ + SHARED["folder"] + """, lang, k || '.md') AS rel_path, TIMESTAMP '2024-06-01' - to_days(CAST(k * 37 % 500 AS INT)) - to_hours(CAST(k % 5 AS INT)) AS last_modified,
    """ + SHARED["head"] + """ || '# ' || CASE WHEN trim(substr(split_part(coalesce(own, ''), chr(10), 1), 1, 60), ' ') = '' THEN 'Note ' || k ELSE trim(substr(split_part(coalesce(own, ''), chr(10), 1), 1, 60), ' ') END
      || chr(10) || chr(10) || coalesce(own, '') || chr(10) || """ + SHARED["tail"] + """ AS raw
  FROM base),
cut AS (SELECT *, regexp_extract(raw, '^---\\n((?s:.*?))\\n---', 1) AS fm, regexp_replace(raw, '^---\\n(?s:.*?)\\n---\\n?', '') AS content FROM markdown),
notes AS MATERIALIZED (
  SELECT k, doc_id, lang, source, rel_path, last_modified, content, trim(regexp_extract(content, '(?m)^#\\s+(.+)$', 1), ' ') AS title,
    nullif(regexp_extract(fm, '(?m)^status: (.*)$', 1), '') AS status, nullif(trim(regexp_extract(fm, '(?m)^datum: (.*)$', 1), '"'), '') AS datum, nullif(regexp_extract(fm, '(?m)^confidence: (.*)$', 1), '') AS confidence,
    nullif(regexp_extract(fm, '(?m)^recheck_at: (.*)$', 1), '') AS recheck_at, nullif(regexp_extract(fm, '(?m)^quelle: (.*)$', 1), '') AS quelle, nullif(regexp_extract(fm, '(?m)^projekt: (.*)$', 1), '') AS projekt,
    nullif(regexp_extract(fm, '(?m)^contradicted_by: (.*)$', 1), '') AS contradicted_by, nullif(trim(regexp_extract(fm, '(?m)^Owner: (.*)$', 1), '"'), '') AS owner, nullif(regexp_extract(fm, '(?m)^aliases: (.*)$', 1), '') AS aliases,
    CASE WHEN regexp_matches(fm, '(?m)^tags: \\[') THEN string_split(regexp_extract(fm, '(?m)^tags: \\[(.*)\\]$', 1), ', ') ELSE regexp_extract_all(fm, '(?m)^  - (.*)$', 1) END AS listed,
    list_distinct(list_concat(list_transform(listed, lambda x: lower(x)), list_transform(regexp_extract_all(content, '(^|\\s)#([a-zA-ZäöüÄÖÜß][\\w/äöüÄÖÜß-]*)', 2), lambda x: lower(x)))) AS tags,
    list_filter(list_transform(regexp_extract_all(content, '\\[\\[([^\\]]+?)\\]\\]', 1), lambda x: trim(regexp_replace(x, '(?s)\\\\?\\|.*$', ''))), lambda x: x <> '' AND NOT starts_with(x, '!')) AS out_links,
    list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\\s*- \\[[ xX]\\]\\s+.')) AS tasks,
    CAST(len(list_filter(tasks, lambda x: regexp_matches(x, '^\\s*- \\[ \\]'))) AS BIGINT) AS open_todos, len(tasks) - open_todos AS done_todos
  FROM cut),
names AS (SELECT rel_path, regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\\.md$', '') AS name FROM notes),
resolved AS MATERIALIZED (
  SELECT src, target, coalesce((SELECT min(rel_path) FROM notes n WHERE n.rel_path = target || '.md'), (SELECT min(rel_path) FROM notes n WHERE n.rel_path = target),
    CASE WHEN NOT contains(target, '/') THEN coalesce((SELECT min(rel_path) FROM names n WHERE n.name = target), (SELECT min(rel_path) FROM names n WHERE lower(n.name) = lower(target))) END) AS dst
  FROM (SELECT DISTINCT rel_path AS src, unnest(out_links) AS target FROM notes)),
links AS (SELECT DISTINCT src, dst FROM resolved WHERE dst IS NOT NULL)
"""
)
