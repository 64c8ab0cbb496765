"""File sources: Markdown folders, JSONL transcripts, action logs, strict JSON states, suggestion logs, source ingest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import markdown as md
from lorewell.sources.tables import parsed


def read_vault(spark: SparkSession, folder: str) -> DataFrame:
    """rel_path, raw, last_modified of all Markdown files under a folder, but those in or named with a leading dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.col("path"), f"^(?:file:)?/*\\Q{root.lstrip('/')}\\E/", "")
    return files.select(rel.alias("rel_path"), F.decode("content", "UTF-8").alias("raw"), F.col("modificationTime").alias("last_modified")).filter(~F.col("rel_path").rlike(r"(^|/)\."))


def read_notes(spark: SparkSession, folder: str, yaml: bool = False) -> DataFrame:
    """The notes of a Markdown folder; yaml: with all of YAML in the frontmatter, which needs PyYAML, not only scalars and lists."""
    return parsed(read_vault(spark, folder), yaml_frontmatter if yaml else md.flat_frontmatter)


def _frontmatter(texts: pd.Series) -> pd.Series:
    import json

    import yaml

    def shown(v) -> str:
        if isinstance(v, list) and not any(isinstance(x, list | dict) for x in v):
            return "[" + ", ".join("" if x is None else str(x) for x in v) + "]"
        return json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, list | dict | bool) else str(v)

    def one(text: str) -> dict[str, str]:
        class Last(yaml.SafeLoader):
            """Repeated keys are allowed, the last counts."""

        try:
            found = yaml.load(text or "", Last)
        except yaml.YAMLError:
            return {}
        return {str(k): shown(v) for k, v in found.items() if v is not None} if isinstance(found, dict) else {}

    return texts.map(one)


def yaml_frontmatter(raw: Column) -> Column:
    """The frontmatter by key: scalars as text, lists of scalars as `[a, b]`, other values as JSON; broken YAML gives an empty map."""
    return F.pandas_udf(_frontmatter, "map<string,string>")(md.frontmatter_text(raw))


ENTRY = "type string, role string, message struct<role: string, content: string>, ts string"
BLOCK = "array<struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>>"


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """session (file), line, ord, role, kind (text, tool_use, tool_result), content, id, is_error of JSONL transcripts. Bad
    lines are skipped; a message is a text or a list of blocks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("session"), F.monotonically_increasing_id().alias("line"), F.from_json("value", ENTRY).alias("e"))
    lines = lines.filter("e.message.content IS NOT NULL").withColumn("blocks", F.when(F.col("e.message.content").startswith("["), F.from_json("e.message.content", BLOCK)))
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("e.message.content").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")], F.lit(None).cast("boolean").alias("is_error")))
    b = lines.select("session", "line", F.coalesce("e.message.role", "e.role", "e.type").alias("role"), F.posexplode(F.coalesce("blocks", plain)).alias("ord", "b"))
    return b.select("session", "line", "ord", "role", F.col("b.type").alias("kind"), F.coalesce("b.text", "b.content", "b.input").alias("content"), F.coalesce("b.id", "b.tool_use_id").alias("id"), F.col("b.name").alias("tool"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"))


def paired_tools(t: DataFrame) -> DataFrame:
    """tool_use with its tool_result by id."""
    use = t.filter("kind = 'tool_use'").select("session", "id", "tool", F.col("content").alias("command"), "line")
    result = t.filter("kind = 'tool_result'").select("session", "id", F.col("content").alias("output"), "is_error")
    return use.join(result, ["session", "id"])


ACTION = "ts string, tool string, mode string, targets array<string>, summary string"


def read_action_log(spark: SparkSession, path: str, last: int = 50) -> DataFrame:
    """The last entries of a log folder or file, newest first by file and place in it; a line that is not JSON becomes a summary."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no")).withColumn("e", F.from_json("value", ACTION))
    ok = F.col("value").startswith("{") & (F.coalesce("e.tool", "e.ts").isNotNull())
    return lines.orderBy(F.desc("file"), F.desc("block"), F.desc("no")).limit(max(1, min(last, 500))).select("no", *[F.when(ok, F.col(f"e.{c}")).alias(c) for c in ("ts", "tool", "mode", "targets")], F.when(ok, F.col("e.summary")).otherwise(F.col("value")).alias("summary"))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON states and feedback: a malformed row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def pending_sources(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources (path, text) whose content the manifest (path, hash) does not have yet."""
    return sources.withColumn("hash", F.sha2("text", 256)).join(manifest.select("path", "hash"), ["path", "hash"], "left_anti")


def source_profile(sources: DataFrame) -> DataFrame:
    """Headings (20 at most), key points (12 at most) and links (20 at most) of raw sources (path, text)."""
    points = F.regexp_extract_all("text", F.lit(r"(?m)^\s*[-*]\s+(.{20,240})$"), F.lit(1))
    urls = F.regexp_extract_all("text", F.lit(r"(https?://[^\s)\"'<>\]]+)"), F.lit(1))
    return sources.select("path", F.slice(md.headings(F.col("text")), 1, 20).alias("headings"), F.slice(F.array_distinct(points), 1, 12).alias("points"), F.slice(F.array_distinct(urls), 1, 20).alias("urls"))


def page_profile(pages: DataFrame) -> DataFrame:
    """page_id, host, title, n_headings, n_links, n_words of raw HTML pages."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return pages.select(
        "page_id", F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("host"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit(r"<h[1-6]>")).cast("long").alias("n_headings"), F.regexp_count("html", F.lit(r"<a href=")).cast("long").alias("n_links"), F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")).cast("long").alias("n_words"),
    )


def generated_vault(spark: SparkSession, n: int) -> DataFrame:
    """rel_path, raw of n synthetic notes: 25 clients, five folders, note 1 titled like note 0, each naming its predecessor."""
    k = F.col("id")
    folder = F.get(F.array(*[F.lit(x) for x in ("Projekte", "Technik", "Kunden", "Referenz", "Wissen")]), (k % 5).cast("int"))
    name = F.when(k == 1, F.lit(0)).otherwise(k)
    raw = F.format_string("---\nstatus: aktiv\ntags: [bench, client-%d]\n---\n# Synthetic note %05d\n\nClient %d. After Synthetic note %05d.\n", k % 25, name, k % 25, F.greatest(k - 1, F.lit(0)))
    return spark.range(n).select(F.concat_ws("/", folder, F.format_string("note-%05d.md", k)).alias("rel_path"), raw.alias("raw"), F.expr("timestamp_ntz'2024-06-01'").alias("last_modified"))
