"""The link graph: resolution of link texts, edges, degrees, orphans, broken links, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import markdown as md
from lorewell.functions import text as tx
from lorewell.sources import scratch
from lorewell.sources.tables import NOTES_SQL, notes


def link_texts(n: DataFrame) -> DataFrame:
    """src, target, ord of every link."""
    return n.select(F.col("rel_path").alias("src"), F.posexplode("out_links").alias("ord", "target"))


def resolved(links: DataFrame, n: DataFrame) -> DataFrame:
    """links with dst: the note whose path is the target with .md, the path itself, or whose file name it is, in this
    order, the name at last in any case; the smallest path where several have it; null where none has."""
    names = n.select("rel_path", md.basename(F.col("rel_path")).alias("name"))
    paths = names.select(F.col("rel_path").alias("p"))
    exact = names.groupBy(F.col("name").alias("e")).agg(F.min("rel_path").alias("by_name"))
    loose = names.groupBy(F.lower("name").alias("l")).agg(F.min("rel_path").alias("by_lower"))
    targets = links.select("target").distinct()
    plain = ~F.contains("target", F.lit("/"))
    t = targets.join(paths.withColumnRenamed("p", "with_md"), F.concat("target", F.lit(".md")) == F.col("with_md"), "left")
    t = t.join(paths.withColumnRenamed("p", "as_is"), F.col("target") == F.col("as_is"), "left")
    t = t.join(exact, plain & (F.col("target") == F.col("e")), "left").join(loose, plain & (F.lower("target") == F.col("l")), "left")
    return links.join(t.select("target", F.coalesce("with_md", "as_is", "by_name", "by_lower").alias("dst")), "target", "left")


def edges(n: DataFrame) -> DataFrame:
    return resolved(link_texts(n), n).filter("dst IS NOT NULL").select("src", "dst").distinct()


def resolved_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link index of the documents table: src, target, ord, dst."""
    return scratch.index(spark, "links", f"{sf_dir}/documents.parquet", lambda: resolved(link_texts(n), n) if (n := notes(spark, sf_dir)) is not None else None)


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_of(spark, sf_dir).filter("dst IS NOT NULL").select("src", "dst").distinct()


def backlink_counts(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("dst").alias("rel_path")).agg(F.count("*").alias("inbound"))


def degrees(n: DataFrame, e: DataFrame) -> DataFrame:
    outgoing = e.groupBy(F.col("src").alias("rel_path")).agg(F.count("*").alias("outbound"))
    d = n.select("rel_path").join(backlink_counts(e), "rel_path", "left").join(outgoing, "rel_path", "left")
    return d.select("rel_path", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))


def orphans(n: DataFrame, e: DataFrame) -> DataFrame:
    return n.filter("title != 'Dashboard'").join(e.select(F.col("dst").alias("rel_path")), "rel_path", "left_anti").select("rel_path", "title")


def broken(r: DataFrame) -> DataFrame:
    """src and target of the links that lead nowhere. r: resolved links."""
    return r.filter("dst IS NULL").select("src", "target").distinct()


def broken_candidates(b: DataFrame, n: DataFrame, least: float = 0.5, most: int = 3) -> DataFrame:
    """src, target, candidate, confidence, similarity of broken links: notes of the same file name wherever they lie (high if
    there is one, else medium), else notes whose names have similar tokens (medium from 0.8); the best `most`. Similar
    names are joined on the prefix of their rarest tokens, which sets of that similarity cannot both miss."""
    names = n.select(F.col("rel_path").alias("candidate"), F.lower(md.basename(F.col("rel_path"))).alias("name"))
    wanted = b.select("src", "target", F.lower(md.basename(F.col("target"))).alias("name"))
    same = names.join(wanted.select("name").distinct(), "name", "left_semi")
    place, shared = F.row_number().over(Window.partitionBy("name").orderBy("candidate")), F.count("*").over(Window.partitionBy("name"))
    first = same.select("*", place.alias("place"), shared.alias("n")).filter(F.col("place") <= most)
    exact = wanted.join(first, "name").select("src", "target", "candidate", F.when(F.col("n") == 1, "high").otherwise("medium").alias("confidence"), F.lit(1.0).alias("similarity"))
    rest = wanted.join(same.select("name").distinct(), "name", "left_anti").select(F.col("name").alias("key"), tx.title_tokens(F.col("name")).alias("tokens")).distinct()
    pool = names.select(F.col("candidate").alias("key"), tx.title_tokens(F.col("name")).alias("tokens"))
    near = similar_sets(rest, pool, least).select(F.col("left").alias("name"), F.col("right").alias("candidate"), F.round("similarity", 6).alias("similarity"))
    fuzzy = wanted.join(near, "name").select("src", "target", "candidate", F.when(F.col("similarity") >= 0.8, "medium").otherwise("low").alias("confidence"), "similarity")
    rank = F.row_number().over(Window.partitionBy("src", "target").orderBy(F.desc("similarity"), "candidate"))
    return exact.union(fuzzy).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left, right, similarity of all keys whose token sets (key, tokens; a row a key) have this Jaccard similarity or more. A pair
    is taken where its prefixes first meet, so that it is made and judged once and candidates are not exchanged."""
    sides = [d.filter(F.size("tokens") > 0).select("key", "tokens", F.size("tokens").alias("size"), F.explode("tokens").alias("t")) for d in (left, right)]
    df = sides[1].groupBy("t").agg(F.count("*").alias("df"))
    prefix = []
    for d in sides:
        ranked = d.join(df, "t", "left").groupBy("key").agg(F.first("tokens").alias("tokens"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("ranked"))
        first = F.slice("ranked", F.lit(1), (F.col("size") - F.ceil(F.col("size") * least) + 1).cast("int"))
        prefix.append(ranked.select("key", "tokens", "size", F.transform(first, lambda x: x["t"]).alias("prefix")).select("*", F.explode("prefix").alias("t")))
    x = prefix[0].select(F.col("key").alias("left"), F.col("tokens").alias("a"), F.col("size").alias("n"), F.col("prefix").alias("pa"), "t")
    y = prefix[1].select(F.col("key").alias("right"), F.col("tokens").alias("b"), F.col("size").alias("m"), F.col("prefix").alias("pb"), "t")
    met = x.join(y, "t").filter((F.col("n") >= least * F.col("m")) & (F.col("m") >= least * F.col("n")) & (F.get(F.array_intersect("pa", "pb"), F.lit(0)) == F.col("t")))
    return met.select("left", "right", tx.jaccard(F.col("a"), F.col("b")).alias("similarity")).filter(F.col("similarity") >= least)


def broken_fixes(n: DataFrame, candidates: DataFrame) -> DataFrame:
    """What can be repaired: links with exactly one candidate of high confidence. src, target, replacement, changes (places),
    after (the note's content with all its repairs)."""
    one = candidates.filter("confidence = 'high'").groupBy("src", "target").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate")).filter("n = 1")
    one = one.select("src", "target", F.regexp_replace("candidate", r"\.md$", "").alias("replacement"))
    pattern = lambda t: F.concat(F.lit(r"\[\[\Q"), F.replace(t, F.lit("\\E"), F.lit("")), F.lit(r"\E(\\?\|[^\]]+)?\]\]"))
    by_note = one.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("target", "replacement"))).alias("fixes"))
    j = by_note.join(n.select(F.col("rel_path").alias("src"), "content"), "src")
    after = F.aggregate("fixes", F.col("content"), lambda text, f: F.regexp_replace(text, pattern(f["target"]), F.concat(F.lit("[["), f["replacement"], F.lit("$1]]"))))
    return j.select("src", F.explode("fixes").alias("f"), "content", after.alias("after")).select("src", "f.*", F.regexp_count("content", pattern(F.col("f.target"))).cast("long").alias("changes"), "after")


def expansion(primary: DataFrame, e: DataFrame) -> DataFrame:
    """Notes one link away from the primary ones (rel_path): outgoing links weigh 2, backlinks 1."""
    out = e.join(primary.withColumnRenamed("rel_path", "src"), "src").select(F.col("dst").alias("rel_path"), F.lit(2).alias("w"))
    back = e.join(primary.withColumnRenamed("rel_path", "dst"), "dst").select(F.col("src").alias("rel_path"), F.lit(1).alias("w"))
    return out.union(back).groupBy("rel_path").agg(F.sum("w").alias("weight")).join(primary, "rel_path", "left_anti")


def related_by_tags(n: DataFrame, path_like: str, least: int = 2, k: int = 10) -> DataFrame:
    """Notes that share at least `least` tags with the note whose path ends so."""
    focus = n.filter(F.col("rel_path").endswith(path_like)).select(F.explode("tags").alias("tag"), F.col("rel_path").alias("self"))
    shared = n.select("rel_path", F.explode("tags").alias("tag")).join(F.broadcast(focus), "tag").filter("rel_path != self")  # one note's tags
    return shared.groupBy("rel_path").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least).orderBy(F.desc("shared"), "rel_path").limit(k)


def _broken(s, d):
    return broken_candidates(broken(resolved_of(s, d)), notes(s, d))


QUERIES = {
    "link_edges": edges_of, "link_degrees": lambda s, d: degrees(notes(s, d), edges_of(s, d)), "orphan_notes": lambda s, d: orphans(notes(s, d), edges_of(s, d)),
    "broken_links": lambda s, d: broken(resolved_of(s, d)), "broken_link_candidates": _broken, "broken_link_fixes": lambda s, d: broken_fixes(notes(s, d), _broken(s, d)).drop("after"), "related_by_tags": lambda s, d: related_by_tags(notes(s, d), "/0.md"),
    "graph_expansion": lambda s, d: expansion(notes(s, d).filter("array_contains(tags, 'decision')").select("rel_path"), edges_of(s, d)),
}
#: Tokens of a lower-case name in DuckDB; {0} is the text.
NAME_TOKENS = "list_distinct(list_filter(string_split_regex(regexp_replace({0}, '[^\\p{{L}}\\p{{N}} \\t\\n\\r-]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "], w)))"
BROKEN_SQL = NOTES_SQL + ", b AS (SELECT src, target, lower(regexp_replace(regexp_extract(target, '([^/]*)$', 1), '\\.md$', '')) AS base FROM resolved WHERE dst IS NULL), low AS (SELECT rel_path AS candidate, lower(name) AS name FROM names), exact AS (SELECT src, target, candidate, CASE WHEN count(*) OVER (PARTITION BY src, target) = 1 THEN 'high' ELSE 'medium' END AS confidence, CAST(1 AS DOUBLE) AS similarity FROM b JOIN low ON low.name = base)" + ", sets AS (SELECT candidate, " + NAME_TOKENS.format("name") + " AS own FROM low), want AS (SELECT DISTINCT src, target, " + NAME_TOKENS.format("base") + " AS tokens FROM b WHERE base NOT IN (SELECT name FROM low)), fuzzy AS (SELECT src, target, candidate, round(len(list_intersect(tokens, own)) / (len(tokens) + len(own) - len(list_intersect(tokens, own))), 6) AS similarity FROM want JOIN sets ON len(list_intersect(tokens, own)) > 0), cands AS (SELECT src, target, candidate, confidence, similarity FROM (SELECT *, row_number() OVER (PARTITION BY src, target ORDER BY similarity DESC, candidate) AS r FROM (SELECT * FROM exact UNION ALL SELECT src, target, candidate, CASE WHEN similarity >= 0.8 THEN 'medium' ELSE 'low' END, similarity FROM fuzzy WHERE similarity >= 0.5)) WHERE r <= 3)"
SQL = {
    "link_edges": NOTES_SQL + "SELECT src, dst FROM links",
    "link_degrees": NOTES_SQL + "SELECT rel_path, (SELECT count(*) FROM links WHERE dst = rel_path) AS inbound, (SELECT count(*) FROM links WHERE src = rel_path) AS outbound FROM notes",
    "orphan_notes": NOTES_SQL + "SELECT rel_path, title FROM notes WHERE title <> 'Dashboard' AND rel_path NOT IN (SELECT dst FROM links)",
    "broken_links": NOTES_SQL + "SELECT src, target FROM resolved WHERE dst IS NULL",
    "broken_link_candidates": BROKEN_SQL + " SELECT * FROM cands",
    "broken_link_fixes": BROKEN_SQL + ", one AS (SELECT src, target, min(candidate) AS candidate FROM cands WHERE confidence = 'high' GROUP BY 1, 2 HAVING count(*) = 1) SELECT src, target, regexp_replace(candidate, '\\.md$', '') AS replacement, CAST(len(regexp_extract_all(content, '\\[\\[' || regexp_escape(target) || '(\\\\?\\|[^\\]]+)?\\]\\]')) AS BIGINT) AS changes FROM one JOIN notes n ON n.rel_path = src",
    "related_by_tags": NOTES_SQL + "SELECT b.rel_path, count(*) AS shared FROM (SELECT unnest(tags) AS tag FROM notes WHERE doc_id = 0) a JOIN (SELECT rel_path, doc_id, unnest(tags) AS tag FROM notes) b USING (tag) WHERE b.doc_id <> 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY shared DESC, b.rel_path LIMIT 10",
    "graph_expansion": NOTES_SQL + ", p AS (SELECT rel_path FROM notes WHERE list_contains(tags, 'decision')) SELECT rel_path, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT dst AS rel_path, 2 AS w FROM links WHERE src IN (SELECT rel_path FROM p) UNION ALL SELECT src, 1 FROM links WHERE dst IN (SELECT rel_path FROM p)) WHERE rel_path NOT IN (SELECT rel_path FROM p) GROUP BY 1",
}
