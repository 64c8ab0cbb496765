"""The link index under change: added, changed and deleted notes as a delta of links, without resolving the others again.

A link text can resolve otherwise only if a note of a path or name that it may mean has come or gone. So a batch touches the
links of its own notes, and of all other links those whose text names a path or a file name that appeared or vanished;
candidates for these texts are looked up by the same keys. Everything else stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import markdown as md
from lorewell.operators.links import link_texts, resolved, resolved_of
from lorewell.sources import scratch
from lorewell.sources.tables import NOTES_SQL, notes


def path_keys(path: Column) -> Column:
    """What a link text may say to mean this path: the path, and the file name in any case."""
    return F.array(F.concat(F.lit("p"), path), F.concat(F.lit("n"), F.lower(md.basename(path))))


def text_keys(target: Column) -> Column:
    """The path_keys() that a link text names."""
    own = F.array(F.concat(F.lit("p"), target, F.lit(".md")), F.concat(F.lit("p"), target))
    return F.when(F.contains(target, F.lit("/")), own).otherwise(F.concat(own, F.array(F.concat(F.lit("n"), F.lower(target)))))


def latest(upserts: DataFrame) -> DataFrame:
    """One row a path: the last modified, then the one with the larger hash of its links."""
    w = Window.partitionBy("rel_path").orderBy(F.desc_nulls_last("last_modified"), F.desc(F.xxhash64(F.coalesce("out_links", F.array()))))
    return upserts.filter("rel_path IS NOT NULL").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def changed_notes(n: DataFrame, upserts: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The notes after the batch, the notes that it writes, and the paths that it takes away. A path in both sides of a batch
    is deleted; deleting what is not there changes nothing. upserts has the columns of n, deletes rel_path."""
    gone = deletes.filter("rel_path IS NOT NULL").select("rel_path").distinct()
    new = scratch.written(latest(upserts.select(*n.columns)).join(gone, "rel_path", "left_anti").select(*n.columns), "upserts")
    gone = scratch.written(gone.join(n.select("rel_path"), "rel_path", "left_semi"), "deletes")
    touched = new.select("rel_path").union(gone)
    return n.join(touched, "rel_path", "left_anti").select(*n.columns).unionByName(new), new, gone


def link_delta(n: DataFrame, links: DataFrame, after: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """src, ord, target, dst, gone: the links (a place of a note each) that a batch writes, and with gone those that vanish.
    n, links: notes and resolved links before; after, new, gone: of changed_notes()."""
    came = new.select("rel_path").join(n.select("rel_path"), "rel_path", "left_anti")
    moved = came.union(gone)
    keys = scratch.written(moved.select(F.explode(path_keys(F.col("rel_path"))).alias("key")).distinct(), "moved")
    touched = new.select(F.col("rel_path").alias("src")).union(gone.select(F.col("rel_path").alias("src")))
    texts = links.select("target").distinct()
    struck = texts.select("target", F.explode(text_keys(F.col("target"))).alias("key")).join(keys, "key", "left_semi").select("target").distinct()
    struck = scratch.written(struck, "struck")
    again = links.join(struck, "target", "left_semi").join(touched, "src", "left_anti").select("src", "target", "ord")
    redo = scratch.written(again.unionByName(link_texts(new).select("src", "target", "ord")), "redo")
    wanted = redo.select(F.explode(text_keys(F.col("target"))).alias("key")).distinct()
    pool = after.select("rel_path", F.explode(path_keys(F.col("rel_path"))).alias("key")).join(wanted, "key", "left_semi").select("rel_path").distinct()
    found = resolved(redo, pool).select("src", "ord", "target", "dst", F.lit(False).alias("gone"))
    before = links.join(touched, "src", "left_semi").select("src", "ord")
    left = before.join(link_texts(new).select("src", "ord"), ["src", "ord"], "left_anti")
    return found.unionByName(left.select("src", "ord", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("dst"), F.lit(True).alias("gone")))


def applied(links: DataFrame, delta: DataFrame) -> DataFrame:
    """The links after a delta: src, ord, target, dst."""
    kept = links.join(delta.select("src", "ord"), ["src", "ord"], "left_anti").select("src", "ord", "target", "dst")
    return kept.unionByName(delta.filter(~F.col("gone")).select("src", "ord", "target", "dst"))


def updated(n: DataFrame, links: DataFrame, upserts: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and resolved links after a batch; equal to resolving all links again."""
    after, new, gone = changed_notes(n, upserts, deletes)
    return after, applied(links, scratch.written(link_delta(n, links, after, new, gone), "delta"))


def sample_batch(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch over the notes of the documents table: some go, some get links, some come, with file names that others have."""
    k = F.col("doc_id")
    changed = n.filter((k % 23 == 7) & (k % 19 != 4)).withColumn("out_links", F.concat("out_links", F.array(F.concat(F.lit("NEU-"), (k + 22).cast("string")), F.lit("nowhere"))))
    came = n.filter(k % 29 == 11).withColumn("out_links", F.array(F.lit("3"), F.concat(F.lit("Neu/neu-"), k.cast("string"))))
    first = came.withColumn("rel_path", F.concat(F.lit("Neu/neu-"), k.cast("string"), F.lit(".md")))
    second = came.withColumn("rel_path", F.concat(F.lit("AA/"), (k + 1).cast("string"), F.lit(".md")))
    return changed.unionByName(first).unionByName(second), n.filter(k % 19 == 4).select("rel_path")


def _updated(s: SparkSession, d: str) -> DataFrame:
    n = notes(s, d)
    return updated(n, resolved_of(s, d), *sample_batch(n))[1].select("src", "target", "dst").distinct()


QUERIES = {"link_index_update": _updated}
SQL = {
    "link_index_update": NOTES_SQL + """, after AS MATERIALIZED (
      SELECT rel_path, CASE WHEN doc_id % 23 = 7 THEN list_concat(out_links, ['NEU-' || (doc_id + 22), 'nowhere']) ELSE out_links END AS out_links FROM notes WHERE doc_id % 19 <> 4
      UNION ALL SELECT unnest(['Neu/neu-' || doc_id || '.md', 'AA/' || (doc_id + 1) || '.md']), ['3', 'Neu/neu-' || doc_id] FROM notes WHERE doc_id % 29 = 11),
    newer AS MATERIALIZED (SELECT rel_path, regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\\.md$', '') AS name FROM after),
    wanted AS (SELECT DISTINCT rel_path AS src, unnest(out_links) AS target FROM after)
    SELECT src, target, coalesce((SELECT min(rel_path) FROM newer b WHERE b.rel_path = target || '.md'), (SELECT min(rel_path) FROM newer b WHERE b.rel_path = target),
      CASE WHEN NOT contains(target, '/') THEN coalesce((SELECT min(rel_path) FROM newer b WHERE b.name = target), (SELECT min(rel_path) FROM newer b WHERE lower(b.name) = lower(target))) END) AS dst FROM wanted""",
}
