"""A vault under watch: a stream of changed files keeps the note index and the link index, batch by batch.

Both indexes are logs: a batch appends only the rows that it changes, with its number, and reading takes each key's newest
row since the last base, which compact() writes. A batch that is run again reads what was before it and overwrites its own
part, so it gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.operators import link_updates
from lorewell.sources import scratch
from lorewell.sources.tables import parsed

#: What a change is: raw is null where the file is gone.
CHANGE = "rel_path string, raw string, last_modified timestamp_ntz"
KEYS = {"notes": ["rel_path"], "links": ["src", "ord"]}


def _parts(spark: SparkSession, root: str, name: str, before: int | None) -> list[tuple[int, str, str]]:
    """(batch, delta or base, path) of the finished parts of a log, of batches before that one."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    found = [(int(n.split("-")[1]), n.split("-")[0], f"{root}/{name}/{n}") for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{n}/_SUCCESS"))]
    return sorted(p for p in found if before is None or p[0] < before)


def current(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame | None:
    """The notes or links of the index after all batches (before that one); None if there was none."""
    parts = _parts(spark, root, name, before)
    if not parts:
        return None
    base = max((i for i, p in enumerate(parts) if p[1] == "base"), default=0)
    since = [p for p in parts[base:] if p[1] == "base" or p[0] > parts[base][0] or parts[base][1] == "delta"]
    rows = None
    for number, _, path in since:
        part = spark.read.parquet(path).withColumn("batch", F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    newest = Window.partitionBy(*KEYS[name]).orderBy(F.desc("batch"))
    return rows.withColumn("_r", F.row_number().over(newest)).filter("_r = 1 AND NOT gone").drop("_r", "gone", "batch")


def apply_batch(changes: DataFrame, root: str, number: int) -> None:
    """Append what a batch of changes (rel_path, raw, last_modified) does to both indexes. Of several changes of a path the last
    modified one counts; equal ones: a present file, then the larger text."""
    spark = changes.sparkSession
    order = Window.partitionBy("rel_path").orderBy(F.desc_nulls_last("last_modified"), F.desc_nulls_last("raw"))
    last = scratch.written(changes.filter("rel_path IS NOT NULL").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r"), "changes")
    new = parsed(last.filter("raw IS NOT NULL"))
    before = current(spark, root, "notes", number)
    notes = new.limit(0) if before is None else scratch.written(before, "before").select(*new.columns)
    known = current(spark, root, "links", number)
    links = spark.createDataFrame([], "src string, ord int, target string, dst string") if known is None else scratch.written(known, "known")
    after, written, gone = link_updates.changed_notes(notes, new, last.filter("raw IS NULL").select("rel_path"))
    delta = link_updates.link_delta(notes, links, after, written, gone)
    delta.write.mode("overwrite").parquet(f"{root}/links/delta-{number:09d}")
    dropped = notes.join(gone, "rel_path", "left_semi").withColumn("gone", F.lit(True))
    written.withColumn("gone", F.lit(False)).unionByName(dropped).write.mode("overwrite").parquet(f"{root}/notes/delta-{number:09d}")


def compact(spark: SparkSession, root: str) -> None:
    """Write both indexes as they are, so that later reads begin there."""
    for name in KEYS:
        parts = _parts(spark, root, name, None)
        if parts and parts[-1][1] == "delta":
            current(spark, root, name).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{root}/{name}/base-{parts[-1][0]:09d}")


def watched(changes: DataFrame, root: str, checkpoint: str):
    """A streaming query that keeps the indexes under root up to date with a stream of changes; it ends when none is left."""
    return changes.writeStream.foreachBatch(lambda df, number: apply_batch(df, root, number)).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
