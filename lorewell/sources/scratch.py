"""Tables in the shared folder that the cluster names in spark.checkpoint.dir; on a local master our own where it names none."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder. Only a local master may do without one, as executors do not see each other's disks; it gets a folder
    of this process, which goes at its end."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN:
        made = tempfile.mkdtemp(prefix="lorewell-")
        _OWN[context.applicationId] = f"file://{made}"
        context.setCheckpointDir(_OWN[context.applicationId])
        atexit.register(shutil.rmtree, made, True)
    return _OWN[context.applicationId]


def checkpointed(df: DataFrame) -> DataFrame:
    root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own: computed once however often the result is read."""
    path = f"{root(df.sparkSession)}/lorewell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and last change of a file or folder, wherever Spark can read it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


_INDEXES: dict[tuple, DataFrame] = {}


def discard(df: DataFrame) -> None:
    """Deletes the table of written() that df reads, which nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        p.getFileSystem(conf).delete(p, True)


def index(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], made: bool = False) -> DataFrame:
    """The index `name` over the file or folder source: built at the first request of a session and when source changed. made:
    build() gives a table of written() already."""
    key = (spark.sparkContext.applicationId, name, source, *stamp(spark, source))
    if key not in _INDEXES:
        _INDEXES[key] = build() if made else written(build(), name)
    return _INDEXES[key]


def spread(spark: SparkSession, df: DataFrame, source: str) -> DataFrame:
    """df dealt over all cores if source is small, as one file of one row group is read by one task; large inputs have tasks enough."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if stamp(spark, source)[0] < cores * (32 << 20) else df
