"""Helpers that the training-data operators share: shared scratch tables, document ranges, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.sources import scratch

#: Stands for a null id wherever ids are ordered or packed; it sorts before every other id.
NULL_ID = -(2**63)
#: Texts are handled in slices of about so many bytes, so that memory does not follow a batch's row count.
SLICE_BYTES = 2 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the cluster (spark.checkpoint.dir)."""
    return f"{scratch.root(spark)}/lorewell/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. Returns the table and its path."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Rows and bytes of the Arrow batches that tasks exchange with Python; bounds memory whatever the texts' length.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds on Arrow batches to BATCH where they are higher or unset."""
    for key, most in BATCH.items():
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def lean(run):
    """A mapInArrow function that allocates from the system and returns freed memory to it when a task ends, as Python
    workers live on and their allocators would keep what the largest task needed."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        pa.set_memory_pool(pa.system_memory_pool())
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        done = 0
        for out in run(batches):
            yield out
            done += 1
            if trim and done % 16 == 0:
                trim(0)
        del batches
        if trim:
            trim(0)

    return lean_run


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the named columns, with the id as _id (null: NULL_ID); other columns, clashing or not, go."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), *[F.col(c).alias(c) for c in cols])


#: A key is hot if it holds more than one in so many rows; so there are no more hot keys than that.
HOT = 1000


def hot_join(df: DataFrame, keyed: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """df joined with keyed (key, size: df's rows of that key, ...) on key, where df has at most so many rows. The hot keys, at
    most HOT by their definition, are broadcast, so that no task gets all rows of one; the others are exchanged."""
    least = max(rows // HOT, 64)
    hot, rest = F.broadcast(keyed.filter(F.col("size") > least)), keyed.filter(F.col("size") <= least)
    return df.join(hot, key).unionByName(df.join(hot.select(key), key, "left_anti").join(rest, key, how))


def restored(col: Column) -> Column:
    return F.when(col != F.lit(NULL_ID), col)


def edges(df: DataFrame, parts: int, col: str = "_id") -> list[float]:
    """Inner bounds that cut df into about equal ranges of col; at most parts - 1 numbers, found from that column alone."""
    if parts < 2:
        return []
    found = df.select(F.col(col).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted(set(found))


def range_of(bounds: list[float], col: str = "_id") -> Column:
    """The number of the range that col falls in, inside the JVM: first the chunk of bounds, then the bound in it, so that
    a row is compared with about twice the root of their number."""
    if not bounds:
        return F.lit(0)
    x, step = F.col(col).cast("double"), max(1, round(len(bounds) ** 0.5))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda bs: F.size(F.filter(bs, lambda b: b <= x))
    listed = lambda bs: F.array(*[F.lit(float(b)) for b in bs])
    chunk = below(listed([c[0] for c in chunks[1:]])) if len(chunks) > 1 else F.lit(0)
    return chunk * step + below(F.get(F.array(*[listed(c) for c in chunks]), chunk))


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) index ranges of at most about limit bytes, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts and at < len(texts):
        yield at, len(texts)


def batch(schema: pa.Schema, *cols: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bits of the bitmaps that tell a scan which ids a small table may hold; their size does not follow the data. When a table
#: has more ids than that, the scan learns nothing and all rows are exchanged: slower, with the same result.
SLOT_BITS = 23
FOLDS = (7, 20, 33, 45)


def slots_of(ids: DataFrame, col: str) -> np.ndarray:
    """A bitmap with the slots of all ids set, built on the cluster in pieces of 4 KB."""
    slot = F.col(col)
    for k in FOLDS:  # numbers that differ in their upper bits only, as row numbers do, must not share slots
        slot = slot.bitwiseXOR(F.shiftrightunsigned(col, k))
    s = ids.filter(F.col(col).isNotNull()).select(slot.bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("s"))
    pieces = s.groupBy(F.shiftright("s", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit(32767))).alias("bits")).collect()  # 256 rows at most
    out = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    for r in pieces:
        out[r["piece"] * 4096 : r["piece"] * 4096 + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def in_slots(slots: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids a bitmap of slots_of() may hold."""
    u = ids.astype(np.int64).view(np.uint64)
    s = u.copy()
    for k in FOLDS:
        s ^= u >> np.uint64(k)
    s &= np.uint64((1 << SLOT_BITS) - 1)
    return (slots[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs but for the ids in gone (one column, id_col). Only rows whose slot gone has are exchanged for the anti join."""
    bounded_batches(docs.sparkSession)
    slots, at = slots_of(gone, id_col), docs.columns.index(id_col)

    def side(which: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = in_slots(slots, b.column(at).fill_null(0).to_numpy(zero_copy_only=False))
                yield b.filter(pa.array(hit == which))

        return docs.mapInArrow(lean(run), docs.schema)

    return side(False).union(side(True).join(gone, id_col, "left_anti").select(docs.columns))
