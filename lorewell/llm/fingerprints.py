"""Canonical exact digests: texts are normalised (NFKC), case-folded, their white space folded, and hashed to 128 bits.

Documents with one digest form a group. Digests that occur twice are confirmed byte by byte: canonical texts are
aggregated together with their digest, partially on the map side, so a hot group sends one row a task; if two texts ever
share a digest, the run is repeated with a digest of 384 bits. Which rows must show their text is told by a bitmap of
SLOTS bits over the repeated digests, a bound that does not follow the data; false hits cost only a comparison.
Null texts count as empty, null ids sort first and come back as null, rows that repeat an id are each other's neighbours
in order of their text's bytes, an empty table gives an empty result, texts of any length are whole.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common

SLOTS = 1 << 20
#: Hexadecimal digits of a digest; fewer serve tests of collisions.
DIGITS = 32


def canonical(text: str) -> str:
    """The text's canonical form: equal for texts that differ in compatibility forms, case or white space only."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def print_of(data: bytes, wide: bool, digits: int) -> str:
    return xxhash.xxh3_128_hexdigest(data)[:digits] + (hashlib.sha256(data).hexdigest() if wide else "")


def digest(text: str, wide: bool = False, digits: int = DIGITS) -> str:
    return print_of(canonical(text).encode(), wide, digits)


def repeated_slots(prints: DataFrame) -> np.ndarray:
    """A bitmap of SLOTS bits over the digests that occur more than once."""
    slot = F.conv(F.substring("fingerprint", 1, 5), 16, 10).cast("int")
    twice = prints.groupBy("fingerprint").count().filter("count > 1").select(slot.alias("slot")).distinct()
    out = np.zeros(SLOTS, bool)
    out[[r["slot"] for r in twice.collect()]] = True  # SLOTS numbers at most
    return out


def has_collision(docs: DataFrame, prints: DataFrame, wide: bool, digits: int = DIGITS) -> bool:
    """Whether two canonical texts share a digest. docs: _id, text; prints: fingerprint."""
    slots = repeated_slots(prints)
    schema = pa.schema([("fingerprint", pa.string()), ("canon", pa.binary())])

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            rows = {}
            for text in b.column(0).to_pylist():
                data = canonical(text or "").encode()
                key = print_of(data, wide, digits)
                if slots[int(key[:5], 16)]:
                    rows[key, pack.compress(data)] = None
            yield common.batch(schema, [k for k, _ in rows], [v for _, v in rows])

    texts = docs.select("text").mapInArrow(common.lean(shown), "fingerprint string, canon binary")
    distinct = texts.groupBy("fingerprint", "canon").agg(F.count("*").alias("n"))
    return not distinct.groupBy("fingerprint").agg(F.count("*").alias("texts")).filter("texts > 1").isEmpty()


ROWS = pa.schema([("_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
ROWS_DDL = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
SENT = pa.schema([("range", pa.int32()), ("tail", pa.bool_()), ("_id", pa.int64()), ("packed", pa.binary()), ("order", pa.binary())])


def with_neighbours(docs: DataFrame) -> DataFrame:
    """range, tail, _id, packed text, order (the text where ids repeat): documents dealt by ranges of ids, each range sorted and followed by a copy of the
    first document after it (tail; after the last range: of the first range), so that neighbours meet in one task."""
    bounds = common.edges(docs, common.width(docs.sparkSession))
    cuts = np.array(bounds)
    firsts = {r["range"]: r["first"] for r in docs.groupBy(common.range_of(bounds).alias("range")).agg(F.min("_id").alias("first")).collect()}
    filled = sorted(firsts)
    tail_of = {firsts[k]: filled[i - 1] for i, k in enumerate(filled)}
    ties = not docs.groupBy("_id").count().filter("count > 1").isEmpty()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = b.column(0).to_numpy()
            texts = common.utf8(b.column(1))
            for at, to in common.slices(texts, 8 << 20):
                packed = [pack.compress(t) for t in texts[at:to]]
                part = np.searchsorted(cuts, ids[at:to].astype(np.float64), "right")
                yield common.batch(SENT, part.astype(np.int32), np.zeros(to - at, bool), ids[at:to], packed, texts[at:to] if ties else [None] * (to - at))
                more = [i for i in range(at, to) if int(ids[i]) in tail_of]
                if more:
                    yield common.batch(SENT, [tail_of[int(ids[i])] for i in more], np.ones(len(more), bool), ids[more], [packed[i - at] for i in more], [texts[i] if ties else None for i in more])

    dealt = docs.select("_id", "text").mapInArrow(common.lean(deal), "range int, tail boolean, _id long, packed binary, order binary")
    return dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "tail", "_id", "order").select("range", "tail", "_id", "packed")


def edited_prints(docs: DataFrame, wide: bool = False, digits: int = DIGITS) -> DataFrame:
    """For each document its fingerprint, that of its edited text and the next document's likeness. docs: _id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        before, done = None, False
        for b in batches:
            out = []
            for part, tail, key, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if before is not None and part != before[0]:
                    before, done = None, False
                if done:
                    continue
                text = unpack.decompress(packed).decode()
                mine = digest(text, wide, digits)
                if before is not None:
                    _, last_key, last, last_print = before
                    k = len(last) // 4
                    edited = last[: len(last) - k] + text[:k]
                    edited_print = digest(edited, wide, digits) if edited != last else last_print
                    out.append((last_key, len(last), hashlib.sha256(edited.encode()).hexdigest(), last_print, edited_print, float(edited_print == last_print), float(mine == last_print)))
                before, done = (part, key, text, mine), tail
            yield common.batch(ROWS, *(zip(*out, strict=True) if out else [[]] * len(ROWS)))

    return with_neighbours(docs).mapInArrow(common.lean(run), ROWS_DDL)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id (smallest id with
    the same canonical text), group_size."""
    d = common.keyed(docs, id_col, text_col).withColumnRenamed(text_col, "text")
    for wide in (False, True):
        prints, path = common.materialize(edited_prints(d, wide, digits), "prints")
        if wide or not has_collision(d, prints, wide, digits):
            break
        common.discard(d.sparkSession, path)
    groups, _ = common.materialize(prints.groupBy("fingerprint").agg(F.min("_id").alias("first"), F.count("*").alias("size")).filter("size > 1"), "groups")
    out = common.hot_join(prints, groups, "fingerprint", prints.count(), "left")
    return out.select(
        common.restored(F.col("_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        common.restored(F.coalesce("first", "_id")).alias("group_id"), F.coalesce("size", F.lit(1)).alias("group_size"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
