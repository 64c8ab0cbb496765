"""Importance resampling towards a target distribution over hashed features, by external sort-count.

Every text becomes a stream of packed 16-bit bucket numbers (features: runs of 1 to ORDER words; bucket: crc32 modulo
BUCKETS). The streams of a task's documents are written as blocks of a table, each with the offsets of its documents. Both
later passes read that table, not the texts: the first sorts each block and run-length encodes it, runs of equal buckets
are added up by bucket over all blocks; the second looks the buckets' gains up and sums them by document with
np.add.reduceat. What the driver holds is one count a bucket. Documents are then drawn without replacement by Gumbel noise
that a hash of the id gives: scores are sorted by range (score, id, place of the row, so that equal scores and even equal
rows are split), and ranks are places in a range after the totals of the ranges before it.

Null texts have no features (weight 0), repeated rows count and are scored as often as they occur (equal scores: smaller
id, then place in the table), null ids stay null, rank before all others among equal scores and are hashed as the empty
text; an empty table gives an empty result, an empty target gives gains of its smoothing alone. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common

BUCKETS, ORDER, SEED = 10_000, 1, 2024
#: Documents under so many words are never drawn; so many of a hundred of the others are.
LEAST_WORDS, PERCENT = 20, 10
#: Bytes of text that are split into words at a time, and features of a block (a longer document is a block of its own).
PIECE, BLOCK = 1 << 20, 1 << 20
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 17
#: Bytes of UTF-8 as they count: A-Z in lower case, every other byte outside words as a space.
_WORD_BYTE = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
FOLDED = bytes(b if _WORD_BYTE.match(bytes([b])) else 32 for b in bytes(range(256)).lower())

BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("stream", pa.large_binary())])
BLOCKS_DDL = "part int, block int, ids array<long>, ends array<long>, words array<long>, stream binary"
SCORED_DDL = "_id long, part int, place long, n_words long, n_features long, weight long, score long"


class Hashes(dict):
    """crc32 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = zlib.crc32(word)
        return found


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded pieces of it."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(FOLDED)
        if at + PIECE < len(text):  # up to the last word's end
            cut = piece.rfind(b" ") + 1
            while not cut:  # one word goes beyond the piece
                more = text[at + len(piece) : at + len(piece) + PIECE].translate(FOLDED)
                cut = len(piece) + more.find(b" ") + 1 if b" " in more else 0
                piece += more
                if not more:
                    cut = len(piece)
            piece = piece[:cut]
        yield piece.split()
        at += len(piece)


def features(text: bytes, known: Hashes, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Buckets of all features of a text, and its number of words."""
    out, n = [], 0
    before: list[int] = []  # hashes of the runs of 1, 2, ... words that end at the last word
    for words in words_of(text):
        n += len(words)
        if order == 1:
            out.append(np.fromiter((known[w] for w in words), np.uint32, len(words)))
            continue
        hashes = []
        for w in words:
            tail = b" " + w
            before = [known[w], *(zlib.crc32(tail, h) for h in before[: order - 1])]
            hashes += before
        out.append(np.array(hashes, np.uint32))
    stream = np.concatenate(out) if out else np.zeros(0, np.uint32)
    return (stream % np.uint32(buckets)).astype("<u2"), n


def streams(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of bucket streams with the ids, word counts and end offsets of their documents."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers must fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, known = TaskContext.get().partitionId(), 0, Hashes()
        ids: list[int] = []
        held: list[np.ndarray] = []
        words: list[int] = []
        size = 0

        def put() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            return common.batch(BLOCKS, [part], [block], [ids], [ends.tolist()], [words], [np.concatenate(held).tobytes()])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                stream, n = features((text.as_py() or "").encode(), known, order, buckets)
                if ids and size + len(stream) > BLOCK or len(ids) >= BLOCK // 8:
                    yield put()
                    ids, held, words, size, block = [], [], [], 0, block + 1
                ids.append(i)
                held.append(stream)
                words.append(n)
                size += len(stream)
        if ids:
            yield put()

    return common.keyed(docs, id_col, text_col).mapInArrow(common.lean(run), BLOCKS_DDL)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a stream and their counts, by sorting it."""
    s = np.sort(stream)
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[starts], np.diff(np.append(starts, len(s)))


def counted(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all streams. A task adds the runs of its blocks up before they are exchanged."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for stream in b.column(0):
                which, n = run_lengths(np.frombuffer(stream.as_buffer() or b"", "<u2"))
                total[which] += n
        some = np.flatnonzero(total)
        yield common.batch(schema, some.astype(np.int32), total[some])

    rows = blocks.select("stream").mapInArrow(common.lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains_of(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of each bucket's share in the target to that in the corpus, rounded down."""
    k, of_own, of_target = len(own), float(own.sum() + len(own)), float(target.sum() + len(own))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * of_own / ((float(own[b]) + 1) * of_target))) for b in range(k)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(stream: np.ndarray, ends: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The sum of the gains over each document's part of a stream; empty parts sum to 0."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out, full = np.zeros(len(ends), np.int64), ends > starts
    if full.any():
        out[full] = np.add.reduceat(gains[stream], starts[full])
    return out


def scored(blocks: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """_id, place, n_words, n_features, weight and score of every document of the blocks."""
    schema = pa.schema([("_id", pa.int64()), ("part", pa.int32()), *((k, pa.int64()) for k in ("place", "n_words", "n_features", "weight", "score"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block, ids, ends, words, stream in zip(*b.columns, strict=True):
                ids, ends = ids.values.to_numpy(), ends.values.to_numpy()
                weight = weights(np.frombuffer(stream.as_buffer() or b"", "<u2"), ends, gains)
                score = weight + np.array([noise(None if i == common.NULL_ID else i, seed) for i in ids.tolist()], np.int64)
                place = (block.as_py() << 32) + np.arange(len(ids))
                yield common.batch(schema, ids, np.full(len(ids), part.as_py(), np.int32), place, words.values.to_numpy(), np.diff(ends, prepend=0), weight, score)

    return blocks.mapInArrow(common.lean(run), SCORED_DDL)


def ranked(rows: DataFrame, share: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """rows (of scored(), a table) with rank: 1, 2, 3, ... for the drawn ones, null for the others. No row meets all others:
    rows are dealt by range of (score, id, place) and sorted there, and the driver adds one count a range up."""
    spark = rows.sparkSession
    able = rows.filter(F.col("n_words") >= least)
    dealt = able.repartitionByRange(common.width(spark), F.desc("score"), "_id", "part", "place").sortWithinPartitions(F.desc("score"), "_id", "part", "place")
    at = F.monotonically_increasing_id()  # range number above, place in the range in the lower 33 bits
    sorted_rows, _ = common.materialize(dealt.select("_id", "n_features", "weight", "score", at.alias("at")), "ranked")
    which = F.shiftright("at", 33)
    sizes = sorted_rows.groupBy(which.alias("range")).agg(F.count("*").alias("n")).collect()  # a row a range
    base, total = {}, 0
    for r in sorted(sizes):
        base[r["range"]], total = total, total + r["n"]
    first = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[which] if base else F.lit(0)
    rank = first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = sorted_rows.select("_id", "n_features", "weight", "score", F.when(rank <= share * total // 100, rank.cast("long")).alias("rank"))
    return drawn.unionByName(rows.filter(F.col("n_words") < least).select("_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, share: int = PERCENT, least: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; those with a rank are the sample, `share` of a hundred documents
    of `least` words or more, the likelier the more their features are the target's."""
    spark = docs.sparkSession
    blocks, blocks_path = common.materialize(streams(docs, order, buckets, id_col, text_col), "streams")
    wanted, wanted_path = common.materialize(streams(target, order, buckets, target_id, target_text), "target")
    gains = gains_of(counted(blocks, buckets), counted(wanted, buckets))
    rows, _ = common.materialize(scored(blocks, gains, seed), "scored")
    common.discard(spark, blocks_path, wanted_path)
    return ranked(rows, share, least).select(common.restored(F.col("_id")).alias("doc_id"), "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: a tenth of all documents drawn towards the benchmark's words."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents"), read("benchmark"))


#: The same in DuckDB: crc32 by its table over the bytes of each distinct word.
SQL = """WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS tab FROM bits WHERE k = 8),
hexes AS (SELECT map(list(printf('%02X', i)), list(CAST(i AS BIGINT))) AS byte FROM range(256) t(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
own AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY 1), wanted AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY 1),
hashed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 2 * strlen(word), 2), lambda p: byte[substr(hex(encode(word)), p, 2)])), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM own UNION SELECT word FROM wanted), crc, hexes),
s AS (SELECT bucket, sum(n) AS s FROM own JOIN hashed USING (word) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM wanted JOIN hashed USING (word) GROUP BY 1),
gain AS (SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
paid AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN paid USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (doc_id)"""
