"""Packing: the token stream of all documents is cut into fixed windows; boundary records say which piece lies where.

Two passes: the first tokenizes whole texts and gives each document its place within its partition; the partitions'
totals, summed on the driver (one number a partition), give every partition its global offset, and the second pass cuts
documents at multiples of the window without moving a row. Only the last window can be short; it is padded.
Null texts count as empty (their end id is packed), null ids stay null, repeated rows are packed as often as they occur,
an empty table makes no pieces. The stream follows the order in which the table was read, not the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common
from lorewell.llm.token_output import token_table
from lorewell.llm.tokens import encoder

WINDOW = 1024
COLUMNS = "_id long, start long, length long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit; digest: ids_crc32)."""
    table, _ = common.materialize(token_table(common.keyed(docs, id_col, text_col), tokenizer_path, end_id, text_col), "packed")
    dtype = encoder(tokenizer_path).dtype
    base, total = {}, 0
    for part, n in sorted(table.groupBy("part").agg(F.sum("n_tokens")).collect()):
        base[part], total = total, total + n
    last = pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.binary())
    schema = pa.schema([*((k, pa.int64()) for k in ("_id", "start", "length", "doc_tokens", "sequence_id", "offset")), last])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, before, n = (b.column(k).to_numpy() for k in (1, 2, 3))
            at = np.array([base[p] for p in part.tolist()], np.int64) + before
            pieces = (at + n - 1) // window - at // window + 1  # every document has its end id at least
            doc = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[doc] // window + k
            begin = np.maximum(at[doc], sequence * window)
            end = np.minimum((at + n)[doc], (sequence + 1) * window)
            start, length = begin - at[doc], end - begin
            ids = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in b.column(4).to_pylist()]
            cuts = [ids[d][4 * a : 4 * z] for d, a, z in zip(doc.tolist(), start.tolist(), (start + length).tolist(), strict=True)]
            yield common.batch(schema, b.column(0).to_numpy()[doc], start, length, n[doc], sequence, begin - sequence * window, [zlib.crc32(x) for x in cuts] if digest else cuts)

    out = table.mapInArrow(common.lean(cut), f"{COLUMNS}, " + ("ids_crc32 long" if digest else "ids binary"))
    return out.select(common.restored(F.col("_id")).alias("doc_id"), *out.columns[1:])


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of every window, put together from the pieces of pack()."""
    row = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.concat(F.lit(b""), F.aggregate(row, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the pieces of all documents in windows of 1024 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, digest=True)
