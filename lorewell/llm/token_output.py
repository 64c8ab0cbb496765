"""Token-ID output: ids in independent, canonically Huffman-coded blocks, with bit offsets from which decoding can start.

A store is a folder of two Parquet tables: `header` (one row: code lengths of all ids, end id) and `blocks` (one row a
block: number of the document range, number of the block, ids before it, document ids, token counts, bit offsets of
every STRIDE-th token, code bits). Blocks decode on their own; ranges and blocks are in ascending doc_id order.
Null texts count as empty, null ids sort first and come back as null, repeated rows stay, equal ids are in text order of
their ids' bytes; an empty table makes a store without blocks. Texts of any length are whole; a block holds whole documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common
from lorewell.llm.tokens import encoder

#: Longest code; ids up to 2**MAX_BITS can be told apart, and the decoding table has so many rows.
MAX_BITS = 18
#: Tokens between two bit offsets.
STRIDE = 128
#: A block is closed when it has so many tokens.
BLOCK_TOKENS = 1 << 19
#: Bytes of ids that one document range holds, about.
RANGE_BYTES = 12 << 20

IDS = pa.schema([("_id", pa.int64()), ("part", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
IDS_DDL = "_id long, part long, before long, n_tokens long, ids binary"


def token_table(docs: DataFrame, path: str, end_id: int, text_col: str = "text") -> DataFrame:
    """_id, part (the scan's partition), before (ids before it in its part), n_tokens, ids (with the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for at in range(0, len(texts), 2000):
                ids = [x + end for x in enc.encode(texts[at : at + 2000])]
                n = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield common.batch(IDS, b.column(0)[at : at + 2000], np.full(len(n), part), start, n, ids)

    return docs.select("_id", text_col).mapInArrow(common.lean(run), IDS_DDL)


def limited_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code lengths of an optimal prefix code with codes of at most limit bits (package-merge); 0 for unused ids."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    items, levels = weights, []
    for _ in range(limit - 1):
        n = len(items) // 2 * 2
        packages = items[0:n:2] + items[1:n:2]
        both = np.concatenate((weights, packages))
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        items = both[order]
    take = 2 * (len(used) - 1)
    for own in reversed(levels):
        singles = int(own[:take].sum())
        lengths[used[:singles]] += 1
        take = 2 * (take - singles)
    lengths[used[:take]] += 1
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and id, each the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next MAX bits: the id that it begins with, and that id's code length."""
    bits = max(1, int(lengths.max(initial=1)))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = (1 << (bits - lengths[order].astype(np.int64))).astype(np.int64)
    ids, sizes = np.repeat(order, spans), np.repeat(lengths[order], spans)
    pad = (1 << bits) - len(ids)
    return np.concatenate((ids, np.zeros(pad, ids.dtype))), np.concatenate((sizes, np.ones(pad, np.uint8))), bits


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids one after the other, highest bit first, and the bit offset of every STRIDE-th id."""
    size = lengths[ids].astype(np.int64)
    after = np.cumsum(size)
    at = after - size
    n = (int(after[-1]) + 7) // 8 if len(ids) else 0
    out = np.zeros(n + 4)
    word = codes[ids].astype(np.uint64) << (np.uint64(32) - size.astype(np.uint64) - (at & 7).astype(np.uint64))
    for k in range(4):
        part = (word >> np.uint64(24 - 8 * k)) & np.uint64(255)
        out += np.bincount((at >> 3) + k, weights=part, minlength=n + 4)
    return out[:n].astype(np.uint8).tobytes(), at[::STRIDE].astype("<u4")


def unpack_bits(payload: bytes, marks: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids: from every bit offset at once, one id a step, by lookups in the table."""
    ids_of, size_of, bits = table
    lanes = marks.astype(np.int64)
    out = np.zeros((len(lanes), STRIDE), np.uint32)
    data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    most = len(words) - 1
    for k in range(STRIDE if n >= STRIDE else n):
        at = np.minimum(lanes >> 3, most)
        key = (words[at] << (lanes & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        out[:, k] = ids_of[key]
        lanes += size_of[key]
    return out.reshape(-1)[:n]


BLOCKS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.binary()), ("doc_tokens", pa.binary()), ("marks", pa.binary()), ("bits", pa.binary())])
BLOCKS_DDL = "part long, block long, start long, doc_ids binary, doc_tokens binary, marks binary, bits binary"


def write_store(docs: DataFrame, store: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenize whole texts and write them to the store, in ascending order of ids. Returns the store's path."""
    spark = docs.sparkSession
    table, scratch = common.materialize(token_table(common.keyed(docs, id_col, text_col), tokenizer_path, end_id, text_col), "ids")
    dtype, n_vocab = encoder(tokenizer_path).dtype, max(encoder(tokenizer_path).n_vocab, end_id + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_vocab, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype)
            total += np.bincount(ids, minlength=n_vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(n_vocab, np.int64)  # at most as many rows as the vocabulary has ids
    for r in table.select("ids").mapInArrow(common.lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    lengths = limited_lengths(counts, max(MAX_BITS, int(np.ceil(np.log2(max(2, np.count_nonzero(counts)))))))
    codes = canonical_codes(lengths)

    # as many ranges as bytes call for, but no more bounds than a few a task of the session; blocks are streamed within a range
    parts = max(1, min(int(counts.sum()) * dtype.itemsize // RANGE_BYTES, max(64, 4 * common.width(spark))))
    bounds = common.edges(table, parts)
    ranged = table.select(common.range_of(bounds).cast("int").alias("range"), "_id", "n_tokens", "ids")
    totals = dict(ranged.groupBy("range").agg(F.sum("n_tokens")).collect())  # one number a range
    base, total = {}, 0
    for k in sorted(totals):
        base[k], total = total, total + totals[k]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"range": None, "start": 0, "block": 0}
        held: list[tuple[int, bytes]] = []

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), dtype)
            bits, marks = pack_bits(ids, codes, lengths)
            out = common.batch(BLOCKS, [state["range"]], [state["block"]], [state["start"]], [np.array([k for k, _ in held], "<i8").tobytes()], [np.array([len(x) // dtype.itemsize for _, x in held], "<i8").tobytes()], [marks.tobytes()], [bits])
            state["start"] += len(ids)
            state["block"] += 1
            held.clear()
            return out

        size = 0
        for b in batches:
            for k, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and (k != state["range"] or size >= BLOCK_TOKENS * dtype.itemsize):
                    yield block()
                    size = 0
                if k != state["range"]:
                    state |= {"range": k, "start": base[k], "block": 0}
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield block()

    ordered = ranged.select("range", "_id", "ids").repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("_id", "ids")
    ordered.mapInArrow(common.lean(encode), BLOCKS_DDL).write.option("compression", "none").parquet(f"{store}/blocks")
    spark.createDataFrame([(lengths.tobytes(), end_id, MAX_BITS)], "lengths binary, end_id long, max_bits long").coalesce(1).write.parquet(f"{store}/header")
    common.discard(spark, scratch)
    return store


OUT = pa.schema([("_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_store(spark: SparkSession, store: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers; digest: ids_crc32 instead) of each document."""
    lengths = np.frombuffer(spark.read.parquet(f"{store}/header").first()["lengths"], np.uint8)
    table = decode_table(lengths)
    schema = pa.schema([*list(OUT)[:3], ("ids_crc32", pa.int64())]) if digest else OUT

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.frombuffer(r["doc_tokens"], "<i8")
                after = np.cumsum(n)
                ids = unpack_bits(r["bits"], np.frombuffer(r["marks"], "<u4"), int(after[-1]), table).astype("<u4")
                cut = [ids[a - k : a].tobytes() for a, k in zip(after.tolist(), n.tolist(), strict=True)]
                yield common.batch(schema, np.frombuffer(r["doc_ids"], "<i8"), r["start"] + after - n, n, [zlib.crc32(x) for x in cut] if digest else cut)

    blocks = spark.read.schema(BLOCKS_DDL).parquet(f"{store}/blocks")
    out = blocks.mapInArrow(common.lean(decode), "_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))
    return out.select(common.restored(F.col("_id")).alias("doc_id"), *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files that were just written."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = write_store(docs, common.scratch_path(spark, "store"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_store(spark, store, digest=True)
