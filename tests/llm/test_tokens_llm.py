import struct
import zlib

import numpy as np
import pytest

from lorewell.llm import chat, packing, token_output
from lorewell.llm.tokens import Encoder

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = ["", "  a  b\n\n c ", "it's 'tis ''s \n's x'll 'Re'LL 1's 23've 4 's", "'", "a'", "É Ünï<|endoftext|>x 12½ ", "日本 語 ΣΑΣ é", "a \n b\t c", "x\x1fy z", " lead", "trail ", "a b c   d", "x" * 5000, "don't\r\n\r\n ok"]
DDL = "doc_id long, text string, source string, _id long, ids string, range long"


def rows(texts):
    return [(i, t, "s", 7, "x", 3) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name, spark):
    e = Encoder(P.path(name), limit=50)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == want


def test_huffman_round_trip_and_lengths():
    rng = np.random.default_rng(5)
    counts = np.bincount(rng.zipf(1.3, 50_000) % 3000, minlength=3000)
    lengths = token_output.limited_lengths(counts, 12)
    used = lengths[lengths > 0].astype(int)
    assert used.max() <= 12 and abs(sum(2.0**-used) - 1) < 1e-12
    free = token_output.limited_lengths(counts, 30)
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((counts * free).sum()) == cost
    ids = rng.choice(np.flatnonzero(counts), 1000)
    bits, marks = token_output.pack_bits(ids, token_output.canonical_codes(lengths), lengths)
    assert (token_output.unpack_bits(bits, marks, len(ids), token_output.decode_table(lengths)) == ids).all()


def expected(spark, docs, name, end):
    e = Encoder(P.path(name)).tokenizer
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -(2**63), r["text"] or "") for r in docs.collect())
    return [(k, [*e.encode(t, add_special_tokens=False).ids, end]) for k, t in got]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_store_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").limit(150)
    docs = docs.union(spark.createDataFrame([(5000 + i, t, "s") for i, t in enumerate(ODD)] + [(9000, None, None), (None, "no id", "s")], "doc_id long, text string, source string"))
    store = token_output.write_store(docs, str(tmp_path / "s"), P.path("word_bpe_49k.json"), 2)
    got = {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_store(spark, store, True).collect()}
    want, at = set(), 0
    for k, ids in expected(spark, docs, "word_bpe_49k.json", 2):
        want.add((None if k == -(2**63) else k, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert spark.read.parquet(f"{store}/blocks").count() > 5


def test_store_empty_clashing_and_repeated(spark, tmp_path):
    docs = spark.createDataFrame(rows(["a b", None, ""]) + rows(["a b"]), DDL)
    store = token_output.write_store(docs, str(tmp_path / "a"), P.path("word_bpe_49k.json"), 2)
    out = token_output.read_store(spark, store).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in out] == [(0, 0, 3), (0, 3, 3), (1, 6, 1), (2, 7, 1)]
    store = token_output.write_store(docs.limit(0), str(tmp_path / "b"), P.path("word_bpe_49k.json"), 2)
    assert token_output.read_store(spark, store).count() == 0


def test_packing_covers_every_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.union(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(ODD)] + [(9000, None)], "doc_id long, text string"))
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), 0, window=64).cache()
    stream = {}
    for r in pieces.collect():
        assert 0 < r["length"] <= 64 and r["offset"] + r["length"] <= 64
        stream.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for k, ids in expected(spark, docs, "byte_bpe_50k.json", 0):
        assert b"".join(x for _, x in sorted(stream[k])) == struct.pack(f"<{len(ids)}I", *ids)
    seq = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert [r["sequence_id"] for r in seq] == list(range(len(seq))) and all(r["n_tokens"] == 64 == len(r["ids"]) // 4 for r in seq[:-1])
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json"), 0).count() == 0


def test_chat_folds_and_reads_back(spark):
    E = [
        (1, 0, "user", "hi <|im_end|>\n & [INST]", "message", None), (1, 1, "assistant", "Hel", "message", None), (1, 2, "assistant", "lo", "delta", None),
        (1, 3, "user", "more", "message", None), (1, 4, "assistant", "bad", "message", None), (1, 5, None, "go", "regenerate", None), (1, 6, None, "od", "delta", None),
        (1, 7, None, "HI &lt; there", "edit", 0), (1, 7, None, "!", "zdelta", 0), (2, 0, None, None, None, None), (None, 0, "a\nb", "", "message", None),
    ]
    E[8] = (1, 8, None, "!", "delta", 0)
    events = spark.createDataFrame(E, "conv_id long, turn long, role string, text string, kind string, target long")
    m = chat.fold(events, kind_col="kind", target_col="target")
    got = {(r["conv_id"], r["ordinal"]): (r["role"], r["text"]) for r in m.collect()}
    assert got == {(1, 0): ("user", "HI &lt; there!"), (1, 1): ("assistant", "Hello"), (1, 2): ("user", "more"), (1, 3): ("assistant", "good"), (2, 0): ("", ""), (None, 0): ("a\nb", "")}
    out = chat.format_conversations(m).withColumn("read", chat.parse(chat.F.col("formatted")))
    for r in out.collect():
        assert [(t["role"], t["text"]) for t in r["read"]] == [v for k, v in sorted(got.items(), key=str) if k[0] == r["conv_id"]]
        said = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert said == [v[1] for k, v in sorted(got.items(), key=str) if k[0] == r["conv_id"] and v[0] == "assistant"]
    assert chat.format_conversations(chat.fold(events.limit(0), kind_col="kind")).count() == 0


def test_range_of_is_a_binary_search(spark):
    import bisect

    from lorewell.llm import common

    for n in (0, 1, 2, 7, 50):
        bounds = sorted({float(k * k % 101) for k in range(n)})
        rows = spark.range(-3, 105).select("id", common.range_of(bounds, "id").alias("r")).collect()
        assert [r["r"] for r in rows] == [bisect.bisect_right(bounds, r["id"]) for r in rows]
