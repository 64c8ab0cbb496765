"""Language identification by prediction by partial matching (PPM) over bytes, with frozen statistics.

For each language a context tree of orders 0 to ORDER holds byte counts; a byte that a context has not seen is coded
after an escape (method C: distinct successors over total plus distinct) in the next shorter context, at last with 8
bits. As statistics are frozen after training, the exact code length of a byte depends on the longest stored context
only, so all escapes are resolved once into a table (context, byte, language); a text's length under every language is
then two lookups a byte. The text goes to the language of the shortest code; score is that language's share under a
uniform prior.
Training takes a bounded sample of labelled rows: about SAMPLE_DOCS whole documents a language, chosen by a hash of the
id, which no prediction sees; every context of the sample counts. The table has a row a context and symbol seen anywhere
and two bytes a language in it, so that it follows the sample and the number of languages, not the corpus. Null or letterless texts, and all texts if nothing is labelled, are `und` with score 0.
Null ids stay null, repeated rows are scored as often as they occur, ties go to the first language by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common

ORDER = 3
#: Documents a language that training takes, about.
SAMPLE_DOCS = 600
#: Characters of the longest documents that training takes; so a sample has at most SAMPLE_DOCS * LONGEST a language.
LONGEST = 1 << 16
#: Code lengths are kept in units of 1/UNIT bits.
UNIT = 1024
LETTER = re.compile(r"[^\W\d_]")
LEAD = b"\n" * ORDER


class Model:
    """code: byte to symbol; longest: last ORDER symbols to context; cost: (context, symbol) to bits of each language."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        joined = {k: np.frombuffer(b"".join(LEAD + t for t in samples[k]), np.uint8) for k in self.langs}
        pads = {k: self._pads([len(t) for t in samples[k]]) for k in self.langs}
        seen = np.unique(np.concatenate([np.frombuffer(LEAD, np.uint8), *joined.values()]))
        self.code = np.full(256, len(seen), np.int64)  # bytes never seen share the last symbol
        self.code[seen] = np.arange(len(seen))
        a = self.size = len(seen) + 1
        counts = {}  # (language, order): contexts with symbol, their counts
        for k in self.langs:
            s = self.code[joined[k]]
            at = np.flatnonzero(~pads[k])
            for d in range(ORDER + 1):
                key = np.zeros(len(at), np.int64)
                for j in range(d, -1, -1):
                    key = key * a + s[at - j]
                counts[k, d] = np.unique(key, return_counts=True)
        per_order = [np.unique(np.concatenate([counts[k, d][0] // a for k in self.langs])) for d in range(ORDER + 1)]
        tables, base = [], 0
        self.longest = np.zeros((a,) * ORDER, np.uint16 if sum(map(len, per_order)) < 1 << 16 else np.uint32)
        before_ctx = before = None
        for d, ctx in enumerate(per_order):
            table = np.full((len(ctx), a, len(self.langs)), 8.0, np.float32)
            if d:
                up = np.searchsorted(before_ctx, ctx % a ** (d - 1))
                table[:] = before[up]
            for j, k in enumerate(self.langs):
                key, n = counts[k, d]
                pos = np.searchsorted(ctx, key // a)
                ok = (pos < len(ctx)) & (ctx[np.minimum(pos, len(ctx) - 1)] == key // a) if len(ctx) else np.zeros(len(key), bool)
                pos, sym, n = pos[ok], key[ok] % a, n[ok]
                kinds = np.bincount(pos, minlength=len(ctx))
                whole = np.bincount(pos, weights=n, minlength=len(ctx)) + kinds
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(kinds > 0, np.log2(whole) - np.log2(kinds), 0.0)
                table[:, :, j] += escape[:, None].astype(np.float32)
                table[pos, sym, j] = np.log2(whole[pos]) - np.log2(n)
            index = (base + np.arange(len(ctx))).astype(self.longest.dtype)
            if d == 0:
                self.longest[...] = 0
            else:
                symbols = [ctx // a**j % a for j in range(d - 1, -1, -1)]
                self.longest[(..., *symbols)] = index
            base += len(ctx)
            tables.append(table)
            before_ctx, before = ctx, table
        cost = np.concatenate(tables)
        self.cost = np.minimum(np.rint(cost * UNIT), 65535).astype(np.uint16).reshape(-1, len(self.langs))
        self.longest = self.longest.reshape(-1)

    @staticmethod
    def _pads(lengths: list[int]) -> np.ndarray:
        starts = np.cumsum([0, *[n + ORDER for n in lengths]])[:-1]
        out = np.zeros(int(sum(lengths)) + ORDER * len(lengths), bool)
        for j in range(ORDER):
            out[starts + j] = True
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in 1/UNIT bits of each text under each language."""
        a, s = self.size, self.code[np.frombuffer(b"".join(LEAD + t for t in texts), np.uint8)]
        context = np.zeros(len(s), np.int64)
        for j in range(ORDER, 0, -1):
            context[ORDER:] = context[ORDER:] * a + s[ORDER - j : len(s) - j]
        lengths = np.array([len(t) for t in texts])
        cost = self.cost[self.longest[context].astype(np.int64) * a + s]
        cost[self._pads(lengths.tolist())] = 0
        starts = np.cumsum(lengths + ORDER) - lengths - ORDER
        return np.add.reduceat(cost, starts, axis=0, dtype=np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        raw = [(t or "").encode() for t in texts]
        langs, scores = [], []
        for at, to in common.slices(raw, 1 << 20):
            bits = self.bits(raw[at:to])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum((bits[np.arange(len(best)), best][:, None] - bits) / UNIT, -1000)).sum(1)
            for t, k, x in zip(texts[at:to], best.tolist(), share.tolist(), strict=True):
                known = bool(t) and LETTER.search(t) is not None
                langs.append(self.langs[k] if known else "und")
                scores.append(x if known else 0.0)
        return langs, scores


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> Model | None:
    """A model from about `sample` labelled documents a language; None if there are none."""
    labelled = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= LONGEST))
    counts = {r[lang_col]: r["count"] for r in labelled.groupBy(lang_col).count().collect()}  # a row a language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])[F.col(lang_col)]
    chosen = labelled.filter(F.pmod(F.xxhash64(F.coalesce(F.col(id_col), F.lit(0)), F.lit("language")), F.lit(1 << 30)) < share * (1 << 30))
    samples: dict[str, list[bytes]] = {}
    for r in chosen.select(F.col(lang_col).alias("k"), F.col(text_col).alias("t")).collect():
        samples.setdefault(r["k"], []).append(r["t"].encode())
    return Model({k: sorted(v) for k, v in samples.items()}) if samples else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names."""
    common.bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            langs, scores = shared.value.predict(texts) if shared.value else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(common.lean(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The test fold: crc32 of the id as text leaves 2 modulo 4; null ids are not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: language of all documents, learned outside the test fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out())
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
