"""Benchmark decontamination: word n-grams of test items seed candidates, Smith-Waterman alignment scores them.

An item's seeds are all its SEED-word n-grams, whatever number of documents holds them, so that what is found of a copy
depends neither on how often its item leaked nor on the size of the corpus. Seed hits of one
item that lie on near diagonals, MIN_HITS of them at least (or all seeds of a shorter item), make a passage; item and
passage are aligned locally by words (match 1, mismatch and gap -1), which tolerates edits. score is the alignment's
score over the item's words; THRESHOLD or more is a leak. Items with fewer words than a seed match texts that are the
same words.
Items are taken in blocks of BLOCK_ITEMS, which bounds what is sent to tasks; every block sees all documents.
Null or empty texts leak nothing; null item ids and document ids come back as null; repeated rows are judged alike;
passages are found wherever they lie in a text of any length; of equal alignments the first passage counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common
from lorewell.llm.shingles import IS_SPACE, STEP, words

SEED, MIN_HITS, THRESHOLD = 3, 2, 0.4
#: Seed hits (of whole texts) and words of passages that are handled at once.
HITS, CELLS = 1 << 19, 1 << 18
BLOCK_ITEMS = 20_000
#: Words are runs of bytes other than ASCII control characters, space and punctuation.
BREAKS = IS_SPACE.copy()
BREAKS[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes with the word they begin at and their text; all words' hashes and texts."""
    h, doc, _, _ = words(texts, BREAKS)
    per = np.bincount(doc, minlength=len(texts))
    left = np.cumsum(per)[doc] - np.arange(len(h))
    at = np.flatnonzero((left >= SEED) | ((per[doc] < SEED) & (left == per[doc])))
    size = np.minimum(left[at], SEED)
    out = common.mix(size.astype(np.uint64))
    for j in range(SEED):
        more = size > j
        out[more] = common.mix(out[more] * STEP + h[at[more] + j])
    return out, at, doc[at], h, doc


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of an item against equally long passages (a row each; 0 pads), and the alignments' ends."""
    n, w = passages.shape
    ramp = np.arange(w, dtype=np.int32)
    row = np.zeros((n, w + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for word in item:
        cell = np.maximum(row[:, :-1] + np.where(passages == word, 1, -1), row[:, 1:] - 1)
        cell = np.maximum(cell, 0)
        cell = np.maximum.accumulate(cell + ramp, axis=1) - ramp  # gaps in the item cost 1 a word
        row[:, 1:] = np.maximum(cell, 0)
        k = row[:, 1:].argmax(1)
        top = row[np.arange(n), k + 1]
        better = top > best
        best[better], end[better] = top[better], k[better] + 1
    return best, end


class Items:
    """A block of test items: their words, and the seeds in sorted order with item and place."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids = np.array(ids, np.int64)
        gram, at, item, h, owner = grams(texts)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.words = [h[first[i] : first[i + 1]] for i in range(len(texts))]
        order = np.lexsort((at, item, gram))
        self.gram, self.item, self.place = gram[order], item[order], (at - first[item])[order]
        self.need = np.minimum(MIN_HITS, np.bincount(self.item, minlength=len(self.ids)))
        self.size = np.array([len(w) for w in self.words])

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, float, int, int, int]]:
        """text, item, score, seeds hit, first and last word + 1 of the best passage, for all leaks."""
        gram, at, doc, h, owner = grams(texts)
        lo, hi = np.searchsorted(self.gram, gram, "left"), np.searchsorted(self.gram, gram, "right")
        hit = np.flatnonzero(hi > lo)
        lo, n, at, doc = lo[hit], (hi - lo)[hit], at[hit], doc[hit]
        word_from = np.searchsorted(owner, np.arange(len(texts) + 1))
        per_text = np.cumsum(np.bincount(doc, n, len(texts)).astype(np.int64))
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        first = 0
        while first < len(texts):
            done = int(per_text[first - 1]) if first else 0
            to = max(first + 1, int(np.searchsorted(per_text, done + HITS, "right")))
            k = slice(*np.searchsorted(doc, (first, to)).tolist())
            self.aligned(self.passages(lo[k], n[k], at[k], doc[k], word_from), h, word_from, best)
            first = to
        return [(t, i, *v) for (t, i), v in sorted(best.items())]

    def passages(self, lo: np.ndarray, n: np.ndarray, at: np.ndarray, doc: np.ndarray, word_from: np.ndarray) -> tuple[np.ndarray, ...]:
        """text, item, first and last word + 1, and seed hits of the places where enough seeds lie on near diagonals; lo and
        n: the seeds that each hit n-gram is, at and doc: where it stands."""
        k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        where = np.repeat(np.arange(len(n)), n)
        text, item, start = doc[where], self.item[k], at[where] - self.place[k]
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + np.maximum(4, self.size[item[1:]] // 4))
        first = np.flatnonzero(new)
        hits = np.diff(np.append(first, len(text)))
        last = start[first + hits - 1]
        first, last, hits = (x[hits >= self.need[item[first]]] for x in (first, last, hits))
        text, item, start = text[first], item[first], start[first]
        margin = np.maximum(3, self.size[item] // 2)
        return text, item, np.maximum(word_from[text], start - margin), np.minimum(word_from[text + 1], last + self.size[item] + margin), hits

    def aligned(self, found: tuple[np.ndarray, ...], h: np.ndarray, word_from: np.ndarray, best: dict[tuple[int, int], tuple[float, int, int, int]]) -> None:
        """Puts into best the score, seed hits, first and last word + 1 of each text's and item's best passage."""
        text, item, a, b, hits = found
        order = np.lexsort((b - a, item))
        text, item, a, b, hits = (x[order] for x in found)
        at = 0
        while at < len(item):
            i = int(item[at])
            width = (b - a)[at : int(np.searchsorted(item, i, "right"))]
            rows = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), CELLS, "right")))
            part = slice(at, at + rows)
            at += rows
            ramp = np.arange(int(width[rows - 1]))
            inside = ramp < width[:rows, None]
            passages = np.where(inside, h[np.minimum(a[part, None] + ramp, len(h) - 1)], np.uint64(0))
            size = max(1, int(self.size[i]))
            # no alignment scores more than the words of its passage that the item has
            known = np.unique(self.words[i])
            held = (known[np.minimum(np.searchsorted(known, passages), len(known) - 1)] == passages) & inside
            able = held.sum(1) / size >= THRESHOLD
            if not able.any():
                continue
            score, end = align(self.words[i], passages[able])
            for t, start, m, s, e in zip(*(x[part][able].tolist() for x in (text, a, hits)), (score / size).tolist(), end.tolist(), strict=True):
                stop = start + e - int(word_from[t])
                was = best.get((t, i))
                if s >= THRESHOLD and (was is None or (s, -stop) > (was[0], -was[3])):
                    best[t, i] = (s, m, max(0, stop - size), stop)


OUT = pa.schema([("_id", pa.int64()), ("item", pa.int64()), ("score", pa.float64()), ("seeds", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, seeds, first_word, end_word (words from 0) for every document and item that leaks into it."""
    spark = docs.sparkSession
    d = common.keyed(docs, id_col, text_col)
    items = common.keyed(benchmark, item_col, item_text_col).filter(F.trim(item_text_col) != "")
    n_items = items.count()
    bounds = common.edges(items, -(-n_items // BLOCK_ITEMS))
    placed = items.withColumn("block", common.range_of(bounds))
    found = [block_leaks(d, Items(*zip(*rows, strict=True))) for k in range(len(bounds) + 1) if (rows := [(r[0], r[1].encode()) for r in placed.filter(F.col("block") == k).orderBy("_id", item_text_col).select("_id", item_text_col).collect()])]
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, seeds long, first_word long, end_word long")
    out = reduce(DataFrame.union, found)
    return out.select(common.restored(F.col("_id")).alias("doc_id"), common.restored(F.col("item")).alias("item_id"), "score", "seeds", "first_word", "end_word")


def block_leaks(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            ids, texts = b.column(0).to_numpy(), common.utf8(b.column(1))
            for at, to in common.slices(texts):
                got = block.leaks(texts[at:to])
                if got:
                    t, i, *rest = zip(*got, strict=True)
                    yield common.batch(OUT, ids[at + np.array(t)], block.ids[list(i)], *rest)

    return docs.mapInArrow(common.lean(run), "_id long, item long, score double, seeds long, first_word long, end_word long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: test items that leaked into documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
