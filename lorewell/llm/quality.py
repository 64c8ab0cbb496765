"""Quality classifier: hierarchical empirical Bayes over hosts and paths, with document evidence from a classifier.

Evidence: two logistic models (quality, toxic) over shape numbers and the log-odds of hashed words, fitted on a bounded
sample of at most about SAMPLE labelled documents, give each document a probability. Sites: the sum of evidence over a
host's documents is shrunk toward the corpus mean, that over a path's documents toward its host's posterior, with prior
strengths (pseudo-counts) estimated from the spread between sites by moments; sparse sites so keep the mean of their
parents. score combines the document's log-odds with what its path's posterior, taken without the document itself, adds
to the corpus mean; a document is kept if score is 0.5 or more and its toxicity below 0.5.
Hosts and paths are grouped by partial aggregates, so a hot site costs a row a task. Null hosts and paths are sites of
their own; null texts count as empty; null ids stay null; repeated rows are judged alike; without labels the evidence is
0.5 and toxicity 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common
from lorewell.llm.decontamination import BREAKS
from lorewell.llm.shingles import words

SAMPLE = 8_000
#: Characters of the longest documents that the sample takes; so it has at most SAMPLE * LONGEST.
LONGEST = 1 << 16
#: Documents of the sample that a word must be in to count.
LEAST_DOCS = 5
#: Standard errors by which log-odds are drawn to 0.
SURE = 2.5
BUCKETS = 1 << 16
SHAPES = 9


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words with their text, and the shape numbers of each text."""
    n = len(texts)
    h, doc, start, end = words(texts, BREAKS)
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    pair = np.unique(doc * BUCKETS + bucket)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    edge = np.cumsum(sizes) - sizes

    def share(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), edge) / np.maximum(1, sizes - 1)

    upper = (data >= 65) & (data <= 90)
    marks = BREAKS[data] & (data > 32)
    per = np.maximum(1, np.bincount(doc, minlength=n))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    twice = np.zeros(len(data), bool)
    twice[1:] = marks[1:] & (data[1:] == data[:-1])
    distinct = np.bincount(pair // BUCKETS, minlength=n)
    shape = np.stack(
        [np.log1p(sizes) / 10, 4 * share(upper), 4 * share(marks), 4 * share((data >= 48) & (data <= 57)), distinct / per, 4 * np.bincount(doc, weights=same, minlength=n) / per, np.bincount(doc, weights=end - start, minlength=n) / per / 10, 8 * share(twice), np.ones(n)], 1
    )
    return pair % BUCKETS, pair // BUCKETS, shape


def features_by_slices(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of many texts, a slice at a time, so that only their results stay."""
    found = [(at, *features(texts[at:to])) for at, to in common.slices(texts, 1 << 20)]
    return np.concatenate([b for _, b, _, _ in found]), np.concatenate([d + at for at, _, d, _ in found]), np.concatenate([x for _, _, _, x in found])


class Evidence:
    """P(quality) and P(toxic) of texts. One half of the sample tells each word bucket's log-odds under both targets, the
    other half fits a logistic model on the shape numbers and on a text's most telling words."""

    def __init__(self, texts: list[bytes], target: np.ndarray, steps: int = 400, rate: float = 0.3):
        """target: quality and toxicity (1 or 0) of each text; NaN where it is not known."""
        half = np.arange(len(texts)) % 2 == 0
        bucket, doc, shape = features_by_slices(texts)
        known = ~np.isnan(target)
        target = np.nan_to_num(target)
        self.odds = np.zeros((BUCKETS, 2))
        for j in range(2):
            use = half & known[:, j]
            own = use[doc]
            n = np.bincount(bucket[own], minlength=BUCKETS)
            yes = np.bincount(bucket[own], weights=target[doc[own], j], minlength=BUCKETS)
            rate_yes, rate_no = (yes + 0.5) / (target[use, j].sum() + 1), (n - yes + 0.5) / ((1 - target[use, j]).sum() + 1)
            odds, error = np.log(rate_yes / rate_no), np.sqrt(1 / (yes + 0.5) + 1 / (n - yes + 0.5))
            self.odds[:, j] = np.where(n >= LEAST_DOCS, np.sign(odds) * np.maximum(0, np.abs(odds) - SURE * error), 0.0)
        x, y, told = self._rows(bucket, doc, shape)[~half], target[~half], known[~half].astype(np.float64)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.mean[-1], self.scale[-1] = 0, 1
        x = (x - self.mean) / self.scale
        self.w, g2 = np.zeros((x.shape[1], 2)), np.full((x.shape[1], 2), 1e-6)
        positive = np.clip((y * told).sum(0) / np.maximum(1, told.sum(0)), 1e-3, 1 - 1e-3)
        weight = told * np.where(y > 0, 0.5 / positive, 0.5 / (1 - positive)) / np.maximum(1, told.sum(0))
        for _ in range(steps):
            g = x.T @ ((self._link(x) - y) * weight) + 1e-4 * self.w
            g2 += g * g
            self.w -= rate * g / np.sqrt(g2)

    def _rows(self, bucket: np.ndarray, doc: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Shapes, and for each target the mean, the three largest and the least log-odds of a text's words; 1 comes last."""
        n, out = len(shape), [shape[:, :-1]]
        first = np.searchsorted(doc, np.arange(n))
        size = np.bincount(doc, minlength=n)
        for j in range(2):
            o = self.odds[bucket, j]
            o = o[np.lexsort((-o, doc))]
            top = np.zeros((n, 5))
            top[:, 0] = np.bincount(doc, weights=o, minlength=n) / np.maximum(1, size)
            for k in range(3):
                has = size > k
                top[has, 1 + k] = o[(first + k)[has]]
            has = size > 0
            top[has, 4] = o[(first + size - 1)[has]]
            out.append(top)
        return np.concatenate([*out, shape[:, -1:]], 1)

    def _link(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return self._link((self._rows(*features(texts)) - self.mean) / self.scale)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Evidence | None:
    """The evidence model from about `sample` labelled documents, chosen by a hash of their id. A label may lack either
    target; of contradicting labels of one id the larger counts."""
    told = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("quality IS NOT NULL OR toxic IS NOT NULL")
    n = told.count()
    share = F.lit(min(1.0, sample / max(1, n)) * (1 << 30))
    chosen = told.filter(F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 30)) < share)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter(F.length("t") <= LONGEST)
    rows = texts.join(F.broadcast(chosen), "_id").orderBy("_id", "t").collect()  # bounded by the sample and LONGEST
    if not rows:
        return None
    known = lambda v: float("nan") if v is None else float(v > 0)
    return Evidence([r["t"].encode() for r in rows], np.array([(known(r["quality"]), known(r["toxic"])) for r in rows]))


def strength(n: Column, mean: Column, parent: Column) -> Column:
    """Pseudo-counts of a parent's prior by moments: how far its children spread beyond their own sampling noise."""
    noise = F.sum(parent * (1 - parent))
    spread = F.sum(n * (mean - parent) * (mean - parent)) - noise
    between = spread / F.greatest(F.sum(n) - F.sum(n * n) / F.sum(n), F.lit(1.0))
    return F.least(F.greatest(F.avg(parent * (1 - parent)) / F.greatest(between, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1e5))


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """host, path, host_posterior, path_posterior of every site with the sums behind them (hn, hs, hk: documents, evidence and
    prior strength of hosts; n, s, k: of paths), and the corpus mean. evidence: host, path, p."""
    paths, path_table = common.materialize(evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s")), "paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = (total["s"] or 0.0) / (total["n"] or 1.0)
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    k = hosts.agg(strength(F.col("hn"), F.col("hs") / F.col("hn"), F.lit(mean)).alias("k")).first()["k"] or 1.0
    hosts = hosts.select(F.col("host").alias("site"), "hn", "hs", F.lit(k).alias("hk"), shrunk("hn", "hs", k, F.lit(mean)).alias("host_posterior"))
    both, _ = common.materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("site"))).drop("site"), "sites")
    common.discard(evidence.sparkSession, path_table)
    k = both.agg(strength(F.col("n"), F.col("s") / F.col("n"), F.col("host_posterior")).alias("k")).first()["k"] or 1.0
    return both.select("*", F.lit(k).alias("k"), shrunk("n", "s", k, F.col("host_posterior")).alias("path_posterior")), mean


def shrunk(n: str, s: str, k, parent: Column, own: Column | float = 0.0, docs: float = 0.0) -> Column:
    """A site's mean evidence shrunk toward its parent; own: the evidence of as many documents that do not count."""
    k = F.col(k) if isinstance(k, str) else F.lit(k)
    return (F.col(s) - own + k * parent) / (F.col(n) - docs + k)


def log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


ROWS = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("p", pa.float64()), ("toxic", pa.float64())])


def classify(docs: DataFrame, model: Evidence | None, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, evidence, toxic, host_posterior, path_posterior, score, kept."""
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = common.utf8(b.column(3))
            for at, to in common.slices(texts):
                p = shared.value(texts[at:to]) if shared.value else np.tile([0.5, 0.0], (to - at, 1))
                cut = b.slice(at, to - at)
                yield common.batch(ROWS, cut.column(0), cut.column(1), cut.column(2), p[:, 0], p[:, 1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    evidence, _ = common.materialize(rows.mapInArrow(common.lean(run), "doc_id long, host string, path string, p double, toxic double"), "evidence")
    sites, mean = posteriors(evidence)
    sites = sites.withColumnsRenamed({"host": "h", "path": "q"})
    out = evidence.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    # what a document's sites tell of it is what their other documents do
    others = shrunk("n", "s", "k", shrunk("hn", "hs", "hk", F.lit(mean), F.col("p"), 1.0), F.col("p"), 1.0)
    score = 1 / (1 + F.exp(-(log_odds(F.col("p")) + log_odds(others) - log_odds(F.lit(mean)))))
    out = out.withColumn("score", score)
    return out.select("doc_id", F.col("p").alias("evidence"), "toxic", "host_posterior", "path_posterior", "score", ((F.col("score") >= 0.5) & (F.col("toxic") < 0.5)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: quality of all documents; the source is the host, source and language the path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"))
