"""Near-duplicates by MinHash with fast similarity sketching, banding and exact verification.

A document's set of word shingles is hashed into COORDS bins: in rounds, every element falls into one bin of the round
and a bin keeps the least (round, value); after COORDS rounds each further round sends all elements to one fixed bin, so
every coordinate is filled, most documents being done after a few rounds. Equal coordinates estimate Jaccard similarity
with the concentration of independent minima. BANDS bands of ROWS coordinates find pairs: at similarity 0.8 a pair has
no common band with probability 5e-8.
Equal sets are one class from the start. In each bucket of a band, members are linked to the smallest and the largest
member; those pairs are screened by their sketches (5 standard deviations) and confirmed on full sets. The links are
contracted to components. Buckets that still hold several components then compare all members of different ones: small
buckets by a join, large ones in blocks of BLOCK x BLOCK members, of which one side is outside the family's largest
component; links between components are put out, no more than join them. So no link that shares a bucket is lost and no
group's pairs are written out. Null or empty texts have empty sets, are linked with nothing and kept; null ids sort first and
come back as null; rows that share an id share its verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common
from lorewell.llm.components import components, relabelled
from lorewell.llm.shingles import shingle_sets

COORDS, BANDS, ROWS = 128, 32, 4
BLOCK = 500
#: Buckets up to this size are joined with themselves, larger ones compared in blocks.
SMALL_BUCKET = 64
EMPTY = np.uint64(2**64 - 1)


def fast_sketches(h: np.ndarray, doc: np.ndarray, n: int, coords: int = COORDS) -> np.ndarray:
    """(n, coords) sketch of each document's elements h (documents without elements keep EMPTY)."""
    out = np.full(n * coords, EMPTY, np.uint64)
    for r in range(2 * coords):
        v = common.mix(h + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = (v >> np.uint64(40)) % np.uint64(coords) if r < coords else np.full(len(v), r - coords, np.uint64)
        value = (np.uint64(r) << np.uint64(54)) | (v & np.uint64((1 << 40) - 1)) << np.uint64(14)
        np.minimum.at(out, doc * coords + place.astype(np.int64), value)
        open_docs = (out.reshape(n, coords) == EMPTY).any(1)
        going = open_docs[doc]
        if not going.all():
            h, doc = h[going], doc[going]
        if not len(h):
            break
    return out.reshape(n, coords)


SIG = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("set_hash", pa.string()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
SIG_DDL = "_id long, n long, set_hash string, bands array<long>, sketch binary"


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """docs (_id, text): size and hash of each set, band hashes, one byte of every coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = common.utf8(b.column(1))
            for at, to in common.slices(texts):
                h, doc = shingle_sets(texts[at:to], k)
                size = np.bincount(doc, minlength=to - at)
                cut = np.cumsum(size) - size
                sketch = fast_sketches(h, doc, to - at)
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (to - at, BANDS)).copy()
                rows = sketch.reshape(to - at, BANDS, ROWS)
                for j in range(ROWS):
                    band = common.mix(band * np.uint64(0x9FB21C651E98DF25) + rows[:, :, j])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).reshape(-1)))
                byte = (common.mix(sketch.reshape(-1)) & np.uint64(255)).astype(np.uint8).reshape(to - at, COORDS)
                hashes = [xxhash.xxh3_128_hexdigest(h[c : c + m].tobytes()) for c, m in zip(cut.tolist(), size.tolist(), strict=True)]
                yield common.batch(SIG, b.column(0)[at:to], size.astype(np.int64), hashes, bands, [x.tobytes() for x in byte])

    return docs.select("_id", "text").mapInArrow(common.lean(run), SIG_DDL)


def least_equal(similarity: float) -> int:
    """Equal coordinates that a pair of this similarity has but for five standard deviations."""
    return int(COORDS * (similarity - 5 * (similarity * (1 - similarity) / COORDS) ** 0.5))


def likely_matrix(left: pd.DataFrame, right: pd.DataFrame, least: int) -> np.ndarray:
    """Which members (rows of left, columns of right) of different components have so many equal coordinates."""
    u, v = (np.frombuffer(b"".join(q["sketch"]), np.uint8).reshape(-1, COORDS) for q in (left, right))
    same = np.stack([(v == row).sum(1) for row in u])
    return (same >= least) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :])


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree often enough."""
    least = least_equal(similarity)
    x = sketches.select(F.col("_id").alias("a"), F.col("sketch").alias("x"))
    y = sketches.select(F.col("_id").alias("b"), F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if not r.num_rows:
                continue
            u, v = (np.frombuffer(b"".join(r.column(c).to_pylist()), np.uint8).reshape(-1, COORDS) for c in (2, 3))
            yield r.select([0, 1]).filter(pa.array((u == v).sum(1) >= least))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(common.lean(run), "a long, b long")


def involved_sets(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """_id and set (sorted hashes) of all documents in pairs. A bitmap tells the scan which may be needed."""
    ids = pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct()
    slots = common.slots_of(ids, "_id")
    schema = pa.schema([("_id", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(common.in_slots(slots, b.column(0).to_numpy())))
            texts = common.utf8(b.column(1))
            for at, to in common.slices(texts):
                h, doc = shingle_sets(texts[at:to], k)
                cut = np.searchsorted(doc, np.arange(to - at + 1))
                yield common.batch(schema, b.column(0)[at:to], [h[i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])

    return docs.select("_id", "text").mapInArrow(common.lean(run), "_id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union."""
    x = sets.select(F.col("_id").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("_id").alias("b"), F.col("set").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            keep = []
            for u, v in zip(r.column(2).to_pylist(), r.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                both = np.concatenate((u, v))
                both.sort()
                common_size = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common_size >= percent * (len(both) - common_size))
            yield r.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(common.lean(run), "a long, b long").distinct()


def small_cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different components that share a small bucket. members: key, size, _id, component."""
    x = members.filter(F.col("size") <= SMALL_BUCKET)
    y = x.select("key", F.col("_id").alias("b"), F.col("component").alias("other"))
    return x.withColumnRenamed("_id", "a").join(y, "key").filter("a < b AND component != other").select("a", "b").distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets on the left with those on the right, by products of 0/1 matrices."""
    x, y = np.concatenate(left), np.concatenate(right)
    words = np.intersect1d(x, y)
    rows, cols = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    i, j = np.searchsorted(words, x), np.searchsorted(words, y)
    ok_x, ok_y = np.isin(x, words, kind="sort"), np.isin(y, words, kind="sort")
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(words), 4096):
        a, b = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        for m, r, k, ok in ((a, rows, i, ok_x), (b, cols, j, ok_y)):
            ok = ok & (k >= at) & (k < at + 4096)
            m[r[ok], k[ok] - at] = 1
        out += a @ b.T
    return out.astype(np.int64)


def block_links(members: DataFrame, sketches: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, list[str]]:
    """Confirmed links (a, b: components) among members of large buckets, and the scratch tables behind them. members: key,
    size, _id, component.

    Large buckets that share a component form a family. Its largest component is its core; every other member is loose and
    meets all members: loose ones and all ones are dealt into blocks of BLOCK, and each pair of blocks is compared by
    sketches in one task. Sets follow only into the pairs of blocks in which they have a likely partner, and there only
    links that still join two components are put out. So the work is linear in the core and quadratic in loose members."""
    spark, old = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = common.materialize(df, name)
        old.append(path)
        return table

    large = members.filter(F.col("size") > SMALL_BUCKET)
    held = kept(large.groupBy("key", "component").agg(F.count("*").alias("members")), "held")
    hubs = held.groupBy("key").agg(F.min("component").alias("a"))
    stars = held.join(hubs, "key").filter("a != component").select("a", F.col("component").alias("b"))
    families = components(stars).select(F.col("_id").alias("component"), F.col("component").alias("family"))
    placed = kept(large.select("_id", "component").distinct().join(families, "component"), "families")
    parts = placed.groupBy("family", "component").agg(F.count("*").alias("n"))
    core = parts.groupBy("family").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("core"))
    core = core.select("family", F.ceil(F.col("all") / BLOCK).cast("int").alias("wide"), F.ceil((F.col("all") - F.col("core.n")) / BLOCK).cast("int").alias("tall"), F.col("core.component").alias("core"))
    full = kept(placed.join(core, "family").join(sketches, "_id").select("_id", "component", "sketch", "family", "wide", "tall", (F.col("component") != F.col("core")).alias("loose")), "family-sketches")
    hashed = F.xxhash64("_id")
    left = full.filter("loose").withColumn("i", F.pmod(hashed, F.col("tall")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    right = full.withColumn("j", F.pmod(hashed, F.col("wide")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)))
    sides = [x.select("family", "i", "j", F.lit(side).alias("side"), "_id", "component", "sketch") for side, x in (("left", left), ("right", right))]
    least = least_equal(percent / 100)

    def likely_members(p: pd.DataFrame) -> pd.DataFrame:
        u, v = (p[p["side"] == side] for side in ("left", "right"))
        if not len(u) or not len(v):
            return p.iloc[:0][["family", "i", "j", "side", "_id", "component", "sketch"]]
        hit = likely_matrix(u, v, least)
        return pd.concat([u[hit.any(1)], v[hit.any(0)]])[["family", "i", "j", "side", "_id", "component", "sketch"]]

    shown = kept(sides[0].union(sides[1]).groupBy("family", "i", "j").applyInPandas(likely_members, "family long, i int, j int, side string, _id long, component long, sketch binary"), "likely")
    sets = kept(involved_sets(docs, shown.select(F.col("_id").alias("a"), F.col("_id").alias("b")), k), "family-sets")

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        left, right = (p[p["side"] == side] for side in ("left", "right"))
        hit = likely_matrix(left, right, least)
        a, b = ([np.frombuffer(s, np.uint64) for s in q["set"]] for q in (left, right))
        n = shared_counts(a, b)
        union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - n
        lc, rc, out, top = left["component"].tolist(), right["component"].tolist(), [], {}

        def find(c: int) -> int:
            while top.get(c, c) != c:
                c = top[c]
            return c

        for s, t in np.argwhere(hit & (100 * n >= percent * union)).tolist():
            c, d = find(lc[s]), find(rc[t])
            if c != d:
                top[max(c, d)] = min(c, d)
                out.append((lc[s], rc[t]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return shown.join(sets, "_id").groupBy("family", "i", "j").applyInPandas(compare, "a long, b long"), old


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n_shingles, component (smallest id reachable over links; its own for empty sets) of every row."""
    spark, old = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = common.materialize(df, name)
        old.append(path)
        return table

    d = common.keyed(docs, id_col, text_col).withColumnRenamed(text_col, "text")
    sig, _ = common.materialize(signatures(d, k), "signatures")
    total = sig.count()
    classes = kept(sig.filter("n > 0").groupBy("set_hash").agg(F.min("_id").alias("rep"), F.count("*").alias("size")), "classes")
    firsts = classes.select("set_hash", F.col("rep").alias("_id"))
    sketches = kept(sig.filter("n > 0").join(firsts, ["_id", "set_hash"], "left_semi").dropDuplicates(["_id", "set_hash"]).select("_id", "sketch", "bands"), "sketches")
    keys = sketches.select("_id", F.explode("bands").alias("key"))
    buckets = kept(keys.groupBy("key").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count("*").alias("size")).filter("low < high"), "buckets")
    members = kept(common.hot_join(keys, buckets, "key", total * BANDS).select("key", "size", "_id", "low", "high"), "members")
    ends = members.select(F.explode(F.array("low", "high")).alias("hub"), "_id").filter("hub != _id")
    pairs = ends.select(F.least("hub", "_id").alias("a"), F.greatest("hub", "_id").alias("b")).distinct()
    sketches = sketches.select("_id", "sketch")
    similarity = percent / 100
    first = kept(likely(pairs, sketches, similarity), "pairs")
    links = kept(confirmed(first, kept(involved_sets(d, first, k), "sets"), percent), "links")
    labels = components(links)
    placed = kept(members.select("key", "size", "_id").join(labels, "_id", "left").withColumn("component", F.coalesce("component", "_id")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("size").alias("size")).filter("low < high").select("key", "size")
    still = kept(common.hot_join(placed.drop("size"), kept(mixed, "mixed"), "key", total * BANDS).select("key", "size", "_id", "component"), "still")
    second = kept(likely(small_cross_pairs(still), sketches, similarity), "pairs")
    added = confirmed(second, kept(involved_sets(d, second, k), "sets"), percent)
    of = still.select("_id", "component").distinct()
    for end in ("a", "b"):  # links of the second phase are drawn between components
        added = added.join(of.select(F.col("_id").alias(end), F.col("component").alias(f"{end}_in")), end)
    added = added.select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).distinct()
    if not still.filter(F.col("size") > SMALL_BUCKET).isEmpty():
        more, behind = block_links(still, sketches, d, k, percent)
        added, old = added.union(more), old + behind
    top = components(added).select("_id", F.col("component").alias("up"))
    of = classes.join(labels, classes["rep"] == labels["_id"], "left").select("set_hash", "size", F.coalesce("component", "rep").alias("component"))
    out, _ = common.materialize(relabelled(of, "component", top), "components")
    common.discard(spark, *old)
    found = common.hot_join(sig.filter("n > 0").select("_id", "n", "set_hash"), out, "set_hash", total).select("_id", F.col("n").alias("n_shingles"), "component")
    return found.union(sig.filter("n = 0").select("_id", "n", F.col("_id").alias("component")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: classes of near-duplicates over 2-word shingles."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
    return out.select(common.restored(F.col("_id")).alias("doc_id"), "n_shingles", common.restored(F.col("component")).alias("component_id"), (F.col("_id") == F.col("component")).alias("kept"))
