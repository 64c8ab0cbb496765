"""Suffix-array deduplication: bytes covered by a MIN_LENGTH-byte string that also starts earlier are removed.

1. Anchors. Every window of MIN_LENGTH bytes names the K bytes in it whose hash is least; equal windows name equal
   anchors, so all windows of an anchor (a run of starts, its context) need to be compared only with contexts of the same
   anchor. Contexts are first aggregated by (anchor, whole context) within a task, then dealt by anchor: of equal
   contexts the earliest stays, all others are repeats in full. Contexts that differ but share an anchor go on.
2. Enhanced suffix array. Those contexts' texts are dealt by anchor (contexts of very frequent anchors window by window,
   aggregated first, so that no anchor needs one task) and each task sorts the suffixes of what it has by prefix
   doubling, takes the common-prefix lengths of neighbours, and scans them with a stack for the intervals of its
   common-prefix tree. An interval whose members are preceded by different bytes cannot be extended to the left: it is a
   maximal repeat, put out with all its occurrences. All but the earliest occurrence are removed, at full length.
3. The spans of each document are united and cut out.

Equal contexts are recognised by two 64-bit hashes (anchor and context), all others by their bytes. Texts are UTF-8
bytes, null: empty; matches never cross documents. Null ids sort first and come back as null. Rows that repeat an id are
told apart by a hash of their text; rows that repeat id and text are one document and share its spans. Texts of any
length are whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common
from lorewell.llm.tokens import span_hashes

MIN_LENGTH = 100
#: Bytes of an anchor; a power of two.
K = 32
#: Bytes of text whose anchors are found at once; positions take PLACE_BITS bits.
SLICE, PLACE_BITS = 2 << 20, 22
#: Bytes of text a task's share of the anchors stands for.
BUCKET_BYTES = 16 << 20
#: Bytes of contexts whose suffixes are sorted at once, whole anchors.
SORTED_BYTES = 1 << 20
#: Different contexts from which an anchor is dealt window by window.
FREQUENT = 20_000
LENGTH_BITS = 16  # of a span; spans of contexts are shorter than 2 * MIN_LENGTH
KEEP, REPEAT, REQUEST, REQUEST_FREQUENT = range(4)


def pieces_of(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the texts: joined bytes, and for each piece its document and its offset there. Pieces of a text that is
    longer than a slice overlap by length - 1 bytes, so that each window lies in one piece."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), SLICE):
            piece = t[at : at + SLICE + length - 1]
            if held and size + len(piece) > SLICE + length:
                yield [x for _, _, x in held], np.array([d for d, _, _ in held]), np.array([o for _, o, _ in held])
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield [x for _, _, x in held], np.array([d for d, _, _ in held]), np.array([o for _, o, _ in held])


def contexts(parts: list[bytes], length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: joined bytes, piece, anchor hash, context hash, first and last window start."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    if len(data) > 1 << PLACE_BITS:
        raise ValueError(f"{len(data)} bytes at once: positions take {PLACE_BITS} bits")
    z = np.zeros(0, np.int64)
    if len(data) < length:
        return data, z, z.astype(np.uint64), z.astype(np.uint64), z, z
    h, m, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while m < K:
        h = h[:-m] * np.uint64(base) + h[m:]
        base, m = base * base % (1 << 64), 2 * m
    h = common.mix(h)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, m, w = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - K + 1
    while 2 * m <= w:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    if m < w:
        least = np.minimum(least[: len(least) - (w - m)], least[w - m :])
    sizes = np.array([len(p) for p in parts])
    start = np.flatnonzero(np.arange(len(data)) + length <= np.repeat(np.cumsum(sizes), sizes))
    if not len(start):
        return data, z, z.astype(np.uint64), z.astype(np.uint64), z, z
    anchor = (least[start] & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, anchor = start[first], start[np.append(first[1:], len(start)) - 1], anchor[first]
    whole = common.mix(span_hashes(data, lo, hi + length) + (anchor - lo).astype(np.uint64))
    return data, np.searchsorted(np.cumsum(sizes), lo, "right"), h[anchor], whole, lo, hi


def span(start, n):
    return (start << LENGTH_BITS) | n


A_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("_id", pa.int64()), ("mark", pa.int64()), ("span", pa.int64()), *((k, pa.binary()) for k in ("ids", "marks", "anchors", "wholes", "spans"))])
A_DDL = "bucket int, kind int, _id long, mark long, span long, ids binary, marks binary, anchors binary, wholes binary, spans binary"
V_SCHEMA = pa.schema([("_id", pa.int64()), ("mark", pa.int64()), ("kind", pa.int32()), ("span", pa.int64())])
V_DDL = "_id long, mark long, kind int, span long"


def anchor_rows(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Contexts by bucket of their anchor, one row a slice and bucket; of equal contexts of a slice only the first, the
    others as finished spans. docs: _id, mark, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), common.utf8(b.column(2))
            for parts, doc, offset in pieces_of(texts, length):
                _, piece, anchor, whole, lo, hi = contexts(parts, length)
                if not len(lo):
                    continue
                base = np.cumsum([0, *map(len, parts)])[piece]
                row = doc[piece]
                spans = span(lo - base + offset[piece], hi - lo + length)
                order = np.lexsort((spans, marks[row], ids[row], whole, anchor))
                same = np.zeros(len(order), bool)
                a, c = anchor[order], whole[order]
                same[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
                # occurrences of one id and text at one place are the same occurrence
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                own = (ids[row[order]] == ids[row[order[head]]]) & (marks[row[order]] == marks[row[order[head]]]) & (spans[order] == spans[order[head]])
                local = order[same & ~own]
                if len(local):
                    yield pa.RecordBatch.from_arrays([pa.array((common.mix(ids[row[local]].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)), pa.array(np.full(len(local), REPEAT, np.int32)), pa.array(ids[row[local]]), pa.array(marks[row[local]]), pa.array(spans[local]), *[pa.nulls(len(local), pa.binary())] * 5], schema=A_SCHEMA)
                kept = np.sort(order[~same])
                bucket = (anchor[kept] % np.uint64(buckets)).astype(np.int32)
                kept = kept[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket)
                used, cut = np.unique(bucket, return_index=True)
                ends = np.append(cut[1:], len(kept))
                groups = [kept[i:j] for i, j in zip(cut.tolist(), ends.tolist(), strict=True)]
                n = len(groups)
                none = [pa.nulls(n, pa.int64())] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), pa.array(np.full(n, KEEP, np.int32)), *none, *[pa.array([x[g].tobytes() for g in groups], pa.binary()) for x in (ids[row], marks[row], anchor, whole, spans)]], schema=A_SCHEMA
                )

    return docs.select("_id", "mark", "text").mapInArrow(common.lean(run), A_DDL)


def judged(rows: DataFrame, buckets: int, frequent: int) -> DataFrame:
    """For each context what is to become of it: REPEAT (an equal one is earlier), REQUEST or REQUEST_FREQUENT (others
    share its anchor), or no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: list[list[bytes]] = [[] for _ in range(5)]
        for b in batches:
            done = b.filter(pc.equal(b.column(1), REPEAT))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(2), done.column(3), done.column(1), done.column(4)], schema=V_SCHEMA)
            rest = b.filter(pc.equal(b.column(1), KEEP))
            for k in range(5):
                held[k] += rest.column(5 + k).to_pylist()
        ids, marks, spans = (np.frombuffer(b"".join(held[k]), np.int64) for k in (0, 1, 4))
        anchor, whole = (np.frombuffer(b"".join(held[k]), np.uint64) for k in (2, 3))
        held.clear()
        order = np.lexsort((spans, marks, ids, whole, anchor))
        ids, marks, spans, anchor, whole = (x[order] for x in (ids, marks, spans, anchor, whole))
        new_anchor = np.ones(len(ids), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new = new_anchor.copy()
        new[1:] |= whole[1:] != whole[:-1]
        if not len(ids):
            return
        group = np.cumsum(new_anchor) - 1
        kinds = np.bincount(group, weights=new)[group]
        head = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        own = (ids == ids[head]) & (marks == marks[head]) & (spans == spans[head])
        kind = np.where(~new, np.where(own, KEEP, REPEAT), np.where(kinds > frequent, REQUEST_FREQUENT, np.where(kinds > 1, REQUEST, KEEP)))
        told = np.flatnonzero(kind != KEEP)
        for at in range(0, len(told), 100_000):
            k = told[at : at + 100_000]
            yield common.batch(V_SCHEMA, ids[k], marks[k], kind[k].astype(np.int32), spans[k])

    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(common.lean(run), V_DDL)


def needed(docs: DataFrame, by_doc: DataFrame) -> DataFrame:
    """docs joined with by_doc (_id, mark, ...); a bitmap of the ids spares other texts the exchange."""
    slots = common.slots_of(by_doc, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(common.in_slots(slots, b.column(0).to_numpy())))

    return docs.mapInArrow(common.lean(run), docs.schema).join(by_doc, ["_id", "mark"])


C_SCHEMA = pa.schema([("anchor", pa.int64()), ("kind", pa.int32()), ("_id", pa.int64()), ("mark", pa.int64()), ("span", pa.int64()), ("text", pa.binary())])
C_DDL = "anchor long, kind int, _id long, mark long, span long, text binary"


def context_texts(docs: DataFrame, requests: DataFrame, length: int) -> DataFrame:
    """The requested contexts' bytes and anchor; those of frequent anchors window by window, with a hash of the window for
    an anchor and each window once a slice (its further occurrences as finished spans)."""
    spans = requests.groupBy("_id", "mark").agg(F.collect_list(F.when(F.col("kind") == REQUEST, F.col("span"))).alias("asked"), F.collect_list(F.when(F.col("kind") == REQUEST_FREQUENT, F.col("span"))).alias("often"))
    mask = (1 << LENGTH_BITS) - 1

    def sent(whole: list[tuple], windows: dict[bytes, list[tuple[int, int, int]]]) -> pa.RecordBatch:
        out: list[tuple] = []
        if whole:
            anchor = contexts([x[3] for x in whole], length)[2].view(np.int64)
            out += [(a, KEEP, *x) for a, x in zip(anchor.tolist(), whole, strict=True)]
        for part, places in windows.items():
            places.sort()
            hashed = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "big", signed=True)
            out.append((hashed, KEEP, *places[0][:2], span(places[0][2], length), part))
            out += [(hashed, REPEAT, k, m, span(at, length), None) for k, m, at in places[1:] if (k, m, at) != places[0]]
        return common.batch(C_SCHEMA, *(zip(*out, strict=True) if out else [[]] * len(C_SCHEMA)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []
        windows: dict[bytes, list[tuple[int, int, int]]] = {}
        held = 0
        for b in batches:
            for key, mark, text, asked, often in zip(*(b.column(c).to_pylist() for c in ("_id", "mark", "text", "asked", "often")), strict=True):
                data = (text or "").encode()
                # a document's contexts may be several times its size, so that it is cut between them too
                for s in asked:
                    part = data[s >> LENGTH_BITS : (s >> LENGTH_BITS) + (s & mask)]
                    whole.append((key, mark, s, part))
                    held += len(part)
                    if held >= SLICE // 2:
                        yield sent(whole, windows)
                        whole, windows, held = [], {}, 0
                for s in often:
                    at = s >> LENGTH_BITS
                    for k in range(at, at + (s & mask) - length + 1):
                        windows.setdefault(data[k : k + length], []).append((key, mark, k))
                        held += length
                    if held >= SLICE // 2:
                        yield sent(whole, windows)
                        whole, windows, held = [], {}, 0
        yield sent(whole, windows)

    return needed(docs, spans).mapInArrow(common.lean(run), C_DDL)


def suffix_ranks(symbols: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 7, 14, 28, ... symbols (below 512), up to depth or more, by prefix doubling."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | padded[j : j + n]
    levels, at = [], 7
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new)
        levels.append((at, rank))
        if at >= depth:
            return levels
        after = np.zeros(n, np.int64)
        after[: max(0, n - at)] = rank[at:] + 1
        key, at = rank.astype(np.int64) * (n + 1) + after, 2 * at


def maximal_repeats(symbols: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The maximal repeats of at least `length` symbols: suffix array, and first, last (in it) and depth of each interval.

    symbols: bytes + 1, 0 between texts; room: symbols from each place to the next 0, which no repeat goes beyond."""
    levels = suffix_ranks(symbols, 2 * length)
    sa = np.argsort(levels[-1][1], kind="stable")
    sa = sa[room[sa] >= length]
    if len(sa) < 2:
        z = np.zeros(0, np.int64)
        return sa, z, z, z
    a, b = sa[:-1], sa[1:]
    lcp, n = np.zeros(len(a), np.int64), len(symbols)
    for step, rank in reversed(levels):
        x, y = a + lcp, b + lcp
        ok = (x < n) & (y < n)
        ok[ok] = rank[x[ok]] == rank[y[ok]]
        lcp[ok] += step
    for _ in range(6):
        x, y = a + lcp, b + lcp
        ok = (x < n) & (y < n)
        ok[ok] = symbols[x[ok]] == symbols[y[ok]]
        lcp[ok] += 1
    lcp = np.minimum(lcp, np.minimum(room[a], room[b]))
    left = np.where(sa > 0, symbols[sa - 1], 0)
    left = np.where(left == 0, -1 - np.arange(len(sa)), left)  # what precedes a text's start differs from all else
    # Only neighbours with a long common prefix can be in an interval.
    first, last, depth = [], [], []
    stack: list[list[int]] = []  # depth, first, left symbol of all members or -(2**62) if they differ
    mixed = -(2**62)
    long_at = np.flatnonzero(lcp >= length)
    before = -2
    for i, d, u, v in zip(long_at.tolist(), lcp[long_at].tolist(), left[long_at].tolist(), left[long_at + 1].tolist(), strict=True):
        if i != before + 1:
            while stack:
                top = stack.pop()
                if top[2] == mixed:
                    first.append(top[1]), last.append(before + 1), depth.append(top[0])
                if stack and stack[-1][2] != top[2]:
                    stack[-1][2] = mixed
        begin, side = i, u
        while stack and stack[-1][0] > d:
            top = stack.pop()
            if top[2] == mixed:
                first.append(top[1]), last.append(i), depth.append(top[0])
            begin = top[1]
            side = top[2]
            if stack and stack[-1][0] >= d and stack[-1][2] != side:
                stack[-1][2] = mixed
        if not stack or stack[-1][0] < d:
            stack.append([d, begin, side])
        if stack[-1][2] != v:
            stack[-1][2] = mixed
        before = i
    while stack:
        top = stack.pop()
        if top[2] == mixed:
            first.append(top[1]), last.append(before + 1), depth.append(top[0])
        if stack and stack[-1][2] != top[2]:
            stack[-1][2] = mixed
    return sa, np.array(first, np.int64), np.array(last, np.int64), np.array(depth, np.int64)


def repeat_groups(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal repeats of the texts, some at a time: group, text, offset and length of every occurrence."""
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    joined[ends] = 0
    room = np.repeat(ends, sizes + 1) - np.arange(len(joined))
    sa, first, last, depth = maximal_repeats(joined, room, length)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(np.cumsum(last[at:] - first[at:] + 1), 2_000_000)) + at)
        n = last[at:to] - first[at:to] + 1
        group = np.repeat(np.arange(to - at), n)
        place = sa[np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        text = np.searchsorted(ends, place)
        yield group + at, text, place - (ends[text] - sizes[text]), np.repeat(depth[at:to], n)
        at = to


def later_occurrences(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """Spans of all occurrences of maximal repeats but the earliest."""

    def found(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, marks, spans = (np.array(x, np.int64) for x in zip(*(r[:3] for r in held), strict=True))
        start = spans >> LENGTH_BITS
        for group, text, offset, n in repeat_groups([r[3] for r in held], length):
            place = start[text] + offset
            order = np.lexsort((place, marks[text], ids[text], group))
            g, text, place, n = group[order], text[order], place[order], n[order]
            head = np.ones(len(g), bool)
            head[1:] = g[1:] != g[:-1]
            lead = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
            own = (ids[text] == ids[text[lead]]) & (marks[text] == marks[text[lead]]) & (place == place[lead])
            k = np.flatnonzero(~own)
            # of the repeats that begin at one place only the longest counts
            k = k[np.lexsort((-n[k], place[k], marks[text[k]], ids[text[k]]))]
            one = np.ones(len(k), bool)
            one[1:] = (text[k][1:] != text[k][:-1]) | (place[k][1:] != place[k][:-1])
            k = k[one]
            yield common.batch(V_SCHEMA, ids[text[k]], marks[text[k]], np.full(len(k), REPEAT, np.int32), span(place[k], n[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: list[tuple] = []
        size, before = 0, None
        for b in batches:
            done = b.filter(pc.equal(b.column(1), REPEAT))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(2), done.column(3), done.column(1), done.column(4)], schema=V_SCHEMA)
            b = b.filter(pc.equal(b.column(1), KEEP))
            for anchor, *row in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                if size >= SORTED_BYTES and anchor != before:
                    yield from found(held)
                    held, size = [], 0
                held.append(tuple(row))
                size, before = size + len(row[3]), anchor
        if held:
            yield from found(held)

    dealt = rows.repartitionById(buckets, F.pmod("anchor", F.lit(buckets)).cast("int")).sortWithinPartitions("anchor")
    return dealt.mapInArrow(common.lean(run), V_DDL)


def united(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the spans cover."""
    if not len(spans):
        return spans, spans
    spans = np.sort(spans)
    start, end = spans >> LENGTH_BITS, (spans >> LENGTH_BITS) + (spans & ((1 << LENGTH_BITS) - 1))
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def repeated_spans(docs: DataFrame, length: int = MIN_LENGTH, frequent: int = FREQUENT, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """docs with mark, and the spans (_id, mark, span) that repeat something earlier. docs: _id, text."""
    spark = docs.sparkSession
    told = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(common.width(spark) if told > BUCKET_BYTES else 1, int(told // BUCKET_BYTES))
    repeated_ids = not docs.groupBy("_id").count().filter("count > 1").isEmpty()
    carried = docs.select("_id", (F.xxhash64("text") if repeated_ids else F.lit(0).cast("long")).alias("mark"), "text", *carry)
    docs = carried.select("_id", "mark", "text")
    verdicts, _ = common.materialize(judged(anchor_rows(docs, buckets, length), buckets, frequent), "anchors")
    requests = verdicts.filter(F.col("kind") != REPEAT)
    later, _ = common.materialize(later_occurrences(context_texts(docs, requests, length), buckets, length), "later")
    return carried, verdicts.filter(F.col("kind") == REPEAT).union(later).select("_id", "mark", "span")


def without_repeats(docs: DataFrame, length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, digest: bool = False, as_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """_id, mark, n_bytes, n_removed, n_spans, kept (the remaining bytes; as_text: the text that they are,
    without characters that a cut went through; digest: kept_sha256 instead), spans (start, end),
    and the columns of docs named in carry, each as carried_<name>."""
    common.bounded_batches(docs.sparkSession)
    names = tuple(f"carried_{c}" for c in carry)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("_id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    d, spans = repeated_spans(d, length, frequent, names)
    by_doc, _ = common.materialize(spans.groupBy("_id", "mark").agg(F.collect_list("span").alias("cuts")), "cuts")
    slots = common.slots_of(by_doc, "_id")
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("_id", pa.int64()), ("mark", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()) if digest else ("kept", pa.string() if as_text else pa.binary()), ("spans", pair)])
    fields = [f for f in d.schema.fields if f.name in names]
    ddl = f"_id long, mark long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept string' if as_text else 'kept binary'}, spans array<struct<start: long, end: long>>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields)

    def cut(key: int, mark: int, data: bytes, cuts: list[int] | None) -> tuple:
        start, end = united(np.array(cuts or [], np.int64))
        kept, at = [], 0
        for i, j in zip(start.tolist(), end.tolist(), strict=True):
            kept.append(data[at:i])
            at = j
        rest = b"".join([*kept, data[at:]]) if cuts else data
        return key, mark, len(data), len(data) - len(rest), len(start), hashlib.sha256(rest).hexdigest() if digest else rest.decode(errors="ignore") if as_text else rest, [{"start": i, "end": j} for i, j in zip(start.tolist(), end.tolist(), strict=True)]

    def rows(out: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
        done = common.batch(schema, *(zip(*out, strict=True) if out else [[]] * len(schema)))
        return pa.RecordBatch.from_arrays([*done.columns, *[b.column(n) for n in names]], [*schema.names, *names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~common.in_slots(slots, b.column(0).to_numpy())))
            yield rows([cut(k, m, t, None) for k, m, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.utf8(b.column(2)), strict=True)], b)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows([cut(k, m, t, c) for k, m, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.utf8(b.column(2)), b.column("cuts").to_pylist(), strict=True)], b)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(common.in_slots(slots, b.column(0).to_numpy())))

    untouched = d.mapInArrow(common.lean(whole), ddl)
    touched = d.mapInArrow(common.lean(some), d.schema).join(by_doc, ["_id", "mark"], "left").select("_id", "mark", "text", "cuts", *names).mapInArrow(common.lean(joined), ddl)
    return untouched.union(touched)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what remains of all documents without their repeats of 100 bytes."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.select(common.restored(F.col("_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
