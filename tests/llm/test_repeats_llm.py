import hashlib
import random

import numpy as np
import pytest

from lorewell.llm import repeats

DDL = "doc_id long, text string, mark string, _id long, span int"


def brute(rows, n):
    """rows: (id, text) in order of id."""
    seen, out = set(), []
    for key, text in rows:
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            if w in seen:
                gone[i : i + n] = True
            seen.add(w)
        runs = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out.append((key, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def got(df):
    return sorted((r["_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("frequent", [2000, 2])
def test_equals_brute_force_on_documents(spark, frequent, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 60_000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 100_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert got(repeats.without_repeats(docs, digest=True, frequent=frequent)) == brute(rows, 100)
    assert sum(r[2] for r in brute(rows, 100)) > 0


def test_equals_brute_force_on_edited_copies(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcde fé") for _ in range(900))
    texts = ["", None, "aaaa" * 200, "a" * 500, "ab" * 99, "x" * 99, "x" * 100, "x" * 101]
    for _ in range(60):
        t = list(base[rng.randrange(300) : 600 + rng.randrange(300)])
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = rng.choice("xyzü")
        texts.append("".join(t))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "m", 1, 2) for i, t in enumerate(texts)], DDL)
    for frequent in (2000, 3):
        assert got(repeats.without_repeats(docs, digest=True, frequent=frequent)) == brute(list(enumerate(texts)), 100)


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 60))) for _ in range(12)] + [b"\0\0\0\0\0\xff\xff\0\0\0\0\0"]
    want = set()
    places = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]))]
    words = {texts[t][i : i + n] for t, i in places for n in range(5, len(texts[t]) - i + 1)}
    for w in words:
        occ = [(t, i) for t, i in places if texts[t].startswith(w, i)]
        left = {texts[t][i - 1] if i else (t, -1) for t, i in occ}
        right = {texts[t][i + len(w)] if i + len(w) < len(texts[t]) else (t, i) for t, i in occ}
        if len(occ) > 1 and len(left) > 1 and len(right) > 1:
            want.add((len(w), tuple(sorted(occ))))
    found = {}
    for group, text, offset, n in repeats.repeat_groups(texts, 5):
        for g, t, o, k in zip(group.tolist(), text.tolist(), offset.tolist(), n.tolist(), strict=True):
            found.setdefault((g, k), []).append((t, o))
    assert {(k, tuple(sorted(v))) for (_, k), v in found.items()} == want and len(found) == len(want)


def test_edges(spark):
    t = "abcdefghij" * 30
    rows = spark.createDataFrame([(None, t, "m", 1, 2), (4, t, "m", 1, 2), (4, t, "m", 1, 2), (4, t + "x", "m", 1, 2), (5, None, "m", 1, 2)], DDL)
    out = {(r["_id"], r["n_bytes"]): r["n_removed"] for r in repeats.without_repeats(rows).collect()}
    low = -(2**63)
    assert out[(low, 300)] == 290 and out[(4, 300)] == 300 and out[(4, 301)] == 300 and out[(5, 0)] == 0 and len(out) == 4
    assert repeats.without_repeats(rows.limit(0)).count() == 0


def test_contexts_of_one_document_beyond_the_bits_of_a_position(spark):
    text = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz ", k=1_500_000))
    _, _, anchor, _, lo, hi = repeats.contexts([text.encode()])
    spans = repeats.span(lo, hi - lo + 100)
    assert (hi - lo + 100).sum() > 1 << repeats.PLACE_BITS
    docs = spark.createDataFrame([(1, 0, text)], "_id long, mark long, text string")
    asked = spark.createDataFrame([(1, 0, repeats.REQUEST, s) for s in spans.tolist()], "_id long, mark long, kind int, span long")
    found = {r["span"]: r["anchor"] for r in repeats.context_texts(docs, asked, 100).select("span", "anchor").collect()}
    assert found == dict(zip(spans.tolist(), anchor.view(np.int64).tolist(), strict=True))
    with pytest.raises(ValueError):
        repeats.contexts([b"x" * ((1 << repeats.PLACE_BITS) + 1)])
