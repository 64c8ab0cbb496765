import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a.b@c.de", "x@y", "@", ".", "a@b.c_d@e.f", "@a.b@c.d", "1.2.3.4", "300.1.2.3", "001.02.3.0255", "+49 (30) 123-4567", "+", "1", " ", "-", "+1+2", "é", "٣", "\n", card(rng), "4111 1111-1111 1111", "_%", "9" * 14, "(", ")", "..", "1.2.3.4.5.6.7.8"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(pii.KINDS[k - 1], s, e) for k, s, e in pii.base_spans(text)] == plain_base(text), text


def test_scans_are_linear():
    for unit in ("1", "a", "1 ", "a.", "+1", "a@", "(", "1.", "[at] ", "@a.b"):
        began = time.time()
        pii.nodes(unit * (400_000 // len(unit)))
        assert time.time() - began < 10, unit


def test_beliefs_are_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(4)
    for edges in ([(0, 1), (1, 2), (1, 3), (3, 4)], [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)]):
        unary, pair = rng.normal(size=(5, 3)), rng.normal(size=(len(edges), 3, 3)) * 0.5
        joint = np.zeros((5, 3))
        for y in itertools.product(range(3), repeat=5):
            w = np.exp(sum(unary[i, y[i]] for i in range(5)) + sum(pair[k, y[i], y[j]] for k, (i, j) in enumerate(edges)))
            for i in range(5):
                joint[i, y[i]] += w
        want = joint / joint.sum(1, keepdims=True)
        got = pii.beliefs(unary, np.array(edges), pair, rounds=60)
        assert np.abs(got - want).max() < (1e-6 if len(edges) == 4 else 0.05)


def corpus(rng):
    """Documents with base spans, decoys that base rejects, and plain numbers."""
    out = []
    for k in range(300):
        phone = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        decoy = next(x for x in iter(lambda: "".join(rng.choice("0123456789") for _ in range(16)), None) if not luhn(x))
        items = [phone, card(rng), f"u{k}.smith@mail{k % 7}.example.com", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.7.{rng.randint(0, 255)}", decoy, "2024-05-01", str(rng.randint(10**7, 10**11)), f"999.{k}.1.2"]
        rng.shuffle(items)
        again = [items[0]] if k % 3 == 0 else []
        out.append(" some words between them and more of these here ".join(items[: rng.randint(1, 8)] + again))
    return out


def field_of(texts):
    total = pii.Counter()
    for t in texts:
        total.update(pii.counts_of(pii.nodes(t)))
    return pii.fit_counts(total)


@pytest.fixture(scope="module")
def model():
    return field_of(corpus(random.Random(8)))


def added(model, text):
    return sorted((pii.KINDS[k - 1], text[s:e]) for k, s, e, _ in pii.infer([pii.nodes(text)], model)[0])


def test_the_field_adds_what_base_misses(model):
    phone = "call +1 (017) 555-7713 today"
    far = " and so on with many words" * 40
    assert added(model, phone + far + " (017) 555-7713") == [("phone", "(017) 555-7713")]  # skip edge over a long distance
    assert added(model, phone + far + " 017.555.7713") == [("phone", "017.555.7713")]
    assert added(model, "ring (017) 555-7713 or 017.555.7713") == []  # nothing says that it is one
    assert added(model, "joe.smith [at] example [dot] com") == [("email", "joe.smith [at] example [dot] com")]
    assert added(model, "joe.smith@localhost") == [] and added(model, "joe.smith@example.org" + far + " joe.smith@localhost") == [("email", "joe.smith@localhost")]
    assert added(model, "97[.]51[.]17[.]173 and 300[.]1[.]2[.]3") == [("ip", "97[.]51[.]17[.]173")]
    number = card(random.Random(3))
    spaced = ".".join(number[i : i + 4] for i in range(0, 16, 4))
    assert added(model, f"paid with {spaced} yesterday") == [("card", spaced)]
    assert added(model, "call " + "".join(chr(0xFF10 + int(c)) if c.isdigit() else c for c in number)) != []  # fullwidth digits


def test_the_field_leaves_clean_texts_alone(model):
    rng = random.Random(9)
    for text in ("on 2024-05-01 at 12:30:55, 1234567 units, 3.14159265358979, 10.1000/182", "id 2390409500648960 and 2390409500648961 twice 2390409500648960", "version 1.2.3 and 1.2.3.4000", "f(x)[at]", "me@home"):
        if not any(luhn(x) for x in re.findall("[0-9]{13,}", text)):
            assert added(model, text) == [], text
    for text in corpus(rng):
        assert [s for s in added(model, text) if s[0] != "card"] == []


def test_documents_do_not_influence_each_other(model):
    texts = [t + " (555) 123-4567 u1.smith [at] x [dot] org" for t in corpus(random.Random(10))[:40]]
    docs = [pii.nodes(t) for t in texts]
    assert pii.infer(docs, model) == [pii.infer([d], model)[0] for d in docs]


def test_many_repeats_stay_linear(model):
    text = "+1 (017) 555-7713 or " + "017.555.7713 x " * 20_000
    doc = pii.nodes(text)
    assert sum(map(len, pii.links(doc))) < 3 * len(doc)
    began = time.time()
    assert len(pii.infer([doc], model)[0]) == 20_000
    assert time.time() - began < 60


def test_find_and_query_columns(spark, tmp_path, monkeypatch):
    texts = [*corpus(random.Random(11)), None, "", "call +1 (017) 555-7713, (017) 555-7713", "x " * 300_000 + "a@b.cd"]
    rows = [(i, t, "k", 0, "") for i, t in enumerate(texts)] + [(3, texts[3], "k", 0, ""), (None, texts[4], "k", 0, "")]
    (tmp_path / "d").mkdir()
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, start long, found string")
    docs.repartition(5).write.parquet(str(tmp_path / "d/documents.parquet"))
    got = pii.query(spark, str(tmp_path / "d")).collect()
    model = field_of([r[1] or "" for r in rows])
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        t = t or ""
        base = plain_base(t)
        more = [(pii.KINDS[k - 1], s, e) for k, s, e, _ in pii.infer([pii.nodes(t)], model)[0]]
        join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        every = sorted(base + more, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        want.setdefault(i, (*[sum(x[0] == k for x in base) for k in pii.KINDS], hashlib.sha256(join(base).encode()).hexdigest(), join(every)))
    for r in got:
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) == want[r["doc_id"]]
    assert pii.find(docs.limit(0), model).collect() == [] and pii.fit(docs.limit(0)) is None
    assert pii.find(docs, None).agg(F.sum(F.size("found"))).first()[0] == sum(sum(want[r[0]][:4]) for r in rows)
    hidden = {r["doc_id"]: r["text"] for r in pii.masked(docs, model).collect()}
    assert hidden[302] == "call [phone], [phone]" and hidden[300] is None and hidden[303].endswith(" [email]")
