"""Personal data by a skip-chain conditional random field over a document's candidates.

Base patterns name e-mail addresses, IP addresses, card and phone numbers; these spans stay whatever the model says. Wider
patterns propose what they miss: numbers grouped by other marks or written in other digits, numbers without their country
code, addresses with [at] and [dot], bracketed dots, domains without a dot. Nodes of the field are base spans, observed with
their label, and proposals, whose label (a kind or none) is to be found; tokens that neither names can carry no label, so
the chain passes over them. Potentials:

- node: log-probability of a label under shape features (digits, check digit, plus sign, quads, domain, a cue word before);
- chain: neighbours at most NEAR characters apart, log of p(y, z) / p(y) p(z);
- skip: nodes of one document that share a key (the last SUFFIX digits, the quad, the address or its local part), each linked
  with the key's first node, so that links grow with the nodes; SKIP times the log of p(y, z) / sqrt(p(y) p(z)).

Loopy sum-product with damping runs a fixed number of rounds on each document's graph, and a proposal becomes a span if a
kind is likelier than none. All potentials come from counts over all documents, taken in one distributed pass and added up
by group (their number follows the features, not the data); proposals that share a key with a base span are left out of
these counts, as whether base missed them is what the field decides. Node weights are a multinomial logistic fit to the
counts; if there is no base span at all, nothing is proposed.

Null and empty texts have no spans, null ids stay null, repeated rows are told as often as they occur; other columns are
ignored. Positions are code points, ends exclusive. A proposed address has at most 64 characters before its sign and 255
after it, as the standard has; base patterns have no such bound.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = 1, 2, 3, 4
LABELS = len(KINDS) + 1
NEAR, SUFFIX, SKIP = 40, 7, 2.0
#: Digits of the longest number that a card can have; longer runs are cut at spaces.
MOST_DIGITS = 19
#: Rounds of messages; log-weight of what is ruled out, beyond what any number of neighbours can say.
ROUNDS, DAMPING, CLAMP = 30, 0.5, 1e9
#: Shrinkage of node weights, and what is added to each count of pairs.
RIDGE, PAIR = 0.5, 0.5
#: Observations that the counts start with, so that shapes which a corpus lacks are no personal data by themselves: features
#: of addresses without a dot in their domain, and of numbers of every size without a plus sign.
PRIOR = {(1, 0, 0, 0, 1, 0): 5} | {(0, size * 3, size * 2, 0, 0, 0): 1 for size in range(1, 6)}
#: Nodes that are inferred together at least, unless the input ends.
TOGETHER = 20_000

# Base patterns, fixed by contract; look-behinds only keep the scan linear.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Proposals.
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|punto|point|\.)\s?[\])}]\s?)"
_MARK = r"\s?[\[({]\.[\])}]\s?|\)[\x20.-]?|[\x20.-]?\("
_SPACE = r"\x20\u00a0\u2007\u2009\u202f"
_JOIN = r"\-./_:\u2010-\u2015\u30fb"
_NUMBER = re.compile(rf"[+\uff0b]?\(?(?<!\d)\d+(?:(?:{_MARK}|[{_SPACE}{_JOIN}])\d+)*")
_TIGHT = re.compile(rf"[+\uff0b]?\(?(?<!\d)\d+(?:(?:\)|\(|[{_JOIN}])\d+)*")
_SIGN = re.compile(r"[@\uff20]|\s?[\[({]\s?(?:at|@|arroba|chez)\s?[\])}]\s?", re.I)
_BEFORE = re.compile(r"[\w.%+'-]+\Z")
_AFTER = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)*", re.I)
_DOTS = re.compile(_DOT, re.I)
_WORDS = re.compile(r"[^\W\d_]+")

#: Words that announce a kind.
CUES = {
    EMAIL: frozenset("email mail e mailto correo courriel contact kontakt contacto".split()),
    IP: frozenset("ip ipv host server address adresse dirección serveur".split()),
    CARD: frozenset("card visa mastercard amex karte kreditkarte tarjeta carte iban account konto".split()),
    PHONE: frozenset("phone tel telephone telefon teléfono téléphone call mobile handy móvil fax cell".split()),
}
_CUE = {w: k for k, words in CUES.items() for w in words}

Node = tuple[int, int, int, tuple[int, ...], tuple[str, ...]]  # start, end, label (-1: unknown), features, keys


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out, free = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((EMAIL, start, m.end()))
                free = m.end()
    out += [(IP, *m.span()) for m in _QUAD.finditer(text) if all(map(byte_sized, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, *m.span()))
    if "+" in text:
        out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def plain_digits(text: str) -> str:
    """All decimal digits of a text as 0-9."""
    return "".join(c if c.isascii() else str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def cue(text: str, start: int) -> int:
    """The kind that a word just before a position announces; 0 if none does."""
    for w in reversed(_WORDS.findall(text[max(0, start - NEAR) : start].lower())):
        if w in _CUE:
            return _CUE[w]
    return 0


#: Numbers of values of the features that shape() gives.
SIZES = (2, 18, 12, 3, 4, LABELS)


def number_shape(raw: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    digits = plain_digits(raw)
    n = len(digits)
    size = sum(n >= k for k in (7, 9, 13, 16, 20))  # 0 to 5
    check = 0 if not 13 <= n <= 19 else 1 + luhn(digits)
    parts = re.split(r"\s?[\[({]\.[\])}]\s?|\.", raw)
    quad = len(parts) == 4 and all(p.isdecimal() for p in parts)
    quads = 0 if not quad else 1 + all(byte_sized(plain_digits(p)) for p in parts)
    plus = raw[0] in "+\uff0b"
    keys = [f"n{digits[-SUFFIX:]}"] if n >= SUFFIX else []
    if quad:
        keys.append("q" + ".".join(plain_digits(p).lstrip("0") for p in parts))
    return (0, size * 3 + check, size * 2 + plus, quads, 0), tuple(keys)


def address_shape(local: str, domain: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    labels = [x for x in _DOTS.split(domain) if x]
    name = unicodedata.normalize("NFKC", local).lower()
    whole = name + "@" + unicodedata.normalize("NFKC", ".".join(labels)).lower()
    dotted, ascii_only = len(labels) > 1, whole.isascii()
    keys = [f"a{whole}"] + ([f"l{name}"] if len(name) >= 5 else [])
    return (1, 0, 0, 0, 1 + dotted * (1 + ascii_only)), tuple(keys)


def nodes(text: str, base: list[tuple[int, int, int]] | None = None) -> list[Node]:
    """Base spans and proposals of a text by start."""
    base = base_spans(text) if base is None else base
    out: list[Node] = []
    for kind, start, end in base:
        raw = text[start:end]
        shape, keys = address_shape(*raw.split("@", 1)) if kind == EMAIL else number_shape(raw)
        out.append((start, end, kind, (*shape, cue(text, start)), keys))
    taken = sorted((s, e) for _, s, e in base)
    found: list[Node] = []
    for m in _SIGN.finditer(text):
        before = _BEFORE.search(text[max(0, m.start() - 64) : m.start()])
        after = _AFTER.match(text[m.end() : m.end() + 255])
        if before and after:
            start, end = m.start() - len(before[0]), m.end() + after.end()
            shape, keys = address_shape(before[0], after[0])
            found.append((start, end, -1, (*shape, cue(text, start)), keys))
    numbers: list[Node] = []
    for m in _NUMBER.finditer(text):
        whole = sum(map(str.isdecimal, m[0])) <= MOST_DIGITS
        for start, end in [m.span()] if whole else [x.span() for x in _TIGHT.finditer(text, *m.span())]:
            raw = text[start:end]
            if len(raw) >= 7 and sum(map(str.isdecimal, raw)) <= MOST_DIGITS:
                shape, keys = number_shape(raw)
                if keys:
                    numbers.append((start, end, -1, (*shape, cue(text, start)), keys))
    for more in (found, numbers):  # what overlaps anything before it is no proposal
        kept = clear_of(more, taken)
        out += kept
        taken = sorted(taken + [x[:2] for x in kept])
    return sorted(out)


def clear_of(found: list[Node], taken: list[tuple[int, int]]) -> list[Node]:
    """The nodes that overlap neither taken spans nor an earlier one of theirs; both are in order of their starts."""
    out, k, reach = [], 0, 0
    for x in sorted(found):
        while k < len(taken) and taken[k][0] < x[1]:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= x[0]:
            out.append(x)
            reach = x[1]
    return out


def links(doc: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain and skip edges of a document's nodes."""
    chain = [(i, i + 1) for i in range(len(doc) - 1) if doc[i + 1][0] - doc[i][1] <= NEAR]
    first: dict[str, int] = {}
    skip = {(j, i) for i, x in enumerate(doc) for key in x[4] if (j := first.setdefault(key, i)) != i}
    return chain, sorted(skip)


def counts_of(doc: list[Node]) -> Counter:
    """What a document tells of the potentials: ("n", features, label), ("c" or "s", label, label)."""
    shared = {key for x in doc if x[2] > 0 for key in x[4]}
    label = [x[2] if x[2] > 0 else -1 if shared.intersection(x[4]) else 0 for x in doc]
    out: Counter = Counter()
    for x, y in zip(doc, label, strict=True):
        if y >= 0:
            out["n", code(x[3]), y] += 1
    for kind, pairs in zip("cs", links(doc), strict=True):
        for i, j in pairs:
            if label[i] >= 0 and label[j] >= 0:
                out[kind, label[i], label[j]] += 1
    return out


def code(features: tuple[int, ...]) -> int:
    at = 0
    for x, size in zip(features, SIZES, strict=True):
        at = at * size + x
    return at


def one_hot(codes: np.ndarray) -> np.ndarray:
    """A row of indicators (and a constant) for each code."""
    out, rest = [np.ones((len(codes), 1))], codes.copy()
    for size in reversed(SIZES):
        out.append(np.eye(size)[rest % size])
        rest //= size
    return np.concatenate(out, 1)


def allowed(features: tuple[int, ...]) -> np.ndarray:
    """Which labels a value's shape can bear at all: an address, a quad of bytes, a number with its check digit, a number of 7
    to 15 digits; none always."""
    form, size_check, size_plus, quads, _, _ = features
    return np.array([True, form == 1, quads == 2, size_check % 3 == 2, form == 0 and 1 <= size_plus // 2 <= 3])


@dataclass
class Field:
    """Node weights by indicator and label, and the log-potentials of pairs of labels."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    known: dict[int, np.ndarray] = field(default_factory=dict)

    def unary(self, features: tuple[int, ...]) -> np.ndarray:
        key = code(features)
        if key not in self.known:
            s = np.where(allowed(features), (one_hot(np.array([key])) @ self.weights)[0], -CLAMP)
            self.known[key] = s - np.logaddexp.reduce(s)
        return self.known[key]


def fit_counts(rows: Counter) -> Field | None:
    """The field from counts added up over all documents; None if no base span was counted."""
    if not any(k[0] == "n" and k[2] for k in rows):
        return None
    rows = rows + Counter({("n", code(k), 0): n for k, n in PRIOR.items()})
    named = sorted((k[1], k[2], n) for k, n in rows.items() if k[0] == "n")
    codes = sorted({c for c, _, _ in named})
    target = np.zeros((len(codes), LABELS))
    for c, y, n in named:
        target[codes.index(c), y] += n
    x, total = one_hot(np.array(codes)), target.sum(1)
    w = np.zeros((x.shape[1], LABELS))
    value = lambda w: float((target * log_softmax(x @ w)).sum() - RIDGE / 2 * (w * w).sum())
    for _ in range(100):  # damped Newton steps on a concave function
        p = np.exp(log_softmax(x @ w))
        g = x.T @ (target - total[:, None] * p) - RIDGE * w
        h = hessian(x, total, p)
        step = np.linalg.solve(h + RIDGE * np.eye(h.shape[0]), g.T.reshape(-1)).reshape(LABELS, -1).T
        size, now = 1.0, value(w)
        while value(w + size * step) < now and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    pairs = {}
    for kind in "cs":
        n = np.full((LABELS, LABELS), PAIR)
        for (k, a, b), c in rows.items():
            if k == kind:
                n[a, b] += c / 2
                n[b, a] += c / 2
        p = n / n.sum()
        one = p.sum(1)
        pairs[kind] = np.log(p / np.outer(one, one)) if kind == "c" else SKIP * np.log(p / np.sqrt(np.outer(one, one)))
    return Field(w, pairs["c"], pairs["s"])


def log_softmax(s: np.ndarray) -> np.ndarray:
    return s - np.logaddexp.reduce(s, 1, keepdims=True)


def hessian(x: np.ndarray, total: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Minus the second derivatives of the log-likelihood, label by label."""
    m, d = p.shape[1], x.shape[1]
    out = np.zeros((m, d, m, d))
    for a in range(m):
        for b in range(m):
            out[a, :, b, :] = (x.T * (total * p[:, a] * ((a == b) - p[:, b]))) @ x
    return out.reshape(m * d, m * d)


def beliefs(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """Probabilities of the labels by loopy sum-product. unary: node x label, edges: edge x (from, to), pair: edge x label x
    label, all in logs."""
    if not len(edges):
        return np.exp(log_softmax(unary))
    source, goal = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    theta, n = np.concatenate([pair, pair.transpose(0, 2, 1)]), len(edges)
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    message = np.full((2 * n, unary.shape[1]), -np.log(unary.shape[1]))
    for _ in range(rounds):
        held = unary.copy()
        np.add.at(held, goal, message)
        new = np.empty_like(message)
        for at in range(0, len(source), 1 << 14):
            part = slice(at, at + (1 << 14))
            new[part] = np.logaddexp.reduce((held[source[part]] - message[back[part]])[:, :, None] + theta[part], axis=1)
        message = log_softmax(damping * message + (1 - damping) * log_softmax(new))
    held = unary.copy()
    np.add.at(held, goal, message)
    return np.exp(log_softmax(held))


def infer(docs: list[list[Node]], model: Field) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, probability) of the proposals that are accepted, for each document."""
    unary, edges, types, at = [], [], [], 0
    for doc in docs:
        for x in doc:
            if x[2] > 0:
                u = np.full(LABELS, -CLAMP)
                u[x[2]] = 0.0
            else:
                u = model.unary(x[3])
            unary.append(u)
        for k, pairs in enumerate(links(doc)):
            edges += [(i + at, j + at) for i, j in pairs]
            types += [k] * len(pairs)
        at += len(doc)
    p = beliefs(np.array(unary).reshape(-1, LABELS), np.array(edges, np.int64).reshape(-1, 2), np.stack([model.chain, model.skip])[np.array(types, np.int64)])
    out, at = [], 0
    for doc in docs:
        own, accepted = p[at : at + len(doc)], []
        for x, q in zip(doc, own, strict=True):
            best = int(q[1:].argmax()) + 1
            if x[2] < 0 and q[best] > q[0]:
                accepted.append((best, x[0], x[1], float(q[best])))
        out.append(sorted(accepted))
        at += len(doc)
    return out


def fit(docs: DataFrame, text_col: str = "text") -> Field | None:
    """The field of a table's documents."""
    common.bounded_batches(docs.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                total.update(counts_of(nodes(text.as_py() or "")))
        keys = list(total)
        yield common.batch(schema, [k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [total[k] for k in keys])

    rows = docs.select(text_col).mapInArrow(common.lean(run), "kind string, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()  # features and labels bound their number
    return fit_counts(Counter({(r["kind"], r["a"], r["b"]): r["n"] for r in rows}))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])
SPAN_DDL = "array<struct<kind: string, start: long, end: long, base: boolean, score: double>>"


def find(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: all spans by kind and start, with whether a base pattern names them and the probability of their kind."""
    schema = pa.schema([("_id", pa.int64()), ("found", pa.list_(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, ids, held, base, size = model, [], [], [], 0

        def put() -> pa.RecordBatch:
            some = [k for k, doc in enumerate(held) if any(x[2] < 0 for x in doc)] if shared else []
            more = dict(zip(some, infer([held[k] for k in some], shared), strict=True)) if some else {}
            rows = [sorted([(k, s, e, True, 1.0) for k, s, e in own] + [(k, s, e, False, p) for k, s, e, p in more.get(at, [])]) for at, own in enumerate(base)]
            return common.batch(schema, ids, [[dict(zip(("kind", "start", "end", "base", "score"), (KINDS[r[0] - 1], *r[1:]), strict=True)) for r in row] for row in rows])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                own = base_spans(text)
                doc = nodes(text, own) if shared else []
                ids.append(i)
                base.append(own)
                held.append(doc)
                size += 1 + len(doc)
                if size >= TOGETHER:
                    yield put()
                    ids, held, base, size = [], [], [], 0
        if ids:
            yield put()

    out = common.keyed(docs, id_col, text_col).mapInArrow(common.lean(run), f"_id long, found {SPAN_DDL}")
    return out.select(common.restored(F.col("_id")).alias("doc_id"), "found")


def masked(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets; of overlapping spans the first, then the longest counts."""
    schema = pa.schema([("_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            docs = [nodes(t or "") if model else [] for t in texts]
            some = [k for k, doc in enumerate(docs) if any(x[2] < 0 for x in doc)]
            more = dict(zip(some, infer([docs[k] for k in some], model), strict=True)) if some else {}
            out = []
            for k, t in enumerate(texts):
                spans = sorted([(s, -e, kind) for kind, s, e in base_spans(t or "")] + [(s, -e, kind) for kind, s, e, _ in more.get(k, [])])
                made, at = [], 0
                for s, e, kind in spans:
                    if s >= at:
                        made += [t[at:s], f"[{KINDS[kind - 1]}]"]
                        at = -e
                out.append(t if t is None else "".join([*made, t[at:]]))
            yield common.batch(schema, b.column(0), out)

    out = common.keyed(docs, id_col, text_col).mapInArrow(common.lean(run), "_id long, text string")
    return out.select(common.restored(F.col("_id")).alias("doc_id"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: base counts and digest and all spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, fit(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
