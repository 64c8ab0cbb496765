"""Token ids of whole texts, by the tokenizers library, with bounded caches for repeated pieces."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

from lorewell.llm.common import mix

#: Characters below this have stable Unicode classes and are their own NFC form; texts with others go to the library whole.
PLAIN = 0x250
SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
#: Code points handled at once.
SLICE_CHARS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every plain character."""
    kinds = ((SPACE, regex.compile(r"\s")), (LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")))
    kind = [next((k for k, r in kinds if r.match(chr(c))), OTHER) for c in range(PLAIN)]
    lower = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(PLAIN)]
    return np.array(kind, np.uint8), np.array(lower, np.uint32)


KIND, LOWER = char_tables()
#: White space in one library but not in another, characters without a single lower-case form, and all that aren't plain.
ODD = re.compile("[\x1c-\x1f\u0130]|[^\x00-\u024f]")
_powers: dict[np.uint64, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out)
    return _powers[base][:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, from one prefix sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=total[1:])
    return mix((total[end] - total[start]) * powers(BASE_INVERSE, len(values) + 1)[start] + (end - start).astype(np.uint64))


def visible_bytes() -> list[str]:
    """The characters by which byte-level vocabularies spell the 256 bytes: printable ones stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Cache(dict):
    """A dict of bounded size: when the young half is full it becomes the old half, and the old half goes."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """encode(texts): for each text the little-endian bytes of its ids (self.dtype), equal to encode_batch's.

    Two shapes of tokenizer cut texts into pieces that the library's model merges one by one: lower-cased words whose
    white space is dropped, and byte-level pieces that keep it. For them many texts' pieces are found at once, and the
    model sees each distinct piece of a slice once, or never if the cache has it. Texts with characters beyond PLAIN or
    with special tokens, and all texts of other tokenizers, go to the library whole."""

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.n_vocab = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.n_vocab <= 1 << 16 else np.dtype("<u4")
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kind = "whole"
        if not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
                self.kind = "word"
            elif norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
                self.kind = "byte"
        self.visible = visible_bytes()
        self.pieces = Cache(self._piece, limit)

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece.isalnum() else "".join([self.visible[b] for b in piece.encode()])
        return self._pack([t.id for t in self.tokenizer.model.tokenize(spelled)])

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        for i, text in enumerate(texts):
            if self.kind == "whole" or ODD.search(text) or (self.special and self.special.search(text)):
                out[i] = self._whole(text)
            elif text:
                plain.append(i)
        at = 0
        while at < len(plain):
            to, size = at + 1, len(texts[plain[at]])
            while to < len(plain) and size + len(texts[plain[to]]) < SLICE_CHARS:
                size += len(texts[plain[to]])
                to += 1
            for i, ids in zip(plain[at:to], self._slice([texts[i] for i in plain[at:to]]), strict=True):
                out[i] = ids
            at = to
        return out

    def _slice(self, texts: list[str]) -> list[bytes]:
        joined = "\n".join(["", *texts, ""])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        kind = KIND[chars]
        kind[0] = EDGE
        kind[ends] = EDGE
        start, end = (self._words if self.kind == "word" else self._byte_pieces)(chars, kind)
        if self.kind == "word":
            chars = LOWER[chars]
            joined = chars.tobytes().decode("utf-32-le")
        _, first, which = np.unique(span_hashes(chars, start, end), return_index=True, return_inverse=True)
        cache = self.pieces
        found = [cache[joined[a:b]] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        sizes = np.array([len(x) for x in found], np.int64) // self.dtype.itemsize
        base = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(found), self.dtype)
        n = sizes[which]
        after = np.cumsum(n)
        ids = pool[np.repeat(base[which] - (after - n), n) + np.arange(int(after[-1]) if len(after) else 0)]
        cut = np.concatenate(([0], after))[np.searchsorted(start, ends)]
        return [x.tobytes() for x in np.split(ids, cut[:-1])]

    @staticmethod
    def _contractions(chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Length of the English contraction that begins at each apostrophe in at; 0 for none."""
        a, b = chars[at + 1], chars[np.minimum(at + 2, len(chars) - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        return np.where(one, 2, np.where(two, 3, 0))

    def _cut(self, chars: np.ndarray, kind: np.ndarray, begins: np.ndarray, may: np.ndarray) -> np.ndarray:
        """begins: where pieces begin, but for contractions, which begin at apostrophes in may and end after themselves."""
        at = np.flatnonzero((chars == ord("'")) & may)
        if len(at):
            n = self._contractions(chars, at)
            at, n = at[n > 0], n[n > 0]
            begins[at] = True
            begins[at + 1] = False
            begins[(at + 2)[n == 3]] = False
            begins[at + n] = True
        return begins

    def _words(self, chars: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars = LOWER[chars]
        begins = np.ones(len(kind), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == EDGE)
        begins = self._cut(chars, kind, begins, np.concatenate(([False], kind[:-1] != OTHER)))
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(kind))
        keep = (kind[start] != SPACE) & (kind[start] != EDGE)
        return start[keep], end[keep]

    def _byte_pieces(self, chars: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(kind)
        begins = np.ones(n, bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == EDGE)
        space = kind == SPACE
        solid = ~space & (kind != EDGE)
        next_solid = np.append(solid[1:], False)
        last = space & next_solid  # the last of a run of white space, if something follows it
        begins[last] = True
        leads = last & (chars == ord(" "))  # it belongs to what follows
        begins[1:][leads[:-1]] = False
        before = np.concatenate(([False], (kind[:-1] != OTHER) & ~leads[:-1]))
        begins = self._cut(chars, kind, begins, before)
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        keep = kind[start] != EDGE
        return start[keep], end[keep]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
