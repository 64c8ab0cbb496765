"""Word shingles of many texts at once, as 64-bit hashes. Words are maximal runs of bytes other than ASCII white space,
A-Z in lower case; no shingle crosses documents; a text with fewer words than a shingle has one shingle of all."""

from __future__ import annotations

import numpy as np

from lorewell.llm.common import mix
from lorewell.llm.tokens import span_hashes

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = np.uint64(0xD6E8FEB86659FD93)


def words(texts: list[bytes], space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, start and end (bytes in the joined texts, one more between two of them) of every word."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    if not len(data):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    space = space[data]
    flip = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(flip == -1), np.flatnonzero(flip == 1)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    return span_hashes(data, start, end), doc, start, end


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every shingle, in order."""
    h, doc, _, _ = words(texts)
    n = len(h)
    per_doc = np.bincount(doc, minlength=len(texts))
    left = (np.cumsum(per_doc))[doc] - np.arange(n)  # words from here to the document's end
    short = (per_doc[doc] < k) & (left == per_doc[doc])
    at = np.flatnonzero((left >= k) | short)
    size = np.minimum(left[at], k)
    out = mix(size.astype(np.uint64))
    for j in range(k):
        more = size > j
        out[more] = mix(out[more] * STEP + h[at[more] + j])
    return out, doc[at]


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Like shingles(), but each hash once a document, sorted by document and hash."""
    h, doc = shingles(texts, k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]
