"""Vectorised word shingling for one Arrow batch of texts.

Words are maximal runs of bytes other than U+0009-U+000D and U+0020, after A-Z are lower-cased; those seven code points
and A-Z are single bytes in UTF-8, so everything works on the bytes of the whole batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end (null: empty), and the n + 1 offsets of the texts in them."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets, data = texts.buffers()[1:]
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    # the bytes of a slice may begin at its first text while its offsets still count from the whole array's first
    base = offsets[0] if len(data) >= offsets[-1] else 0
    return data[base : base + offsets[-1] - offsets[0]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the batch, and the n + 1 offsets of the texts among them."""
    data, offsets = text_bytes(texts)
    size = len(data)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True  # words end where texts do
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    summed = np.zeros(size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, size), out=summed[1:])
    hashes = (summed[ends] - summed[starts]) * _powers(_P_INV, size + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the n + 1 offsets of the texts among them.

    A text of fewer than ``width`` words has its whole sequence as the one shingle; without words it has none.
    """
    words, at = word_hashes(texts)
    lengths = np.diff(at)
    counts = np.where(lengths == 0, 0, np.maximum(lengths - width + 1, 1))
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = at[:-1][doc] + np.arange(len(doc)) - (ends - counts)[doc]
    value = np.zeros(len(doc), np.uint64)
    last = at[1:][doc] - 1
    for k in range(width):
        here = first + k
        value = mix(value + np.where(here <= last, words[np.minimum(here, max(len(words) - 1, 0))], np.uint64(k))) if len(words) else value
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(counts) + 1))
