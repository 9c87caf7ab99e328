"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow string column.

All separators used here are ASCII, so words can be cut in bytes: no byte of a longer character is below 0x80.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; bounds the memory of one step whatever the texts' length.
SLICE = 1 << 20


def lower_table() -> np.ndarray:
    """Byte -> byte with A-Z in lower case, all else unchanged."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def not_blank() -> np.ndarray:
    """Bytes of words that end at ASCII white space (0x20, 0x09-0x0D)."""
    t = np.ones(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alphanumeric() -> np.ndarray:
    """Bytes of words that end at any ASCII character but letters and digits; upper case counts as a letter."""
    t = np.zeros(256, dtype=bool)
    t[128:] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        t[a:b] = True
    return t


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word: a longest run of bytes with inside[byte], within one text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = inside[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = mask[edges]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    ends[edges - 1] = mask[edges - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as a polynomial modulo 2**64, mixed with its length."""
    out = np.empty(len(start), np.uint64)
    size = end - start
    if not len(start):
        return out
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(int(min(size.max(), 1 << 16)), base, np.uint64))
    at = 0
    while at < len(start):
        # As many words as fit in one slice; a longer word makes a slice of its own.
        upto = max(at + 1, int(np.searchsorted(end, start[at] + SLICE, side="right")))
        a, b = int(start[at]), int(end[upto - 1])
        place = np.arange(a, b, dtype=np.int64)
        gaps = np.zeros(b - a, np.int64)
        gaps[start[at:upto] - a] = np.diff(start[at:upto], prepend=a)
        place -= a + np.cumsum(gaps)
        terms = (data[a:b].astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)]
        if size[at:upto].max() > len(power):  # bytes far into a huge word still count by their place
            terms *= mix((place // len(power)).astype(np.uint64) + np.uint64(7)) | np.uint64(1)
        # reduceat runs to the next word's start; the separators between are taken out first.
        keep = np.zeros(b - a + 1, np.int8)
        keep[start[at:upto] - a] += 1
        keep[end[at:upto] - a] -= 1
        terms[np.cumsum(keep[:-1]) == 0] = 0
        out[at:upto] = np.add.reduceat(terms, start[at:upto] - a)
        at = upto
    return mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, owner: np.ndarray, texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number), distinct within a text and sorted by both: runs of ``width`` words.

    A text with fewer words has its whole sequence as the one shingle; a text without words has none.
    """
    counts = np.bincount(owner, minlength=texts).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    n = len(words)
    full = np.zeros(0, np.int64)
    if n >= width:
        full = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    value = np.zeros(len(full), np.uint64)
    for k in range(width):
        value = mix(value * np.uint64(0x9FB21C651E98DF25) + words[full + k] + np.uint64(k + 1))
    short = np.flatnonzero((counts > 0) & (counts < width))
    few = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        there = counts[short] > k
        at = np.minimum(first[short] + k, max(n - 1, 0))
        few = np.where(there, mix(few * np.uint64(0x9FB21C651E98DF25) + words[at] + np.uint64(k + 1)), few)
    few = mix(few + np.uint64(0xA0761D6478BD642F) * counts[short].astype(np.uint64))
    values, texts_of = np.concatenate((value, few)), np.concatenate((owner[full], short))
    order = np.lexsort((values, texts_of))
    values, texts_of = values[order], texts_of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (texts_of[1:] != texts_of[:-1])
    return values[new], texts_of[new]
