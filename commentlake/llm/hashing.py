"""Hashes of words and shingles for whole Arrow columns of text, in numpy.

A word's hash is a polynomial over its bytes, read off running sums, so no Python code runs per word. Memory is bounded
by the segment size plus eight bytes per word of the documents in hand, whatever the length of one text.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
RUN_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1


def mix64(x):
    """Bit mixing of 64-bit words; bijective, so it adds no collisions."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def seeds(n, seed):
    """n odd pseudo-random 64-bit constants, the same everywhere."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _powers(base, n):
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_FORWARD = _powers(_BASE, SEGMENT + 1)
_BACKWARD = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), SEGMENT + 1)
_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(977))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z only

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def text_buffer(column):
    """Bytes and row offsets of an Arrow string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8).copy()
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def runs(offsets, limit=RUN_BYTES):
    """Row ranges of at most `limit` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def hash_words(data, offsets, is_word=NOT_SPACE, fold=FOLD):
    """Hashes of all words of the rows, and the place where each row's words begin (one more than rows).

    A word is a maximal run of bytes of the class, inside one row.
    """
    table = _BYTE[fold]
    raw, sizes, firsts = [], [], []
    row_starts = np.unique(offsets[:-1])
    open_word = False
    for lo in range(0, len(data), SEGMENT):
        part = data[lo:lo + SEGMENT]
        word = is_word[part]
        breaks = np.zeros(len(part) + 1, bool)
        breaks[0] = breaks[-1] = True
        a, b = np.searchsorted(row_starts, (lo, lo + len(part)))
        breaks[row_starts[a:b] - lo] = True
        before = np.concatenate(([False], word[:-1])) & ~breaks[:-1]
        after = np.concatenate((word[1:], [False])) & ~breaks[1:]
        start = np.flatnonzero(word & ~before)
        end = np.flatnonzero(word & ~after) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _FORWARD[:len(part)], out=sums[1:])
        h = (sums[end] - sums[start]) * _BACKWARD[start]
        size = (end - start).astype(np.int64)
        first = start + lo
        new_row = a < b and row_starts[a] == lo
        if open_word and len(start) and start[0] == 0 and not new_row:
            joined = (int(raw[-1][-1]) + int(h[0]) * pow(int(_BASE), int(sizes[-1][-1]), 1 << 64)) & _MASK
            raw[-1][-1], sizes[-1][-1] = np.uint64(joined), sizes[-1][-1] + size[0]
            h, size, first = h[1:], size[1:], first[1:]
        open_word = bool(len(part) and word[-1])
        if len(h):
            raw.append(h.copy()), sizes.append(size.copy()), firsts.append(first)
    if not raw:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    sizes = np.concatenate(sizes).astype(np.uint64)
    hashes = mix64(np.concatenate(raw) + sizes * np.uint64(0xC2B2AE3D27D4EB4F))
    return hashes, np.searchsorted(np.concatenate(firsts), offsets, "left")


def grams(hashes, k, seed=0):
    """Hash of every k consecutive words, whichever rows they are in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k + 31 * seed), np.uint64)
    for j, c in enumerate(seeds(k, 7 * k + seed)):
        out += hashes[j:j + n] * c
    return mix64(out)


def shingle_set(words, k):
    """Sorted distinct hashes of a row's k-word shingles; with fewer words the whole sequence is one, none gives none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(grams(words, min(k, len(words))))


def signed(x):
    return np.ascontiguousarray(x).view(np.int64)
