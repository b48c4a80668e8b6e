"""Vectorised word and shingle hashing over Arrow text columns.

A text column is read as one byte block (Arrow's own buffers, no Python
string per row). Words are maximal runs of "word bytes" of a 256-entry class
table; ASCII capitals hash like their lower-case letters. Work goes on in
blocks of at most ``BLOCK_BYTES`` (or one text, where that is longer), so
memory is bounded by the longest text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def class_table(is_word) -> np.ndarray:
    """Boolean table over byte values (after A-Z lower-casing)."""
    return np.array([bool(is_word(int(_LOWER[b]))) for b in range(256)])


#: Words as runs of anything but space and \t \n \v \f \r.
SPACED = class_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words as runs of ASCII letters, digits and all non-ASCII characters.
ALNUM = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges (i, j) whose texts hold at most ``limit`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Start and end of every word of rows ``offsets`` (relative to raw), and
    the row of each word. A word never crosses a row's edge."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    on = table[raw[lo:hi]]
    edge = np.zeros(hi - lo + 1, dtype=bool)
    edge[offsets - lo] = True
    prev = np.empty(hi - lo, dtype=bool)
    prev[0] = False
    prev[1:] = on[:-1]
    starts = np.flatnonzero(on & (~prev | edge[:-1]))
    nxt = np.empty(hi - lo, dtype=bool)
    nxt[-1] = False
    nxt[:-1] = on[1:]
    ends = np.flatnonzero(on & (~nxt | edge[1:])) + 1
    rows = np.searchsorted(offsets - lo, starts, side="right") - 1
    return starts + lo, ends + lo, rows


#: Longer slices are hashed one by one.
LANES_BYTES = 256
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=_U)  # masks of the first n bytes


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def lane(at: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first eight of ``left`` bytes from each start; zeros behind the end."""
    return at[starts] & _KEEP[np.minimum(left, 8)]


def slice_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hash of each slice [start, end), taken in eight bytes at a time.
    Each step is a mixed bijection of the bytes and of what came before, so no
    pattern of bytes makes hashes meet. Hashes of two seeds are independent."""
    if not len(starts):
        return np.zeros(0, _U)
    lo, hi = int(starts.min()), int(ends.max())
    raw = raw[lo:hi]
    if lower:
        raw = _LOWER[raw]
    at, starts, left = lanes(raw), starts - lo, ends - starts
    with np.errstate(over="ignore"):
        mul = _U(0x9E3779B97F4A7C15 + 2 * seed)
        h = mix64((left.astype(_U) + _U(1)) * mul)
        live = np.arange(len(starts))
        if (left > LANES_BYTES).any():
            import xxhash
            for i in np.flatnonzero(left > LANES_BYTES).tolist():
                h[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:starts[i] + left[i]].tobytes(), seed=seed)
            live = np.flatnonzero(left <= LANES_BYTES)
        pos, left = starts[live], left[live]
        while len(live):
            h[live] = mix64(h[live] * mul + lane(at, pos, left))
            more = left > 8
            live, pos, left = live[more], pos[more] + 8, left[more] - 8
    return h


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word (A-Z lower-cased)."""
    return slice_hashes(raw, starts, ends, lower=True, seed=seed)


_SHINGLE = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                            0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words of one text; of the whole sequence
    where it is shorter; nothing without words."""
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    k = min(size, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - k + 1, _U(k), dtype=_U)
        for i in range(k):
            acc = mix64(acc * _SHINGLE[i % 8] + words[i:n - k + 1 + i])
        return acc


def shingle_sets(col, size: int, table: np.ndarray = SPACED, seeds: tuple[int, ...] = (0,)):
    """Sorted distinct shingle hashes of every row of a text column; with more
    than one seed, a tuple of such sets."""
    raw, off = column_bytes(col)
    for i, j in blocks(off):
        s, e, rows = word_spans(raw, off[i:j + 1], table)
        h = [word_hashes(raw, s, e, seed) for seed in seeds]
        cut = np.searchsorted(rows, np.arange(j - i + 1))
        for r in range(j - i):
            sets = tuple(np.unique(shingle_hashes(x[cut[r]:cut[r + 1]], size)) for x in h)
            yield sets if len(seeds) > 1 else sets[0]
