"""Token ids by the `tokenizers` library, with a bounded cache of units.

Both public vocabularies first cut a text by a pattern (letters | digits |
other signs | white space) and merge nothing across a cut. A text's ids are
therefore the ids of its units in a row, where units end only at cuts that
hold in any context: between an ASCII letter and ASCII punctuation, around a
single line feed, and before a single space. Units repeat, texts hardly do:
the library encodes a unit once, and the ids are kept in a table of bounded
size: when the young generation is full, it becomes the old one, whose units
are young again when they are met. Look-ups go by the unit's 64-bit hash in
whole blocks, and every hit is compared byte by byte; a unit that only shares
its hash with another is encoded by itself. Texts that hold the opening of a
special token, or white space outside ASCII, are one unit and are encoded whole.
"""
from __future__ import annotations

import os

import numpy as np

from .common import give_back
from .textblocks import blocks, column_bytes, lane, lanes, slice_hashes

#: Slots of a generation (it is full at half of them): 20 MB, the bytes and the ids.
SLOTS = 1 << 20
#: Longer units are encoded once in a block.
KEEP_BYTES = 64
#: Units that the library encodes at a time: its results are many times their ids.
AT_A_TIME = 2048
_U = np.uint64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_WHITE = np.zeros(256, bool)
_WHITE[9:14] = _WHITE[32] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_PUNCT_END = _PUNCT.copy()
_PUNCT_END[39] = False  # after an apostrophe letters may belong to it


def _shift(a: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(a)
    if by > 0:
        out[by:] = a[:-by]
    else:
        out[:by] = a[-by:]
    return out


def cuts(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Start positions of the units of texts that begin at ``edges[:-1]``."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    at_start, at_end = edge[:-1], edge[1:]
    white = _WHITE[raw]
    alone_before = ~_shift(white, 1) & ~at_start  # a non-space of the same text stands before
    alone_after = ~_shift(white, -1) & ~at_end
    single = white & alone_before & alone_after
    cut = single & ((raw == 32) | (raw == 10))          # before a single space or line feed
    cut |= _shift(single & (raw == 10), 1)              # after a single line feed
    letter = _LETTER[raw]
    cut |= _shift(letter, 1) & _PUNCT[raw]
    cut |= _shift(_PUNCT_END[raw], 1) & letter
    # texts to be left whole
    b1, b2 = _shift(raw, -1), _shift(raw, -2)
    odd = (raw == 60) & (b1 == 124)
    odd |= (raw == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    odd |= (raw == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)
    odd |= (raw == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))
    odd |= (raw == 0xE2) & (b1 == 0x81) & (b2 == 0x9F)
    odd |= (raw == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
    for t in np.unique(np.searchsorted(edges, np.flatnonzero(odd), side="right") - 1):
        cut[edges[t]:edges[t + 1]] = False
    cut |= at_start
    return np.flatnonzero(cut)


class _Pool:
    """A growing array."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> int:
        at, self.n = self.n, self.n + len(values)
        if self.n > len(self.data):
            grown = np.zeros(max(len(self.data) * 3 // 2, self.n), self.data.dtype)
            grown[:at] = self.data[:at]
            self.data = grown
        self.data[at:self.n] = values
        return at

    def shrink(self) -> None:
        """Nothing more is added."""
        self.data = self.data[:self.n].copy()


def _runs(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for lens[0] places, then start[1], ..."""
    before = np.cumsum(lens) - lens
    return np.repeat(start - before, lens) + np.arange(int(lens.sum()))


class UnitTable:
    """hash -> ids, open addressing in numpy. A unit's bytes are kept in lanes
    of eight."""

    def __init__(self, slots: int):
        self.slots, self.mask = slots, _U(slots - 1)
        self.keys = np.zeros(slots, _U)
        self.entry = np.zeros(slots, np.int32)
        self.ids, self.lanes = _Pool(np.uint32), _Pool(_U)
        # by entry: where its ids and lanes begin, how many ids and bytes
        self.id_at, self.lane_at, self.n_ids, self.n_bytes = (_Pool(t) for t in (np.int32, np.int32, np.uint8, np.uint8))

    def room(self) -> int:
        return self.slots // 2 - self.id_at.n

    def shrink(self) -> None:
        for pool in (self.ids, self.lanes, self.id_at, self.lane_at, self.n_ids, self.n_bytes):
            pool.shrink()

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where it is absent."""
        out = np.full(len(h), -1, np.int64)
        slot = h & self.mask
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.entry[slot[left[hit]]]
            left = left[~hit & (key != 0)]
            slot[left] = (slot[left] + _U(1)) & self.mask
        return out

    def is_unit(self, entry: np.ndarray, at: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Whether each entry holds the bytes of the slice beside it."""
        same = self.n_bytes.data[entry] == lens
        for i in range(0, int(lens.max(initial=0)), 8):
            live = np.flatnonzero(same & (lens > i))
            kept = self.lanes.data[self.lane_at.data[entry[live]] + i // 8]
            same[live] = kept == lane(at, starts[live] + i, lens[live] - i)
        return same

    def add(self, h: np.ndarray, at: np.ndarray, starts: np.ndarray, lens: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        """Distinct absent hashes with their units and ids (in a row)."""
        entry = self.n_bytes.add(lens) + np.arange(len(h))
        self.id_at.add(self.ids.add(ids) + np.cumsum(n_ids) - n_ids)
        self.n_ids.add(n_ids)
        n_lanes = (lens + 7) // 8
        nth = _runs(np.zeros(len(h), np.int64), n_lanes)
        of = np.repeat(np.arange(len(h)), n_lanes)
        self.lane_at.add(self.lanes.add(lane(at, starts[of] + 8 * nth, lens[of] - 8 * nth)) + np.cumsum(n_lanes) - n_lanes)
        slot = h & self.mask
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.entry[slot[won]] = entry[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + _U(1)) & self.mask


class UnitEncoder:
    def __init__(self, path: str, slots: int = SLOTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.slots = slots
        self.young, self.old = UnitTable(slots), UnitTable(2)

    def column(self, col):
        """(first row, ids of the rows in a row, ids per row) for each block
        of rows of a string column; null counts as empty."""
        raw, off = column_bytes(col)
        for i, j in blocks(off):
            yield i, *self.block(raw[off[i]:off[j]], off[i:j + 1] - off[i])

    def block(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, np.int64)
        # an empty text at the end has no unit; its edge is the block's end
        starts = cuts(raw, edges)
        lens = np.append(starts[1:], len(raw)) - starts
        kind, first = self._kinds(raw, starts, lens)
        buffer, at, n = self._ids(raw, starts[first], lens[first])
        n_unit = n[kind]
        ids = buffer[_runs(at[kind], n_unit)]
        total = np.concatenate(([0], np.cumsum(n_unit)))
        return ids, np.diff(total[np.searchsorted(starts, edges)])

    @staticmethod
    def _kinds(raw, starts, lens) -> tuple[np.ndarray, np.ndarray]:
        """Number of each unit's kind (equal bytes, equal kind, but for a few
        that have more than one), and one unit of each kind."""
        _, first, kind = np.unique(slice_hashes(raw, starts, starts + lens), return_index=True, return_inverse=True)
        at, like = lanes(raw), first[kind]
        same = lens == lens[like]
        for i in range(0, min(int(lens.max()), KEEP_BYTES), 8):
            live = np.flatnonzero(same & (lens > i))
            same[live] = lane(at, starts[live] + i, lens[live] - i) == lane(at, starts[like[live]] + i, lens[live] - i)
        for u in np.flatnonzero(same & (lens > KEEP_BYTES) & (like != np.arange(len(lens)))).tolist():
            a, b, n = starts[u], starts[like[u]], lens[u]
            same[u] = raw[a:a + n].tobytes() == raw[b:b + n].tobytes()
        odd = np.flatnonzero(~same)  # each a kind of its own
        kind[odd] = len(first) + np.arange(len(odd))
        return kind, np.concatenate((first, odd))

    def _ids(self, raw, starts, lens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buffer, where the ids of each kind begin, how many)."""
        at = lanes(raw)
        h = slice_hashes(raw, starts, starts + lens)
        h[h == 0] = 1
        where, n = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        found, buffers, base = np.flatnonzero(lens <= KEEP_BYTES), [], 0
        for table in (self.young, self.old):
            entry = table.find(h[found])
            hit = np.flatnonzero(entry >= 0)
            hit = hit[table.is_unit(entry[hit], at, starts[found[hit]], lens[found[hit]])]
            again = found[hit]
            n[again] = n_ids = table.n_ids.data[entry[hit]].astype(np.int64)
            where[again] = base + np.cumsum(n_ids) - n_ids
            buffers.append(table.ids.data[_runs(table.id_at.data[entry[hit]], n_ids)])
            base += len(buffers[-1])
            found = np.flatnonzero((n < 0) & (lens <= KEEP_BYTES))
        miss = np.flatnonzero(n < 0)
        if len(miss):
            for i in range(0, len(miss), AT_A_TIME):
                some = miss[i:i + AT_A_TIME]
                texts = [raw[a:a + k].tobytes().decode() for a, k in zip(starts[some].tolist(), lens[some].tolist())]
                got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                n[some] = np.fromiter(map(len, got), np.int64, len(got))
                buffers.append(np.fromiter((i for ids in got for i in ids), np.uint32, int(n[some].sum())))
            where[miss] = base + np.cumsum(n[miss]) - n[miss]
        buffer = np.concatenate(buffers)
        keep = np.concatenate((again, miss[lens[miss] <= KEEP_BYTES]))
        _, one = np.unique(h[keep], return_index=True)
        keep = keep[one]
        keep = keep[self.young.find(h[keep]) < 0]  # the hash may belong to another unit
        if len(keep) > self.young.room():
            self.young.shrink()
            self.young, self.old = UnitTable(self.slots), self.young
        if 0 < len(keep) <= self.young.room():
            self.young.add(h[keep], at, starts[keep], lens[keep], buffer[_runs(where[keep], n[keep])], n[keep])
        return buffer, where, n


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each vocabulary and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
        give_back()  # what reading the vocabulary took
    return _ENCODERS[path]


def forget_encoders() -> None:
    """A worker lives on after its task; other work needs no encoder."""
    _ENCODERS.clear()
