"""Byte-level BPE by looked-up pieces.

Such a tokenizer splits a text by a fixed expression (contractions; letters, numbers or other characters with one blank
before; white space) and encodes each piece by itself. Here the split is made by NumPy over UTF-8 bytes, pieces are
looked up by a hash of 64 bits, and the ids of known pieces are copied from a table, which also holds each piece's bytes:
a piece counts as known if its bytes are the same. Other pieces go to the tokenizers library.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from ._words import byte_numbers, same_bytes, sums, with_length

_L, _N, _S, _O = 1, 2, 4, 8
_KIND = np.full(256, _O, np.uint8)
_KIND[0x30:0x3A] = _N
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = _S
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = _L
#: Bytes of texts that are split here: printable ASCII, usual white space, and letters of U+00C0 to U+024F. What other
#: characters are depends on a Unicode version, so a text with any of them is encoded as a whole.
_ODD = np.ones(256, bool)
_ODD[0x20:0x7F] = _ODD[0x80:0xC0] = _ODD[0xC3:0xCA] = False
_ODD[[0x09, 0x0A, 0x0D]] = False


def odd_rows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which rows have other characters."""
    odd = _ODD[data]
    sign = np.flatnonzero(((data == 0x97) | (data == 0xB7)))  # the signs for times and divided by, among letters
    sign = sign[(sign > 0) & (data[sign - 1] == 0xC3)]
    odd[sign] = True
    at = np.flatnonzero(odd)
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, at, side="right") - 1] = True
    return out


def split(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin, of rows without odd characters."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    # A blank before letters, numbers or others goes with them: their piece begins at the blank.
    ahead = np.zeros(n, bool)
    ahead[:-1] = (data[:-1] == 0x20) & change[1:] & ~first[1:n]  # a blank that ends a run of white space within its row
    begin = change.copy()
    after = np.flatnonzero(ahead) + 1
    begin[after] = False
    begin[after - 1] = True
    # The last of other white space before such characters stands alone.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == _S) & (data[:-1] != 0x20) & change[1:] & ~first[1:n]
    begin |= last
    # Contractions: a lone apostrophe with no blank before it and certain letters after it.
    a = np.flatnonzero((data == 0x27) & change)
    if len(a):
        a = a[~((a > 0) & (data[a - 1] == 0x20) & ~first[a])]
        wide = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = wide[a + 1], wide[a + 2]
        row_end = off[np.searchsorted(off, a, side="right")]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (a + 1 < row_end)
        long = (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & (a + 2 < row_end)
        for where, size in ((a[short], 2), (a[long], 3)):
            begin[where + 1] = False
            rest = where + size
            rest = rest[rest < n]
            begin[rest] = True
    return np.flatnonzero(begin)


class Pieces:
    """Ids of texts, with a table of pieces that grows to at most `most` entries of at most `longest` bytes."""

    def __init__(self, path: str, most: int = 1 << 20, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most, self.longest, self.held, self.bits = most, longest, 0, 16
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        #: Of each entry: where its ids begin, how many, where its bytes begin, how many.
        self.entries = np.zeros((1 << 15, 4), np.int32)
        self.ids, self.used, self.raw, self.filled = np.zeros(1 << 18, np.uint32), 0, np.zeros(1 << 18, np.uint8), 0

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 1000):  # bounds the library's own objects
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes, -1 for unknown ones."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (h & mask).astype(np.int64)
        out = np.full(len(h), -1)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot[left]]
            good = key == h[left]
            out[left[good]] = slot[left[good]]
            left = left[~good & (key != 0)]
            slot[left] = (slot[left] + 1) & int(mask)
        return out

    def _put(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Entries under new hashes, all different."""
        if (self.held + len(h)) * 2 > len(self.keys):
            live = self.keys != 0
            keys, entries = self.keys[live], self.entry[live]
            while (self.held + len(h)) * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.entry, self.held = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0
            self._put(keys, entries)
        mask = (1 << self.bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]  # of several for one slot the last stays
            won = free[self.keys[slot[free]] == h[free]]
            self.entry[slot[won]] = entry[won]
            done = np.zeros(len(h), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & mask
        self.held += len(h)

    def _known(self, h: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries of pieces, -1 for those that are not in the table with these very bytes."""
        slot = self._find(h)
        out = np.where(slot >= 0, self.entry[slot], -1)
        at = np.flatnonzero(out >= 0)
        at = at[self.entries[out[at], 3] == size[at]]
        at = at[same_bytes(data, begin[at], self.raw, self.entries[out[at], 2], size[at])]
        known = np.full(len(h), -1)
        known[at] = out[at]
        return known

    def _learn(self, h: np.ndarray, ids: np.ndarray, count: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Puts pieces with hashes that the table has not, as far as there is room."""
        fit = np.flatnonzero((self._find(h) < 0) & (size <= self.longest))[: max(0, self.most - self.held)]
        if not len(fit):
            return
        start = np.cumsum(count) - count
        count, size = count[fit], size[fit]
        mine = np.repeat(start[fit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        text = np.repeat(begin[fit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        entry = np.stack([self.used + np.cumsum(count) - count, count, self.filled + np.cumsum(size) - size, size], axis=1)

        def room(x: np.ndarray, have: int, more: int) -> np.ndarray:
            return x if have + more <= len(x) else np.concatenate([x, np.zeros((max(more, len(x) // 4), *x.shape[1:]), x.dtype)])

        self.ids, self.raw, self.entries = room(self.ids, self.used, len(mine)), room(self.raw, self.filled, len(text)), room(self.entries, self.held, len(fit))
        self.ids[self.used : self.used + len(mine)], self.raw[self.filled : self.filled + len(text)] = ids[mine], data[text]
        self.entries[self.held : self.held + len(fit)] = entry
        self.used, self.filled = self.used + len(mine), self.filled + len(text)
        self._put(h[fit], np.arange(self.held, self.held + len(fit), dtype=np.int32))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows (uint32) and each row's offsets in them."""
        odd = odd_rows(data, off)
        if odd.any():
            return self._with_odd(data, off, odd)
        begin = split(data, off)
        size = np.diff(np.append(begin, len(data))) if len(begin) else begin
        total = sums(byte_numbers(data, begin))
        h = self.hash(total, begin, size)
        entry = self._known(h, data, begin, size)
        known, miss = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0)
        start, count = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        start[known], count[known] = self.entries[entry[known], 0], self.entries[entry[known], 1]
        used, fresh = self.used, np.zeros(0, np.uint32)
        if len(miss):
            # One of each hash, and those of other bytes than that one.
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            first = miss[one]
            like = first[back]
            alone = size[like] != size[miss]
            alone[~alone] = ~same_bytes(data, begin[miss[~alone]], data, begin[like[~alone]], size[miss[~alone]])
            raw = self.whole([data[begin[i] : begin[i] + size[i]].tobytes().decode() for i in [*first.tolist(), *miss[alone].tolist()]])
            counts = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
            fresh, places = np.frombuffer(b"".join(raw), np.uint32), np.cumsum(counts) - counts
            back[alone] = len(first) + np.arange(int(alone.sum()))
            start[miss], count[miss] = used + places[back], counts[back]
            self._learn(h[first], fresh, counts[: len(first)], data, begin[first], size[first])
        ends = np.cumsum(count)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)
        row = np.concatenate([[0], ends])[np.searchsorted(begin, off)]
        new = take >= used
        out = self.ids[np.where(new, 0, take)]
        out[new] = fresh[take[new] - used]
        return out, row

    @staticmethod
    def hash(total: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash for each piece, never 0."""
        return with_length(total[begin + size] - total[begin], size) | np.uint64(1)

    def _with_odd(self, data: np.ndarray, off: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = np.diff(off)
        keep = np.repeat(~odd, length)
        ids, row = self.encode(data[keep], np.concatenate([[0], np.cumsum(np.where(odd, 0, length))]))
        whole = iter(self.whole([data[off[i] : off[i + 1]].tobytes().decode() for i in np.flatnonzero(odd)]))
        parts = [np.frombuffer(next(whole), np.uint32) if o else ids[a:b] for o, a, b in zip(odd.tolist(), row[:-1].tolist(), row[1:].tolist(), strict=True)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
