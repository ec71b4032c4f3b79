"""Token ids of whole texts with a public tokenizer file.

Text repeats its words, so a worker remembers the ids of the parts that the tokenizer's first step
makes and that it never joins. In plain text (printable ASCII, line breaks and the letters from
U+00C0 to U+00FF) those parts are found for a whole batch at once, on its UTF-8 bytes; only parts
that the worker has not met reach the tokenizer. Parts are known by 64-bit hashes. Text with other
characters, with contractions or with what may name an added token is encoded as it is.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from postgrain.llm.shared import utf8
from postgrain.llm.wordhash import BYTE_KEYS, LOWER, mixed, powers

SLOTS = 1 << 21  # of a worker's memory, at most half of them filled
U = np.uint64
# 0 white space, 1 letter, 2 digit, 3 other; _ODD: bytes that plain text does not have
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x0A, 0x20]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
_KIND[48:58] = 2
_ODD = np.ones(256, bool)
_ODD[[0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3]] = False
#: Fixed: first letters of the contractions that the first step of both tokenizers knows.
_CONTRACTED = np.zeros(256, bool)
_CONTRACTED[list(b"stmdrvlSTMDRVL")] = True
_encoders: dict[tuple, Encoder] = {}


class Memory:
    """Hash of a part -> its ids. Open addressing over arrays, looked up for many parts at once."""

    def __init__(self, slots: int = 0):
        self.slots = max(slots, SLOTS)
        self.keys = np.zeros(self.slots, U)
        self.entry = np.zeros(self.slots, np.int32)
        self.count = self.used = 0
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int32)
        left, slot = np.arange(len(hashes)), (hashes % U(self.slots)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == hashes[left]
            out[left[hit]] = self.entry[slot[hit]]
            going = ~hit & (there != 0)
            left, slot = left[going], (slot[going] + 1) % self.slots
        return out

    def add(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        """New, distinct hashes with their ids."""
        if self.count + len(hashes) > self.slots // 2:  # start anew, larger only for a huge text
            self.__init__(1 << (4 * len(hashes)).bit_length())
        sizes = np.array([len(x) for x in ids], np.int64)
        first, last = self.count, self.count + len(hashes)
        self.start, self.size = _room(self.start, last), _room(self.size, last)
        self.pool = _room(self.pool, self.used + int(sizes.sum()))
        self.start[first:last] = self.used + np.cumsum(sizes) - sizes
        self.size[first:last] = sizes
        self.pool[self.used:self.used + int(sizes.sum())] = np.concatenate(ids) if ids else 0
        self.count, self.used = last, self.used + int(sizes.sum())
        left, slot = np.arange(len(hashes)), (hashes % U(self.slots)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            taken, who = np.unique(slot[free], return_index=True)
            won = free[who]
            self.keys[taken] = hashes[left[won]]
            self.entry[taken] = first + left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) % self.slots

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries in a row, and how many each has."""
        sizes = self.size[entries]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[entries] - (ends - sizes), sizes)
        return self.pool[at], sizes


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, len(array)), array.dtype)])


class Encoder:
    """``drops_space``: the tokenizer lowers text, drops white space and splits numbers into digits;
    else it is byte-level and joins a blank to what follows it."""

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.drops_space = drops_space
        self.memory = Memory()

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column as uint32, without special tokens; null: none."""
        data, offsets = utf8(column)
        odd = np.diff(np.searchsorted(np.flatnonzero(self._odd(data)), offsets)) > 0
        if not odd.any():
            return self._plain(data, offsets)
        keep = pa.array(~odd)
        plain = iter(self._plain(*utf8(column.filter(keep))))
        other = iter(self.tokenizer.encode_batch_fast(column.filter(pa.array(odd)).to_pylist(), add_special_tokens=False))
        return [np.array(next(other).ids, np.uint32) if x else next(plain) for x in odd]

    def _odd(self, data: np.ndarray) -> np.ndarray:
        odd, after = _ODD[data], np.append(data[1:], np.uint8(0)) if len(data) else data
        odd |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7))  # signs among the letters
        odd |= (data == ord("<")) & (after == ord("|"))
        odd |= (data == ord("'")) & _CONTRACTED[after]
        return odd

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if not len(data):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        starts, sizes = self._parts(data, offsets)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = data[at + np.repeat(starts, sizes)]
        values = BYTE_KEYS[LOWER[letters] if self.drops_space else letters] * powers(int(sizes.max()) + 1)[at]
        sums = np.add.reduceat(values, np.cumsum(sizes) - sizes) + sizes.astype(U) * U(0xA24BAED4963EE407)
        hashes = np.maximum(mixed(sums), U(1))
        entries = self.memory.find(hashes)
        if (entries < 0).any():
            new = np.flatnonzero(entries < 0)
            keys, first = np.unique(hashes[new], return_index=True)
            raw = data.tobytes()
            parts = [raw[a:a + n].decode() for a, n in zip(starts[new[first]].tolist(), sizes[new[first]].tolist(), strict=True)]
            found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
            had = self.memory.count
            self.memory.add(keys, [np.array(x.ids, np.uint32) for x in found])
            if self.memory.count < had + len(keys):  # it was full and started anew
                return self._plain(data, offsets)
            entries = self.memory.find(hashes)
        ids, counts = self.memory.ids(entries)
        ends = np.append(0, np.cumsum(counts))[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of all texts start, and their sizes in bytes."""
        kind = _KIND[data]
        space = kind == 0
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True  # the first byte of a text
        tail, head = head[1:], head[:-1]  # and the last
        changes = head.copy()
        changes[1:] |= kind[1:] != kind[:-1]
        if self.drops_space:
            start = ~space & (changes | (kind == 2))
            start |= space & changes  # gaps, left out below
        else:
            last = space & ~tail
            last[:-1] &= ~space[1:]
            joined = np.zeros(len(data), bool)  # what a blank before it belongs to
            joined[1:] = last[:-1] & (data[:-1] == 0x20)
            start = (changes & ~joined) | last
        starts = np.flatnonzero(start)
        sizes = np.diff(np.append(starts, len(data)))
        if self.drops_space:
            words = ~space[starts]
            starts, sizes = starts[words], sizes[words]
        return starts, sizes


def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder per worker and file; it stays in memory for the worker's next task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = path, drops_space
    if key not in _encoders:
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]
