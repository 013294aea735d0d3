"""Arrow text columns as flat byte / code-point arrays, rolling hashes and a vectorised hash table.

All helpers work on one bounded slice of an Arrow batch at a time (``slices``), so a task's
memory follows the slice size (or one single longer text), never the partition.
"""
from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = (0x9E3779B97F4A7C15 | 5) & 0xFFFFFFFFFFFFFFFF  # odd, so it has an inverse modulo 2**64
BASE_INV = pow(BASE, -1, 1 << 64)


def slices(batches, column: str, target: int = SLICE_BYTES):
    """Cut Arrow batches into runs of rows whose ``column`` holds about ``target`` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        _, offs, _ = flat_bytes(arr)
        at = 0
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + target, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


def flat_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets from 0, is valid) of a string array; a null is an empty text."""
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    valid = np.ones(n, bool) if arr.null_count == 0 else np.asarray(arr.is_valid())
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], kind)[arr.offset: arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    data = data[offs[0]: offs[-1]]
    return data, offs - offs[0], valid


def space_table() -> np.ndarray:
    """True for the bytes that end a word: space and \\t \\n \\v \\f \\r."""
    t = np.zeros(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of all rows, and each row's first word number."""
    inside = ~space_table()[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    cuts = offs[:-1][offs[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[:-1] = inside[1:]
        after[-1] = False
        after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand and shared by the slices of a task."""

    def __init__(self):
        self.n, self.up, self.down = -1, None, None

    def get(self, n: int):
        if n > self.n:
            self.n = max(n, SLICE_BYTES + (1 << 16) if self.n < 0 else 2 * self.n)
            self.up, self.down = powers(self.n, BASE), powers(self.n, BASE_INV)
        return self.up, self.down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that sums of powers see well spread values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray, pw: Powers) -> np.ndarray:
    """Running sums of ``values[i] * BASE**i`` (one longer than ``values``, starting at 0)."""
    up, _ = pw.get(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, pw: Powers) -> np.ndarray:
    """Position-independent hash of the spans ``[start, end)`` over the values behind ``pre``."""
    _, down = pw.get(len(pre))
    return (pre[end] - pre[start]) * down[start]


def byte_values(seed: int = 1) -> np.ndarray:
    """A spread 64-bit value for each byte."""
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000003))


def word_hashes(data, starts, ends, pw: Powers, seed: int = 1) -> np.ndarray:
    return mix(span_hash(prefix(byte_values(seed)[data], pw), starts, ends, pw) + np.uint64(seed))


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions ``first[i] .. first[i] + length[i] - 1`` for all i, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    return np.repeat(first - begin, length) + np.arange(total, dtype=np.int64)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by one separator place; offsets of the texts in them."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "\x00".join([*texts, ""]).encode("utf-32-le")
    return np.frombuffer(joined, np.uint32), np.concatenate(([0], np.cumsum(lens + 1)))


#: White space of the Unicode property White_Space (a fixed list).
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE] = SPACE
    return out


def lower_table() -> np.ndarray:
    """Lower case of every code point whose lower case is one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        low = chr(cp).lower()
        if len(low) == 1:
            out[cp] = ord(low)
    return out


class HashTable:
    """Open addressing over 64-bit keys with whole-array lookups and inserts; grows by doubling."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.vals = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)

    def _slot(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Stored value of each key, -1 where there is none."""
        slot = self._slot(keys)
        got = self.vals[slot]
        same = self.keys[slot] == keys
        out = np.where(same, got, -1)
        todo = np.flatnonzero(~same & (got >= 0))
        mask = (1 << self.bits) - 1
        while len(todo):
            slot_t = (slot[todo] + 1) & mask
            slot[todo] = slot_t
            got = self.vals[slot_t]
            same = self.keys[slot_t] == keys[todo]
            out[todo[same]] = got[same]
            todo = todo[~same & (got >= 0)]
        return out

    def insert(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Add distinct keys that are not stored yet."""
        if 2 * (self.size + len(keys)) > (1 << self.bits):
            used = self.vals >= 0
            old_k, old_v = self.keys[used], self.vals[used]
            while 2 * (self.size + len(keys)) > (1 << self.bits):
                self.bits += 1
            self.keys, self.vals = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
            self._put(old_k, old_v)
        self._put(keys, vals)
        self.size += len(keys)

    def _put(self, keys, vals):
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        todo = np.arange(len(keys))
        while len(todo):
            free = self.vals[slot[todo]] < 0
            put = todo[free]
            self.keys[slot[put]], self.vals[slot[put]] = keys[put], vals[put]
            won = (self.keys[slot[todo]] == keys[todo]) & (self.vals[slot[todo]] == vals[todo])
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask
