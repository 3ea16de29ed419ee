"""Vectorised text kernels: words, shingles, lines and hashes of whole Arrow string columns.

Everything here works on the UTF-8 bytes of many texts at once with numpy, so a Python worker
spends its time in compiled loops and holds a few megabytes whatever the size of a partition.
A word is a run of characters outside space and U+0009..U+000D; those are all single bytes in
UTF-8, so byte masks find words exactly.  Hashes are 64-bit, deterministic across processes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
#: Bytes of text that a kernel takes at once (one longer text is taken alone).
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: spreads every input bit over the whole word."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n deterministic 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * BASE + U64(seed))


PLACE = stream(11, 16) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Ranges of more bytes than this are hashed one by one, with a cryptographic hash.
LONG = 512
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian numbers; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))


def same_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether pairs of equally long ranges of two `blocks_of` hold the same bytes."""
    out = np.ones(len(size), dtype=bool)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        left = size[live] - k
        differ = (a[at_a[live] + k] ^ b[at_b[live] + k]) & MASKS[np.minimum(left, 8)] != 0
        out[live[differ]] = False
        live, k = live[(left > 8) & ~differ], k + 8
    return out


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each."""
    ends = _offsets(column)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)


class Texts:
    """The bytes of some texts, end to end. Null texts count as empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        off = _offsets(column)
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.data = LOWER[raw] if lower else raw
        self.off = off - off[0]
        self.n = len(off) - 1
        self._blocks: np.ndarray | None = None

    @property
    def blocks(self) -> np.ndarray:
        if self._blocks is None:
            self._blocks = blocks_of(self.data)
        return self._blocks

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges: eight bytes at a time are mixed in, so no sum of places can be made to vanish."""
        size = end - start
        h = size.astype(U64) * PLACE[15] if len(size) else np.zeros(0, U64)
        live, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
        with np.errstate(over="ignore"):
            while len(live):
                left = size[live] - k
                block = self.blocks[start[live] + k] & MASKS[np.minimum(left, 8)]
                h[live] = mix((h[live] ^ block) + PLACE[14])
                live, k = live[left > 8], k + 8
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return h

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start and end of each word, and how many words come before each text (n + 1 numbers)."""
        if not len(self.data):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.n + 1, np.int64)
        word = ~SPACE[self.data]
        cut = np.zeros(len(word) + 1, dtype=bool)
        cut[self.off] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | cut[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(start, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start and end of each line (split at \\n), and how many lines come before each text."""
        breaks = np.flatnonzero(self.data == 10)
        before = np.searchsorted(breaks, self.off)
        start = np.sort(np.concatenate([self.off[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([breaks, self.off[1:]]), kind="stable")
        return start, end, before + np.arange(self.n + 1)


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `size`-word windows inside a text, and how many come before each text."""
    count = np.diff(first)
    have = np.maximum(count - size + 1, 0)
    before = np.concatenate([[0], np.cumsum(have)])
    total = int(before[-1])
    if not total:
        return np.zeros(0, U64), before
    at = np.arange(total) + np.repeat(first[:-1] - before[:-1], have)
    with np.errstate(over="ignore"):
        h = np.zeros(total, U64)
        for k in range(size):
            h += words[at + k] * PLACE[k % 15] if k < 15 else mix(words[at + k] + U64(k))
    return mix(h), before


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Like `windows`, but a text of 1 to size-1 words has its whole sequence as one shingle."""
    h, before = windows(words, first, size)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if not len(short):
        return h, before
    whole = np.zeros(len(short), U64)
    with np.errstate(over="ignore"):
        for k in range(size - 1):
            has = count[short] > k
            whole[has] += words[first[short][has] + k] * PLACE[k]
        whole = mix(whole + count[short].astype(U64) * PLACE[14])
    have = np.diff(before)
    have[short] = 1
    out = np.concatenate([[0], np.cumsum(have)])
    h2 = np.empty(int(out[-1]), U64)
    mask = np.zeros(len(h2), dtype=bool)
    mask[out[short]] = True
    h2[mask] = whole
    h2[~mask] = h
    return h2, out
