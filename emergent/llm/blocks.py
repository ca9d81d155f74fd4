"""Whole texts as byte blocks: Arrow string buffers seen as numpy arrays, without making Python strings.

A block is a run of rows of one Arrow batch whose texts hold about ``limit`` bytes together (a longer text is a block of its own), so
memory is bounded by the block and the longest text, whatever the batch size is. Small blocks stay in a core's cache, and what a batch took
goes back to the system after it, because workers live on and an executor's memory is the sum of them.
"""

from __future__ import annotations

import ctypes
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK_BYTES, BLOCK_ROWS = 1 << 18, 256
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes that hashes reads in numpy; longer spans go to BLAKE2b. Bytes of a block that are hashed at once.
SHORT, CHUNK = 32, 1 << 20
#: The key of hashes that models keep; where equal hashes decide a result, a key drawn at random makes collisions unforeseeable.
FIXED = 20240607
_END = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


@lru_cache(maxsize=8)
def _keyed(key: int) -> tuple[np.ndarray, bytes]:
    """An odd multiplier and an addend for each lane of eight bytes, and the key of BLAKE2b."""
    drawn = np.random.default_rng(key).integers(0, 1 << 63, (SHORT // 8, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return drawn, blake2b(key.to_bytes(16, "little"), digest_size=32).digest()


def random_key() -> int:
    """A key that nobody knows beforehand."""
    return secrets.randbits(62)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each tuple of hashes, by order."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = mix(out * np.uint64(3) + part + np.uint64(0x632BE59BD9B4E019))
    return out


@dataclass
class Block:
    """Bytes of the texts of rows first..first+n of a batch; starts and ends are offsets into data."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts)

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def text(self, i: int) -> str:
        return self.raw(i).decode("utf-8", "replace")

    @cached_property
    def white(self) -> np.ndarray:
        return WHITE[self.data]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The row in this block that each byte position belongs to."""
        return np.searchsorted(self.starts, positions, "right") - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of True within a text: start and end offsets."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = self.ends > self.starts
        begin[self.starts[full]] = inside[self.starts[full]]
        end[self.ends[full] - 1] = inside[self.ends[full] - 1]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Words: runs of anything but space and 09-0D."""
        return self.runs(~self.white)

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """Words of row i are word_bounds[i] to word_bounds[i + 1]."""
        return np.append(np.searchsorted(self.words[0], self.starts), len(self.words[0]))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False, key: int = FIXED) -> np.ndarray:
        """A keyed 64-bit hash of each span of bytes (by ascending starts), equal for equal bytes wherever they stand."""
        out = np.zeros(len(starts), np.uint64)
        low = 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + CHUNK)))
            out[low:high] = self._hashed(starts[low:high], ends[low:high], lower, key)
            low = high
        return out

    def _hashed(self, starts: np.ndarray, ends: np.ndarray, lower: bool, key: int) -> np.ndarray:
        lanes, secret = _keyed(key)
        base, sizes = int(starts[0]), ends - starts
        part = self.data[base : int(starts[-1]) + SHORT]
        # Row r holds the eight bytes from each position 8 * q + r on.
        rows = len(part) // 8 + 1
        text = np.zeros(8 * rows + 8 + SHORT, np.uint8)
        text[: len(part)] = LOWER[part] if lower else part
        at_eight = np.concatenate([text[r : r + 8 * (rows + SHORT // 8)].view("<u8") for r in range(8)])
        step = rows + SHORT // 8
        place = starts - base
        cell = (place & 7) * step + (place >> 3)
        h = mix((at_eight[cell] & _END[np.minimum(sizes, 8)]) * lanes[0, 0] + lanes[0, 1] + sizes.astype(np.uint64))
        for k in range(1, SHORT // 8):
            more = np.flatnonzero(sizes > 8 * k)
            if not len(more):
                return h
            lane = at_eight[cell[more] + k] & _END[np.minimum(sizes[more] - 8 * k, 8)]
            h[more] = mix((h[more] ^ lane) * lanes[k, 0] + lanes[k, 1])
        for i in np.flatnonzero(sizes > SHORT).tolist():
            raw = self.data[starts[i] : ends[i]]
            h[i] = int.from_bytes(blake2b((LOWER[raw] if lower else raw).tobytes(), digest_size=8, key=secret).digest(), "little")
        return h

    def word_hashes(self, lower: bool = False, key: int = FIXED) -> np.ndarray:
        return self.hashes(*self.words, lower=lower, key=key)

    def starts_of_chars(self) -> np.ndarray:
        """True at the first byte of each code point."""
        return (self.data & 0xC0) != 0x80


def hash_of(text: bytes, lower: bool = False, key: int = FIXED) -> int:
    """The hash that Block.hashes gives these bytes."""
    data = np.frombuffer(text, np.uint8)
    one = Block(0, data, np.array([0]), np.array([len(data)]))
    return int(one.hashes(one.starts, one.ends, lower, key)[0])


def blocks_of(column: pa.Array, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[Block]:
    """Blocks over a string column; a null text is an empty one."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, first + rows, max(first + 1, last))
        low, high = int(offsets[first]), int(offsets[last])
        yield Block(first, data[low:high], offsets[first:last] - low, offsets[first + 1 : last + 1] - low)
        first = last
    release_memory()


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns free memory to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


def release_memory() -> None:
    """Give back what Arrow and the C library hold free; else a worker keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def counts_between(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often mask is True in each span."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[ends] - sums[starts]
