"""A cuckoo filter over 64-bit keys, with vectorised lookups; insertions and deletions keep its answers free of false negatives."""

from __future__ import annotations

import struct

import numpy as np

from emergent.llm.blocks import mix

SLOTS_PER_BUCKET, MAX_KICKS = 4, 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key's two buckets differ by a hash of its fingerprint."""

    def __init__(self, buckets: int) -> None:
        self.buckets = 1 << max(2, (buckets - 1).bit_length())
        self.table = np.zeros((self.buckets, SLOTS_PER_BUCKET), np.uint16)
        self.spill: set[int] = set()  # keys that found no slot; kept exactly

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        """An empty filter that takes n keys and a few more."""
        return cls(int(n / (SLOTS_PER_BUCKET * 0.8)) + 1)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        one = cls.for_keys(len(keys))
        one.insert(keys)
        return one

    def full(self) -> bool:
        """Whether so many keys found no slot that a larger filter is due."""
        return len(self.spill) > self.table.size // 64

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64))
        prints = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, first ^ self._jump(prints)

    def _jump(self, prints: np.ndarray) -> np.ndarray:
        return (mix(prints.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        prints, first, second = self._places(keys)
        rows = self.table.tolist()
        jump: dict[int, int] = {}
        state = 12345
        for key, p, a, b in zip(keys.tolist(), prints.tolist(), first.tolist(), second.tolist(), strict=True):
            for place in (a, b):
                if 0 in (row := rows[place]):
                    row[row.index(0)] = p
                    break
            else:
                path, place, carried = [], a, p
                for _ in range(MAX_KICKS):
                    state = (state * 1103515245 + 12345) & 0x7FFFFFFF
                    slot = (state >> 16) % SLOTS_PER_BUCKET
                    path.append((place, slot, rows[place][slot]))
                    rows[place][slot], carried = carried, rows[place][slot]
                    if carried not in jump:
                        jump[carried] = int(self._jump(np.array([carried], np.uint16))[0])
                    place ^= jump[carried]
                    if 0 in (row := rows[place]):
                        row[row.index(0)] = carried
                        break
                else:
                    for at, slot, old in reversed(path):
                        rows[at][slot] = old
                    self.spill.add(key)
        self.table = np.array(rows, np.uint16)

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted, each as often as it was."""
        for key, p, a, b in zip(keys.tolist(), *(x.tolist() for x in self._places(keys)), strict=True):
            if key in self.spill:
                self.spill.discard(key)
                continue
            for place in (a, b):
                slots = np.flatnonzero(self.table[place] == p)
                if len(slots):
                    self.table[place, slots[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that is in, and for about one in eight thousand of the others."""
        prints, first, second = self._places(keys)
        found = (self.table[first] == prints[:, None]).any(axis=1) | (self.table[second] == prints[:, None]).any(axis=1)
        return found | np.isin(keys, np.fromiter(self.spill, np.uint64, len(self.spill))) if self.spill else found

    def to_bytes(self) -> bytes:
        extra = np.fromiter(self.spill, np.uint64, len(self.spill))
        return struct.pack("<qq", self.buckets, len(extra)) + extra.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        buckets, extra = struct.unpack_from("<qq", raw)
        one = cls(buckets)
        one.spill = set(np.frombuffer(raw, np.uint64, extra, 16).tolist())
        one.table = np.frombuffer(raw, np.uint16, buckets * SLOTS_PER_BUCKET, 16 + 8 * extra).reshape(buckets, SLOTS_PER_BUCKET).copy()
        return one
