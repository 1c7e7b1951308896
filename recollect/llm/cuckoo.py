"""A cuckoo filter over 16-byte keys: 16-bit fingerprints, four to a bucket."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS, LOAD = 4, 500, 0.8
#: Spreads a fingerprint over the buckets.
MIX = 0x5BD1E995


class Full(Exception):
    """No slot was found; the filter has to be built anew and larger."""


class CuckooFilter:
    """Answers whether a key may be present; keys that were inserted always are.

    Each key is inserted once at most and only keys that are present are deleted;
    the exact table behind the filter sees to both.
    """

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells, np.uint64(len(cells) - 1)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        n = len(keys)
        while True:
            made = cls.sized(n)
            try:
                made.insert(*keys)
                return made
            except Full:
                n = 2 * n + 8

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = keys.view(np.uint64).reshape(-1, 2)
        prints = (halves[:, 0] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = halves[:, 1] & self.mask
        return prints, first, first ^ self._shift(prints)

    def _shift(self, prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(MIX)) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """keys: n rows of 16 bytes."""
        prints, first, second = self._places(keys)
        return ((self.cells[first] == prints[:, None]) | (self.cells[second] == prints[:, None])).any(axis=1)

    def insert(self, *keys: bytes) -> None:
        """Inserts all keys, or raises Full and leaves the filter as it is."""
        prints, firsts, seconds = (x.tolist() for x in self._places(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16).copy()))
        cells, mask = self.cells.ravel().tolist(), int(self.mask)
        for mark, first, second in zip(prints, firsts, seconds, strict=True):
            if self._put(cells, mark, first) or self._put(cells, mark, second):
                continue
            at = first
            for kick in range(KICKS):
                slot = at * SLOTS + kick % SLOTS
                mark, cells[slot] = cells[slot], mark
                at ^= (mark * MIX) & mask
                if self._put(cells, mark, at):
                    break
            else:
                raise Full
        self.cells = np.array(cells, np.uint16).reshape(-1, SLOTS)

    @staticmethod
    def _put(cells: list[int], mark: int, bucket: int) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not cells[slot]:
                cells[slot] = mark
                return True
        return False

    def delete(self, key: bytes) -> None:
        prints, first, second = self._places(np.frombuffer(key, np.uint8).reshape(1, 16).copy())
        for place in (int(first[0]), int(second[0])):
            found = np.flatnonzero(self.cells[place] == prints[0])
            if len(found):
                self.cells[place, found[0]] = 0
                return
