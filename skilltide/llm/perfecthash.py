"""A minimal perfect hash of 64-bit keys, as one block of numbers that can be memory-mapped.

Keys are hashed to a row of bits, two a key. Those alone at their bit own it; the others go on to the
next, smaller row. A key's number is the count of set bits before its own, so n keys have the numbers
0 to n - 1. The keys are stored in that order, which tells a key of the set from any other.
"""

import numpy as np

SPREAD = 2  # bits a key in each row
ROWS = 40  # keys that are not alone in any of them are looked up in a sorted list


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-spread bits of each key (the finaliser of MurmurHash3 over key and seed)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def build(keys: np.ndarray) -> bytes:
    """The block for distinct non-negative keys, in any order."""
    rest, rows = keys.astype(np.int64), []
    while len(rest) and len(rows) < ROWS:
        size = -(-SPREAD * len(rest) // 64) * 64
        at = (mixed(rest, len(rows) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        rows.append(np.packbits(alone, bitorder="little").view(np.uint64))
        rest = rest[~alone[at]]
    words = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1]
    head = np.array([len(keys), len(rows), len(words), len(rest), *map(len, rows)], np.int64)
    parts = [head, words.view(np.int64), before, np.sort(rest)]
    table = PerfectHash(np.concatenate([*parts, np.zeros(len(keys), np.int64)]))
    table.keys[table._number(keys)] = keys
    return table.block.tobytes()


class PerfectHash:
    """Numbers of keys, from a block of 64-bit integers."""

    def __init__(self, block: np.ndarray):
        self.block = block
        self.n, rows, words, rest = (int(x) for x in block[:4])
        at = 4 + rows
        self.sizes = [int(x) for x in block[4:at]]
        self.words = block[at:at + words].view(np.uint64)
        self.before = block[at + words:at + 2 * words]
        self.rest = block[at + 2 * words:at + 2 * words + rest]
        self.keys = block[at + 2 * words + rest:]

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        todo, start = np.arange(len(keys)), 0
        for seed, size in enumerate(self.sizes, 1):
            at = mixed(keys[todo], seed) % np.uint64(size * 64)
            word, low = start + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            bits = self.words[word]
            own = (bits >> low & np.uint64(1)).astype(bool)
            inside = np.bitwise_count(bits & ((np.uint64(1) << low) - np.uint64(1)))
            out[todo[own]] = (self.before[word] + inside)[own]
            todo, start = todo[~own], start + size
            if not len(todo):
                return out
        out[todo] = self.n - len(self.rest) + np.searchsorted(self.rest, keys[todo])
        return out

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that are not of the set."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        found = np.minimum(self._number(keys), self.n - 1)
        return np.where(self.keys[found] == keys, found, -1)
