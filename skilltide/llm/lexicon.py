"""A minimal acyclic transducer from words to lists of token ids, in one file that is memory-mapped.

States with equal futures are shared, so suffixes are stored once. Every transition carries the number
of words that sort before those it leads to; their sum along a path is the word's number, and that
number names its ids. File: a header of HEADER 32-bit numbers, then the arrays of ``_LAYOUT``.
"""

import mmap

import numpy as np

HEADER = 8


def build(words: dict[bytes, list[int]]) -> bytes:
    """Compile words in their byte order, merging each finished state with an equal one."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, labels, targets)
    path: list[list] = [[False, [], []]]  # states of the current word, not yet merged
    before = b""

    def settle(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, labels, targets = path.pop()
            key = (final, bytes(labels), tuple(targets))
            state = register.get(key)
            if state is None:
                state = register[key] = len(states)
                states.append(key)
            path[-1][2].append(state)

    ordered = sorted(words)
    for word in ordered:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        settle(shared)
        for c in word[shared:]:
            path[-1][1].append(c)
            path.append([False, [], []])
        path[-1][0] = True
        before = word
    settle(0)
    final, labels, targets = path[0]
    states.append((final, bytes(labels), tuple(targets)))

    below = np.zeros(len(states), np.int64)  # words that a state accepts; targets come first
    firsts, finals, chars, goals, skips = [], [], bytearray(), [], []
    for number, (final, labels, targets) in enumerate(states):
        firsts.append(len(chars))
        finals.append(final)
        passed = int(final)
        for c, target in zip(labels, targets):
            chars.append(c)
            goals.append(target)
            skips.append(passed)
            passed += int(below[target])
        below[number] = passed
    firsts.append(len(chars))
    lengths = [len(words[w]) for w in ordered]
    ids = [i for w in ordered for i in words[w]]
    arrays = [np.array(x, np.int32) for x in (
        firsts, finals, goals, skips, np.cumsum([0, *lengths]), ids)]
    header = np.zeros(HEADER, np.int32)
    header[:7] = [len(states), len(chars), *[len(a) for a in arrays[:1]], len(arrays[4]), len(ids),
                  len(ordered), 0]
    return b"".join([header.tobytes(), *[a.tobytes() for a in arrays], bytes(chars)])


class Lexicon:
    """Look-ups in a mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        numbers = memoryview(self._map)
        header = numbers[:4 * HEADER].cast("i")
        self.states, transitions, n_firsts, n_offsets, n_ids, self.words = list(header[:6])
        at = 4 * HEADER
        parts = []
        for n in (n_firsts, self.states, transitions, transitions, n_offsets, n_ids):
            parts.append(numbers[at:at + 4 * n].cast("i"))
            at += 4 * n
        self._firsts, self._finals, self._goals, self._skips, self._offsets, self._ids = parts
        self._chars = at

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None when it is not in the lexicon."""
        state, number, base = self.states - 1, 0, self._chars
        firsts, goals, skips, find = self._firsts, self._goals, self._skips, self._map.find
        for i in range(len(word)):
            at = find(word[i:i + 1], base + firsts[state], base + firsts[state + 1])
            if at < 0:
                return None
            at -= base
            number += skips[at]
            state = goals[at]
        if not self._finals[state]:
            return None
        return list(self._ids[self._offsets[number]:self._offsets[number + 1]])
