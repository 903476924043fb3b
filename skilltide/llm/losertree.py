"""K-way merging with a tree of losers."""

from collections.abc import Callable, Iterable, Iterator
from typing import Any


class _End:
    """Greater than every key."""

    def __lt__(self, other: object) -> bool:
        return False


END = _End()


def merge(runs: list[Iterable], key: Callable[[Any], tuple]) -> Iterator:
    """The items of sorted runs in one sorted stream; of equal keys, the earlier run goes first.

    Each inner node holds the loser of its match and the winner moves up, so replacing the winner
    costs one comparison per level.
    """
    sources = [iter(r) for r in runs]
    k = len(sources)
    heads: list = [None] * k
    keys: list = [END] * k

    def advance(i: int) -> None:
        try:
            heads[i] = next(sources[i])
            keys[i] = (key(heads[i]), i)
        except StopIteration:
            keys[i] = END

    def before(a: int, b: int) -> bool:
        if keys[b] is END:
            return keys[a] is not END or a < b
        return keys[a] is not END and keys[a] < keys[b]

    for i in range(k):
        advance(i)
    losers = [-1] * max(k, 1)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        left, right = build(2 * node), build(2 * node + 1)
        winner, losers[node] = (left, right) if before(left, right) else (right, left)
        return winner

    winner = build(1) if k > 1 else 0
    while k and keys[winner] is not END:
        yield heads[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            if before(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def natural_runs(items: Iterable, key: Callable[[Any], tuple]) -> list[list]:
    """Cut a stream into its ascending runs."""
    runs: list[list] = []
    last = None
    for item in items:
        now = key(item)
        if not runs or now < last:
            runs.append([])
        runs[-1].append(item)
        last = now
    return runs
