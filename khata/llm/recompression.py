"""Recompression of a sequence of numbers into a run-length grammar, and longest common extensions on it.

Rounds alternate. Block compression names every maximal repetition of one symbol; pair compression splits the symbols in left and
right ones and names every left symbol followed by a right one. Equal stretches are cut alike except near their ends, whatever is around
them, so two positions are extended by comparing single symbols up the levels until their cuts differ or their symbols do, and
then down again: a few symbols per level, and whole blocks at a time. Many pairs of positions are extended together.

Documents stand between separators, numbers that occur once and are never merged, so no extension leaves its document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from khata.llm.shingles import mix

#: More rounds than any document needs; further levels only save time, so the number is no limit.
ROUNDS = 64


@dataclass
class Level:
    """Symbols in order; for each, its parent on the next level and whether it is the parent's first child."""

    symbol: np.ndarray
    parent: np.ndarray | None = None
    head: np.ndarray | None = None
    #: First child of each symbol on the level below.
    child: np.ndarray | None = None
    #: Where the blocks of this level begin, and its length; None where the next level names pairs.
    blocks: np.ndarray | None = None

    def room(self, at: np.ndarray, forward: bool) -> np.ndarray:
        """Symbols left in the block of the next symbol; one where there are no blocks."""
        if self.blocks is None:
            return np.ones(len(at), np.int64)
        return self.blocks[self.parent[at] + 1] - at if forward else at - self.blocks[self.parent[at - 1]]


def _named(fresh: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Equal numbers for equal keys of the symbols that start at ``fresh``."""
    first, second = keys
    if len(first) == 0:
        return np.zeros(0, np.int64)
    return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1].astype(np.int64)


def compress(symbol: np.ndarray, alone: int) -> list[Level]:
    """Levels from the given symbols upwards; symbols of ``alone`` or more are separators.

    Separators keep the highest numbers on every level, in their order.
    """
    levels = [Level(symbol)]
    documents = int(np.count_nonzero(symbol >= alone))
    for n in range(ROUNDS):
        # blocks
        below = levels[-1]
        fresh = np.ones(len(below.symbol), bool)
        fresh[1:] = below.symbol[1:] != below.symbol[:-1]
        if not fresh.all():
            first = np.flatnonzero(fresh)
            _lift(levels, fresh, _named(first, [below.symbol[first], np.diff(np.append(first, len(fresh)))]), block=True)
        # pairs
        below = levels[-1]
        if len(below.symbol) < 2 * documents:
            break
        edge = below.symbol.max() - documents + 1
        side = (mix(below.symbol.astype(np.uint64) + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        inner = below.symbol < edge
        both = inner[1:] & inner[:-1]
        ahead, behind = both & ~side[:-1] & side[1:], both & side[:-1] & ~side[1:]
        joined = ahead if np.count_nonzero(ahead) >= np.count_nonzero(behind) else behind
        if not joined.any():
            continue
        fresh = np.ones(len(below.symbol), bool)
        fresh[1:] = ~joined
        first = np.flatnonzero(fresh)
        second = np.where(np.diff(np.append(first, len(fresh))) == 2, below.symbol[np.minimum(first + 1, len(fresh) - 1)] + 1, 0)
        _lift(levels, fresh, _named(first, [below.symbol[first], second]))
    return levels


def _lift(levels: list[Level], fresh: np.ndarray, symbol: np.ndarray, block: bool = False) -> None:
    below = levels[-1]
    first = np.flatnonzero(fresh)
    below.parent, below.head = np.cumsum(fresh) - 1, fresh
    below.blocks = np.append(first, len(fresh)) if block else None
    levels.append(Level(symbol, child=first))


def extend(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
    """How many symbols from positions i and j on (or before them, backwards) are equal; the positions differ."""
    a, b = i.astype(np.int64), j.astype(np.int64)
    back, sign = (0, 1) if forward else (1, -1)
    stop = np.full(len(a), len(levels) - 1)

    rising = np.arange(len(a))
    for depth, level in enumerate(levels[:-1]):
        todo, ready = rising, []
        while len(todo):
            x, y = a[todo], b[todo]
            same = level.symbol[x - back] == level.symbol[y - back]
            stop[todo[~same]] = depth
            todo, x, y = todo[same], x[same], y[same]
            level_up = level.head[x] & level.head[y]
            ready.append(todo[level_up])
            todo, x, y = todo[~level_up], x[~level_up], y[~level_up]
            step = np.minimum(level.room(x, forward), level.room(y, forward))
            a[todo], b[todo] = x + sign * step, y + sign * step
        rising = np.concatenate(ready) if ready else np.zeros(0, np.int64)
        a[rising], b[rising] = level.parent[a[rising]], level.parent[b[rising]]
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        here = todo = np.flatnonzero(stop >= depth)
        while len(todo):
            x, y = a[todo], b[todo]
            same = level.symbol[x - back] == level.symbol[y - back]
            todo, x, y = todo[same], x[same], y[same]
            step = np.minimum(level.room(x, forward), level.room(y, forward))
            a[todo], b[todo] = x + sign * step, y + sign * step
        if depth:
            a[here], b[here] = level.child[a[here]], level.child[b[here]]
    return sign * (a - i)
