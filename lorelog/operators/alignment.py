"""Which lines of a newer text are lines of an older one.

The rules decide which lines match, so they are fixed.  Equal lines at both ends of a stretch match.  What is left between
them, if it has at most ``EXACT_CELLS`` pairs of lines, takes a longest common subsequence; where two would do, the one
that passes over older lines first.  A larger stretch is parted at lines that are unique on both sides, as the run of
them in order that patience sorting finds, and its parts follow the same rules; without such lines nothing in it matches.
Pairs that are compared count against a budget of the whole text; the stretch that would exceed it, and all after it,
match at their ends only.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: Fixed values.
EXACT_CELLS = 1 << 20
WORK_PER_LINE = 16
WORK_BASE = 4


def split_lines(content: bytes) -> list[bytes]:
    """Lines with their terminators; a last line without one counts."""
    *whole, tail = content.split(b"\n")
    return [line + b"\n" for line in whole] + [tail] * bool(tail)


def _run(flags: np.ndarray) -> int:
    """How many flags in a row hold from the start on."""
    return int(flags.argmin()) if not flags.all() else len(flags)


class Aligner:
    """Two texts as numbers of lines, and for each newer line the older one that it is (-1: none)."""

    def __init__(self, older: list[bytes], newer: list[bytes]):
        _, numbers = np.unique(np.array([*older, *newer], dtype=object), return_inverse=True) if older or newer else (None, np.zeros(0, dtype=np.int64))
        self.older, self.newer = numbers[: len(older)], numbers[len(older) :]
        self.found = np.full(len(newer), -1, dtype=np.int64)
        self.left = WORK_PER_LINE * (len(older) + len(newer)) + WORK_BASE * EXACT_CELLS
        self._match(slice(0, len(older)), slice(0, len(newer)))

    def _match(self, olds: slice, news: slice) -> None:
        waiting = [(olds, news)]
        while waiting:
            olds, news = self._without_ends(*waiting.pop())
            x, y = self.older[olds], self.newer[news]
            if not len(x) or not len(y):
                continue
            exact = len(x) * len(y) <= EXACT_CELLS
            cost = len(x) * len(y) if exact else 2 * (len(x) + len(y))
            if cost > self.left:
                self.left = 0
                continue
            self.left -= cost
            pairs = common_subsequence(x, y) if exact else unique_run(x, y)
            if not len(pairs):
                continue
            at_old, at_new = pairs[:, 0] + olds.start, pairs[:, 1] + news.start
            self.found[at_new] = at_old
            if not exact:
                starts = zip([olds.start, *(at_old + 1).tolist()], [news.start, *(at_new + 1).tolist()])
                ends = zip([*at_old.tolist(), olds.stop], [*at_new.tolist(), news.stop])
                # the first part is looked at first
                waiting += reversed([(slice(a, c), slice(b, d)) for (a, b), (c, d) in zip(starts, ends)])

    def _without_ends(self, olds: slice, news: slice) -> tuple[slice, slice]:
        x, y = self.older[olds], self.newer[news]
        n = min(len(x), len(y))
        head = _run(x[:n] == y[:n])
        tail = _run(x[::-1][: n - head] == y[::-1][: n - head])
        old_end, new_end = olds.stop - tail, news.stop - tail
        self.found[news.start : news.start + head] = np.arange(olds.start, olds.start + head)
        self.found[new_end : news.stop] = np.arange(old_end, olds.stop)
        return slice(olds.start + head, old_end), slice(news.start + head, new_end)


def common_subsequence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows (place in x, place in y) of a longest common subsequence; among equals x is passed over first."""
    # rows[i][j]: the most that x from i and y from j have in common
    rows = [np.zeros(len(y) + 1, dtype=np.int32)]
    for value in x[::-1]:
        below = rows[-1]
        with_match = np.where(y == value, below[1:] + 1, below[:-1])
        rows.append(np.append(np.maximum.accumulate(with_match[::-1])[::-1], 0))
    rows.reverse()
    pairs, j = [], 0
    for i, value in enumerate(x):
        # this older line is passed over where that loses nothing, unless the newer line at hand equals it
        while j < len(y) and y[j] != value and rows[i + 1][j] < rows[i][j + 1]:
            j += 1
        if j < len(y) and y[j] == value:
            pairs.append((i, j))
            j += 1
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


def unique_run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows (place in x, place in y), rising in both, of values that each has once: a longest such run."""

    def once(values: np.ndarray) -> dict[int, int]:
        kinds, first, times = np.unique(values, return_index=True, return_counts=True)
        return dict(zip(kinds[times == 1].tolist(), first[times == 1].tolist()))

    in_x, in_y = once(x), once(y)
    shared = sorted((j, in_x[v]) for v, j in in_y.items() if v in in_x)
    lowest: list[int] = []  # the smallest place in x that ends a run of each length
    holder: list[int] = []  # and which of the shared lines it is
    before = [-1] * len(shared)
    for k, (_, i) in enumerate(shared):
        length = bisect_left(lowest, i)
        before[k] = holder[length - 1] if length else -1
        lowest[length : length + 1], holder[length : length + 1] = [i], [k]
    run, k = [], holder[-1] if holder else -1
    while k >= 0:
        run.append((shared[k][1], shared[k][0]))
        k = before[k]
    return np.array(run[::-1], dtype=np.int64).reshape(-1, 2)


def align(older: list[bytes], newer: list[bytes]) -> list[int]:
    """For each line of newer the line of older that it is, or -1."""
    return Aligner(older, newer).found.tolist()
