"""A run-length compressed Burrows-Wheeler index of many strings, and matching statistics streamed through it.

The strings are sorted as a collection: suffixes end at their string's end and ties follow the order of the strings. The transform is kept as
its runs; the text position of the last suffix of every run is sampled. Many patterns stream through the index side by side, from their
ends to their starts: a step that stays in a run of the right symbol follows it, any other moves to the nearest end of such a run above
or below, whichever shares the longer match with the text at the sampled position.
"""

from __future__ import annotations

import numpy as np

#: Symbols compared in the first sorting round (nine bits each).
FIRST = 7


class RunLengthIndex:
    """Index of byte strings; ``floor`` is the match length from which strings of a match are grouped."""

    def __init__(self, strings: list[bytes], floor: int = 50):
        self.floor, self.count = floor, len(strings)
        sizes = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(sizes + 1)
        total = int(ends[-1]) if len(ends) else 0
        self.text = np.zeros(total + 1, np.int16)  # 0 closes a string
        body = np.ones(total, bool)
        body[ends - 1] = False
        self.text[:total][body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
        self.owner = np.repeat(np.arange(len(strings)), sizes + 1)
        self.left = np.repeat(ends - 1, sizes + 1) - np.arange(total)  # symbols up to the string's end
        order, groups = self._sorted()
        self._blocks(order, groups)
        self._runs(order)

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and a number per suffix that those agreeing on ``floor`` symbols share (-1: shorter ones)."""
        n, floor = len(self.owner), self.floor
        key = np.zeros(n, np.int64)
        for k in range(min(FIRST, floor)):
            key <<= 9
            key[: max(0, n - k)] |= np.where(self.left[: max(0, n - k)] > k, self.text[k:n], 0)
        depth, longest = min(FIRST, floor), int(self.left.max(initial=0))
        # A rank is the place of the first suffix of its group; groups of one are final and not sorted again.
        order, rank = np.arange(n), np.zeros(n, np.int64)
        slots = open_ = np.arange(n)
        groups = None
        while True:
            sort = np.argsort(key)
            open_, key = open_[sort], key[sort]
            order[slots] = open_
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(head)
            rank[open_] = np.repeat(slots[starts], np.diff(np.append(starts, len(key))))
            if groups is None and 2 * depth >= floor:
                # Two overlapping (or touching) stretches of ``depth`` symbols give the first ``floor`` symbols.
                groups = np.full(n, -1, np.int64)
                long = np.flatnonzero(self.left >= floor)
                groups[long] = rank[long] * (n + 1) + rank[long + floor - depth]
            single = head & np.append(head[1:], True)
            slots, open_ = slots[~single], open_[~single]
            if not len(open_) or depth > longest:
                break
            key = rank[open_] * (n + 2)
            inside = self.left[open_] > depth
            key[inside] += rank[open_[inside] + depth] + 1
            depth *= 2
        if len(open_):  # equal to the strings' ends: in the order of the strings
            order[slots] = open_[np.lexsort((open_, rank[open_]))]
        if groups is None:
            groups = np.full(n, -1, np.int64)
            long = np.flatnonzero(self.left >= floor)
            groups[long] = rank[long]
        return order, groups

    def _blocks(self, order: np.ndarray, groups: np.ndarray) -> None:
        """For every place in the order, the first string among the suffixes that agree with it on ``floor`` symbols."""
        at = groups[order]
        start = np.ones(len(at), bool)
        start[1:] = (at[1:] != at[:-1]) | (at[1:] < 0)
        heads = np.flatnonzero(start)
        least = np.minimum.reduceat(self.owner[order], heads) if len(heads) else np.zeros(0, np.int64)
        self.first_at = np.repeat(least, np.diff(np.append(heads, len(at)))).astype(np.int32)

    def _runs(self, order: np.ndarray) -> None:
        before = np.where(order > 0, self.text[order - 1], 0)
        before[order == 0] = 0
        start = np.ones(len(before), bool)
        start[1:] = before[1:] != before[:-1]
        self.run_start = np.flatnonzero(start)
        self.run_symbol = before[self.run_start].astype(np.int64)
        self.run_end = np.append(self.run_start[1:], len(before)) - 1
        self.run_at = np.repeat(np.arange(len(self.run_start), dtype=np.int32), np.diff(np.append(self.run_start, len(before))))
        self.head_at, self.tail_at = order[self.run_start], order[self.run_end]  # sampled text positions of run ends
        sizes = self.run_end - self.run_start + 1
        counts = np.bincount(self.text[: len(before)], minlength=258).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        by = np.argsort(before[self.run_start], kind="stable")
        done = np.cumsum(sizes[by]) - sizes[by]
        per = np.bincount(self.run_symbol, weights=sizes, minlength=258).astype(np.int64)
        self.run_to = np.empty(len(by), np.int64)  # where the first suffix of a run goes when its symbol is put in front
        self.run_to[by] = done - (np.cumsum(per) - per)[self.run_symbol[by]] + first[self.run_symbol[by]]
        self.run_skip = self.run_to - self.run_start
        self.by_symbol, self.symbol_from = by, np.concatenate([[0], np.cumsum(np.bincount(self.run_symbol, minlength=258))])
        # Runs by (symbol, place) in one array, so that one search serves cursors with different symbols.
        self.width = len(before) + 1
        self.directory = self.run_symbol[by] * self.width + self.run_start[by]

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of text positions, at most ``most`` and within both strings."""
        most = np.minimum(most, np.minimum(self.left[a], self.left[b]))
        out, live, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(live):
            live = live[most[live] > k]
            live = live[self.text[a[live] + k] == self.text[b[live] + k]]
            out[live] += 1
            k += 1
        return out

    def stream(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of all patterns, laid end to end.

        ``length[i]``: longest match of the pattern from place ``i`` on with a part of any indexed string; ``position[i]``: a text
        position of it; ``first[i]``: the first string that holds the ``floor`` symbols from ``i`` on, or -1.
        """
        sizes = np.array([len(p) for p in patterns], np.int64)
        total = int(sizes.sum())
        length, position, first = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, -1, np.int64)
        if not total or not len(self.run_start):
            return length, position, first
        symbols = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64) + 1
        starts = np.cumsum(sizes) - sizes
        live = np.argsort(-sizes, kind="stable")  # longest first: the live cursors are a prefix of this order
        place, run = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        at, held = np.full(len(sizes), self.head_at[0]), np.zeros(len(sizes), np.int64)
        ordered = sizes[live]
        for step in range(1, int(ordered[0]) + 1 if len(ordered) else 1):
            now = live[: np.searchsorted(-ordered, -step, "right")]
            where = starts[now] + sizes[now] - step
            c = symbols[where]
            k, r, p, m = place[now], run[now], at[now], held[now]
            off = np.flatnonzero(self.run_symbol[r] != c)
            if len(off):
                k[off], r[off], p[off], m[off] = self._moved(c[off], k[off], p[off], m[off])
            k = k + self.run_skip[r]
            p, m = p - 1, m + 1
            if len(off) and (lost := r < 0).any():  # a symbol that the strings do not hold
                k[lost], p[lost], m[lost] = 0, self.head_at[0], 0
            place[now], at[now], held[now] = k, p, m
            run[now] = self.run_at[k]
            length[where], position[where] = m, p
            deep = np.flatnonzero(m >= self.floor)
            first[where[deep]] = self.first_at[k[deep]]
        return length, position, first

    def _moved(self, c: np.ndarray, k: np.ndarray, p: np.ndarray, m: np.ndarray):
        """Cursors moved to the better of the nearest run ends of their symbol; run -1 where the symbol is absent."""
        low, high = self.symbol_from[c], self.symbol_from[c + 1]
        nxt = np.searchsorted(self.directory, c * self.width + k)
        has_up, has_down = nxt > low, nxt < high
        up = self.by_symbol[np.where(has_up, nxt - 1, 0)]
        down = self.by_symbol[np.where(has_down, nxt, 0) % max(1, len(self.by_symbol))]
        up_at, down_at = self.tail_at[up], self.head_at[down]
        up_len = np.where(has_up, self._common(p, up_at, m), -1)
        down_len = np.where(has_down, self._common(p, down_at, m), -1)
        above = up_len >= down_len
        run = np.where(above, up, down)
        run[~has_up & ~has_down] = -1
        return np.where(above, self.run_end[up], self.run_start[down]), run, np.where(above, up_at, down_at), np.maximum(up_len, down_len)
