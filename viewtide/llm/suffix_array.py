"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Induction works bucket by bucket: all predecessors that a bucket (or a wave inside it, for
runs of one character) induces are placed at once, in order. A pass is linear in the text.
"""

from __future__ import annotations

import numpy as np

from viewtide.llm import arrays


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is, by definition."""
    n = len(s)
    change = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    at = np.minimum.accumulate(change[::-1])[::-1]  # the end of each run of equal characters
    out = np.ones(n, bool)
    out[:-1] = s[at] < s[at + 1]
    return out


class _Induction:
    def __init__(self, s: np.ndarray, alphabet: int):
        self.s, self.n, self.alphabet = s, len(s), alphabet
        self.smaller = _smaller(s)
        before = np.concatenate(([True], self.smaller[:-1]))
        self.lms = np.flatnonzero(self.smaller & ~before)
        count = np.bincount(s, minlength=alphabet)
        self.start = np.cumsum(count) - count
        self.end = self.start + count
        self.larger_end = self.start + np.bincount(s[~self.smaller], minlength=alphabet)

    def _groups(self, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        c = self.s[j]
        order = np.argsort(c, kind="stable")
        count = np.bincount(c, minlength=self.alphabet)
        c = c[order]
        return j[order], c, np.arange(len(c)) - (np.cumsum(count) - count)[c], count

    def sort(self, lms: np.ndarray) -> np.ndarray:
        """Suffix array from leftmost-smaller suffixes given in order."""
        s, smaller, start, end = self.s, self.smaller, self.start, self.end
        sa = np.full(self.n, -1)
        head = start.copy()
        own = arrays.runs(s[lms])
        of = {int(s[lms[a]]): lms[a:z] for a, z in zip(own[:-1], own[1:], strict=True)}
        used = np.flatnonzero(end > start).tolist()

        def to_head(batch: np.ndarray) -> None:
            j = batch[batch > 0] - 1
            j = j[~smaller[j]]
            if len(j):
                j, c, place, count = self._groups(j)
                sa[head[c] + place] = j
                np.add(head, count, out=head)

        for c in used:
            low = start[c]
            while low < head[c]:
                high = head[c]
                to_head(sa[low:high])
                low = high
            if c in of:
                to_head(of[c])
        tail = end.copy()

        def to_tail(batch: np.ndarray) -> None:
            j = batch[batch > 0] - 1
            j = j[smaller[j]]
            if len(j):
                j, c, place, count = self._groups(j)
                sa[tail[c] - 1 - place] = j
                np.subtract(tail, count, out=tail)

        sa[0] = self.n - 1
        for c in reversed(used):
            high = end[c]
            while high > tail[c]:
                low = tail[c]
                to_tail(sa[low:high][::-1])
                high = low
            to_tail((sa[0:1] if c == 0 else sa[start[c] : self.larger_end[c]])[::-1])
        return sa


def _refine(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``rank``: ranks of twice the length from pairs, until all differ."""
    step = 1
    while rank.max() + 1 < len(rank):
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1]
        step *= 2
    out = np.empty(len(rank), np.int64)
    out[rank] = np.arange(len(rank))
    return out


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order; ``s`` ends with its only 0."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    text = _Induction(s, alphabet)
    lms = text.lms
    if len(lms) == 1:
        return text.sort(lms)
    sa = text.sort(lms[np.argsort(s[lms], kind="stable")])
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    same = length[ordered[1:]] == length[ordered[:-1]]
    left = np.flatnonzero(same)
    offset = 0
    while len(left):  # compare neighbours' substrings, 8 characters at a time
        a, b = ordered[left + 1] + offset, ordered[left] + offset
        rest = length[ordered[left]] - offset
        equal = np.ones(len(left), bool)
        for k in range(8):
            inside = k < rest
            equal &= ~inside | (s[np.where(inside, a + k, 0)] == s[np.where(inside, b + k, 0)])
        same[left[~equal]] = False
        offset += 8
        left = left[equal & (rest > 8)]
    name = np.zeros(len(s), np.int64)
    name[ordered] = np.concatenate(([0], np.cumsum(~same)))
    return text.sort(lms[_refine(name[lms])])


def common_prefixes(s: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """For each entry of ``sa`` the common prefix with the entry before, not reaching into characters <= ``stop``.

    Computed in text order: where the characters before both suffixes agree, the value is one less
    than at the position before; only the other positions are compared.
    """
    n = len(s)
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    known = phi > 0
    known[0] = False
    at = np.flatnonzero(known)
    reducible = np.zeros(n, bool)
    reducible[at] = (s[at - 1] == s[phi[at] - 1]) & (s[at - 1] > stop)
    plcp = np.zeros(n, np.int64)
    left = np.flatnonzero(~reducible & (phi >= 0))
    width = 16
    padded = np.concatenate((s, np.zeros(2 * width, s.dtype)))
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    while len(left):
        a, b = view[left + plcp[left]], view[phi[left] + plcp[left]]
        good = (a == b) & (a > stop)
        run = np.where(good.all(1), width, good.argmin(1))
        plcp[left] += run
        left = left[run == width]
    last = np.maximum.accumulate(np.where(reducible, 0, np.arange(n)))
    plcp = plcp[last] + last - np.arange(n)
    return np.where(phi[sa] >= 0, plcp[sa], 0)
