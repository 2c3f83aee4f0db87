"""A bidirectional FM-index over a bounded list of words, searched by whole arrays of queries.

Each word is closed by a delimiter and read as a circle, so that "delimiter + half" and "half + delimiter" are patterns like any
other. A wavelet matrix over the transformed text gives, for an interval of suffix ranks and a symbol, the interval of the
pattern that is one symbol longer and the number of smaller symbols before it, which keeps the intervals of the forward and
the reversed text in step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def ranked(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all rotations in order, by prefix doubling up to the delimiter; ties go by place, which is the words' own order."""
    n = len(symbols)
    at, rank, reach = np.arange(n), symbols.astype(np.int64), 1
    longest = int((ends - at).max()) + 1 if n else 0
    while reach < longest:
        beyond = at + reach
        second = np.where(beyond <= ends, rank[np.minimum(beyond, n - 1)] + 1, 0)
        values, rank = np.unique(rank * (n + int(symbols.max()) + 2) + second, return_inverse=True)
        if len(values) == n:
            break
        reach *= 2
    return np.argsort(rank, kind="stable")


class Wavelet:
    """Counts of symbols in prefixes of a sequence of small numbers."""

    def __init__(self, sequence: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        cur = sequence
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~bit, dtype=np.int32)]).astype(np.int32))
            cur = np.concatenate([cur[~bit], cur[bit]])
        self.shift = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=sigma))[:-1]])
        start = np.zeros(sigma, np.int64)
        for k, zeros in enumerate(self.zeros):
            one = np.arange(sigma) >> (self.bits - 1 - k) & 1
            start = np.where(one == 1, zeros[-1] + start - zeros[start], zeros[start])
        self.shift = self.shift - start

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, smaller): the interval of c + pattern, and how many rows of [lo, hi) have a symbol below c."""
        smaller = np.zeros(len(lo), np.int64)
        for k, zeros in enumerate(self.zeros):
            one = (c >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            smaller += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return lo + self.shift[c], hi + self.shift[c], smaller

    def each(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, symbol, from, to, smaller): extend() by every symbol that the intervals hold."""
        row, c, smaller = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for zeros in self.zeros:
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            none, some = np.flatnonzero(b > a), np.flatnonzero(hi - b > lo - a)
            row, c = np.concatenate([row[none], row[some]]), np.concatenate([c[none] * 2, c[some] * 2 + 1])
            smaller = np.concatenate([smaller[none], smaller[some] + b[some] - a[some]])
            lo, hi = np.concatenate([a[none], zeros[-1] + lo[some] - a[some]]), np.concatenate([b[none], zeros[-1] + hi[some] - b[some]])
        return row, c, lo + self.shift[c], hi + self.shift[c], smaller


@dataclass
class Found:
    """Intervals of one pattern each: where it starts among the suffixes of the text, and among those of the reversed text."""

    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray

    def take(self, rows: np.ndarray) -> Found:
        return Found(self.forward[rows], self.backward[rows], self.size[rows])

    @staticmethod
    def joined(parts: list[Found]) -> Found:
        return Found(*[np.concatenate([getattr(p, k) for p in parts]) for k in ("forward", "backward", "size")])


def transform(symbols: np.ndarray, off: np.ndarray, order: np.ndarray, back: bool) -> np.ndarray:
    """The symbol before each rotation, in the order of rotations, of the words in the given order (each read backward, if asked)."""
    size = np.diff(off)[order]
    closed = np.concatenate([[0], np.cumsum(size + 1)])
    word = np.repeat(np.arange(len(size)), size + 1)
    inner = np.arange(closed[-1]) - closed[word]
    last = size[word]
    place = off[order][word] + (last - 1 - inner if back else inner)
    text = np.where(inner < last, symbols[np.minimum(np.maximum(place, 0), max(len(symbols) - 1, 0))] if len(symbols) else 0, 0)
    return text[ranked(text, closed[1:][word] - 1) - 1]


class Index:
    """The words must be distinct and in code-point order; symbols are 1 and above, `off` the words' offsets."""

    def __init__(self, symbols: np.ndarray, off: np.ndarray, by_end: np.ndarray, sigma: int) -> None:
        self.words, self.length = len(off) - 1, int(off[-1]) + len(off) - 1
        self.forward = Wavelet(transform(symbols, off, np.arange(self.words), False), sigma)
        self.backward = Wavelet(transform(symbols, off, by_end, True), sigma)

    def everything(self, n: int) -> Found:
        return Found(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.length, np.int64))

    def extend(self, f: Found, c: np.ndarray, left: bool) -> Found:
        """Each pattern with one symbol before it (or behind it)."""
        at = f.forward if left else f.backward
        lo, hi, smaller = (self.forward if left else self.backward).extend(at, at + f.size, c)
        return Found(lo, f.backward + smaller, hi - lo) if left else Found(f.forward + smaller, lo, hi - lo)

    def each(self, f: Found, left: bool) -> tuple[np.ndarray, np.ndarray, Found]:
        """(row, symbol, patterns) for every symbol that comes before (or behind) each pattern."""
        at = f.forward if left else f.backward
        row, c, lo, hi, smaller = (self.forward if left else self.backward).each(at, at + f.size)
        return row, c, Found(lo, f.backward[row] + smaller, hi - lo) if left else Found(f.forward[row] + smaller, lo, hi - lo)


def one_error(index: Index, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of words that differ from a query by one inserted, deleted or replaced symbol.

    The query's first half (or, with `left`, its second one) matches exactly, then the pattern grows over the other half with one
    error. An insertion or deletion in a run of equal symbols counts at its end only, so no word is found twice.
    """
    cut = (starts + ends) // 2
    exact = ends - cut if left else cut - starts
    rest = cut - starts if left else ends - cut
    f, query = index.everything(len(starts)), np.arange(len(starts))
    for t in range(int(exact.max()) + 1 if len(exact) else 0):
        # The half from the cut outward, then the delimiter at the word's end.
        place = cut[query] + t if left else cut[query] - 1 - t
        c = np.where(t < exact[query], symbols[np.clip(place, 0, max(len(symbols) - 1, 0))], 0)
        grown, go = index.extend(f, c, not left), t <= exact[query]
        f = Found(*[np.where(go, getattr(grown, k), getattr(f, k)) for k in ("forward", "backward", "size")])
        live = np.flatnonzero(f.size > 0)
        f, query = f.take(live), query[live]
    done_q, done_w = [], []
    t, broken = np.zeros(len(query), np.int64), np.zeros(len(query), bool)
    wanted = lambda q, t: np.where(t < rest[q], symbols[np.clip(cut[q] - 1 - t if left else cut[q] + t, 0, len(symbols) - 1)], 0)
    while len(query):
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, Found]] = []

        def keep(q: np.ndarray, t: np.ndarray, broken: bool, f: Found, parts: list = parts) -> None:
            parts.append((q, t, np.full(len(q), broken), f))

        whole = np.flatnonzero(~broken)
        q0, t0, f0 = query[whole], t[whole], f.take(whole)
        row, c, grown = index.each(f0, left)
        q, at = q0[row], t0[row]
        want = wanted(q, at)
        more = at < rest[q]
        a = np.flatnonzero(more & (c == want))
        keep(q[a], at[a] + 1, False, grown.take(a))
        a = np.flatnonzero(more & (c != want) & (c != 0))
        keep(q[a], at[a] + 1, True, grown.take(a))
        a = np.flatnonzero((c != want) & (c != 0))
        keep(q[a], at[a], True, grown.take(a))
        a = np.flatnonzero((t0 < rest[q0]) & (wanted(q0, t0) != wanted(q0, t0 + 1)))
        keep(q0[a], t0[a] + 1, True, f0.take(a))
        late = np.flatnonzero(broken)
        q1, t1 = query[late], t[late]
        grown = index.extend(f.take(late), wanted(q1, t1), left)
        end = t1 == rest[q1]
        a = np.flatnonzero(end & (grown.size > 0))
        done_q.append(q1[a])
        done_w.append(grown.forward[a])
        a = np.flatnonzero(~end & (grown.size > 0))
        keep(q1[a], t1[a] + 1, True, grown.take(a))
        query, t, broken = (np.concatenate([p[k] for p in parts]) for k in range(3))
        f = Found.joined([p[3] for p in parts])
    return np.concatenate([*done_q, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*done_w, np.zeros(0, np.int64)]).astype(np.int64)
