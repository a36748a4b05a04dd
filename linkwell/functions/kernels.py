"""Similarities of many string pairs at once, as array programs over padded matrices of code points.

Pairs are sorted into widths of 8, 16, 32 and 64 letters and computed in blocks, so memory is bounded; of the few longer
strings each pair is computed by the function of ``strings`` for one pair.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np

from linkwell.functions import strings as S

WIDTHS, BLOCK = (8, 16, 32, 64), 16_384
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, f"<U{width}").view(np.uint32).reshape(len(texts), width)


def over(kernel: Kernel, single: Callable[[str, str], float], a: list[str], b: list[str]) -> np.ndarray:
    """One value for each pair: ``kernel`` (codes, lengths, codes, lengths) in blocks of one width, ``single`` for longer strings."""
    out = np.zeros(len(a))
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    low = -1
    for width in WIDTHS:
        here = np.flatnonzero((size > low) & (size <= width))
        low = width
        for k in range(0, len(here), BLOCK):
            at = here[k : k + BLOCK]
            x, y = [a[i] for i in at], [b[i] for i in at]
            out[at] = kernel(_codes(x, width), np.array([len(s) for s in x]), _codes(y, width), np.array([len(s) for s in y]))
    for i in np.flatnonzero(size > low):
        out[i] = single(a[i], b[i])
    return out


def _share(part: np.ndarray, whole: np.ndarray, empty: float) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), empty)


def lcs(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences: one bit for each letter of ``a``, one step for each letter of ``b``."""
    width = a.shape[1]
    kind = np.dtype(f"<u{width // 8}")
    inside = np.arange(width) < n[:, None]
    full = np.packbits(inside, axis=1, bitorder="little").view(kind)[:, 0]
    row = full.copy()
    for j in range(int(m.max(initial=0))):
        at = np.packbits((a == b[:, j : j + 1]) & inside, axis=1, bitorder="little").view(kind)[:, 0]
        hit = row & at
        row = np.where(j < m, ((row + hit) | (row - hit)) & full, row)
    return n - np.bitwise_count(row)


def _matched(a, n, b, m, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of either side that meet an equal one within ``reach`` places, each at most once, first come."""
    width = a.shape[1]
    col, used, found = np.arange(width), np.zeros(b.shape, bool), np.zeros(a.shape, bool)
    for i in range(int(n.max(initial=0))):
        may = (b == a[:, i : i + 1]) & ~used & (np.abs(col - i) <= reach[:, None]) & (col < m[:, None]) & (i < n)[:, None]
        rows = np.flatnonzero(may.any(1))
        used[rows, may[rows].argmax(1)] = True
        found[rows, i] = True
    return found, used


def jaro(a, n, b, m) -> np.ndarray:
    found, used = _matched(a, n, b, m, np.maximum(0, np.maximum(n, m) // 2 - 1))
    hits = found.sum(1)
    first, second = (np.take_along_axis(x, np.argsort(~k, axis=1, kind="stable"), 1) for x, k in ((a, found), (b, used)))
    moved = ((first != second) & (np.arange(a.shape[1]) < hits[:, None])).sum(1) // 2
    h = np.maximum(hits, 1)
    score = (hits / np.maximum(n, 1) + hits / np.maximum(m, 1) + (hits - moved) / h) / 3
    return np.where((n == 0) & (m == 0), 1.0, np.where(hits > 0, score, 0.0))


def jaro_winkler(a, n, b, m, p: float = 0.1, most: int = 4) -> np.ndarray:
    s = jaro(a, n, b, m)
    same = (a[:, :most] == b[:, :most]) & (np.arange(most) < np.minimum(n, m)[:, None])
    return s + np.cumprod(same, 1).sum(1) * p * (1 - s)


def bag(a, n, b, m) -> np.ndarray:
    """1 - bag distance over the longer length: letters in common, order aside; 1 for two empty strings."""
    found, _ = _matched(a, n, b, m, np.full(len(a), a.shape[1]))
    return _share(found.sum(1), np.maximum(n, m), 1.0)


def _table(a, n, b, m, first: Callable[[int], np.ndarray], column: Callable[[int], np.ndarray], cell: Callable) -> np.ndarray:
    """The last cell of each pair's table: ``first`` (j) and ``column`` (i) give its borders, ``cell`` (i, j, diagonal, above, left) the others."""
    row = [first(j) for j in range(int(m.max(initial=0)) + 1)]
    out = np.where(n == 0, np.stack(row, 1)[np.arange(len(m)), m], 0.0)
    for i in range(int(n.max(initial=0))):
        now = [column(i + 1)]
        for j in range(len(row) - 1):
            now.append(cell(i, j, row[j], row[j + 1], now[-1]))
        row = now
        ends = n == i + 1
        out[ends] = np.stack(row, 1)[ends, m[ends]]
    return out


def needleman_wunsch(a, n, b, m, gap: float = 1.0) -> np.ndarray:
    border = lambda k: np.full(len(a), -gap * k)
    return _table(a, n, b, m, border, border, lambda i, j, diagonal, above, left: np.maximum(diagonal + (a[:, i] == b[:, j]), np.maximum(above, left) - gap))


def affine(a, n, b, m, opened: float = 1.0, longer: float = 0.5) -> np.ndarray:
    """Global alignment: a match scores 1, a gap costs ``opened`` for its first letter and ``longer`` for each further one."""
    size, low = len(a), np.full(len(a), -np.inf)
    gap = lambda k: np.full(size, -(opened + longer * (k - 1)))
    # (ends in a pair, in a gap in b, in a gap in a)
    row = [(np.zeros(size), low, low), *[(low, low, gap(j)) for j in range(1, int(m.max(initial=0)) + 1)]]
    pick = lambda row: np.stack([np.maximum(np.maximum(x, y), z) for x, y, z in row], 1)
    out = np.where(n == 0, pick(row)[np.arange(size), m], 0.0)
    for i in range(int(n.max(initial=0))):
        now = [(low, gap(i + 1), low)]
        for j in range(len(row) - 1):
            met = np.maximum(np.maximum(row[j][0], row[j][1]), row[j][2]) + (a[:, i] == b[:, j])
            down = np.maximum(row[j + 1][0] - opened, row[j + 1][1] - longer)
            right = np.maximum(now[j][0] - opened, now[j][2] - longer)
            now.append((met, down, right))
        row = now
        ends = n == i + 1
        out[ends] = pick(row)[ends, m[ends]]
    return out


#: Letters that sound alike, and letters that are often silent (fixed values).
SOUNDS, SILENT = ("aeiouy", "bp", "ckq", "dt", "lr", "mn", "gj", "fpv", "sxz", "csz"), "hw"


def _letter_cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 for equal letters, 1 for letters of one sound, 2 for others."""
    alike = np.zeros(x.shape, bool)
    for group in SOUNDS:
        letters = np.array([ord(c) for c in group], np.uint32)
        alike |= np.isin(x, letters) & np.isin(y, letters)
    return np.where(x == y, 0.0, np.where(alike, 1.0, 2.0))


def _step_cost(s: np.ndarray) -> np.ndarray:
    """What leaving out each letter costs behind the one before it: 1 behind a silent letter that differs, else the letters' cost."""
    before = np.concatenate([np.full((len(s), 1), ord(" "), s.dtype), s[:, :-1]], 1)
    silent = np.isin(before, np.array([ord(c) for c in SILENT], np.uint32)) & (before != s)
    return np.where(silent, 1.0, _letter_cost(before, s))


def editex(a, n, b, m) -> np.ndarray:
    """1 - letter-group edit distance (of lower-case letters) over twice the longer length; 1 for two empty strings."""
    da, db = _step_cost(a), _step_cost(b)
    left, top = (np.concatenate([np.zeros((len(d), 1)), np.cumsum(d, 1)], 1) for d in (da, db))
    cell = lambda i, j, diagonal, above, before: np.minimum(np.minimum(above + da[:, i], before + db[:, j]), diagonal + _letter_cost(a[:, i], b[:, j]))
    distance = _table(a, n, b, m, lambda j: top[:, j], lambda i: left[:, i], cell)
    return 1 - _share(distance, 2 * np.maximum(n, m), 0.0)


def common_substring(a, n, b, m) -> np.ndarray:
    """Longest common substring over the longer length; 1 for two empty strings."""
    width = a.shape[1]
    best, row, inside = np.zeros(len(a)), np.zeros((len(a), width + 1)), np.arange(width) < m[:, None]
    for i in range(int(n.max(initial=0))):
        now = np.zeros_like(row)
        now[:, 1:] = np.where((b == a[:, i : i + 1]) & inside & (i < n)[:, None], row[:, :-1] + 1, 0)
        best = np.maximum(best, now.max(1))
        row = now
    return _share(best, np.maximum(n, m), 1.0)


def ratcliff(a: str, b: str) -> float:
    """Twice the letters of matching blocks over all letters: the longest common substring, then left and right of it."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def _by_one(kernel: Kernel, a: str, b: str) -> float:
    """A longer pair through its kernel, at its own width."""
    width = -(-max(len(a), len(b), 1) // 8) * 8
    return float(kernel(_codes([a], width), np.array([len(a)]), _codes([b], width), np.array([len(b)]))[0])


#: Name to values of lists of strings.
PAIRS: dict[str, Callable[[list[str], list[str]], np.ndarray]] = {
    "jaro": lambda a, b: over(jaro, S.jaro, a, b),
    "jaro_win": lambda a, b: over(jaro_winkler, S.jaro_winkler, a, b),
    "lcs": lambda a, b: over(lcs, S.lcs_length, a, b),
    "needleman_wunsch": lambda a, b: over(needleman_wunsch, S.needleman_wunsch, a, b),
    "lcsstr": lambda a, b: over(common_substring, S.common_substring, a, b),
    "bag": lambda a, b: over(bag, lambda x, y: _by_one(bag, x, y), a, b),
    "affine": lambda a, b: over(affine, lambda x, y: _by_one(affine, x, y), a, b),
    "editex": lambda a, b: over(editex, lambda x, y: _by_one(editex, x, y), [x.lower() for x in a], [x.lower() for x in b]),
    "ratcliff": lambda a, b: np.array([ratcliff(x, y) for x, y in zip(a, b, strict=True)]),
}


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 M / T with M the length of the longest common subsequence; 1 for two empty strings."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], float)
    return _share(2 * PAIRS["lcs"](a, b), total, 1.0)


def lcs_similarities(a: list[str], b: list[str]) -> np.ndarray:
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], float)
    return PAIRS["lcs"](a, b) / np.maximum(longest, 1)


class Batch:
    """Pairs of token lists.  Every distinct pair of tokens is scored once for a measure, however many rows hold it."""

    def __init__(self, q: list[list[str]], d: list[list[str]]):
        self.q, self.d, self.rows = q, d, len(q)
        self.n, self.m = np.array([len(x) for x in q], np.int64), np.array([len(x) for x in d], np.int64)
        words: dict[str, int] = {}
        ids = [np.array([words.setdefault(t, len(words)) for x in side for t in x], np.int64) for side in (q, d)]
        self.words = list(words)
        cells = self.n * self.m
        self.row = np.repeat(np.arange(self.rows), cells)
        self.starts = np.cumsum(cells) - cells
        off, width = np.arange(len(self.row)) - self.starts[self.row], self.m[self.row]
        a = ids[0][(np.cumsum(self.n) - self.n)[self.row] + off // np.maximum(width, 1)] if len(off) else off
        b = ids[1][(np.cumsum(self.m) - self.m)[self.row] + off % np.maximum(width, 1)] if len(off) else off
        key, self.inverse = np.unique(a * max(1, len(words)) + b, return_inverse=True)
        self.left, self.right = ([self.words[i] for i in x] for x in (key // max(1, len(words)), key % max(1, len(words))))
        self.held: dict[str, np.ndarray] = {}
        self.text = [" ".join(x) for x in q], [" ".join(x) for x in d]

    def cells(self, name: str) -> np.ndarray:
        """A measure's value for each cell: pairs row by row, tokens of the left side first."""
        if name not in self.held:
            fn = {"ratio": ratios, "lcsseq": lcs_similarities}.get(name) or PAIRS[name]
            self.held[name] = fn(self.left, self.right)
        return self.held[name][self.inverse]

    def matrices(self, name: str):
        """(row, matrix) of the rows that have tokens on both sides."""
        values = self.cells(name)
        for r in np.flatnonzero(self.n * self.m):
            yield r, values[self.starts[r] : self.starts[r] + self.n[r] * self.m[r]].reshape(self.n[r], self.m[r])

    def best(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(row, value) of each left token that has partners: its best one."""
        values, rows = self.cells(name), np.flatnonzero(self.n * self.m)
        runs = np.repeat(self.m[rows], self.n[rows])
        if not len(runs):
            return np.zeros(0, np.int64), np.zeros(0)
        return np.repeat(rows, self.n[rows]), np.maximum.reduceat(values, np.cumsum(runs) - runs)

    def statistics(self, name: str) -> np.ndarray:
        """(rows, 5): mean, population deviation and linear quartiles of each row's best values; NaN without tokens on a side."""
        out = np.full((self.rows, 5), np.nan)
        row, best = self.best(name)
        n = np.bincount(row, minlength=self.rows)
        rows = np.flatnonzero(n)
        if len(rows):
            mean = np.bincount(row, best, self.rows)[rows] / n[rows]
            spread = best - np.repeat(mean, n[rows])
            out[rows, 0], out[rows, 1] = mean, np.sqrt(np.bincount(row, spread**2, self.rows)[rows] / n[rows])
            ordered, first = best[np.lexsort((best, row))], np.cumsum(n[rows]) - n[rows]
            for k, p in enumerate((0.25, 0.5, 0.75), 2):
                at = (n[rows] - 1) * p
                low = np.floor(at).astype(np.int64)
                below, above = ordered[first + low], ordered[first + np.minimum(low + 1, n[rows] - 1)]
                out[rows, k] = below + (above - below) * (at - low)
        return out

    def filled(self, value: Callable[[int], float]) -> np.ndarray:
        """1 where both sides are empty, 0 where one is, ``value`` of the row elsewhere."""
        return np.array([value(r) if self.n[r] and self.m[r] else float(self.n[r] == self.m[r]) for r in range(self.rows)])

    def monge_elkan(self, name: str) -> np.ndarray:
        row, best = self.best(name)
        n = np.bincount(row, minlength=self.rows)
        return np.where(n > 0, np.bincount(row, best, self.rows) / np.maximum(n, 1), np.where((self.n == 0) & (self.m == 0), 1.0, 0.0))

    def generalised_jaccard(self, name: str, least: float) -> np.ndarray:
        found = dict(self.matrices(name))

        def value(r: int) -> float:
            firsts = [sorted({t: i for i, t in reversed(list(enumerate(side)))}.values()) for side in (self.q[r], self.d[r])]
            g = found[r][np.ix_(*firsts)]
            i, j = np.nonzero(g > least)
            order = np.lexsort((j, i, -g[i, j]))
            left, right, total = set(), set(), 0.0
            for k in order:
                if i[k] not in left and j[k] not in right:
                    left.add(i[k])
                    right.add(j[k])
                    total += g[i[k], j[k]]
            return total / (sum(map(len, firsts)) - len(left))

        return np.array([value(r) if r in found else float(not self.q[r] and not self.d[r]) for r in range(self.rows)])

    def sequence_ratio(self) -> np.ndarray:
        found = dict(self.matrices("ratio"))

        def value(r: int) -> float:
            n, m = self.n[r], self.m[r]
            row = np.arange(m + 1, dtype=float)
            for i in range(n):
                # the least over cheaper starts to the left is a running minimum
                start = np.concatenate([[i + 1.0], np.minimum(row[:-1] + 2 * (1 - found[r][i]), row[1:] + 1)])
                row = np.minimum.accumulate(start - np.arange(m + 1)) + np.arange(m + 1)
            return (n + m - row[-1]) / (n + m)

        return self.filled(value)

    def set_ratio(self) -> np.ndarray:
        found = dict(self.matrices("ratio"))
        return self.filled(lambda r: 2 * S._assignment(found[r] if self.n[r] <= self.m[r] else found[r].T) / (self.n[r] + self.m[r]))

    def partial_ratio(self) -> np.ndarray:
        short, windows, row = [], [], []
        for r, pair in enumerate(zip(*self.text, strict=True)):
            a, b = sorted(pair, key=len)
            if a:
                cuts = list({b[i : i + len(a)] for i in range(len(b) - len(a) + 1)})
                short += [a] * len(cuts)
                windows += cuts
                row += [r] * len(cuts)
        out = np.array([float(not a and not b) for a, b in zip(*self.text, strict=True)])
        np.maximum.at(out, np.array(row, np.int64), ratios(short, windows))
        return out

    def token_sort_ratio(self) -> np.ndarray:
        return ratios(*([" ".join(sorted(t.split())) for t in side] for side in self.text))

    def token_set_ratio(self) -> np.ndarray:
        first, second, row = [], [], []
        for r, (a, b) in enumerate(zip(*self.text, strict=True)):
            x, y = set(a.split()), set(b.split())
            if x and y:
                both = " ".join(sorted(x & y))
                left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
                for p, q in ((both, left), (both, right), (left, right)):
                    if p or (p, q) == (left, right):
                        first.append(p)
                        second.append(q)
                        row.append(r)
        out = np.zeros(self.rows)
        np.maximum.at(out, np.array(row, np.int64), ratios(first, second))
        return out


def percent(x: np.ndarray) -> np.ndarray:
    return np.round(100 * x)
