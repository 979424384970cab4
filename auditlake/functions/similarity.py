"""String similarity for party names: Indel ratios of pairs, and the best three of many names by bounds of their scores."""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word-wide row of the table at a time."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 x common subsequence / both lengths; 100 for two empty strings."""
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer one, shorter windows at its edges
    included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, letters, best = len(short), set(short), 0.0
    for end in range(1, len(long) + n):
        window = long[max(0, end - n) : end]
        if window[0] in letters or window[-1] in letters:
            best = max(best, ratio(short, window))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words, and these followed by each side's other words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    joined = " ".join(both)
    one, other = " ".join([*both, *left]), " ".join([*both, *right])
    return max([ratio(one, other)] + ([ratio(joined, one), ratio(joined, other)] if joined else []))


#: Hashed cells of the shared-pair counts, bits of a machine word, and names scored at a time while bounds fall.
CELLS, WORD, FIRST = 512, 64, 24
#: Characters of a name above which it is scored by itself, not in the matrix.
LONG = 256
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(name: str) -> int:
    """Words of a name; 2 also for one with white space around it, which is no word as it stands."""
    return max(len(name.split()), 2 if name.strip() != name and name.strip() else 0)


class NameIndex:
    """A block of names, ready for scores of one name against many at once and for bounds of them.

    The names' characters stand in a matrix of codes. A second matrix marks what each holds: (character, how often so far) and,
    hashed into CELLS, (pair of neighbours, how often so far); the product of two marks counts what two names share, or
    more where hashes meet, which keeps the bounds valid.
    """

    def __init__(self, names: list[str]):
        self.names = names
        letters = sorted({c for name in names for c in name})
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.size = np.array([len(n) for n in names], np.int64)
        self.codes = np.zeros((len(names), max(1, int(self.size[self.size <= LONG].max(initial=0)))), np.int32)
        for row, name in zip(self.codes, names):
            if len(name) <= LONG:
                row[: len(name)] = [self.code[c] for c in name]
        self.words = np.array([_words(n) for n in names], np.int64)
        seen = sorted({m for n in names for m in self._letters(n)})
        self.cell = {m: i for i, m in enumerate(seen)}
        self.marks = self._marks(names)

    @staticmethod
    def _letters(name: str):
        return [(c, i) for c, n in Counter(name).items() for i in range(n)]

    def _marks(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters, pairs = np.zeros((len(names), len(self.cell)), np.float32), np.zeros((len(names), CELLS), np.float32)
        for i, name in enumerate(names):
            letters[i, [self.cell[m] for m in self._letters(name) if m in self.cell]] = 1
            # a stable hash; counts beyond one go to cells of their own
            for pair, n in Counter(zip(name, name[1:])).items():
                for k in range(n):
                    pairs[i, (ord(pair[0]) * 7919 + ord(pair[1]) * 104729 + k * 1299709) % CELLS] += 1
        return letters, pairs

    def bounds(self, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of partial_ratio and token_set_ratio, a row for each asked name and a column for each of the block.

        A common subsequence of l characters leaves m - l of one string and n - l of the other; each of the former breaks at
        most two pairs of neighbours, each of the latter one, so l <= (shared pairs + m + n + 1) / 3; nor can l exceed the
        shared characters or the shorter string. A window of k < n characters at an edge has l <= k as well.
        """
        letters, pairs = self._marks(asked)
        common = letters @ self.marks[0].T
        # cells count: the smaller of two counts, summed over cells, is at most the product where both are 0 or 1, and at most
        # their product in general, as counts are whole numbers
        shared = pairs @ self.marks[1].T
        a = np.array([len(n) for n in asked], np.float32)[:, None]
        b = self.size[None, :].astype(np.float32)
        n = np.minimum(a, b)
        m = np.minimum(np.minimum(n, common), (shared + n + 1) / 2)
        with np.errstate(invalid="ignore", divide="ignore"):
            partial = np.where(n > 0, 200 * m / (n + m), np.where(np.maximum(a, b) > 0, 0, 100))
            whole = 200 * np.minimum(np.minimum(n, common), (shared + a + b + 1) / 3) / (a + b)
        words = np.array([_words(n) for n in asked])[:, None]
        several, nothing = (words > 1) | (self.words[None, :] > 1), (words == 0) | (self.words[None, :] == 0)
        return np.nan_to_num(partial), np.where(nothing, 0, np.where(several, 100, np.nan_to_num(whole)))

    def _table(self, name: str) -> np.ndarray:
        """For each code the places of its character in a name of at most WORD characters, as bits."""
        table = np.zeros(len(self.code) + 1, np.uint64)
        for i, c in enumerate(name):
            if c in self.code:
                table[self.code[c]] |= np.uint64(1) << np.uint64(i)
        return table

    def token_set(self, name: str, rows: np.ndarray) -> np.ndarray:
        """token_set_ratio of the name with the block's `rows`."""
        if len(name) > WORD or _words(name) != 1 or (self.words[rows] != 1).any() or (self.size[rows] > LONG).any():
            return np.array([token_set_ratio(name, self.names[r]) for r in rows], np.float64)
        table, full = self._table(name), _ONES >> np.uint64(WORD - len(name))
        left = np.full(len(rows), full)
        for column in self.codes[rows].T:
            hit = left & table[column]
            left = ((left + hit) | (left - hit)) & full
        return 200 * (len(name) - np.bitwise_count(left).astype(np.int64)) / (len(name) + self.size[rows])

    def partial(self, name: str, rows: np.ndarray) -> np.ndarray:
        """partial_ratio of the name with the block's `rows`: all windows of all rows go through the table side by side."""
        out = np.zeros(len(rows), np.float64)
        size = self.size[rows]
        if len(name) > WORD or not name or (size > LONG).any():
            return np.array([partial_ratio(name, self.names[r]) for r in rows], np.float64)
        table, n = self._table(name), len(name)
        longer = np.flatnonzero(size >= n)
        if len(longer):  # the name is the shorter one: windows of n codes of the rows, with nothing around them
            wide = int(size[longer].max())
            codes = np.pad(self.codes[rows[longer], :wide], ((0, 0), (n - 1, n - 1)))
            bits = table[codes]
            full = _ONES >> np.uint64(WORD - n)
            ends = np.arange(1, wide + n)
            left = np.full((len(longer), len(ends)), full)
            for j in range(n):
                hit = left & bits[:, j : j + len(ends)]
                left = ((left + hit) | (left - hit)) & full
            within = np.minimum(ends, size[longer][:, None]) - np.maximum(0, ends - n)
            score = np.where(within > 0, 200 * (n - np.bitwise_count(left).astype(np.int64)) / (n + np.maximum(within, 1)), 0)
            out[longer] = score.max(axis=1)
        shorter = np.flatnonzero((size < n) & (size > 0))
        if len(shorter):  # the rows are: windows of the name, as bits shifted to their start
            k = size[shorter][:, None]
            ends = np.arange(1, n + int(k.max()))[None, :]
            start, stop = np.maximum(0, ends - k), np.minimum(n, ends)
            within = stop - start
            real = (within > 0) & (ends < n + k)
            shift, mask = np.where(real, start, 0).astype(np.uint64), _ONES >> (np.uint64(WORD) - np.where(real, within, 1).astype(np.uint64))
            left = mask.copy()
            for column in self.codes[rows[shorter], : int(k.max())].T:
                hit = left & ((table[column][:, None] >> shift) & mask)
                left = ((left + hit) | (left - hit)) & mask
            score = np.where(real, 200 * (within - np.bitwise_count(left & mask).astype(np.int64)) / np.maximum(k + within, 1), 0)
            out[shorter] = score.max(axis=1)
        return out

    def best(self, name: str, bound: np.ndarray, score, places: np.ndarray, most: int = 3) -> tuple[list[tuple[float, int]], int]:
        """The `most` best rows by score (ties: the smaller place), as (score, row), and how many rows were scored: by falling
        bound, until the next bound is below the score of the last one."""
        order = np.argsort(-bound, kind="stable")
        found, at, step = [], 0, FIRST
        while at < len(order):
            if len(found) == most and bound[order[at]] < found[-1][0] - 1e-4:  # bounds are single precision
                break
            rows = order[at : at + step]
            at, step = at + len(rows), step * 2
            scores = score(name, rows)
            keep = scores >= found[-1][0] if len(found) == most else np.ones(len(rows), bool)
            found = sorted(found + list(zip(scores[keep].tolist(), rows[keep].tolist())), key=lambda x: (-x[0], places[x[1]]))[:most]
        return found, at

    def reaching(self, name: str, partial: np.ndarray, tokens: np.ndarray, least_partial: float, least_tokens: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows whose partial or token score reaches its least, with both scores; partial and tokens are their bounds. Only
        rows with a bound that does are scored."""
        rows = np.flatnonzero((partial >= least_partial - 1e-4) | (tokens >= least_tokens - 1e-4))  # bounds are single precision
        x, y = np.full(len(rows), -1.0), self.token_set(name, rows)
        near = (partial[rows] >= least_partial - 1e-4) | (y >= least_tokens)
        x[near] = self.partial(name, rows[near])
        hit = (x >= least_partial) | (y >= least_tokens)
        return rows[hit], x[hit], y[hit]


def pair_scores(a: str, b: str) -> Column:
    """Struct of partial_ratio (partial) and token_set_ratio (tokens) of two columns; a name's pairs of a batch are scored at
    once."""

    @F.pandas_udf("partial double, tokens double")
    def score(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        x, y = x.fillna(""), y.fillna("")
        index, out = NameIndex(y.unique().tolist()), pd.DataFrame(0.0, index=x.index, columns=["partial", "tokens"])
        row = pd.Series(range(len(index.names)), index=index.names)
        for name, others in y.groupby(x, sort=False):
            rows = row[others].to_numpy()
            out.loc[others.index, "partial"], out.loc[others.index, "tokens"] = index.partial(name, rows), index.token_set(name, rows)
        return out

    return score(a, b)


def partial_score(a: str, b: str) -> Column:
    return pair_scores(a, b)["partial"]


def nfkc(name: str) -> Column:
    """NFKC form; ASCII names don't go through Python's loop body."""

    @F.pandas_udf("string")
    def normal(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))

    return normal(name)
