"""Links of many names with many others, counted without making their pairs: names that begin and end alike are met once."""

from __future__ import annotations

from math import ceil

import numpy as np

from auditlake.functions.similarity import LONG, WORD, NameIndex, _words

#: Names of one length that make a graph, and the graph's size for each of their letters up to which it is walked: names
#: that have little in common are scored sooner one by one.
FEW_NAMES, ALIKE = 200, 0.15
#: Asked names that walk a graph together, cells of their table and of a step's arrays, and names of a block whose bounds
#: are held at once, for how many asked ones.
TOGETHER, TABLE, STEP, PIECE, BOUNDS = 1024, 1 << 22, 1 << 20, 20_000, 64
#: Scores are compared with bounds of them as doubles.
NEAR = 1e-9
_ONE, _MIX = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def _bits(a: int, b: int) -> np.uint64:
    return np.uint64((1 << b) - (1 << a))


class NameGraph:
    """Distinct names of one length, each with a weight, as a tree of their beginnings, and as that tree with equal ends
    (and their weights) put together.

    Names go through it letter by letter, many at once. A state has the bit rows of the longest common subsequences (as in
    similarity.lcs): of the whole name, and of every window that partial_ratio looks at. States of the same name, place and
    rows are one, with the number of ways to it; a row whose score can't matter any more is reset, so more are the same; and
    a state that can't link, or whose links are sure, ends there with all the names below.
    """

    def __init__(self, names: list[str], weights: np.ndarray):
        self.size = k = len(names[0])
        points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(names), k)
        self.rows = np.lexsort(points.T[::-1])
        self.letters, codes = np.unique(points[self.rows], return_inverse=True)
        self.codes = codes.reshape(len(names), k)
        new, firsts = np.arange(len(names)) == 0, [np.zeros(1, np.int64)]
        for d in range(k):
            new = new | np.append(True, self.codes[1:, d] != self.codes[:-1, d])
            firsts.append(np.flatnonzero(new))
        #: by depth: where a node's children begin, their letters, and their nodes
        self.tree = [(np.append(np.searchsorted(b, a), len(b)), self.codes[b, d], np.arange(len(b))) for d, (a, b) in enumerate(zip(firsts, firsts[1:]))]
        last, of = np.unique(weights[self.rows], return_inverse=True)
        self.graph, self.weights = [()] * k, [last] * (k + 1)
        for d in reversed(range(k)):
            at, letter, _ = self.tree[d]
            edges, kinds = (letter.astype(np.int64) << 32 | of).tobytes(), {}
            ends = (at * 8).tolist()
            of = np.array([kinds.setdefault(edges[a:b], len(kinds)) for a, b in zip(ends, ends[1:])], np.int64)
            flat, begin = np.frombuffer(b"".join(kinds), np.int64), np.cumsum([0, *(len(x) // 8 for x in kinds)])
            self.graph[d] = (begin, flat >> 32, flat & 0xFFFFFFFF)
            self.weights[d] = np.add.reduceat(self.weights[d + 1][flat & 0xFFFFFFFF], begin[:-1])
        self.alike = sum(len(edges[1]) for edges in self.graph) <= ALIKE * len(names) * k

    def table(self, asked: list[str]) -> np.ndarray:
        """For each asked name (all of one length) and letter the places of the letter in it, as bits."""
        points = np.frombuffer("".join(asked).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(asked), -1)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        table, known = np.zeros((len(asked), len(self.letters)), np.uint64), self.letters[at] == points
        for i in range(points.shape[1]):
            some = np.flatnonzero(known[:, i])
            table[some, at[some, i]] |= _ONE << np.uint64(i)
        return table

    def counted(self, table: np.ndarray, n: int, least: float, tokens: float, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each asked name of n letters the weight of the names whose partial score reaches `least` or whose token score
        reaches `tokens`, and the best partial score that reaches `least`, 0 if none does. `best` has the best ones known
        before, at least `least`, and is raised; scores below it needn't be found."""
        links, found = np.zeros(len(table), np.int64), np.zeros(len(table))
        for _ in self._walk(table, n, np.full(len(table), least), tokens, (links, found, best)):
            pass
        return links, found

    def reached(self, table: np.ndarray, n: int, least: np.ndarray):
        """(asked, row) of the names whose partial score reaches that asked name's `least`, in parts."""
        for q, at, _ in self._walk(table, n, least, None):
            yield q, self.rows[at]

    def by_tokens(self, table: np.ndarray, n: int, tokens: float):
        """(asked, row, partial score) of the names whose token score reaches `tokens`, in parts."""
        for q, at, score in self._walk(table, n, np.zeros(len(table)), tokens):
            yield q, self.rows[at], score

    def token_scores(self, table: np.ndarray, n: int, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Token scores of pairs of one-word names: asked ones by number, names by row."""
        place = np.empty(len(self.rows), np.int64)
        place[self.rows] = np.arange(len(self.rows))
        left, full = np.full(len(asked), _bits(0, n)), _bits(0, n)
        for d in range(self.size):
            hit = left & table[asked, self.codes[place[rows], d]]
            left = ((left + hit) | (left - hit)) & full
        return 200 * (n - np.bitwise_count(left).astype(np.int64)) / (n + self.size)

    def _walk(self, table: np.ndarray, n: int, least: np.ndarray, tokens: float | None, count: tuple | None = None):
        """With count, (links, found, best): adds to them, over the graph. Else gives (asked, place in the tree, partial score)
        of those that reach least (tokens is None) or tokens, over the tree."""
        k, graph = self.size, self.graph if count else self.tree
        short, low = min(n, k), float(least.min())
        whole = tokens is not None and 200 * short / (n + k) >= tokens - NEAR
        if tokens is not None and not whole and not count:
            return
        # the shortest window that can score enough; windows of the longer one begin at `starts`
        shortest = max(1, ceil(low * short / (200 - low) - NEAR))
        starts = range(max(n, k) - shortest + 1)
        within = n > k  # the asked name is the longer one: its windows are bits, and all begin at once
        begin = [0 if within else s for s in starts]
        end = [k if within else min(s + n, k) for s in starts]
        wide = [min(k, n - s) if within else e - s for s, e in zip(starts, end)]
        full = [_bits(s, n if s == 0 else s + wide[s]) if within else _bits(0, n) for s in starts]
        zero = lambda row, bits: (np.bitwise_count(~row & bits)).astype(np.int64)
        q = np.arange(len(table))
        stack = [(0, q, np.zeros(len(q), np.int64), np.ones(len(q), np.int64), np.zeros(len(q), bool), np.zeros(len(q)), {})]
        while stack:
            d, q, at, times, sure, score, rows = stack.pop()
            first, letter, to = graph[d]
            size = first[at + 1] - first[at]
            total = int(size.sum())
            if total * (len(rows) + 4) > STEP and len(q) > 1:
                half = len(q) // 2
                for part in (slice(half, None), slice(half)):
                    stack.append((d, q[part], at[part], times[part], sure[part], score[part], {s: r[part] for s, r in rows.items()}))
                continue
            rows = rows | {s: np.full(len(q), full[s]) for s in starts if begin[s] == d}
            up = np.repeat(np.arange(len(q)), size)
            edge = np.arange(total) + np.repeat(first[at] - np.cumsum(size) + size, size)
            q, at, times, sure, score = q[up], to[edge], times[up], sure[up], score[up]
            bits = table[q, letter[edge]]
            d += 1
            for s, row in rows.items():
                row = row[up]
                hit = row & bits
                rows[s] = ((row + hit) | (row - hit)) & full[s]
            enough, bounds = least[q], {}
            for s, row in rows.items():  # scores of windows that end here, bounds of those that don't
                if s == 0 and within:
                    bounds[0] = np.zeros(len(q))
                    for w in range(shortest, k + 1):
                        common = zero(row, _bits(0, w))
                        if d == k:
                            value = 200 * common / (k + w)
                            score = np.where(value >= enough, np.maximum(score, value), score)
                        else:
                            bounds[0] = np.maximum(bounds[0], 200 * np.minimum(w, common + k - d) / (k + w))
                    continue
                if d > end[s]:
                    continue  # the whole name's row goes on
                common = zero(row, full[s])
                if d == end[s] or (s == 0 and d >= shortest):
                    value = 200 * common / (short + (wide[s] if d == end[s] else d))
                    score = np.where(value >= enough, np.maximum(score, value), score)
                if d < end[s]:
                    bounds[s] = 200 * np.minimum(wide[s], common + end[s] - d) / (short + wide[s])
            ahead = max((200 * wide[s] / (short + wide[s]) for s in starts if begin[s] >= d), default=0) if not within and d < k else 0
            open_ = np.zeros(len(q), bool)
            if whole:
                common = zero(rows[0], _bits(0, n)) if 0 in rows else np.zeros(len(q), np.int64)
                sure = sure | (200 * common / (n + k) >= tokens)
                if d < k:
                    open_ = ~sure & (200 * np.minimum(common + k - d, n) / (n + k) >= tokens - NEAR)
            if count:
                links, found, best = count
                sure = sure | (score >= enough)
                np.maximum.at(best, q, score)
                np.maximum.at(found, q, score)
                wanted = np.where(sure, np.maximum(best[q] - NEAR, score + NEAR), enough - NEAR)
            elif tokens is None:
                sure = sure | (score >= enough)
                wanted = np.where(sure, np.inf, enough - NEAR)
            else:
                wanted = score + NEAR
            use = {s: b >= wanted for s, b in bounds.items()}
            alive = open_ | (ahead >= wanted) if ahead else open_
            for u in use.values():
                alive = alive | u
            if count:
                done = sure & ~alive
                np.add.at(links, q[done], times[done] * self.weights[d][at[done]])
                keep = alive
            else:
                keep = sure | (open_ if whole else alive)
            if d == k:
                if not count and sure.any():
                    yield q[sure], at[sure], score[sure]
                continue
            kept = np.flatnonzero(keep)
            if not len(kept):
                continue
            q, at, times, sure, score, open_ = q[kept], at[kept], times[kept], sure[kept], score[kept], open_[kept]
            left = {}
            for s, row in rows.items():
                u = use[s][kept] if s in use else np.zeros(len(kept), bool)
                row = row[kept]
                if s == 0 and whole:
                    if within:  # only the windows' letters matter
                        row = np.where(open_, row, row | _bits(k, n))
                    u = u | open_
                if u.any():
                    left[s] = np.where(u, row, full[s])
            if count and len(self.graph[d][0]) < 0.7 * len(self.tree[d][0]):
                q, at, times, sure, score, left = self._same(q, at, times, sure, score, left)
            stack.append((d, q, at, times, sure, score, left))

    @staticmethod
    def _same(q, at, times, sure, score, rows):
        """States that are the same put together; a hash only brings them side by side."""
        columns = [q, at, sure, score, *rows.values()]
        mixed = (q.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64)) * _MIX
        for c in (sure.astype(np.uint64), score.view(np.uint64), *rows.values()):
            mixed = ((mixed ^ (mixed >> np.uint64(31))) + c) * _MIX
        order = np.argsort(mixed)
        differ = np.arange(len(order)) == 0
        for c in columns:
            c = c[order]
            differ[1:] |= c[1:] != c[:-1]
        begin = np.flatnonzero(differ)
        first = order[begin]
        return q[first], at[first], np.add.reduceat(times[order], begin), sure[first], score[first], {s: r[first] for s, r in rows.items()}


def _plain(name: str, most: int) -> bool:
    return 0 < len(name) <= most and _words(name) == 1


def links_of(asked: list[str], names: list[str], weights: np.ndarray, places: np.ndarray, least: float, tokens: float):
    """(number in asked, links, partial, tokens, row) of each asked name with a link: the weight of the (distinct) names whose
    partial score reaches `least` or whose token score reaches `tokens`, and the best of them, by partial, tokens, place and
    row."""
    links, best = np.zeros(len(asked), np.int64), {}

    def offer(number: np.ndarray, row: np.ndarray, partial: np.ndarray, token: np.ndarray):
        order = np.lexsort((row, places[row], -token, -partial, number))
        first = order[np.append(True, number[order][1:] != number[order][:-1])] if len(order) else order
        for i, *mine in zip(number[first].tolist(), (-partial[first]).tolist(), (-token[first]).tolist(), places[row[first]].tolist(), row[first].tolist()):
            best[i] = min(best.get(i, mine), mine)

    def one_by_one(some: list[int], rows: list[int]):
        for a in range(0, len(rows) if some else 0, PIECE):
            part = np.array(rows[a : a + PIECE])
            index = NameIndex([names[r] for r in part])
            for b in range(0, len(some), BOUNDS):
                now = some[b : b + BOUNDS]
                for i, *bound in zip(now, *index.bounds([asked[i] for i in now])):
                    found, x, y = index.reaching(asked[i], *bound, least, tokens)
                    links[i] += weights[part[found]].sum()
                    offer(np.full(len(found), i), part[found], x, y)

    by_size, few, graphs = {}, [], []
    for row, name in enumerate(names):
        (by_size.setdefault(len(name), []) if _plain(name, LONG) else few).append(row)
    for rows in by_size.values():
        graph = NameGraph([names[r] for r in rows], weights[rows]) if len(rows) >= FEW_NAMES else None
        if graph and graph.alike:
            graphs.append((graph, np.array(rows)))
        else:
            few += rows
    one_by_one(list(range(len(asked))), few)
    one_by_one([i for i, name in enumerate(asked) if not _plain(name, WORD)], [r for _, rows in graphs for r in rows])
    together: dict[int, list[int]] = {}
    for i, name in enumerate(asked):
        if graphs and _plain(name, WORD):
            together.setdefault(len(name), []).append(i)
    top = np.full(len(asked), float(least))  # best partial scores as far as known
    for i, x in best.items():
        top[i] = max(top[i], -x[0])
    step = max(1, min(TOGETHER, TABLE // max((len(g.letters) for g, _ in graphs), default=1)))
    for n, group in together.items():
        for a in range(0, len(group), step):
            some = np.array(group[a : a + step])
            texts, seen = [asked[i] for i in some], []
            for graph, rows in graphs:
                now = top[some]
                got, found = graph.counted(graph.table(texts), n, least, tokens, now)
                top[some], links[some] = now, links[some] + got
                seen.append((got, found))
            without = np.array([i not in best or -best[i][0] < least for i in some]) & (top[some] <= least) & ~np.any([f >= least for _, f in seen], axis=0)
            for (graph, rows), (got, found) in zip(graphs, seen):
                hit = np.flatnonzero((found >= least) & (found >= top[some]))
                if len(hit):  # those that score best
                    table = graph.table([texts[i] for i in hit])
                    for q, row in graph.reached(table, n, top[some[hit]]):
                        offer(some[hit[q]], rows[row], top[some[hit[q]]], graph.token_scores(table, n, q, row))
                hit = np.flatnonzero(without & (got > 0))
                if len(hit):  # links by tokens only
                    table = graph.table([texts[i] for i in hit])
                    for q, row, score in graph.by_tokens(table, n, tokens):
                        offer(some[hit[q]], rows[row], score, graph.token_scores(table, n, q, row))
    for i in np.flatnonzero(links).tolist():
        partial, token, _, row = best[i]
        yield i, int(links[i]), -partial, -token, row
