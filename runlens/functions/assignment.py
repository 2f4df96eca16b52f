"""Span lists and maps scored for a whole Arrow batch at once: word bags, keyed values, and the best one-to-one assignment."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType


#: What Python reads as a float, as in ``text.FLOAT``.
FLOAT = r"\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*\Z"

#: Words and spans compared at once.
AT_ONCE = 1 << 19


def _solvers():
    """(largest_sums, sums_of, span_scores, map_scores); nested, so that they are shipped whole and workers need no package."""
    float_like = re.compile(FLOAT, re.I)
    together = 1 << 22  # cells of matrices solved at once
    at_once = AT_ONCE

    def largest_sums(scores: np.ndarray) -> np.ndarray:
        """Largest sum of a one-to-one choice from each of a stack of matrices (rows no more than columns), by shortest augmenting paths.

        Every row in turn looks for its path in all matrices at once; a matrix
        leaves the search when its path has reached a free column.
        """
        cost = -scores
        count, n, m = cost.shape
        u, v = np.zeros((count, n + 1)), np.zeros((count, m + 1))
        row_of = np.zeros((count, m + 1), np.int64)
        everyone = np.arange(count)
        for i in range(1, n + 1):
            row_of[:, 0] = i
            least, came = np.full((count, m + 1), np.inf), np.zeros((count, m + 1), np.int64)
            used = np.zeros((count, m + 1), bool)
            at, live = np.zeros(count, np.int64), everyone
            while len(live):
                here = at[live]
                used[live, here] = True
                row = row_of[live, here]
                slack = cost[live, row - 1] - u[live, row][:, None] - v[live, 1:]
                free, best, back = ~used[live, 1:], least[live, 1:], came[live, 1:]
                better = free & (slack < best)
                best[better] = slack[better]
                came[live, 1:] = np.where(better, here[:, None], back)
                to = np.where(free, best, np.inf).argmin(1) + 1
                step = best[np.arange(len(live)), to - 1][:, None]
                taken = used[live]
                u[live[:, None], row_of[live]] += np.where(taken, step, 0.0)  # a row stands in one column; columns without one add 0
                v[live] -= np.where(taken, step, 0.0)
                best -= np.where(free, step, 0.0)
                least[live, 1:] = best
                at[live] = to
                live = live[row_of[live, to] > 0]
            live = everyone
            while len(live):
                here = at[live]
                back = came[live, here]
                row_of[live, here] = row_of[live, back]
                at[live] = back
                live = live[back > 0]
        b, j = np.nonzero(row_of[:, 1:])
        return np.bincount(b, scores[b, row_of[b, j + 1] - 1, j], minlength=count)

    def sums_of(rows: np.ndarray, columns: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Largest sums of matrices whose cells (not negative) follow one another; padded to powers of two, solved by size."""
        out = np.zeros(len(rows))
        sizes = rows * columns
        matrix = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(cells)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = np.repeat(columns, sizes)
        r, c = place // np.maximum(wide, 1), place % np.maximum(wide, 1)
        flip = np.repeat(rows > columns, sizes)
        r, c = np.where(flip, c, r), np.where(flip, r, c)
        up = lambda x: 1 << np.ceil(np.log2(np.maximum(x, 1))).astype(np.int64)
        few, many = up(np.minimum(rows, columns)), up(np.maximum(rows, columns))
        for n, m in {*zip(few[sizes > 0].tolist(), many[sizes > 0].tolist())}:
            same = np.flatnonzero((few == n) & (many == m) & (sizes > 0))
            for at in range(0, len(same), max(1, together // (n * m))):
                some = same[at : at + max(1, together // (n * m))]
                to = np.full(len(rows), -1)
                to[some] = np.arange(len(some))
                own = np.flatnonzero(to[matrix] >= 0)
                stack = np.zeros((len(some), n, m))
                stack[to[matrix[own]], r[own], c[own]] = np.nan_to_num(cells[own])
                out[some] = largest_sums(stack)
        return out

    def flags(x: pa.Array) -> np.ndarray:
        return x.is_null().to_numpy(zero_copy_only=False)

    def sizes_of(x: pa.Array) -> np.ndarray:
        """Lengths of lists, 0 for null; worked out by Arrow, as an array without lists may come without offsets."""
        return pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def starts(sizes: np.ndarray) -> np.ndarray:
        return np.cumsum(sizes) - sizes

    def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, place in it) of each item of groups with these sizes."""
        group = np.repeat(np.arange(len(sizes)), sizes)
        return group, np.arange(len(group)) - starts(sizes)[group]

    def crossed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, left item, right item) of all pairs within groups that have ``a`` items on the left and ``b`` on the right."""
        group, place = spread(a * b)
        return group, starts(a)[group] + place // np.maximum(b[group], 1), starts(b)[group] + place % np.maximum(b[group], 1)

    def codes(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
        """Numbers for the texts of both arrays, and the texts by number."""
        both = pa.concat_arrays([left.cast(pa.large_string()), right.cast(pa.large_string())]).dictionary_encode()
        n = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return n[: len(left)], n[len(left) :], both.dictionary.to_pylist()

    class Bags:
        """Distinct words of spans: sizes, whether they have a number, and keys (span, word) in order."""

        def __init__(self, sizes: np.ndarray, words: np.ndarray, number: np.ndarray):
            self.many = max(1, len(number))
            span, _ = spread(sizes)
            self.keys = np.unique(span * self.many + words)
            self.size = np.bincount(self.keys // self.many, minlength=len(sizes))
            self.numbered = np.bincount(self.keys // self.many, number[self.keys % self.many], minlength=len(sizes)) > 0
            self.start = starts(self.size)

    def cuts(work: np.ndarray) -> list[slice]:
        """Slices of items whose work is at most ``at_once`` together, or one item each."""
        ends = np.cumsum(work)
        out, at = [], 0
        while at < len(work):
            to = max(at + 1, int(np.searchsorted(ends, at_once + (ends[at - 1] if at else 0), "right")))
            out.append(slice(at, to))
            at = to
        return out

    def in_slices(scores, work):
        """``scores`` over rows in slices, so that memory doesn't grow with a batch's rows."""
        return lambda gold, pred: pa.concat_arrays([pa.array([], pa.float64()), *(scores(gold[s], pred[s]) for s in cuts(work(gold, pred)))])

    def items_of(x: pa.Array) -> np.ndarray:
        """Items of the lists in each row's list."""
        return np.bincount(spread(sizes_of(x))[0], sizes_of(x.flatten()), minlength=len(x))

    def pairs_of(gold: pa.Array, pred: pa.Array) -> np.ndarray:
        return (items_of(gold) + sizes_of(gold)) * sizes_of(pred) + items_of(pred) + 1

    def bag_f1(a: Bags, b: Bags, left: np.ndarray, right: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """F1 of bag pairs, with the left and then the right one as gold: 0 if the gold one has numbers and shares none, 1 if both are empty."""
        parts = [some_f1(a, b, left[s], right[s], number) for s in cuts(a.size[left] + 1)]
        return tuple(np.concatenate([np.zeros(0), *x]) for x in (zip(*parts) if parts else ((), ())))

    def some_f1(a: Bags, b: Bags, left: np.ndarray, right: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair, place = spread(a.size[left])
        word = a.keys[a.start[left][pair] + place] % a.many
        key = right[pair] * b.many + word
        at = np.minimum(np.searchsorted(b.keys, key), max(0, len(b.keys) - 1))
        hit = b.keys[at] == key if len(b.keys) else np.zeros(len(key), bool)
        shared = np.bincount(pair[hit], minlength=len(left))
        alike = np.bincount(pair[hit], number[word[hit]], minlength=len(left)) > 0
        total = a.size[left] + b.size[right]
        f1 = np.where(total == 0, 1.0, 2 * shared / np.maximum(total, 1))
        return np.where(a.numbered[left] & ~alike, 0.0, f1), np.where(b.numbered[right] & ~alike, 0.0, f1)

    def bags_of(left: pa.Array, right: pa.Array) -> tuple[Bags, Bags, np.ndarray]:
        """Bags of two arrays of word lists."""
        a, b, words = codes(left.flatten(), right.flatten())
        number = np.array([bool(float_like.match(w)) for w in words] or [False])
        return Bags(sizes_of(left), a, number), Bags(sizes_of(right), b, number), number

    def span_scores(gold: pa.Array, pred: pa.Array) -> pa.Array:
        """Best alignment of two lists of word lists over the longer one; null if either is null or has a null, or is empty."""
        g, p = sizes_of(gold), sizes_of(pred)
        left, right = gold.flatten(), pred.flatten()
        bad = flags(gold) | flags(pred) | (np.minimum(g, p) == 0)
        bad |= (np.bincount(spread(g)[0], flags(left), minlength=len(g)) + np.bincount(spread(p)[0], flags(right), minlength=len(p))) > 0
        a, b, number = bags_of(left, right)
        _, i, j = crossed(g, p)
        total = sums_of(g, p, bag_f1(a, b, i, j, number)[0])
        return pa.array(total / np.maximum(1, np.maximum(g, p)), mask=bad)

    def ratio(g: np.ndarray, p: np.ndarray) -> np.ndarray:
        """1 - ln(larger / smaller), at least 0; zeros count as 1e-4 but are equal to each other, other signs score 0."""
        with np.errstate(all="ignore"):
            a, b = np.where(g == 0, 1e-4, g), np.where(p == 0, 1e-4, p)
            out = np.where(a > 0, np.maximum(0, 1 - np.log(np.maximum(a, b) / np.minimum(a, b))), (a == b).astype(float))
            return np.nan_to_num(np.where((g == 0) & (p == 0), 1.0, np.where(a * b > 0, out, 0.0)))

    def map_scores(gold: pa.Array, pred: pa.Array) -> pa.Array:
        """Best alignment of two lists of maps over the longer one.

        Maps are lists of (key, kind, number, words); two are scored by the F1 of
        the mean key scores over the gold keys and over the predicted ones. Null
        if a list is null or empty, or has a null map.
        """
        g, p = sizes_of(gold), sizes_of(pred)
        gm, pm = gold.flatten(), pred.flatten()
        bad = flags(gold) | flags(pred) | (np.minimum(g, p) == 0)
        bad |= (np.bincount(spread(g)[0], flags(gm), minlength=len(g)) + np.bincount(spread(p)[0], flags(pm), minlength=len(p))) > 0
        ge, pe = gm.flatten(), pm.flatten()
        gn, pn = sizes_of(gm), sizes_of(pm)
        gk, pk, names = codes(ge.field(0), pe.field(0))
        kinds = [e.field(1).to_numpy(zero_copy_only=False).astype(np.int64) for e in (ge, pe)]
        numbers = [e.field(2).to_numpy(zero_copy_only=False).astype(float) for e in (ge, pe)]
        gs, ps = ge.field(3), pe.field(3)
        spans = [sizes_of(x) for x in (gs, ps)]
        gw, pw = gs.flatten(), ps.flatten()
        odd = [np.bincount(spread(n)[0], flags(w), minlength=len(n)) > 0 for n, w in zip(spans, (gw, pw))]
        row, i, j = crossed(g, p)
        # keys that both maps of a pair have
        pair, place = spread(gn[i])
        left = starts(gn)[i][pair] + place
        many = max(1, len(names))
        held = np.repeat(np.arange(len(pn)), pn) * many + pk
        order = np.argsort(held)
        key = j[pair] * many + gk[left]
        at = np.minimum(np.searchsorted(held[order], key), max(0, len(held) - 1))
        hit = held[order[at]] == key if len(held) else np.zeros(len(key), bool)
        pair, left, right = pair[hit], left[hit], order[at[hit]] if len(held) else at[hit]
        kind = np.where(kinds[0][left] == kinds[1][right], kinds[0][left], -1)
        forth, back = np.zeros(len(left)), np.zeros(len(left))
        own = kind == 0
        forth[own] = back[own] = ratio(numbers[0][left[own]], numbers[1][right[own]])
        own = np.flatnonzero((kind == 1) | (kind == 2) & ~odd[0][left] & ~odd[1][right])
        a, b = spans[0][left[own]], spans[1][right[own]]
        cell, place = spread(a * b)
        x = starts(spans[0])[left[own]][cell] + place // np.maximum(b[cell], 1)
        y = starts(spans[1])[right[own]][cell] + place % np.maximum(b[cell], 1)
        ga, pa_, number = bags_of(gw, pw)
        for out, scores in zip((forth, back), bag_f1(ga, pa_, x, y, number)):
            out[own] = sums_of(a, b, scores) / np.maximum(1, np.maximum(a, b))
        other = [np.bincount(np.repeat(np.arange(len(n)), n), k == 3, minlength=len(n)) > 0 for n, k in zip((gn, pn), kinds)]
        none = other[0][i] | other[1][j] | (gn[i] == 0) | (pn[j] == 0)
        r = np.bincount(pair, forth, minlength=len(i)) / np.maximum(1, gn[i])
        q = np.bincount(pair, back, minlength=len(i)) / np.maximum(1, pn[j])
        f1 = np.where(none | (r + q == 0), 0.0, 2 * r * q / np.where(r + q == 0, 1, r + q))
        return pa.array(sums_of(g, p, f1) / np.maximum(1, np.maximum(g, p)), mask=bad)

    return largest_sums, sums_of, in_slices(span_scores, pairs_of), in_slices(map_scores, pairs_of)


largest_sums, sums_of, _span_scores, _map_scores = _solvers()

#: Columns of gold and predicted span lists (each span its words) -> best one-to-one alignment over the longer list.
span_alignment = arrow_udf(_span_scores, DoubleType())
#: Columns of gold and predicted lists of maps, as lists of struct(key, kind, number, words) -> best one-to-one alignment over the longer list.
map_alignment = arrow_udf(_map_scores, DoubleType())
