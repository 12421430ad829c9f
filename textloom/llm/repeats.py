"""Maximal runs (periodic stretches of words) by branching tandem repeats of a suffix tree.

The tree of a text is kept as its suffix order, found by doubling, and the intervals of common prefixes: an inner node is an interval of
suffixes that agree in ``depth`` words and no more. A branching tandem repeat ww stands at x if the suffixes at x and x + |w| hang below the
node of depth |w| in different children. Every leaf outside a node's largest child is asked for its two partners, at +depth and -depth
(the smaller half: at most n log n leaves in all). A repeat is rotated left as long as the words ``depth`` apart agree; that gives the
maximal run it ends, and runs over the same stretch merge into the one of the smallest period.

All texts of a batch share one order, told apart by their number. Equal words are told by dictionary codes, never by hashes, and the ranks of each
doubling answer every comparison, so results are exact. A run of ``least`` words and ``times`` periods repeats some stretch of
``_reach`` words; texts in which none of that length stands twice have no run and need no tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WORD, bounded_batches, text_of, tidied

LEAST, TIMES = 24, 3
#: Words of the texts whose tree is made at once (a longer text is alone), and leaves that are asked at once.
WORDS, LEAVES = 1 << 19, 1 << 20


def words_of(text: str | Column) -> Column:
    """The words of a text, an empty array if null."""
    return F.regexp_extract_all(text_of(text), F.lit(f"({WORD})"), F.lit(1))


def _reach(least: int, times: int) -> int:
    """The smallest overlap of a run with itself, moved by its period q: least - q or (times - 1) * q words, whichever is more."""
    return max(1, min(max(least - q, (times - 1) * q) for q in range(1, least + 1)))


def _ordered(code: np.ndarray, own: np.ndarray, left: np.ndarray, reach: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(suffix order, ranks by 1, 2, 4, .. words, numbers of the texts in which a stretch of ``reach`` words stands twice).

    A rank is the place of the first suffix that is alike; texts and suffixes that end are alike to none. Only places still shared are sorted again.
    """
    n = len(code)
    key = own * (int(code.max()) + 1) + code
    order = np.argsort(key, kind="stable")
    head = np.r_[True, key[order][1:] != key[order][:-1]]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    levels, h, deep = [rank.astype(np.int32)], 1, np.unique(own)
    while True:
        shared = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if 2 * h > reach >= h or h < reach and not len(shared):
            deep = np.unique(own[order[shared]])
            shared = shared[np.isin(own[order[shared]], deep)]
        if not len(shared):
            return order, levels, deep
        at = order[shared]
        on = left[at] > h
        key = rank[at] * (n + 1) + np.where(on, rank[np.where(on, at + h, 0)] + 1, 0)
        again = np.argsort(key, kind="stable")
        order[shared] = at[again]
        key = key[again]
        head[shared] = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[order[shared]] = np.maximum.accumulate(np.where(head[shared], shared, 0))
        h *= 2
        levels.append(rank.astype(np.int32))


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, first: np.ndarray, back: bool) -> np.ndarray:
    """Words that agree from places a < b of a text on, or before them when ``back``; ``first`` is where the text of a starts."""
    got = np.zeros(len(a), np.int64)
    n = len(levels[0])
    for i in reversed(range(len(levels))):
        x, y = (a - got - (1 << i), b - got - (1 << i)) if back else (a + got, b + got)
        ok = (x >= first) if back else (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[ok] = levels[i][x[ok]] == levels[i][y[ok]]
        got[same] += 1 << i
    return got


def _bounds(depth: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each place the interval [l, r) of the node that parts it from the place before: depths inside are not smaller."""
    left, right, open_ = [0] * len(depth), [len(depth)] * len(depth), []
    for k, d in enumerate(depth):
        while open_ and depth[open_[-1]] > d:
            right[open_.pop()] = k
        top = open_[-1] if open_ else 0
        left[k] = left[top] if open_ and depth[top] == d else top
        open_.append(k)
    return np.array(left, np.int64), np.array(right, np.int64)


def _branching(order: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Leaves outside their node's largest child, in parts: (place in the order, depth, node from, to, child from, to)."""
    left, right = _bounds(depth.tolist())
    inner = np.flatnonzero(depth > 0)
    if not len(inner):
        return
    inner = inner[np.lexsort((inner, right[inner], left[inner]))]
    new = np.r_[True, (left[inner][1:] != left[inner][:-1]) | (right[inner][1:] != right[inner][:-1])]
    # children of a node: from its left end to the first parting place, and from each parting place to the next or the right end
    node = np.cumsum(new) - 1
    begins, ends = left[inner[new]], right[inner[new]]
    lo = np.concatenate([begins, inner])
    of = np.concatenate([np.arange(len(begins)), node])
    by = np.lexsort((lo, of))
    lo, of = lo[by], of[by]
    hi = np.where(np.r_[of[1:] != of[:-1], True], ends[of], np.r_[lo[1:], 0])
    size = hi - lo
    largest = np.lexsort((lo, -size, of))
    largest = largest[np.r_[True, of[largest][1:] != of[largest][:-1]]]
    small = np.ones(len(lo), bool)
    small[largest] = False
    lo, hi, of, size = lo[small], hi[small], of[small], size[small]
    deep = depth[inner[new]][of]
    total = np.cumsum(size)
    start = 0
    while start < len(lo):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + LEAVES, "right")))
        part = np.repeat(np.arange(start, stop), size[start:stop])
        offset = np.arange(len(part)) - np.repeat(total[start:stop] - size[start:stop] - (total[start - 1] if start else 0), size[start:stop])
        yield lo[part] + offset, deep[part], begins[of[part]], ends[of[part]], lo[part], hi[part]
        start = stop


def runs_of(code: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period; ``code`` has the texts' words one after another, ``sizes`` their numbers."""
    none = np.zeros((0, 4), np.int64)
    if not len(code):
        return none
    own = np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)[own]
    order, levels, deep = _ordered(code.astype(np.int64), own, end - np.arange(len(code)), _reach(least, times))
    order = order[np.isin(own[order], deep)]
    if not len(order):
        return none
    same = np.r_[False, own[order][1:] == own[order][:-1]]
    depth = np.full(len(order), -1, np.int64)
    a, b = order[np.flatnonzero(same) - 1], order[same]
    depth[same] = _common(levels, a, b, a, False)
    place = np.empty(len(code), np.int64)
    place[order] = np.arange(len(order))
    first = end - sizes[own]
    found = []
    for leaf, q, lo, hi, child_lo, child_hi in _branching(order, depth):
        x = order[leaf]
        for y, start in ((x + q, x), (x - q, x - q)):
            ok = (y >= first[x]) & (y < end[x])
            at = place[np.where(ok, y, x)]
            ok &= (at >= lo) & (at < hi) & ~((at >= child_lo) & (at < child_hi))
            found.append(np.c_[start[ok], q[ok]])
    x, q = np.unique(np.concatenate(found), axis=0).T if found else np.zeros((2, 0), np.int64)
    if not len(x):
        return none
    turned = _common(levels, x, x + q, first[x], True)
    start, length = x - turned, 2 * q + turned
    ok = (length >= least) & (length >= times * q)
    start, length, q = start[ok], length[ok], q[ok]
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    shortest = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    start, length, q = start[shortest], length[shortest], q[shortest]
    by = np.lexsort((q, start))
    return np.c_[own[start], start - first[start], length, q][by]


def periodic_runs(rows: DataFrame, words_col: str, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``rows`` without ``words_col`` but with runs array<struct<start, length, period>> by start, then period, and collapsed, the words joined by a blank without those that a run repeats after its first period.

    A run is a stretch of words with smallest period q, of at least ``least`` and ``times`` * q words, that cannot be extended. Null or empty arrays have no runs and
    collapse to an empty string; a null word counts as an empty one. Repeated rows and null ids stay as they are; runs and collapsed replace columns of these
    names, others are kept. Texts of any length count whole. An empty table gives no rows.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.drop("runs", "collapsed")
    rest = [c for c in rows.columns if c != words_col]
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def of(part: pa.RecordBatch, words: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        code = words.dictionary_encode().indices.to_numpy()
        found = runs_of(code, sizes, least, times)
        first, keep = np.r_[0, np.cumsum(sizes)], np.ones(len(words), bool)
        for t, start, length, q in found:
            keep[first[t] + start + q : first[t] + start + length] = False
        own = np.repeat(np.arange(len(sizes)), sizes)
        offsets = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        left = pa.ListArray.from_arrays(offsets(np.bincount(own[keep], minlength=len(sizes))), words.filter(pa.array(keep)))
        runs = pa.ListArray.from_arrays(offsets(np.bincount(found[:, 0], minlength=len(sizes))), pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), runs.cast(kind), pc.binary_join(left, " ")], [*rest, "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(words_col)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            words, first = pc.fill_null(lists.flatten(), ""), np.r_[0, np.cumsum(sizes)]
            lo = 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + WORDS, "right")) - 1)
                yield of(batch.slice(lo, hi - lo), words.slice(first[lo], first[hi] - first[lo]), sizes[lo:hi])
                lo = hi

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != words_col]
    return rows.mapInArrow(tidied(run), ", ".join([*fields, "runs array<struct<start: long, length: long, period: long>>", "collapsed string"]))
