"""Periodic runs of words, by Crochemore's partition refinement.

At level l, two places of a document are in one class if the l words from them are equal.  The
classes of level l + 1 come from those of level l by splitting: a place leaves its class if the next
place is in a class that was split off.  Of the children of a split class all but the largest are
used for splitting (the smaller half), so that the refinement costs n log n steps for n words.

Places of a class are linked in order.  Neighbours of distance l at level l begin a primitively
rooted square of period l, and consecutive squares of one period are one maximal run.  A run that
repeats at least four times has three places in each of its classes, so that smaller classes are left
alone, exactly, and links are remembered only where a neighbouring link has the same distance.

The documents of a block are refined together, each with classes of its own, so that every level is
a few numpy operations over what changes; memory is bounded by the block (about 4 MB of text, or one
longer document).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.textops import slices, trim
from itemloom.llm.workspace import small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXPONENT = 4
LEAST = 6
#: Bytes of text that are refined together, so that a level's fixed cost is shared.
TOGETHER = 1 << 22


class _Partition:
    """Classes of places as segments of one array, and the links between neighbours of a class."""

    def __init__(self, cls: np.ndarray, least: int):
        n, self.least = len(cls), least
        self.cls, self.perm = cls, np.argsort(cls, kind="stable")
        self.loc = np.empty(n, np.int64)
        self.loc[self.perm] = np.arange(n)
        self.size = np.zeros(2 * n + 2, np.int64)
        counts = np.bincount(cls)
        self.size[: len(counts)] = counts
        self.start = np.zeros(2 * n + 2, np.int64)
        self.start[1 : len(counts)] = np.cumsum(counts)[:-1]
        self.classes = len(counts)
        self.next, self.prev = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        linked = cls[self.perm[1:]] == cls[self.perm[:-1]]
        self.next[self.perm[:-1][linked]] = self.perm[1:][linked]
        self.prev[self.perm[1:][linked]] = self.perm[:-1][linked]
        self.alive = counts[cls] >= least
        self.flag = np.zeros(n, bool)

    def members(self, which: np.ndarray) -> np.ndarray:
        """Places of the given classes."""
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        return self.perm[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[which] - ends + sizes, sizes)]

    def chained(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of links beside a link of the same distance, with that distance, among ``places`` and their neighbours."""
        places = places[self.alive[places] & (self.next[places] >= 0)]
        after = self.next[places]
        gap = after - places
        left, right = self.prev[places] == places - gap, self.next[after] == after + gap
        at = np.concatenate([places[left | right], places[left] - gap[left], after[right]])
        return at, np.concatenate([gap[left | right], gap[left], gap[right]])

    def refine(self, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One level on: the next splitters, and places whose link is new."""
        before = splitters - 1
        ok = (before >= 0) & self.alive[before]
        before = before[ok]
        if not len(before):
            return before, before
        own, key = self.cls[before], self.cls[before] * self.classes + self.cls[splitters[ok]]
        order = np.lexsort((before, key))
        before, own, key = before[order], own[order], key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes, parent = np.diff(np.append(first, len(key))), own[first]
        head = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        parents, nth = parent[head], np.cumsum(np.concatenate(([0], parent[1:] != parent[:-1])))
        total = np.add.reduceat(sizes, head)
        # Where nothing else is left of a class, its largest part keeps the class; a part that is all of it doesn't split it.
        largest = np.lexsort((-sizes, nth))[head]
        stays = np.zeros(len(sizes), bool)
        stays[largest[total == self.size[parents]]] = True
        moved = np.repeat(~stays, sizes)
        before, own = before[moved], own[moved]
        sizes, parent = sizes[~stays], parent[~stays]
        if not len(before):
            return before, before
        head = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        parents, nth = parent[head], np.cumsum(np.concatenate(([0], parent[1:] != parent[:-1])))
        total = np.add.reduceat(sizes, head)
        self._unlink(before, own)
        fresh = self._segments(before, sizes, parents, total)
        self.size[parents] -= total
        rest = self.size[parents]
        gone = np.concatenate([self.members(parents[rest < self.least]), before[np.repeat(sizes < self.least, sizes)]])
        # The smaller half: all children but the largest split others at the next level.
        largest = np.lexsort((-sizes, nth))[head]
        swap = sizes[largest] > rest
        small = np.ones(len(sizes), bool)
        small[largest[swap]] = False
        splitters = np.concatenate([before[np.repeat(small, sizes)], self.members(parents[swap])])
        self.alive[gone] = False
        linked = np.ones(len(before), bool)
        linked[np.cumsum(sizes) - 1] = False
        inner = np.flatnonzero(linked)
        self.next[before], self.prev[before] = -1, -1
        self.next[before[inner]], self.prev[before[inner + 1]] = before[inner + 1], before[inner]
        self.cls[before] = np.repeat(fresh, sizes)
        return splitters, np.concatenate([before[inner], self.bridged])

    def _unlink(self, moved: np.ndarray, own: np.ndarray) -> None:
        """Takes places out of their lists; ``bridged`` are the places before the gaps."""
        at = moved[np.lexsort((moved, own))]
        begins = np.concatenate(([True], self.next[at[:-1]] != at[1:]))
        ends = np.concatenate((begins[1:], [True]))
        left, right = self.prev[at[begins]], self.next[at[ends]]
        some = left >= 0
        self.next[left[some]] = right[some]
        some &= right >= 0
        self.bridged = left[some]
        some = right >= 0
        self.prev[right[some]] = left[some]

    def _segments(self, moved: np.ndarray, sizes: np.ndarray, parents: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Puts the parts at the ends of their classes' segments, as new classes whose numbers it returns."""
        zone = self.start[parents] + self.size[parents] - total
        base = np.cumsum(total) - total
        slots = np.arange(len(moved)) + np.repeat(zone - base, total)
        self.flag[moved] = True
        inside = self.perm[slots]
        inside = inside[~self.flag[inside]]
        was = self.loc[moved]
        vacant = was[was < np.repeat(zone, total)]
        self.perm[vacant], self.loc[inside] = inside, vacant
        self.perm[slots], self.loc[moved] = moved, slots
        self.flag[moved] = False
        fresh = np.arange(self.classes, self.classes + len(sizes))
        self.classes += len(sizes)
        self.start[fresh], self.size[fresh] = slots[np.cumsum(sizes) - sizes], sizes
        return fresh


def block_runs(codes: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs of documents given as arrays of word numbers, in that order.

    A run has its smallest period q, is as long as possible, and has ``least`` words and ``exponent`` periods or more (at least four).
    """
    codes, which = [c for c in codes if len(c) >= least], np.array([i for i, c in enumerate(codes) if len(c) >= least], np.int64)
    empty = np.zeros(0, np.int64)
    if not codes:
        return empty, empty, empty, empty
    sizes = np.array([len(c) for c in codes], np.int64)
    low = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    cls, base = np.empty(int((sizes + 1).sum()), np.int64), 0
    for c, a, n in zip(codes, low, sizes):
        top = int(c.max()) + 1
        cls[a : a + n], cls[a + n] = c + base, base + top  # a document ends with a word of its own
        base += top + 1
    # Numbers that no word has would be classes without places.
    cls = np.unique(cls, return_inverse=True)[1].astype(np.int64)
    part = _Partition(cls, exponent - 1)
    pending: dict[int, list[np.ndarray]] = defaultdict(list)

    def remember(places: np.ndarray, level: int) -> None:
        at, gap = part.chained(places)
        later = gap >= level
        at, gap = at[later], gap[later]
        if len(at):
            order = np.argsort(gap, kind="stable")
            at, gap = at[order], gap[order]
            cuts = np.flatnonzero(np.diff(gap)) + 1
            for chunk, d in zip(np.split(at, cuts), gap[np.concatenate(([0], cuts))].tolist()):
                pending[d].append(chunk)

    found = []
    by_size = np.argsort(sizes, kind="stable")
    over, level, splitters = 0, 1, np.arange(len(cls))
    remember(splitters, 1)
    while over < len(codes) and (len(splitters) or pending):
        if level in pending:
            at = np.unique(np.concatenate(pending.pop(level)))
            at = at[part.alive[at] & (part.next[at] == at + level)]
            if len(at):
                cuts = np.flatnonzero(np.diff(at) > 1)
                first, last = at[np.concatenate(([0], cuts + 1))], at[np.append(cuts, len(at) - 1)]
                length = last - first + 2 * level
                ok = length >= max(least, exponent * level)
                found.append((first[ok], length[ok], np.full(int(ok.sum()), level)))
        splitters, fresh = part.refine(splitters)
        level += 1
        if len(fresh):
            remember(fresh, level)
        while over < len(codes) and exponent * level > sizes[by_size[over]]:  # too short for a run of this period
            a = low[by_size[over]]
            part.alive[a : a + sizes[by_size[over]]] = False
            over += 1
    if not found:
        return empty, empty, empty, empty
    first, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, first))
    first, length, period = first[order], length[order], period[order]
    doc = np.searchsorted(low, first, "right") - 1
    return which[doc], first - low[doc], length, period


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """Runs of repeating words in each text, and the text without their repetitions.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical) and
    of at least max(6, 4 q) words that no neighbouring word extends.  A word is dropped if any run
    holds it after that run's first q words.

    ``rewrite`` maps (id, number of words) to the numbers of the words to read in their place, or None.

    Null text has no words; rows that repeat are each read for themselves, ids may be null, and other
    columns are left out.  A text of any length is read as a whole by one task.

    Columns: id_col, n_words, runs (by start, then period), collapsed (kept words joined by one space).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=TOGETHER):
            ids = part.column("id")
            words, codes = [WORD.findall(whole) for whole in part.column("text").to_pylist()], []
            for i, own in enumerate(words):
                if rewrite is not None and own and (order := rewrite(ids[i].as_py(), len(own))) is not None:
                    words[i] = own = [own[k] for k in order.tolist()]
                number: dict[str, int] = {}
                codes.append(np.array([number.setdefault(w, len(number)) for w in own], np.int64))
            doc, start, length, period = block_runs(codes)
            cut = np.searchsorted(doc, np.arange(len(words) + 1))
            collapsed = []
            for own, a, b in zip(words, cut[:-1].tolist(), cut[1:].tolist()):
                if a < b:
                    kept = np.ones(len(own), bool)
                    for s, n, q in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()):
                        kept[s + q : s + n] = False
                    own = [own[j] for j in np.flatnonzero(kept).tolist()]
                collapsed.append(" ".join(own))
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs), pa.array(collapsed, pa.string())], ["id", "n_words", "runs", "collapsed"])
            del words, codes, collapsed
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)


def most_repeated(runs: str | Column) -> Column:
    """Of an array of runs by start and period: the one with most periods, by exact comparison, the first of equal ones; null if there is none."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
