"""Periodic runs of words, found on a harmonic grid with longest common extensions from a difference cover.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) and a length of at least
``max(LEAST, 2 * q)`` that no neighbouring word extends keeping the period. Documents are taken in lots of some
``LOT`` words, joined by marks that occur once, so that no match leaves its document:

1. Harmonic grid: for each period ``q`` the anchors ``0, q, 2 q, ...``; a run of period ``q`` covers two neighbours,
   so some ``n ln n`` pairs of anchors see every run. As ``LEAST`` words must come out, three words before or from the
   anchors on must agree; other pairs go at once.
2. Difference cover: in any ``CYCLE`` words in a row the two sides of a comparison reach places of the cover ``COVER`` at
   the same distance. Only suffixes at such places (6 of 31) are sorted: by their first ``CYCLE`` words, then by doubling.
   The common prefixes of neighbours in that order go into a sparse table of range minima.
3. A longest common extension compares word by word up to the next places in step, fewer than ``CYCLE``, and then asks
   the table. Extensions to the right use the lot, those to the left the lot reversed.
4. The stretch that two anchors span is a run if long enough. Found with several periods (a multiple of the smallest
   gives the same stretch) the smallest counts.

Memory is linear in a lot, or in its one document if that is longer; nothing is quadratic in a text.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null or wordless text has no run and an empty ``collapsed``. Rows and
other columns stay as they are, repeated rows and ids are judged each for itself, an empty table gives an empty one.
Columns named ``runs`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from apptledger.llm.arrow import with_columns

LEAST = 12
#: Every difference modulo CYCLE is that of two numbers of COVER.
CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words compared at an anchor before anything else: a half of what must agree around it.
PROBE = LEAST // 4
#: Words of documents, and anchors, that are handled at a time.
LOT, ANCHORS = 100_000, 200_000

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
ADDED = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

_covered = np.full(CYCLE, -1)
_covered[list(COVER)] = np.arange(len(COVER))
#: Least distance at which both of two places (by remainder) meet the cover.
STEP = np.array([[next(s for s in range(CYCLE) if _covered[(i + s) % CYCLE] >= 0 and _covered[(j + s) % CYCLE] >= 0)
                  for j in range(CYCLE)] for i in range(CYCLE)])


class Extensions:
    """Longest common extensions to the right between places of ``ids``, in which any two suffixes differ."""

    def __init__(self, ids: np.ndarray):
        cycles = -(-len(ids) // CYCLE)
        top = int(ids.max(initial=0)) + 1
        # Room for a whole cycle after the last sample, filled with numbers that occur once.
        self.ids = np.concatenate([ids, top + np.arange((cycles + 1) * CYCLE - len(ids))])
        self.at = (np.arange(cycles)[:, None] * CYCLE + np.array(COVER)).ravel()
        levels = self.sorted_levels()
        order = np.argsort(levels[-1])
        self.rank = levels[-1]
        common = np.zeros(len(order), np.int64)
        common[1:] = self.common(levels, order[:-1], order[1:])
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            half = 1 << (len(self.minima) - 1)
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def sorted_levels(self) -> list[np.ndarray]:
        """Ranks of the samples by their first CYCLE words, by twice as many, and so on until all differ."""
        bits = max(1, int(self.ids.max()).bit_length())
        each = max(1, min(CYCLE, 63 // bits))
        columns = []
        for start in range(0, CYCLE, each):
            key = np.zeros(len(self.at), np.int64)
            for word in range(start, min(start + each, CYCLE)):
                key = key << bits | self.ids[self.at + word]
            columns.append(key)
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        for key in columns:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        levels, reach = [], len(COVER)
        while True:
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new)
            levels.append(rank)
            if not len(order) or rank[order[-1]] == len(order) - 1:
                return levels
            following = np.zeros(len(rank), np.int64)
            following[:-reach] = rank[reach:] + 1
            key = rank * (len(rank) + 1) + following
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[False], key[order[1:]] != key[order[:-1]]])
            reach *= 2

    def common(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes of samples ``a`` and ``b`` have in common at their start."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero(np.maximum(a, b) < len(self.at))
            equal = inside[levels[level][a[inside]] == levels[level][b[inside]]]
            found[equal] += CYCLE << level
            a[equal] += len(COVER) << level
            b[equal] += len(COVER) << level
        live = np.flatnonzero(np.maximum(a, b) < len(self.at))
        first, second = self.at[a[live]], self.at[b[live]]
        return self.word_by_word(found, live, first, second, np.full(len(live), CYCLE))[0]

    def word_by_word(self, found: np.ndarray, live: np.ndarray, first: np.ndarray, second: np.ndarray,
                     most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``found`` with the words that agree, up to ``most``; and the places where all did."""
        whole = [live[most == 0]]
        go = np.flatnonzero(most > 0)
        for word in range(CYCLE):
            go = go[self.ids[first[go] + word] == self.ids[second[go] + word]]
            found[live[go]] += 1
            done = most[go] == word + 1
            whole.append(live[go[done]])
            go = go[~done]
            if not len(go):
                break
        return found, np.concatenate(whole)

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and ``j`` on agree, for arrays of unequal places."""
        step = STEP[i % CYCLE, j % CYCLE]
        found, on = self.word_by_word(np.zeros(len(i), np.int64), np.arange(len(i)), i, j, step)

        def rank(place: np.ndarray) -> np.ndarray:
            return self.rank[place // CYCLE * len(COVER) + _covered[place % CYCLE]]

        a, b = rank(i[on] + step[on]), rank(j[on] + step[on])
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        for k in np.unique(level):
            here = level == k
            table = self.minima[k]
            found[on[here]] += np.minimum(table[low[here]], table[high[here] - (1 << int(k)) + 1])
        return found


def joined(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents in one array between marks that occur once, and where each begins."""
    sizes = np.array([len(d) for d in documents], np.int64)
    starts = PROBE + np.concatenate([[0], np.cumsum(sizes + PROBE)[:-1]]).astype(np.int64)
    total = int(starts[-1] + sizes[-1]) + PROBE if len(documents) else PROBE
    top = max((int(d.max(initial=0)) for d in documents), default=0) + 1
    ids = top + np.arange(total)
    for start, document in zip(starts, documents, strict=True):
        ids[start:start + len(document)] = document
    # Marks count on from the vocabulary, not from their place.
    mark = np.ones(total, bool)
    for start, size in zip(starts, sizes, strict=True):
        mark[start:start + size] = False
    ids[mark] = top + np.arange(int(mark.sum()))
    return ids, starts


def anchors(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) for the grids of all documents, some ANCHORS at a time."""
    halves = np.where(sizes >= LEAST, sizes // 2, 0)
    document = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(document)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    counts = (sizes[document] - 1) // period
    ends = np.cumsum(counts)
    at = 0
    while at < len(document):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + ANCHORS, side="right")))
        part = np.repeat(np.arange(at, to), counts[at:to])
        nth = np.arange(len(part)) - (ends - counts)[part] + (ends[at] - counts[at])
        yield document[part], nth * period[part], period[part]
        at = to


def probes(ids: np.ndarray) -> np.ndarray:
    """A number for the PROBE words from each place on."""
    mixed = ids.astype(np.uint64)
    probe = np.zeros(len(ids), np.uint64)
    for word in range(PROBE):
        probe = probe * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([mixed[word:], mixed[:word]])
    return probe


def smallest(found: np.ndarray) -> np.ndarray:
    """Of rows (document, start, length, period) that tell of one stretch the one of smallest period."""
    found = found[np.lexsort(found.T[::-1])]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    return found[first]


def runs(documents: list[np.ndarray]) -> np.ndarray:
    """Rows (document, start, length, period) for documents of word numbers."""
    none = np.zeros((0, 4), np.int64)
    sizes = np.array([len(d) for d in documents], np.int64)
    if not (sizes >= LEAST).any():
        return none
    ids, starts = joined(documents)
    probe = probes(ids)

    def agreeing(sizes: np.ndarray, starts: np.ndarray, probe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Those of the anchors around which words agree."""
        for document, place, period in anchors(sizes):
            i = starts[document] + place
            j = i + period
            agree = (probe[i] == probe[j]) | (probe[i - PROBE] == probe[j - PROBE])
            if agree.any():
                yield document[agree], place[agree], period[agree]

    # Documents without such anchors need no suffixes. The others' anchors are made a second time rather than held, as
    # there are some n ln n of them where words keep recurring.
    seen = np.zeros(len(sizes), bool)
    for document, _, _ in agreeing(sizes, starts, probe):
        seen[document] = True
    used = np.flatnonzero(seen)
    if not len(used):
        return none
    ids, starts = joined([documents[d] for d in used])
    probe = probes(ids)
    right, left, last = Extensions(ids), Extensions(ids[::-1]), len(ids) - 1
    found, held = [none], 0
    for document, place, period in agreeing(sizes[used], starts, probe):
        i = starts[document] + place
        j = i + period
        after, before = right.between(i, j), left.between(last - (i - 1), last - (j - 1))
        length = before + period + after
        long = length >= np.maximum(LEAST, 2 * period)
        found.append(smallest(np.stack([used[document], place - before, length, period], axis=1)[long]))
        held += len(found[-1])
        # Stretches that several lots of anchors tell of are held once.
        if held > ANCHORS:
            found = [smallest(np.concatenate(found))]
            held = 0
    return smallest(np.concatenate(found))


def dropped(size: int, found: np.ndarray) -> np.ndarray:
    """Which of ``size`` words lie in a run after its first period."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, found[:, 1] + found[:, 3], 1)
    np.add.at(steps, found[:, 1] + found[:, 2], -1)
    return np.cumsum(steps[:size]) > 0


def words_of(texts: pa.Array) -> Iterator[list[bytes]]:
    for text in texts:
        yield (text.as_py() or "").encode("utf-8", "surrogatepass").split()


def lots(documents: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for words in documents:
        if held and size + len(words) > LOT:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def judged(lot: list[list[bytes]]) -> Iterator[tuple[list[dict], str]]:
    """Runs and collapsed text of each document of a lot."""
    numbers: dict[bytes, int] = {}
    documents = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in lot]
    found = runs(documents)
    ends = np.searchsorted(found[:, 0], np.arange(len(lot)), side="right")
    begin = 0
    for words, end in zip(lot, ends, strict=True):
        own, begin = found[begin:end], end
        if len(own):
            own = own[np.lexsort((own[:, 3], own[:, 1]))]
            gone = dropped(len(words), own)
            words = [w for w, g in zip(words, gone, strict=True) if not g]
        yield ([{"start": s, "length": n, "period": p} for _, s, n, p in own.tolist()],
               b" ".join(words).decode("utf-8", "surrogatepass"))


def repeats(df: DataFrame, source: str = "text",
            words: Callable[[pa.Array], Iterator[list[bytes]]] = words_of) -> DataFrame:
    """``df`` with ``runs``, by start and period, and ``collapsed``, the words that lie in no run after its first
    period, joined by a space. ``words`` turns values of ``source`` into words."""

    def make():
        def compute(values: pa.Array) -> list[list]:
            results = [result for lot in lots(words(values)) for result in judged(lot)]
            return [[r[0] for r in results], [r[1] for r in results]]

        return compute

    return with_columns(df, source, ADDED, make)
