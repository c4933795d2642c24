"""Periodic runs of words: maximal stretches that repeat a block of words three times or more, and texts without the repetitions.

By the theorem on runs, the first block of each run that begins with its least rotation is the longest Lyndon word at its
place under one of the two orders of words, the plain or the reversed one. So a stack scanned from right to left finds
the longest Lyndon words under each order; a block that its own copy follows is extended both ways and, if long enough,
is a run. Comparisons of suffixes and extensions are longest common extensions by binary search over rolling hashes of
prefixes; the words of each answer are compared directly, so results do not rest on the hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.text_hash import slices, utf8

#: A run has so many words and so many periods at least.
WORDS, PERIODS = 24, 3
#: Words that are compared one by one before hashes are asked.
DIRECT = 12
PRIME, BASE = (1 << 61) - 1, 1_000_003_019
Run = tuple[int, int, int]


class Extensions:
    """Longest common extensions within one sequence of numbers."""

    def __init__(self, words: list[int]):
        self.words, self.array = words, np.array(words, np.int64)
        self.sums: list[int] = []
        self.powers: list[int] = []
        #: For a distance q, [lo, hi): words[x] == words[x + q] there, as compared, and not at hi.
        self.compared: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, n: int) -> bool:
        """Whether the hashes of the n words from i and from j are equal."""
        if not self.sums:
            self.sums = list(accumulate(self.words, lambda h, w: (h * BASE + w + 1) % PRIME, initial=0))
            self.powers = list(accumulate(range(len(self.words)), lambda p, _: p * BASE % PRIME, initial=1))
        s = self.sums
        return (s[i + n] - s[j + n] - (s[i] - s[j]) * self.powers[n]) % PRIME == 0

    def _search(self, low: int, most: int, same: Callable[[int], bool]) -> int:
        """The greatest n from ``low`` to ``most`` that is ``same``: doubled steps, then halves."""
        high = most + 1
        step = max(1, low)
        while low + step < high:
            if same(low + step):
                low, step = low + step, step * 2
            else:
                high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if same(middle) else (low, middle)
        return low

    def forward(self, i: int, j: int) -> int:
        """The number of equal words from i and from j on, i < j."""
        w, q, most = self.words, j - i, len(self.words) - j
        n, soon = 0, min(most, DIRECT)
        while n < soon and w[i + n] == w[j + n]:
            n += 1
        if n < soon or n == most:
            return n
        known = self.compared.get(q)
        if known and known[0] <= i + n and i < known[1]:  # what follows has been compared before
            self.compared[q] = (min(i, known[0]), known[1])
            return known[1] - i
        n = self._search(n, most, lambda m: self._same(i, j, m))
        if (odd := np.flatnonzero(self.array[i : i + n] != self.array[j : j + n])).size:
            n = int(odd[0])
        self.compared[q] = (i, i + n)
        return n

    def backward(self, i: int, j: int) -> int:
        """The number of equal words before i and before j, i < j."""
        w, n, soon = self.words, 0, min(i, DIRECT)
        while n < soon and w[i - n - 1] == w[j - n - 1]:
            n += 1
        if n < soon or n == i:
            return n
        n = self._search(n, i, lambda m: self._same(i - m, j - m, m))
        odd = np.flatnonzero(self.array[i - n : i] != self.array[j - n : j])
        return i - int(odd[-1]) - (i - n) - 1 if odd.size else n


def lyndon_ends(words: list[int], ahead: Extensions) -> list[int]:
    """For each place the end of the longest Lyndon word that begins there: where the next smaller suffix begins. ``ahead`` has the same equalities as ``words``."""
    n = len(words)
    ends, stack = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        x = words[i]
        while (j := stack[-1]) < n:
            y = words[j]
            if y == x:
                same = ahead.forward(i, j)
                if j + same == n or words[j + same] < words[i + same]:
                    break
            elif y < x:
                break
            stack.pop()
        ends[i] = stack[-1]
        stack.append(i)
    return ends


def sequence_runs(words: list[int], least: int = WORDS, periods: int = PERIODS) -> list[Run]:
    """(start, length, period) of the runs of a sequence of numbers, by start and period. ``periods`` is 3 or more: every run then has a block with a copy behind it under one of the orders."""
    ahead, found = Extensions(words), set()
    values, places = ahead.array, np.arange(len(words))
    for ordered in (words, [-w for w in words]):
        ends = np.array(lyndon_ends(ordered, ahead), np.int64)
        period = ends - places
        at = places[(period * (periods - 1) <= len(words) - places) & (ends + period <= len(words))]
        q = period[at]
        at = at[(values[at] == values[at + q]) & (values[at + q - 1] == values[at + 2 * q - 1])]
        last: dict[int, tuple[int, int]] = {}
        for i in at.tolist():
            j = int(ends[i])
            q = j - i
            begin, end = last.get(q, (0, 0))
            if begin <= i and j + q <= end:
                continue  # within the run found last
            more = ahead.forward(i, j)
            if more < q:
                continue
            begin, end = i - ahead.backward(i, j), j + more
            last[q] = (begin, end)
            if end - begin >= max(least, periods * q):
                found.add((begin, end - begin, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_runs(words: list[bytes], least: int = WORDS, periods: int = PERIODS) -> list[Run]:
    """The runs of a text's words. A word of a run occurs once a period, so words that are rarer than ``periods`` part the text before anything else; no run reaches over them."""
    if len(words) < least:
        return []
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.bincount(ids)[ids] >= periods).view(np.int8), [0]])))
    out = []
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - begin >= least:
            out += [(begin + s, n, q) for s, n, q in sequence_runs(ids[begin:end].tolist(), least, periods)]
    return out


def without_repetitions(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


SHAPE = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = WORDS, periods: int = PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id, text): the maximal runs of its words, and the words that are left joined by one space.

    Words are what lies between the ASCII white space of a text, in bytes; case counts. A run is (start, length, period)
    with at least ``least`` words and ``periods`` (3 or more) of its smallest period. ``rewrite`` may replace a text's words first, by
    (doc_id, words). A null or empty text has no words, no runs and an empty ``collapsed``; null doc_ids, repeated rows and equal texts are
    each judged alone; an empty table gives an empty one; other columns are not looked at, whatever their names. Nothing is shuffled:
    a text is read by the task that holds its row, in memory and about n log n steps in its length, however long or repetitive it is.
    """
    if periods < 3:
        raise ValueError("periods must be 3 or more")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 4 << 20):
                n_words, runs, collapsed = [], [], []
                for k in range(i, j):
                    words = data[offsets[k] : offsets[k + 1]].tobytes().split()
                    if rewrite:
                        words = rewrite(ids[k], words)
                    own = word_runs(words, least, periods)
                    n_words.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    collapsed.append(b" ".join(without_repetitions(words, own)))
                texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(n_words, pa.int64()), pa.array(runs, _RUN), texts], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(found, SHAPE)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period (the first by start and period of equals; nulls without runs), and hashes of all runs and of what is left."""
    higher = lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best)
    shown = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(shown, F.lit("\n"))).otherwise("")
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), higher)
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000L div best.period")
    return own.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
