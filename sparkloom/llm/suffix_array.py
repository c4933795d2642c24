"""Suffix arrays by induced sorting: whole buckets at once in NumPy where the alphabet is small, suffix by suffix where it is large."""

from __future__ import annotations

import numpy as np

#: Suffixes a bucket must have on average for scans by bucket to be the faster ones.
BUCKET = 64


def _types(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than the next one). The end of the text counts as the smallest suffix."""
    n = len(text)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return step[following] > 0


def _induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost S-type ones ``lms`` in order: one scan forwards for L-types, one backwards for S-types.

    A scan takes a bucket's suffixes together; the suffixes before them of the type looked for go, in their order, to
    the fronts (or backs) of their own buckets. Those of the same bucket are scanned in a further pass over it.
    """
    n, sigma = len(text), len(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    array = np.full(n, -1, np.int64)

    def spread(source: np.ndarray, want_s: bool, edge: np.ndarray) -> None:
        before = source[source > 0] - 1
        before = before[s_type[before] == want_s]
        symbols = text[before]
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        counts = np.bincount(symbols, minlength=sigma)
        own = np.arange(len(before)) - (np.cumsum(counts) - counts)[symbols]
        if want_s:
            array[edge[symbols] - 1 - own] = before
            edge -= counts
        else:
            array[edge[symbols] + own] = before
            edge += counts

    lms_of = np.split(lms, np.cumsum(np.bincount(text[lms], minlength=sigma))[:-1])  # by first symbol, in order
    front = begins.copy()
    spread(np.array([n]), False, front)  # the end of the text induces the last suffix
    used = np.flatnonzero(sizes)
    for c in used.tolist():
        at = begins[c]
        while at < front[c]:
            done, at = at, front[c]
            spread(array[done:at].copy(), False, front)
        if len(lms_of[c]):
            spread(lms_of[c], False, front)
    back = ends.copy()
    for c in used[::-1].tolist():
        at = ends[c]
        while at > back[c]:
            done, at = at, back[c]
            spread(array[at:done][::-1].copy(), True, back)
        spread(array[begins[c] : front[c]][::-1].copy(), True, back)
    return array


def _induce_each(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ``_induce`` gives, by the same two scans suffix by suffix, for alphabets so large that most buckets hold few suffixes."""
    n, ends = len(text), np.cumsum(sizes)
    front, back = (ends - sizes).tolist(), ends.tolist()
    array = [-1] * n
    for i, c in zip(lms[::-1].tolist(), text[lms[::-1]].tolist(), strict=True):
        back[c] = at = back[c] - 1
        array[at] = i

    def symbol_before(wanted: np.ndarray) -> list[int]:
        """For each place the symbol before it if its suffix is wanted, else -1; the last entry serves places not yet filled."""
        out = np.full(n + 1, -1, np.int64)
        out[1:n] = np.where(wanted[:-1], text[:-1], -1)
        return out.tolist()

    last = int(text[-1])
    array[front[last]] = n - 1
    front[last] += 1
    before = symbol_before(~s_type)
    for i in array:  # grows ahead of the scan
        c = before[i]
        if c >= 0:
            at = front[c]
            array[at] = i - 1
            front[c] = at + 1
    before, back = symbol_before(s_type), ends.tolist()
    for i in reversed(array):
        c = before[i]
        if c >= 0:
            back[c] = at = back[c] - 1
            array[at] = i - 1
    return np.array(array, np.int64)


def suffix_array(text: np.ndarray, largest: int | None = None) -> np.ndarray:
    """The suffixes of ``text`` (non-negative integers) in order; the end of the text counts as the smallest suffix.

    Suffixes are classified, the leftmost S-type (LMS) substrings sorted by one induced pass and named, the string of names
    sorted recursively unless all names differ, and all suffixes induced from that in linear time.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    sigma = (int(text.max()) if largest is None else largest) + 1
    sizes = np.bincount(text, minlength=sigma)
    induce = _induce if sigma * BUCKET <= n else _induce_each
    s_type = _types(text)
    is_lms = s_type.copy()
    is_lms[0] = False
    is_lms[1:] &= ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        names = _names(text, lms, is_lms, induce(text, s_type, lms[np.argsort(text[lms], kind="stable")], sizes))
        distinct = int(names.max()) + 1
        lms = lms[np.argsort(names) if distinct == len(lms) else suffix_array(names, distinct - 1)]
    return induce(text, s_type, lms, sizes)


def _names(text: np.ndarray, lms: np.ndarray, is_lms: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each LMS place, in text order, the rank of its LMS substring; equal substrings have one rank. ``array`` has them sorted."""
    n = len(text)
    ordered = array[is_lms[array]]
    place = np.full(n, -1, np.int64)
    place[lms] = np.arange(len(lms))
    length = np.diff(np.append(lms, n - 1)) + 1  # with the first symbol of the next
    length[-1] = n - lms[-1] + 1  # the last one ends with the end of the text and equals no other
    own = length[place[ordered]]
    same = own[1:] == own[:-1]
    a, b = ordered[1:][same], ordered[:-1][same]
    left, alive, k = own[1:][same], np.arange(int(same.sum())), 0
    equal = np.ones(len(alive), bool)
    while len(alive):
        alive = alive[left[alive] > k]
        differ = text[np.minimum(a[alive] + k, n - 1)] != text[np.minimum(b[alive] + k, n - 1)]
        equal[alive[differ]] = False
        alive, k = alive[~differ], k + 1
    new = np.ones(len(ordered), bool)
    new[1:][same] = ~equal
    names = np.empty(len(lms), np.int64)
    names[place[ordered]] = np.cumsum(new) - 1
    return names


def common_prefixes(data: np.ndarray, array: np.ndarray, cap: int) -> np.ndarray:
    """Permuted common prefixes: for each place of the text the length, up to ``cap``, of the prefix it has in common with the suffix sorted before it.

    ``data`` are bytes with at least ``cap`` + 8 more bytes after the places of ``array``.
    """
    n = len(array)
    out = np.zeros(n, np.int32)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    alive = np.flatnonzero(before >= 0)
    for k in range(0, cap, 8):
        if not len(alive):
            break
        differ = words[alive + k] ^ words[before[alive] + k]
        ended = differ != 0
        low = differ[ended] & (~differ[ended] + np.uint64(1))
        out[alive[ended]] = k + (np.log2(low.astype(np.float64)).astype(np.int32) >> 3)
        alive = alive[~ended]
    out[alive] = cap
    return np.minimum(out, cap)
