"""Suffix array by induced sorting, with numpy doing whole buckets at a time.

Suffixes are classed as S (smaller than the next one) or L; the leftmost S of a run (LMS)
starts a substring that is sorted by one round of induction, named, and the order of the
names' string gives the order of the LMS suffixes, from which a second round induces all others.

Induction visits the buckets of the first characters in order; what a bucket induces in itself is
added in waves (one a repeat of the character), what it induces elsewhere is
dealt by a stable sort. The string of names is ranked by doubling: its alphabet is
as large as itself, so that going bucket by bucket would be a Python loop over single suffixes.
"""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of class S; the last one is L (what follows is smaller than all)."""
    n = len(t)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    differs = np.flatnonzero(t[1:] != t[:-1])
    run_end = np.concatenate([differs, [n - 1]])
    starts = np.concatenate([[0], differs + 1])
    s = np.zeros(len(run_end), dtype=bool)
    s[:-1] = t[run_end[:-1] + 1] > t[run_end[:-1]]
    return np.repeat(s, run_end - starts + 1)


def _deal(p: np.ndarray, ch: np.ndarray, into: list[list[np.ndarray]]) -> None:
    if len(p):
        order = np.argsort(ch, kind="stable")
        p, ch = p[order], ch[order]
        cuts = np.flatnonzero(ch[1:] != ch[:-1]) + 1
        for part, c in zip(np.split(p, cuts), ch[np.concatenate([[0], cuts])], strict=True):
            into[c].append(part)


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order (of substrings: from them in any order)."""
    none = np.zeros(0, dtype=np.int32)
    seeds: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    _deal(lms, t[lms], seeds)
    left: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    left[t[-1]].append(np.array([len(t) - 1], dtype=np.int32))
    l_part: list[np.ndarray] = []
    for c in range(sigma):
        wave = np.concatenate(left[c]) if left[c] else none
        waves = [wave]
        while len(wave):
            p = wave[wave > 0] - 1
            wave = p[(t[p] == c) & ~is_s[p]]
            waves.append(wave)
        own = np.concatenate(waves)
        l_part.append(own)
        source = np.concatenate([own, *seeds[c]])
        p = source[source > 0] - 1
        ch = t[p]
        go = (ch > c) & ~is_s[p]
        _deal(p[go], ch[go], left)
    right: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    out: list[np.ndarray] = []
    for c in range(sigma - 1, -1, -1):
        wave = np.concatenate(right[c]) if right[c] else none
        waves = [wave]
        while len(wave):
            p = wave[wave > 0] - 1
            wave = p[(t[p] == c) & is_s[p]]
            waves.append(wave)
        own = np.concatenate(waves)
        source = np.concatenate([own, l_part[c][::-1]])
        p = source[source > 0] - 1
        ch = t[p]
        go = (ch < c) & is_s[p]
        _deal(p[go], ch[go], right)
        out += [own, l_part[c][::-1]]
    return np.concatenate(out)[::-1]


def _names(t: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of LMS substrings that are given in order: equal ones share a name, names rise."""
    n = len(t)
    length = np.zeros(n, dtype=np.int32)
    length[lms] = np.diff(np.concatenate([lms, [n]])) + 1
    a, b = ordered[:-1], ordered[1:]
    differ = length[a] != length[b]
    last = lms[-1]
    differ |= (a == last) | (b == last)
    open_ = np.flatnonzero(~differ)
    step = 0
    while len(open_):
        x, y = a[open_], b[open_]
        bad = t[x + step] != t[y + step]
        differ[open_[bad]] = True
        open_ = open_[~bad & (length[x] > step + 1)]
        step += 1
    return np.concatenate([[0], np.cumsum(differ)])


def _rank(names: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of a string of names by doubling, exact for their first ``most`` names; then by place."""
    m = len(names)
    rank = names.astype(np.int64)
    size = np.bincount(rank)
    rank = (np.cumsum(size) - size)[rank]  # first place of the group
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < most:
        r = rank[order]
        tied = np.zeros(m, dtype=bool)
        tied[1:] = r[1:] == r[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        x = order[at]
        nxt = np.where(x + k < m, rank[np.minimum(x + k, m - 1)] + 1, 0)
        sub = np.lexsort((nxt, rank[x]))
        x, nxt = x[sub], nxt[sub]
        order[at] = x
        group = rank[x]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        rank[x] = at[new][np.cumsum(new) - 1]
        k *= 2
    return order


def suffix_array(t: np.ndarray, sigma: int, depth: int | None = None) -> np.ndarray:
    """Suffixes of ``t`` (values below ``sigma``) in order.

    With ``depth``, suffixes that agree in so many names of leftmost-S substrings (of two characters at least) may come in
    any order: enough where the text is made of short parts between separators.
    """
    t = np.ascontiguousarray(t)
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    is_s = types(t)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        first = induce(t, is_s, lms, sigma)
        mark = np.zeros(n, dtype=bool)
        mark[lms] = True
        ordered = first[mark[first]]
        names = np.empty(n, dtype=np.int32)
        named = _names(t, ordered, lms)
        if named[-1] + 1 == len(lms):
            lms = ordered
        else:
            names[ordered] = named
            lms = lms[_rank(names[lms], 2 * len(lms) if depth is None else depth)]
    return induce(t, is_s, lms, sigma)


def permuted_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """By place in a text of bytes: how many (up to ``most``) a suffix shares with the one before it in order.

    Eight bytes are compared at a time, for all suffixes side by side.
    """
    n = len(t)
    shared = np.zeros(n, dtype=np.int32)
    if n < 2:
        return shared
    wide = np.concatenate([np.ascontiguousarray(t, dtype=np.uint8), np.zeros(most + 8, dtype=np.uint8)])
    eight = np.ascontiguousarray(np.ndarray((len(wide) - 7,), dtype="<u8", buffer=wide.data, strides=(1,)))
    x, y = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    open_ = np.arange(1, n)
    for off in range(0, most, 8):
        d = eight[x + off] ^ eight[y + off]
        same = d == 0
        d, end = d[~same], open_[~same]
        # The lowest bit that differs tells the byte.
        shared[end] = off + (np.log2((d & (~d + np.uint64(1))).astype(np.float64)) / 8).astype(np.int32)
        open_, x, y = open_[same], x[same], y[same]
        if not len(open_):
            break
    shared[open_] = most
    # What lies behind the text is no byte of it.
    shared[1:] = np.minimum(shared[1:], n - np.maximum(order[1:], order[:-1]))
    out = np.empty(n, dtype=np.int32)
    out[order] = np.minimum(shared, most)
    return out
