"""Induced suffix sorting of one shard, in bulk.

The steps are those of induced sorting: suffixes are smaller (S) or larger (L) than the
next one; leftmost S substrings are sorted by induction and named; the names' own suffixes
are sorted; and the order of all suffixes is induced from theirs, L from the left and S
from the right.  The queues of the induction are monotone: for a first symbol, what is
pushed comes out in the order pushed, so each is a stretch of one array with a pointer at
its open end, and whole batches of suffix places go through at once.  That array is held
in memory up to ``HELD`` suffixes and in an unnamed temporary file above that.

Two steps differ from the textbook, since only the first ``depth`` symbols matter here:
below the first level names are sorted by doubling up to that depth, and common prefixes
are compared on the sorted order instead of being carried along.
"""

from __future__ import annotations

import tempfile

import numpy as np

HELD = 1 << 25


def _places(n: int) -> np.ndarray:
    kind = np.int32 if n < 1 << 31 else np.int64
    return np.zeros(n, kind) if n <= HELD else np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


def smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; ``t`` ends with a symbol below all others."""
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[np.minimum(following, len(step) - 1)] > 0, True)


def _induce(t: np.ndarray, s: np.ndarray, leftmost: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes' places in the order induced from the leftmost S suffixes, given in order within each first symbol."""
    sizes = np.bincount(t, minlength=sigma)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    sa, head, tail = _places(len(t)), begins.copy(), ends.copy()
    first = t[leftmost]
    cuts = np.searchsorted(first, np.arange(sigma + 1))

    def push(batch: np.ndarray, of_s: bool) -> None:
        p = batch[batch > 0] - 1
        p = p[s[p] == of_s]
        if not len(p):
            return
        c = t[p]
        if len(p) < 24:
            for q, x in zip(p.tolist(), c.tolist(), strict=True):
                if of_s:
                    tail[x] -= 1
                    sa[tail[x]] = q
                else:
                    sa[head[x]] = q
                    head[x] += 1
            return
        order = np.argsort(c, kind="stable")  # by radix, symbols being of 16 bits
        p, count = p[order], np.bincount(c, minlength=sigma)
        upto = np.cumsum(count)
        if of_s:
            sa[np.repeat(tail - 1 + upto - count, count) - np.arange(len(p))] = p
            np.subtract(tail, count, out=tail)
        else:
            sa[np.repeat(head - upto + count, count) + np.arange(len(p))] = p
            np.add(head, count, out=head)

    present = np.flatnonzero(sizes)
    for c in present:
        done = begins[c]
        while done < head[c]:
            upto = head[c]
            push(np.array(sa[done:upto]), False)
            done = upto
        push(leftmost[cuts[c] : cuts[c + 1]], False)
    for c in present[::-1]:
        done = ends[c]
        while tail[c] < done:
            low = tail[c]
            push(np.array(sa[low:done])[::-1], True)
            done = low
        push(np.array(sa[begins[c] : head[c]])[::-1], True)
    sa[0] = len(t) - 1
    return sa


def _names(t: np.ndarray, sorted_: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """A rank for the substring from each leftmost S place to the next, equal ones alike, in text order."""
    following = np.append(leftmost[1:], len(t) - 1)
    powers = np.cumprod(np.full(len(t) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((t.astype(np.uint64) + np.uint64(1)) * powers[: len(t)])))
    where = np.empty(len(t), np.int32)
    where[leftmost] = np.arange(len(leftmost))
    i = where[sorted_]
    a, size = leftmost[i], following[i] - leftmost[i]
    # a fingerprint of each substring, moved to a common power; equal ones stand side by side
    mark = (sums[np.minimum(following[i] + 1, len(t))] - sums[a]) * powers[len(t) - a]
    new = np.ones(len(i), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (size[1:] != size[:-1])
    out = np.empty(len(i), np.int64)
    out[i] = np.cumsum(new)
    return out


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a sequence of names by their first ``depth`` names."""
    n, rank, step = len(names), names, 1
    order = np.argsort(rank)
    while step < depth and n > 1 and int(rank.max()) < n:  # ranks count from 1, so n different ones are all
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:]
        key = rank * (n + 2) + after
        order = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
    return order


def suffix_order(t: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """Places of all suffixes, sorted by their first ``depth`` symbols at least.  The last symbol is 0 and no other is."""
    s = smaller(t)
    leftmost = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(leftmost):
        return np.arange(len(t))[::-1].copy()
    rough = leftmost[np.argsort(t[leftmost], kind="stable")]
    sa = _induce(t, s, rough, sigma)
    is_leftmost = np.zeros(len(t), bool)
    is_leftmost[leftmost] = True
    names = _names(t, np.array(sa)[is_leftmost[sa]], leftmost)
    return _induce(t, s, leftmost[_by_doubling(names, -(-depth // 2))], sigma)


def repeats(snippets: list[bytes], sizes: list[int], length: int) -> list[np.ndarray]:
    """For each snippet, which of its first ``sizes`` strings of ``length`` bytes stand earlier, in it or in one before."""
    lengths = np.array([len(x) for x in snippets])
    offs = np.concatenate(([0], np.cumsum(lengths + 1)))
    raw = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    t = raw.astype(np.uint16) + np.uint16(2)
    t[offs[1:] - 1] = 1  # between snippets
    t = np.append(t, np.uint16(0))
    owned = np.zeros(len(t), np.int32)
    np.add.at(owned, offs[:-1], 1)
    np.add.at(owned, offs[:-1] + np.array(sizes), -1)
    owned = np.cumsum(owned) > 0
    sa = np.array(suffix_order(t, 258, length))
    sa = sa[owned[sa]]
    # neighbours with the same first bytes: eight at a time, the last eight overlapping
    wide = np.lib.stride_tricks.sliding_window_view(raw, 8)
    eights = np.ascontiguousarray(wide).view(np.uint64).ravel()
    same = np.ones(max(0, len(sa) - 1), bool)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        at = np.flatnonzero(same)
        same[at] = eights[sa[at] + k] == eights[sa[at + 1] + k]
    flags = np.zeros(len(t), bool)
    if len(sa):
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.minimum.reduceat(sa, starts)
        flags[sa] = sa != np.repeat(least, np.diff(np.append(starts, len(sa))))
    return [flags[o : o + n] for o, n in zip(offs[:-1], sizes, strict=True)]
