"""Suffix arrays by induced sorting, in whole-batch numpy steps, and permuted common prefixes.

The classic algorithm scans the array once from each side and moves one suffix at a time. Here a step
takes the longest stretch of the scan whose moves all land beyond it: the stretch's suffixes are stable-sorted by
the character before them and appended to those buckets' heads (or tails) together. That is the
classic order whatever the alphabet: over few characters a stretch is most of a bucket, over the many
names of a reduced text it spans many buckets. The recursion is linear in the text, without another sort.
"""

from __future__ import annotations

import numpy as np

#: Entries scanned, and neighbours compared, in one step: bounds what a step holds besides the arrays.
STEP = 1 << 16


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True for smaller-type suffixes (smaller than the next suffix); the end counts as smallest."""
    n = len(t)
    s = np.zeros(n, dtype=bool)
    if n < 2:
        return s
    change = np.flatnonzero(t[:-1] != t[1:])
    rises = t[change] < t[change + 1]
    # each position takes the type of the next change at or after it; after the last one: larger
    upto = np.cumsum(np.concatenate(([False], t[:-1] != t[1:])))
    inside = upto < len(change)
    s[inside] = rises[upto[inside]]
    return s


def _append(order: np.ndarray, sa: np.ndarray, at: np.ndarray, chars: np.ndarray) -> None:
    """Append suffixes to their buckets at pointers ``at``, keeping their order."""
    by = np.argsort(chars, kind="stable")
    c = chars[by]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    count = np.diff(np.append(first, len(c)))
    nth = np.arange(len(c)) - np.repeat(first, count)
    sa[at[c] + nth] = order[by]
    at[c[first]] += count


def _scan(t: np.ndarray, moves: np.ndarray, sa: np.ndarray, pointer: np.ndarray, step: int) -> None:
    """One scan of the whole array from the left (step 1) or the right (-1).

    An entry i with moves[i - 1] puts suffix i - 1 at its bucket's pointer, which goes on by a step.
    Every move lands ahead of its entry, so a stretch of entries may move at once as far as none of their
    landing places lies inside it.
    """
    n = len(t)
    at, width = (0 if step > 0 else n - 1), 256
    while 0 <= at < n:
        size = min(width, n - at if step > 0 else at + 1)
        entry = sa[at : at + size] if step > 0 else sa[at - size + 1 : at + 1][::-1]
        place = (entry > 0).nonzero()[0]
        suffix = entry[place] - 1
        go = moves[suffix]
        place, suffix = place[go], suffix[go]
        count = len(place)
        if not count:
            at, width = at + step * size, min(2 * width, STEP)
            continue
        chars = t[suffix]
        by = chars.argsort(kind="stable")
        c = chars[by]
        new = np.empty(count, dtype=bool)
        new[0] = True
        np.not_equal(c[1:], c[:-1], out=new[1:])
        first = new.nonzero()[0]
        names = c[first]
        # the bucket's pointer, less the places of the run before it
        base = pointer[names] - step * first
        lands = np.empty(count, dtype=np.int64)
        lands[by] = base[new.cumsum() - 1] + step * np.arange(count)
        # distance from the stretch's begin; the first landing place of the entries up to here
        ahead = np.minimum.accumulate((lands - at) * step)
        # the stretch ends at the first landing place of its own entries
        if place[-1] < ahead[-1]:
            keep = count
        else:
            keep = int((place < ahead).argmin())
        limit = min(size, int(ahead[keep - 1]))
        sa[lands[:keep]] = suffix[:keep]
        pointer[names] += step * np.add.reduceat(by < keep, first, dtype=np.int64)
        at += step * limit
        width = min(2 * width, STEP) if limit == size else min(max(64, 2 * limit), STEP)


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array from the leftmost-smaller suffixes in order (of their suffixes or substrings)."""
    n, k = len(t), len(ends)
    sa = np.full(n, -1, dtype=np.int32 if n < 1 << 31 else np.int64)
    if len(lms):
        chars = t[lms]
        _append(lms, sa, ends - np.bincount(chars, minlength=k), chars)
    # larger types, buckets from the smallest
    head = np.concatenate(([0], ends[:-1]))
    if not s[n - 1]:
        sa[head[t[n - 1]]] = n - 1  # induced by the end of the text
        head[t[n - 1]] += 1
    _scan(t, ~s, sa, head, 1)
    # smaller types, buckets from the largest: they take the places of the leftmost ones
    sa[(sa >= 0) & s[np.maximum(sa, 0)]] = -1
    _scan(t, s, sa, ends - 1, -1)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``t`` (non-negative integers) in order."""
    t = np.asarray(t)
    n = len(t)
    if n < 2:
        return np.arange(n)
    # narrow characters are sorted by radix
    most = int(t.max())
    t = t.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)
    s = suffix_types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    ends = np.cumsum(np.bincount(t))
    if not len(lms):
        return _induce(t, s, lms, ends)
    # 1. order the leftmost-smaller substrings
    sa = _induce(t, s, lms, ends)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    by_substring = sa[is_lms[sa]]
    # 2. name them; equal neighbours share a name
    length = np.empty(n, dtype=np.int64)
    length[lms] = np.append(np.diff(lms) + 1, n - lms[-1])
    a, b = by_substring[:-1], by_substring[1:]
    same = (length[a] == length[b]) & (a + length[a] < n) & (b + length[b] < n)
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[length[a[live]] > k]
        bad = t[a[live] + k] != t[b[live] + k]
        same[live[bad]] = False
        live, k = live[~bad], k + 1
    name = np.empty(n, dtype=np.int64)
    name[by_substring] = np.concatenate(([0], np.cumsum(~same)))
    # 3. names that repeat need the order of the reduced text
    if same.any():
        by_suffix = lms[suffix_array(name[lms])]
    else:
        by_suffix = by_substring
    return _induce(t, s, by_suffix, ends)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in order, counted up to ``most``.

    Computed for all positions of the text at once, eight characters a step while they agree; the
    first differing character is the lowest set byte of the two words' exclusive or.
    """
    n = len(t)
    out = np.zeros(n, dtype=np.int32)
    if n < 2:
        return out
    if t.max() >= 256:
        return _by_character(t, sa, most)
    word = np.zeros(n + 8, dtype=np.uint64)
    word[:n] = t
    for shift in (1, 2, 4):
        word[:-shift] |= word[shift:] << np.uint64(8 * shift)
    for low in range(1, n, STEP):
        at, before = sa[low : low + STEP].astype(np.int64), sa[low - 1 : low - 1 + STEP].astype(np.int64)
        before = before[: len(at)]
        room = np.minimum(n - np.maximum(at, before), most)
        got = np.zeros(len(at), dtype=np.int64)
        live = np.arange(len(at))
        while len(live):
            k = got[live]
            x = word[at[live] + k] ^ word[before[live] + k]
            same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3  # 8 if x is 0
            got[live] = k + same
            live = live[(same == 8) & (got[live] < room[live])]
        out[at] = np.minimum(got, room)
    return out


def _by_character(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, dtype=np.int32)
    live = np.flatnonzero(before >= 0)
    for k in range(most):
        live = live[(live + k < n) & (before[live] + k < n)]
        live = live[t[live + k] == t[before[live] + k]]
        out[live] = k + 1
    return out
