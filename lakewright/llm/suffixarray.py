"""Suffix arrays by induced sorting, and their permuted common prefixes.

Byte strings are induced bucket by bucket with numpy: all suffixes of a bucket
that are known induce their predecessors together, and the ones that land in
the same bucket form the next round. The shorter strings of names that the
recursion makes have large alphabets and small buckets; there a suffix is
sorted by what induces it, its characters and their types up to the next
leftmost smaller suffix and that one's rank, for all suffixes at once.
"""

from __future__ import annotations

import numpy as np

#: Ends every part of a text of several parts. UTF-8 does not contain it.
SEPARATOR = 0xFF


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor. The end of the string counts as smallest."""
    n = len(s)
    types = np.zeros(n, bool)
    if n < 2:
        return types
    types[:-1] = s[:-1] < s[1:]
    # Within a run of equal characters the type is that of the place behind the run.
    same = np.flatnonzero(s[:-1] == s[1:])
    if len(same):
        ends = np.append(np.diff(same) > 1, True)
        last = same[ends]
        types[same] = types[np.repeat(last, np.diff(np.append(-1, np.flatnonzero(ends)))) + 1]
    return types


def leftmost_smaller(types: np.ndarray) -> np.ndarray:
    """Positions of smaller type behind one of larger type."""
    return np.flatnonzero(types[1:] & ~types[:-1]) + 1


def _induce_bytes(s: np.ndarray, types: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost smaller ones in order, for an alphabet of 256."""
    n = len(s)
    count = np.bincount(s, minlength=256)
    heads = np.concatenate([[0], np.cumsum(count)[:-1]])
    larger = ~types
    order = np.empty(n, np.int64)
    n_larger = np.bincount(s[larger], minlength=256)
    # Suffixes of larger type, from the smallest bucket up. The last suffix has nothing behind it and comes first.
    fill = heads.copy()
    seed_chars = s[seeds]
    seed_ends = np.searchsorted(seed_chars, np.arange(257))

    def push_up(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[larger[before]]
        if not len(before):
            return
        chars = s[before]
        turn = np.argsort(chars, kind="stable")
        chars, before = chars[turn], before[turn]
        starts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        sizes = np.diff(np.append(starts, len(chars)))
        buckets = chars[starts]
        order[np.repeat(fill[buckets] - starts, sizes) + np.arange(len(chars))] = before
        fill[buckets] += sizes

    order[fill[s[n - 1]]] = n - 1
    fill[s[n - 1]] += 1
    for c in np.flatnonzero(count):
        done = heads[c]
        while done < fill[c]:
            now, done = order[done:fill[c]], fill[c]
            push_up(now)
        if seed_ends[c + 1] > seed_ends[c]:
            push_up(seeds[seed_ends[c]:seed_ends[c + 1]])
    # Suffixes of smaller type, from the largest bucket down.
    tails = heads + count
    fill = tails.copy()

    def push_down(found: np.ndarray) -> None:
        """``found`` in falling order."""
        before = found[found > 0] - 1
        before = before[types[before]]
        if not len(before):
            return
        chars = s[before]
        turn = np.argsort(chars, kind="stable")
        chars, before = chars[turn], before[turn]
        starts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        sizes = np.diff(np.append(starts, len(chars)))
        buckets = chars[starts]
        order[np.repeat(fill[buckets] - 1 + starts, sizes) - np.arange(len(chars))] = before
        fill[buckets] -= sizes

    for c in np.flatnonzero(count)[::-1]:
        done = tails[c]
        while done > fill[c]:
            now, done = order[fill[c]:done][::-1], fill[c]
            push_down(now)
        if n_larger[c]:
            push_down(order[heads[c]:heads[c] + n_larger[c]][::-1])
    return order


def _names(s: np.ndarray, sorted_left: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, by position in ``left``, of the substrings that reach to the next leftmost smaller suffix."""
    length = np.empty(len(left), np.int64)
    length[:-1] = np.diff(left) + 1
    length[-1] = len(s) - left[-1] + 1
    place = np.empty(len(s), np.int64)
    place[left] = np.arange(len(left))
    order = place[sorted_left]
    size = length[order]
    differ = np.concatenate([[True], size[1:] != size[:-1]])
    live = np.flatnonzero(~differ)
    # The last substring ends at the end of the string and equals no other.
    live = live[(order[live] != len(left) - 1) & (order[live - 1] != len(left) - 1)]
    differ[order == len(left) - 1] = True
    after = np.flatnonzero(order == len(left) - 1) + 1
    differ[after[after < len(order)]] = True
    t = 0
    while len(live):
        other = s[sorted_left[live] + t] != s[sorted_left[live - 1] + t]
        differ[live[other]] = True
        live = live[~other]
        t += 1
        live = live[size[live] > t]
    names = np.empty(len(left), np.int64)
    names[order] = np.cumsum(differ) - 1
    return names, int(differ.sum())


def _refined(n: int, key) -> np.ndarray:
    """Ranks of n sequences, equal for equal ones. ``key(items, t)`` gives their t-th members; 1 marks an end."""
    rank, live, t = np.zeros(n, np.int64), np.arange(n), 0
    while len(live):
        keys = key(live, t)
        turn = np.argsort(rank[live] * (int(keys.max()) + 1) + keys, kind="stable")
        live, keys = live[turn], keys[turn]
        held = rank[live]
        old = np.concatenate([[True], held[1:] != held[:-1]])
        new = old | np.concatenate([[True], keys[1:] != keys[:-1]])
        at = np.arange(len(live))
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank[live] = held + first - np.maximum.accumulate(np.where(old, at, 0))
        alone = new & np.concatenate([new[1:], [True]])
        live = live[~alone & (keys != 1)]
        t += 1
    return rank


def _sort_names(s: np.ndarray) -> np.ndarray:
    """The suffixes of a string of names in order."""
    n = len(s)
    types = smaller_types(s)
    left = leftmost_smaller(types)
    # Members of a sequence: 0 the end of the string, 1 the end of the sequence, 2 on for characters with types.
    tokens = np.append(s * 2 + types + 2, 0)
    if len(left):
        stops = np.append(left[1:], n)
        names = _refined(len(left), lambda q, t: np.where(left[q] + t <= stops[q], tokens[np.minimum(left[q] + t, n)], 1))
        order = np.argsort(names, kind="stable")
        if (names[order[1:]] == names[order[:-1]]).any():
            dense = np.empty(len(left), np.int64)
            dense[order] = np.cumsum(np.concatenate([[0], names[order[1:]] != names[order[:-1]]]))
            order = _sort_names(dense)
        ranks = np.empty(len(left), np.int64)
        ranks[order] = np.arange(len(left))
    else:
        ranks = np.zeros(0, np.int64)
    following = np.searchsorted(left, np.arange(n), side="right")
    target = np.append(left, n)[following]
    known = np.append(ranks + 2, 0)[following]
    final = _refined(n, lambda i, t: np.where(i + t <= target[i], tokens[np.minimum(i + t, n)], known[i]))
    return np.argsort(final, kind="stable")


def _seeds_in_order(s: np.ndarray, types: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leftmost smaller suffixes in order: their substrings by induction, their names by recursion."""
    if len(left) < 2:
        return left
    rough = left[np.argsort(s[left], kind="stable")]
    order = _induce_bytes(s, types, rough)
    mark = np.zeros(len(s), bool)
    mark[left] = True
    sorted_left = order[mark[order]]
    names, n = _names(s, sorted_left, left)
    return sorted_left if n == len(left) else left[_sort_names(names)]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of a byte string in order, by their beginnings."""
    if len(s) < 2:
        return np.arange(len(s))
    types = smaller_types(s)
    return _induce_bytes(s, types, _seeds_in_order(s, types, leftmost_smaller(types)))


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By position: the common prefix with the suffix before it in order, up to a separator.

    A suffix whose predecessor's and own left characters agree shares one byte
    less than the suffix to its left; only the others are compared.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    at = np.arange(n)
    fresh = (before <= 0) | (at == 0)
    inner = ~fresh
    fresh[inner] = (s[at[inner] - 1] != s[before[inner] - 1]) | (s[at[inner] - 1] == SEPARATOR)
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(fresh & (before >= 0))
    t = 0
    while len(live):
        a, b = live + t, before[live] + t
        fits = (a < n) & (b < n)
        live, a, b = live[fits], a[fits], b[fits]
        same = (s[a] == s[b]) & (s[a] != SEPARATOR)
        live = live[same]
        t += 1
        shared[live] = t
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    return np.maximum(shared[last] - (at - last), 0)
