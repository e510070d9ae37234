"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, merging by binary search.

Everything here is bounded by a length: strings of ``length`` bytes are what repeats are made
of, so suffixes are ordered, and common prefixes counted, up to that many bytes.
"""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray, length: int) -> np.ndarray:
    """The suffixes of ``data`` (uint8) in the order of their first ``length`` bytes or more.

    The first ranks are those of 7 bytes (in 9-bit digits, so that an end sorts first);
    each round doubles the ordered prefix by sorting the groups that are still tied by the
    rank of the suffix as many bytes further on, and leaves settled suffixes alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 7, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    # A group's rank is the place of its first suffix.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    done = 7
    while done < length:
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        at = order[tied]
        after = at + done
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[at]
        again = np.lexsort((second, first))
        at, first, second = at[again], first[again], second[again]
        order[tied] = at
        parts = np.ones(len(tied), bool)
        parts[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[tied] |= parts
        rank[at] = np.maximum.accumulate(np.where(parts, tied, 0))
        done *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, at most ``length``.

    Kasai's bound, a suffix shares at least one byte less than the suffix a byte before it,
    holds over any distance; so suffixes at every 64th place are compared first, then those
    halfway between, each from what its left neighbour leaves it.
    """
    n = len(data)
    shared = np.zeros(n, np.int64)  # by place in the text
    if n < 2:
        return shared
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    stride = 64
    first = True
    while stride >= 1:
        at = np.arange(0, n, 64) if first else np.arange(stride, n, 2 * stride)
        if len(at):
            left = np.zeros(len(at), np.int64) if first else shared[at - stride]
            # Suffixes equal in all ``length`` bytes are in no certain order, so those bound nothing.
            low = np.where(left < length, np.maximum(left - stride, 0), 0)
            _extend(data, at, before[at], low, length)
            shared[at] = low
        stride = stride // 2 if not first else 32
        first = False
    return shared[order]


def _extend(data: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, length: int) -> None:
    """Raise ``low`` to the common prefix of a and b, up to ``length``, eight bytes at a step and then one by one."""
    n = len(data)
    low[b < 0] = 0
    words = np.zeros(n + 8, np.uint64)
    for k in range(min(8, n)):
        words[: n - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    live = np.flatnonzero((b >= 0) & (low < length))
    while len(live):
        x, y = a[live] + low[live], b[live] + low[live]
        inside = (np.maximum(x, y) + 8 <= n) & (low[live] + 8 <= length)
        same = inside & (words[np.minimum(x, n)] == words[np.minimum(y, n)])
        low[live[same]] += 8
        live = live[same]
    live = np.flatnonzero((b >= 0) & (low < length))
    while len(live):
        x, y = a[live] + low[live], b[live] + low[live]
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        same = data[x] == data[y]
        live = live[same]
        low[live] += 1
        live = live[low[live] < length]


def repeats(data: np.ndarray, room: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal ``length``-byte strings among the starts that have ``room`` for one.

    Returns (repeated, first): whether an equal string starts at a place of lower ``rank``, and
    the places, in string order, of the lowest-ranked start of every different string.
    """
    order = suffix_array(data, length)
    shared = common_prefixes(data, order, length)
    starts = np.ones(len(order), bool)
    starts[1:] = shared[1:] < length
    group = np.cumsum(starts) - 1
    usable = room[order] >= length
    at, group = order[usable], group[usable]
    low = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, group, rank[at])
    is_first = rank[at] == low[group]
    repeated = np.zeros(len(data), bool)
    repeated[at] = ~is_first
    at, group = at[is_first], group[is_first]  # one a group, should a start be there twice
    return repeated, at[np.unique(group, return_index=True)[1]]


def strings_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length``-byte strings at these places, as fixed-width byte strings that sort as bytes do."""
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    return np.ascontiguousarray(windows[at]).view(f"V{length}").ravel()


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """Across shards: for each (data, first, rank of first), which firsts start earlier elsewhere.

    Pairs of neighbours are merged up a tree; the strings of one side are looked up in the
    other, sorted, side by binary search, and the lower rank of equal strings goes on.
    """
    beaten = [np.zeros(len(f), bool) for _, f, _ in shards]
    runs = []
    for k, (data, first, rank) in enumerate(shards):
        s = strings_at(data, first, length) if len(first) else np.zeros(0, f"V{length}")
        keys = _sortable(s, length)
        runs.append((keys, rank, np.full(len(first), k), np.arange(len(first))))
    while len(runs) > 1:
        merged = []
        for i in range(0, len(runs) - 1, 2):
            (ka, ra, sa, pa), (kb, rb, sb, pb) = runs[i], runs[i + 1]
            at = np.searchsorted(ka, kb)
            hit = np.zeros(len(kb), bool)
            inside = at < len(ka)
            hit[inside] = ka[at[inside]] == kb[inside]
            ia, ib = at[hit], np.flatnonzero(hit)
            b_loses = ra[ia] <= rb[ib]
            lose_a, lose_b = ia[~b_loses], ib[b_loses]
            differ = ra[ia] != rb[ib]  # of equal ranks, one start in two shards, one goes on unbeaten
            for s_, p_, lost in ((sa, pa, lose_a), (sb, pb, ib[b_loses & differ])):
                for k in np.unique(s_[lost]):
                    beaten[k][p_[lost][s_[lost] == k]] = True
            keep_a, keep_b = np.ones(len(ka), bool), np.ones(len(kb), bool)
            keep_a[lose_a], keep_b[lose_b] = False, False
            keys = np.concatenate([ka[keep_a], kb[keep_b]])
            order = np.argsort(keys, kind="stable")
            merged.append(tuple(np.concatenate([x[keep_a], y[keep_b]])[order] for x, y in ((ka, kb), (ra, rb), (sa, sb), (pa, pb))))
        if len(runs) % 2:
            merged.append(runs[-1])
        runs = merged
    return beaten


def _sortable(strings: np.ndarray, length: int) -> np.ndarray:
    """Byte strings that numpy compares: a last byte 1 keeps ending zero bytes from being cut off."""
    out = np.ones((len(strings), length + 1), np.uint8)
    if len(strings):
        out[:, :length] = strings.view(np.uint8).reshape(len(strings), length)
    return out.view(f"S{length + 1}").ravel()
