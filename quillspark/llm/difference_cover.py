"""Suffix order of a string of integers by the difference cover {1, 2} mod 3, with numpy sorts."""

from __future__ import annotations

import numpy as np


def _packed(parts: list[np.ndarray], bits: int) -> np.ndarray | None:
    if bits * len(parts) > 63:
        return None
    key = parts[0].astype(np.int64)
    for p in parts[1:]:
        key = (key << bits) | p
    return key


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of `s` (values >= 0, fewer than 2^21 distinct) in lexicographic order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = s.astype(np.int64) + 1  # 0 ends the string
    bits = max(int(s.max()), n + 3).bit_length()
    pad = np.concatenate([s, np.zeros(4, np.int64)])
    n0, n1 = (n + 2) // 3, (n + 1) // 3
    at1, at2 = np.arange(1, n + (n0 - n1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([at1, at2])

    # Equal triples get one name, so their order doesn't matter here, and the fastest sort will do.
    # Sort the sampled triples and name them by rank; where names repeat, recurse on the string of names.
    triples = [pad[sampled], pad[sampled + 1], pad[sampled + 2]]
    key = _packed(triples, bits)
    order = np.argsort(key) if key is not None else np.lexsort(triples[::-1])
    cols = [key[order]] if key is not None else [t[order] for t in triples]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) - 1
    sorted12 = order if new.all() else suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled[sorted12]] = np.arange(1, len(sampled) + 1)
    sorted12 = sampled[sorted12]
    sorted12 = sorted12[sorted12 < n]  # without the one that only pads

    # The remaining suffixes follow from their first symbol and their neighbour's rank.
    at0 = np.arange(0, n, 3)
    key0 = (pad[at0] << bits) | rank[at0 + 1]
    at0 = at0[np.argsort(key0)]

    # Merge: against suffixes at 1 mod 3 by one symbol and a rank, against those at 2 mod 3 by two symbols and a rank.
    a1, a2 = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    before = np.searchsorted((pad[a1] << bits) | rank[a1 + 1], (pad[at0] << bits) | rank[at0 + 1])
    two = lambda i: (((pad[i] << bits) | pad[i + 1]) << bits) | rank[i + 2]
    before = before + np.searchsorted(two(a2), two(at0))
    out = np.empty(n, np.int64)
    place = np.arange(len(at0)) + before
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = at0
    out[rest] = sorted12
    return out


def repeated_windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of `starts`: whether text[start : start + length] also begins at another of them."""
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    index = np.full(len(text), -1, np.int64)
    index[starts] = np.arange(len(starts))
    order = suffix_array(text)
    order = order[index[order] >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.zeros(len(order) - 1, bool)
    left, right = order[:-1], order[1:]
    maybe = np.flatnonzero((text[left] == text[right]) & (text[left + length - 1] == text[right + length - 1]) & (text[left + length // 2] == text[right + length // 2]))
    for i in range(0, len(maybe), 16_384):
        m = maybe[i : i + 16_384]
        same[m] = (windows[left[m]] == windows[right[m]]).all(axis=1)
    out = np.zeros(len(starts), bool)
    out[index[left[same]]] = True
    out[index[right[same]]] = True
    return out
