"""Plain versions of the corpus operators for small inputs, written from their contracts."""

import collections
import hashlib
import re
import zlib

import numpy as np


def words(text):
    return (text or "").encode().split()


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))


def near_components(docs, k, percent=80):
    sets = {i: shingle_set(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeated_bytes(docs, length=200):
    count = collections.Counter(b[j : j + length] for _, b in docs for j in range(len(b) - length + 1))
    out = {}
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left)
    return out


def equal_groups(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in docs}
    text = dict(docs)
    groups = collections.defaultdict(list)
    for i, n in norm.items():
        groups[n].append(i)
    out = {}
    for n, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(text[i] or ""), i))
        for i in ids:
            out[i] = (keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest())
    return out


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for j in range(len(w) - 7):
        at[tuple(w[j : j + 8])].append(j)
    again = {k for js in at.values() if len(js) > 1 for j in js for k in range(j, j + 8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), n < 20 or 100 * len(again) > 30 * n


def held_out_ids(ids):
    return {int(i) for i in ids if zlib.crc32(str(i).encode()) % 4 == 2}
