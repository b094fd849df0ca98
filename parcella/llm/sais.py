"""Suffix arrays of byte strings by induced sorting, with common prefixes.

Suffixes are classified (Nong, Zhang and Chan, 2009): a suffix is smaller or larger than its
successor, and a leftmost smaller one starts a substring that ends at the next
such position. These substrings are sorted by inducing from their first
characters, named in order, and sorted for good by recursion on the
string of names; all suffixes are then induced from them, bucket by bucket.
For bytes the buckets are processed as arrays; the recursion uses plain lists.
"""

from __future__ import annotations

import numpy as np


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the end is smallest."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    rises = text[:-1][change] < text[1:][change]
    out = np.zeros(n, bool)
    # A run of equal characters behaves as its last one does.
    begins = np.append(0, change + 1)
    kind = np.append(rises, False)
    return np.repeat(kind, np.diff(np.append(begins, n)), axis=0) if n else out


def _leftmost(smaller: np.ndarray) -> np.ndarray:
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _deal(buckets: list[list[np.ndarray]], text: np.ndarray, positions: np.ndarray):
    """Append positions to the buckets of their characters, in order."""
    chars = text[positions]
    order = np.argsort(chars, kind="stable")
    chars, positions = chars[order], positions[order]
    cuts = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chars)]):
        buckets[chars[a]].append(positions[a:b])


def induced(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of the leftmost smaller ones implies."""
    size, none = 256, np.zeros(0, np.int64)
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    larger_out: list[list[np.ndarray]] = [[] for _ in range(size)]
    smaller_out: list[list[np.ndarray]] = [[] for _ in range(size)]
    if len(leftmost):
        _deal(seeds, text, leftmost)
    larger_out[text[-1]].append(np.array([len(text) - 1]))
    larger: list[np.ndarray] = [none] * size
    for c in range(size):
        done: list[np.ndarray] = []
        while larger_out[c]:
            now = np.concatenate(larger_out[c])
            larger_out[c] = []
            done.append(now)
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _deal(larger_out, text, before)
        larger[c] = np.concatenate(done) if done else none
        for seed in seeds[c]:
            before = seed[seed > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _deal(larger_out, text, before)
    order: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        done = []
        while smaller_out[c]:
            now = np.concatenate(smaller_out[c])
            smaller_out[c] = []
            done.append(now)
            before = now[now > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _deal(smaller_out, text, before)
        back = larger[c][::-1]
        before = back[back > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _deal(smaller_out, text, before)
        order += [*done, back]
    return np.concatenate(order)[::-1]


def _named(text: np.ndarray, at: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names, by rank, of the substrings between leftmost smaller positions; in text order."""
    n = len(text)
    ends = np.append(at[1:] + 1, n)
    place = np.zeros(n, np.int64)
    place[at] = np.arange(len(at))
    own = place[ordered]
    length = ends[own] - at[own]
    fresh = np.ones(len(ordered), bool)
    # Neighbours of equal length are compared character by character, all at once per distance.
    # The substring that runs to the text's end differs from every other.
    same = np.flatnonzero((length[1:] == length[:-1]) & (own[1:] < len(at) - 1) & (own[:-1] < len(at) - 1)) + 1
    x, y, left = ordered[same], ordered[same - 1], length[same]
    step = 0
    while len(same):
        ended = left == step
        fresh[same[ended]] = False
        go = ~ended
        same, x, y, left = same[go], x[go], y[go], left[go]
        if not len(same):
            break
        equal = text[x + step] == text[y + step]
        same, x, y, left = same[equal], x[equal], y[equal], left[equal]
        step += 1
    names = np.empty(len(at), np.int64)
    names[own] = np.cumsum(fresh) - 1
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a byte string in order; a prefix comes before what it begins."""
    if len(text) < 2:
        return np.arange(len(text))
    smaller = _smaller(text)
    at = _leftmost(smaller)
    if len(at):
        marked = np.zeros(len(text), bool)
        marked[at] = True
        first = induced(text, smaller, at)
        names = _named(text, at, first[marked[first]])
        top = int(names.max()) + 1
        if top < len(at):
            at = at[np.array(sorted_suffixes(names.tolist(), top))]
        else:
            at = at[np.argsort(names)]
    return induced(text, smaller, at)


def sorted_suffixes(text: list[int], size: int) -> list[int]:
    """The same for a list of numbers below ``size``."""
    n = len(text)
    if n < 2:
        return list(range(n))
    smaller = [False] * n
    for i in range(n - 2, -1, -1):
        smaller[i] = text[i] < text[i + 1] or text[i] == text[i + 1] and smaller[i + 1]
    at = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]
    counts = [0] * (size + 1)
    for c in text:
        counts[c + 1] += 1
    heads = counts[:]
    for c in range(size):
        heads[c + 1] += heads[c]

    def induce(seeds: list[int]) -> list[int]:
        out = [-1] * n
        tail = heads[1:]
        for i in reversed(seeds):
            c = text[i]
            tail[c] -= 1
            out[tail[c]] = i
        head = heads[:]
        out_of_end = text[n - 1]
        # The end of the text is the smallest suffix and induces its predecessor first.
        out[head[out_of_end]] = n - 1
        head[out_of_end] += 1
        for k in range(n):
            i = out[k] - 1
            if i >= 0 and not smaller[i]:
                c = text[i]
                out[head[c]] = i
                head[c] += 1
        tail = heads[1:]
        for k in range(n - 1, -1, -1):
            i = out[k] - 1
            if i >= 0 and smaller[i]:
                c = text[i]
                tail[c] -= 1
                out[tail[c]] = i
        return out

    if at:
        place = dict(zip(at, range(len(at))))
        ordered = [i for i in induce(at) if i in place]
        ends = [*at[1:], n]
        names, name, before = [0] * len(at), -1, None
        for i in ordered:
            k = place[i]
            part = text[i : ends[k] + 1] if ends[k] < n else None
            if part is None or part != before:
                name += 1
            before = part
            names[k] = name
        if name + 1 < len(at):
            at = [at[k] for k in sorted_suffixes(names, name + 1)]
        else:
            at = ordered
    return induce(at)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int, sums: np.ndarray, back: np.ndarray) -> np.ndarray:
    """In text order: characters, up to ``most``, that each suffix shares with its predecessor.

    ``sums`` and ``back`` give the hash of any stretch; lengths are halved until they fit.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    here = np.flatnonzero(before >= 0)
    there = before[here]
    shared = np.zeros(len(here), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        longer = shared + step
        fits = np.flatnonzero((longer <= most) & (here + longer <= n) & (there + longer <= n))
        a, b, m = here[fits], there[fits], longer[fits]
        equal = (sums[a + m] - sums[a]) * back[a] == (sums[b + m] - sums[b]) * back[b]
        shared[fits[equal]] = m[equal]
        step >>= 1
    out[here] = shared
    return out
