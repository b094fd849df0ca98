"""Periodic runs of words: stretches that repeat with a fixed period.

A run is a stretch of consecutive words with smallest period q, at least
``min_length`` words and ``min_exponent`` periods long, that no neighbouring word
extends. Runs are found by a suffix automaton with link-cut access. The automaton
of a stretch is built word by word; its suffix links form a tree. Then the prefixes
are visited in order: access to the state of prefix i joins the path to the root
into one segment coloured with i, and the segments it passes tell, for each
suffix of the prefix, where it ended last. If that end lies p words back and the
segment's longest suffix has p words or more, the two occurrences form a square
of period p which reaches as far left as it can; seen again at each further
prefix it grows to the right until the run ends.

Words that cannot lie in a run are kept out of the automaton, without loss: a run of
length l and period q repeats each of its grams of l - q words, that is of at least
``min_length - min_length / min_exponent`` ones, at distance q, which is at most
its share of the stretch. So stretches are cut to the words covered by grams that repeat
near enough within the stretch. This looks at hashes, which can only keep too
much; the automaton compares words.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none, no
runs and an empty collapsed text. Every row is judged by itself, so repeated rows
and null ids are no special case; columns of the outputs' names are replaced. Work
and memory follow the words of one text at a time.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parcella.llm.common import SPACED, arrow_map, importable, mix, row_groups, utf8

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: How often a stretch is cut before it is taken as it is; more would change no result.
CUTS = 12

Run = tuple[int, int, int]


def _gram(min_length: int, min_exponent: int) -> int:
    return min_length - min_length // min_exponent


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` consecutive words at every start, built by doubling."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    whole, done, power, width = None, 0, hashes, 1
    factor = np.uint64(0x9E3779B97F4A7C15)
    while True:
        if size & width:
            part = power[done : done + n]
            whole = part if whole is None else mix(whole * factor + part)
            done += width
        if done == size:
            return whole
        power = mix(power[: len(power) - width] * factor + power[width:])
        width *= 2


def candidate_stretches(hashes: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Ranges of words outside which there can be no run, and none across their ends."""
    size = _gram(min_length, min_exponent)
    marks = grams(hashes, size)
    todo, found = [(0, len(hashes), 0)], []
    while todo:
        a, b, depth = todo.pop()
        if b - a < min_length:
            continue
        own = marks[a : b - size + 1]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        near = (ranked[1:] == ranked[:-1]) & ((order[1:] - order[:-1]) * min_exponent <= b - a)
        if not near.any():
            continue
        starts = np.zeros(len(own) + 1, bool)
        starts[order[1:][near]] = True
        starts[order[:-1][near]] = True
        at = np.flatnonzero(starts)
        breaks = np.flatnonzero(np.diff(at) > size)
        firsts = at[np.concatenate(([0], breaks + 1))] + a
        lasts = at[np.concatenate((breaks, [len(at) - 1]))] + a + size
        parts = list(zip(firsts.tolist(), lasts.tolist()))
        if parts == [(a, b)] or depth >= CUTS:
            found += parts
        else:
            todo += [(x, y, depth + 1) for x, y in parts]
    return sorted(found)


def suffix_links(words: list[int]) -> tuple[array, array, array]:
    """(length, link) of the states of the words' suffix automaton, and the state of each prefix.

    State 0 is the root. A state's first transition stands in two arrays; only states
    with several have a dictionary, so long periodic texts take little memory.
    """
    length, link, word, target = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [-1])
    more: dict[int, dict[int, int]] = {0: {}}
    prefixes, last = array("i"), 0
    for c in words:
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        word.append(-1)
        target.append(-1)
        p = last
        while p >= 0:
            if word[p] == c:
                q = target[p]
                break
            others = more.get(p)
            if others is None:
                if word[p] < 0:
                    word[p], target[p] = c, state
                else:
                    more[p] = {c: state}
            else:
                q = others.get(c, -1)
                if q >= 0:
                    break
                others[c] = state
            p = link[p]
        else:
            q = -1
        if q >= 0:
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                word.append(word[q])
                target.append(target[q])
                if q in more:
                    more[clone] = dict(more[q])
                link[q] = link[state] = clone
                while p >= 0:
                    if word[p] == c:
                        if target[p] != q:
                            break
                        target[p] = clone
                    else:
                        others = more.get(p)
                        if others is None or others.get(c) != q:
                            break
                        others[c] = clone
                    p = link[p]
        prefixes.append(state)
        last = state
    return length, link, prefixes


def find_runs(words: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """(start, length, period) of all runs, by start, then period; words are numbers.

    Each segment of the link tree is a splay tree ordered by depth, whose top carries
    the segment's colour: the last end of the suffixes in it.
    """
    length, up, prefixes = suffix_links(words)
    n = len(length)
    # Node 0 means none here, so states are numbered from 1.
    parent = array("i", [0]) + array("i", [x + 1 for x in up])
    size = array("i", [0]) + length
    left, right = array("i", [0]) * (n + 1), array("i", [0]) * (n + 1)
    colour = array("i", [-1]) * (n + 1)
    ends: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefixes):
        x, below = state + 1, 0
        while x:
            # Splay x to the top of its tree; the top's colour moves with it.
            p = parent[x]
            if p and (left[p] == x or right[p] == x):
                while True:
                    g = parent[p]
                    inner = g and (left[g] == p or right[g] == p)
                    if inner:
                        # Rotate the grandparent first where both turns go one way.
                        a, b = (p, g) if (left[g] == p) == (left[p] == x) else (x, p)
                        turns = ((a, b), (x, p if a == p else g))
                    else:
                        turns = ((x, p),)
                        colour[x] = colour[p]
                    for c, d in turns:
                        top = parent[d]
                        if left[d] == c:
                            m = right[c]
                            left[d] = m
                            right[c] = d
                        else:
                            m = left[c]
                            right[d] = m
                            left[c] = d
                        if m:
                            parent[m] = d
                        parent[d] = c
                        parent[c] = top
                        if top:
                            if left[top] == d:
                                left[top] = c
                            elif right[top] == d:
                                right[top] = c
                    p = parent[x]
                    if not inner:
                        break
                    if not p or left[p] != x and right[p] != x:
                        # The tree's old top is now below x.
                        colour[x] = colour[g]
                        break
            end = colour[x]
            if end >= 0:
                period, longest = i - end, size[x]
                whole = longest + period
                if whole >= min_length and whole >= min_exponent * period:
                    ends[i - whole + 1, period] = i
            deeper = right[x]
            if deeper:
                colour[deeper] = end
            right[x] = below
            below, x = x, parent[x]
        colour[below] = i
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


def runs_of(words: list[bytes], hashes: np.ndarray, min_length: int, min_exponent: int) -> list[Run]:
    """The runs of one text."""
    found = []
    for a, b in candidate_stretches(hashes, min_length, min_exponent):
        numbers: dict[bytes, int] = {}
        own = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        found += [(a + start, length, period) for start, length, period in find_runs(own, min_length, min_exponent)]
    return sorted(found)


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds behind its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    kept, upto = [], 0
    for first, end in sorted((start + period, start + length) for start, length, period in runs):
        if first > upto:
            kept += words[upto:first]
        upto = max(upto, end)
    return b" ".join([*kept, *words[upto:]])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUTPUTS = {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}


def with_runs(
    documents: DataFrame,
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """All columns, the ``runs`` of every text and its ``collapsed`` form."""
    importable(documents.sparkSession)
    own = documents.select([c for c in documents.columns if c.lower() not in _OUTPUTS])
    at = own.columns.index(text)

    def run(batch):
        data, offsets = utf8(batch.column(at))
        for i, j in row_groups(offsets):
            hashes, bounds, _, _ = SPACED.words(data, offsets[i : j + 1])
            runs, texts = [], []
            for k in range(j - i):
                words = data[offsets[i + k] : offsets[i + k + 1]].tobytes().split()
                found = runs_of(words, hashes[bounds[k] : bounds[k + 1]], min_length, min_exponent)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(collapsed(words, found))
            part = batch.slice(i, j - i)
            made = [pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *_OUTPUTS])

    fields = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in _OUTPUTS.items()]
    return arrow_map(own, T.StructType([*own.schema.fields, *fields]), run)
