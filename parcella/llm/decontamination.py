"""Benchmark passages in documents, also reworded, by latent semantic retrieval.

Benchmark items are cut into chunks of 24 words, documents into overlapping
windows of 24. Both are TF-IDF vectors over hashed words, projected on the
leading singular directions of the passages of all documents and items, and centred. These come from a randomised SVD: every
round multiplies the passages, where they are, with a narrow matrix and adds
up the products per word; only narrow matrices reach the driver. The last product also gives the directions
(Nystroem's approximation), so no further pass is needed for them.

How frequent a word is, is counted over the whole corpus as the number of
different words that follow it, so neither copies of a passage nor the length
of documents change it. No word weighs nothing. Every window is compared
with all chunks by cosine; eight words in a row that an item holds are found as they are,
so a verbatim copy does not depend on any weight. For close ones that share words the stretch of the
document that would correspond to the whole item is compared with it by their
longest common subsequence of words. An item counts as found if the
subsequence covers 60 % of it, or 50 % and the stretch also holds its
answer, which stands for its most specific content: its three rarest words.

The benchmark is taken in blocks of a bounded number of words, one pass over the documents each.

Defined cases: a null or empty text, or a null or empty item, matches nothing.
Every row is judged by itself; repeated rows get equal results. With an empty
benchmark nothing is found. A null item_id is no item.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcella.llm.common import ALNUM, Scratch, _stream, arrow_map, importable, mix, release, row_groups, utf8

WINDOW, STRIDE = 24, 8
SIZE = 1 << 15
RANK, EXTRA, ROUNDS = 96, 8, 2
#: Words of a benchmark block at most; words that a task multiplies, about.
BLOCK_WORDS = 100_000
TASK_WORDS = 32_000_000
#: Up to so many tasks multiply fewer words, but no less than these: a task's sums take 14 MB of the shuffle at any size.
TASKS, LEAST_WORDS = 16, 4_000_000
COSINE = 0.48
#: A run of so many words of an item is compared whatever its words weigh.
PHRASE = 8
#: What a word weighs at least; registers of a hashed word's count of followers (error 13 %).
LEAST = 0.1
REGISTERS = 64
#: Share of a chunk's words that a window must hold before stretches are compared.
SHARED = 0.4
COVERED, COVERED_WITH_ANSWER = 0.6, 0.5
ANSWER_WORDS = 3
SLACK = 12
#: Windows that are multiplied with a sixteenth as many chunks at once; close pairs whose words are compared at once.
TILE, PAIRS = 8_192, 32_768
#: Bits in which words are marked before they are compared, a multiple of 64; leading bits of hashes that say where to look.
MARKS, LEADING = 256, 18


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(49)).astype(np.int64)


def _count_followers(table: np.ndarray, hashes: np.ndarray, bounds: np.ndarray):
    """Enter every word with the one behind it into its bucket's registers (HyperLogLog, Flajolet et al., 2007)."""
    if not len(hashes):
        return
    behind = np.append(hashes[1:], np.uint64(0))
    behind[bounds[1:][np.diff(bounds) > 0] - 1] = 0
    pair = mix(hashes + mix(behind))
    cell = _bucket(hashes) * REGISTERS + (pair >> np.uint64(58)).astype(np.int64)
    rest = pair | np.uint64(1 << 57)
    rank = np.frexp((rest & (~rest + np.uint64(1))).astype(float))[1]
    np.maximum.at(table, cell, rank.astype(np.uint8))


def _estimates(table: np.ndarray) -> np.ndarray:
    """Distinct entries of each bucket."""
    own = table.reshape(-1, REGISTERS)
    raw = 0.709 * REGISTERS**2 / np.exp2(-own.astype(float)).sum(1)
    empty = (own == 0).sum(1)
    few = REGISTERS * np.log(REGISTERS / np.maximum(1, empty))
    return np.where((raw <= 2.5 * REGISTERS) & (empty > 0), few, raw)


def _passages(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Buckets of the passages of some texts, one to a row filled up with SIZE; the last of a text ends with it."""
    sizes = np.diff(bounds)
    parts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = (bounds[row] + np.minimum(WINDOW * number, np.maximum(0, sizes[row] - WINDOW)))[:, None] + np.arange(WINDOW)
    bucket = np.append(_bucket(hashes), SIZE).astype(np.uint16)
    return bucket[np.where(at < bounds[row + 1][:, None], at, len(hashes))]


def scan(texts: DataFrame, items: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """What the words of each bucket weigh, how often it occurs in passages, and the passages of all texts and items.

    The weight is minus the logarithm of the chance that a window holds the bucket,
    if words occurred as often as different words follow them in the texts.
    """
    parts, step = 32, SIZE // 32

    def run(batches):
        table, times = np.zeros(SIZE * REGISTERS, np.uint8), np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for weighed in (True, False):
                data, offsets = utf8(batch.filter(pc.equal(batch.column(1), weighed)).column(0))
                for i, j in row_groups(offsets):
                    hashes, bounds, _, _ = ALNUM.words(data, offsets[i : j + 1])
                    if weighed:
                        _count_followers(table, hashes, bounds)
                    words = _passages(hashes, bounds)
                    times += np.bincount(words.ravel(), minlength=SIZE + 1)
                    yield row(words=[words.tobytes()])
        for part, own in enumerate(table.reshape(parts, step * REGISTERS)):
            yield row(part=[part], own=[own.tobytes()], times=[times[part * step : (part + 1) * step].tobytes()])

    def row(part=(None,), own=(None,), times=(None,), words=(None,)):
        columns = [pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in (own, times, words))]
        return pa.RecordBatch.from_arrays(columns, ["part", "own", "times", "words"])

    def merge(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, own, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own, times = np.frombuffer(own.as_buffer(), np.uint8), np.frombuffer(times.as_buffer(), np.int64)
                before = total.get(part, (own, 0))
                total[part] = np.maximum(own, before[0]), times + before[1]
        for part, (own, times) in total.items():
            yield row([part], [own.tobytes()], [times.tobytes()]).select(["part", "own", "times"])

    every = texts.select("text", F.lit(True).alias("weighed")).unionByName(items.select("text", F.lit(False).alias("weighed")))
    schema = "part int, own binary, times binary"
    stored = scratch.write(every.mapInArrow(run, f"{schema}, words binary"), "passages")
    followers, counts = np.zeros(SIZE), np.zeros(SIZE, np.int64)
    tables = stored.where("part IS NOT NULL").select("part", "own", "times")
    found = tables.repartition(8, "part").mapInArrow(merge, schema).toArrow()
    for part, table, times in zip(found.column("part").to_pylist(), found.column("own"), found.column("times")):
        own = slice(part * step, (part + 1) * step)
        followers[own] = _estimates(np.frombuffer(table.as_buffer(), np.uint8))
        counts[own] = np.frombuffer(times.as_buffer(), np.int64)
    share = (1 + followers) / (1 + followers.sum())
    weights = np.maximum(LEAST, -np.log(-np.expm1(-WINDOW * share)))
    passages = stored.where("words IS NOT NULL").select("words")
    return weights, counts, passages.coalesce(_tasks(int(counts.sum())))


def _tasks(words: int) -> int:
    """How many tasks multiply passages of so many words."""
    return max(1, min(TASKS, math.ceil(words / LEAST_WORDS)), math.ceil(words / TASK_WORDS))


def _starts(n: int, step: int) -> list[int]:
    """Where windows of n words begin; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, step), n - WINDOW]


@dataclass
class Block:
    """Some benchmark items, ready to be searched for."""

    items: list[int]
    words: list[np.ndarray]
    answers: list[set[int]]
    chunks: np.ndarray
    chunk_item: np.ndarray
    chunk_at: np.ndarray
    chunk_size: np.ndarray
    #: Distinct words in order; where those with the same leading bits begin.
    vocabulary: np.ndarray
    leading: np.ndarray
    #: Numbers (from 1) of every chunk's distinct words in the vocabulary, filled up with -1, and how often they occur; their marks.
    chunk_numbers: np.ndarray
    chunk_times: np.ndarray
    chunk_marks: np.ndarray
    item_numbers: list[np.ndarray]
    #: By length: hashes in order, items and places of their runs of PHRASE words; a shorter item is one run. Leading bits that they have.
    phrases: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _text_words(texts: list[str]) -> list[np.ndarray]:
    data, offsets = utf8(pa.array(texts, pa.string()))
    hashes, bounds, _, _ = ALNUM.words(data, offsets)
    return [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _phrases(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    factors = _stream(14, size) | np.uint64(1)
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * factors[j]
    return mix(total)


def _phrase_tables(words: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for k, own in enumerate(words):
        size = min(PHRASE, len(own))
        # A run that an item repeats stands where it comes first, as it does in a copy.
        first, at = np.unique(_phrases(own, size), return_index=True)
        runs.setdefault(size, []).extend((h, k, a) for h, a in zip(first.tolist(), at.tolist()))
    tables = {}
    for size, rows in runs.items():
        hashes, item, at = (np.array(x, kind) for x, kind in zip(zip(*sorted(rows)), (np.uint64, np.int64, np.int64)))
        known = np.zeros(1 << LEADING, bool)
        known[hashes >> np.uint64(64 - LEADING)] = True
        tables[size] = hashes, item, at, known
    return tables


def _chunks(words: list[np.ndarray]) -> tuple[list[np.ndarray], list[int], list[int]]:
    parts, item, at = [], [], []
    for k, own in enumerate(words):
        for a in _starts(len(own), WINDOW):
            parts.append(own[a : a + WINDOW])
            item.append(k)
            at.append(a)
    return parts, item, at


def _block(items: list[int], texts: list[str], idf: np.ndarray, table: np.ndarray) -> Block:
    words = _text_words(texts)
    parts, item, at = _chunks(words)
    vectors = np.array([table[_bucket(p)].sum(0) for p in parts], np.float32).reshape(len(parts), table.shape[1])
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    sizes = np.array([len(p) for p in parts], np.int64)
    vocabulary = np.unique(np.concatenate(words))
    leading = _leading(vocabulary)
    item_numbers = [_numbers(x, vocabulary, leading) for x in words]
    rare = -idf[_bucket(vocabulary)]
    answers = [set(sorted(set(own.tolist()), key=lambda k: (rare[k - 1], k))[:ANSWER_WORDS]) for own in item_numbers]
    numbers, times = np.full((len(parts), WINDOW), -1, np.int32), np.zeros((len(parts), WINDOW), np.uint8)
    marks = np.zeros((len(parts), MARKS // 64), np.uint64)
    for k, part in enumerate(parts):
        own, often = np.unique(_numbers(part, vocabulary, leading), return_counts=True)
        numbers[k, : len(own)], times[k, : len(own)] = own, often
        marks[k] = _marks(own[None])
    places = np.array(item, np.int64), np.array(at, np.int64)
    words_of = vocabulary, leading, numbers, times, marks, item_numbers
    return Block(items, words, answers, vectors, *places, sizes, *words_of, _phrase_tables(words))


def _places(item: list[int]) -> dict[int, int]:
    """Where each word of an item stands, as bits."""
    masks: dict[int, int] = {}
    for k, word in enumerate(item):
        masks[word] = masks.get(word, 0) | (1 << k)
    return masks


def common_words(item: list[int], stretch: list[int], masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, one whole row of the table per word (as bits)."""
    masks = masks or _places(item)
    full = row = (1 << len(item)) - 1
    for word in stretch:
        mask = masks.get(word)
        if mask:
            row = ((row + (row & mask)) | (row & ~mask)) & full
    return len(item) - row.bit_count()


def _window_vectors(hashes: np.ndarray, bounds: np.ndarray, table: np.ndarray):
    """Row, first word and vector of every window; the last row of ``table`` is empty and stands for no word."""
    sizes = np.diff(bounds)
    # Sums of STRIDE words each; a window is a few of them in a row, fewer in a short text.
    parts = -(-sizes // STRIDE)
    first = np.append(0, np.cumsum(parts))
    owner = np.repeat(np.arange(len(sizes)), parts)
    begins = bounds[:-1][owner] + STRIDE * (np.arange(first[-1]) - first[:-1][owner])
    stops, bucket = bounds[1:][owner], np.append(_bucket(hashes), SIZE)
    sums = np.zeros((first[-1] + 1, table.shape[1]), np.float32)
    for j in range(STRIDE):
        sums[:-1] += table[bucket[np.where(begins + j < stops, begins + j, len(hashes))]]
    several = WINDOW // STRIDE
    begin = np.flatnonzero(np.arange(first[-1]) <= np.maximum(first[owner], first[owner + 1] - several))
    row = owner[begin]
    vectors = sums[begin]
    for j in range(1, several):
        vectors += sums[np.where(begin + j < first[row + 1], begin + j, first[-1])]
    return row, begins[begin], vectors


def _leading(ordered: np.ndarray) -> np.ndarray:
    """How many of some ordered hashes stand before those that begin with the same LEADING bits, for all such bits."""
    return np.searchsorted(ordered, np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING))


def _numbers(hashes: np.ndarray, vocabulary: np.ndarray, leading: np.ndarray) -> np.ndarray:
    """Numbers of words among the benchmark's, from 1; 0 for all others."""
    at = leading[hashes >> np.uint64(64 - LEADING)]
    found = np.zeros(len(hashes), np.int64)
    for k in range(int(np.diff(leading, append=len(vocabulary)).max())):
        own = np.minimum(at + k, len(vocabulary) - 1)
        np.copyto(found, own + 1, where=vocabulary[own] == hashes)
    return found


def _marks(numbers: np.ndarray) -> np.ndarray:
    """The words of each row as bits, several words to a bit."""
    bits = np.zeros((len(numbers), MARKS), bool)
    bits[np.arange(len(numbers))[:, None], numbers % MARKS] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _shared(words: np.ndarray, marks: np.ndarray, block: Block, windows: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Which pairs of a window and a chunk share enough of the chunk's words.

    Words that share a bit are counted as one bit, so a chunk's further words are added: what has too few then is out.
    """
    own, least = block.chunk_marks, SHARED * block.chunk_size
    further = block.chunk_size - np.bitwise_count(own).sum(1, dtype=np.int64)
    both = np.bitwise_count(marks.take(windows, 0) & own.take(chunks, 0))
    bits = sum(both[:, j].astype(np.int64) for j in range(both.shape[1]))
    hit = np.flatnonzero(bits >= (least - further)[chunks])
    same = words[windows[hit], :, None] == block.chunk_numbers[chunks[hit], None, :]
    times = np.where(same.any(1), block.chunk_times[chunks[hit]], 0).sum(1)
    return hit[times >= least[chunks[hit]]]


def _close_windows(hashes, bounds, block: Block, table: np.ndarray, numbers: np.ndarray):
    """(row, item, place where the item would begin) of windows close to a chunk that share words with it."""
    row, starts, vectors = _window_vectors(hashes, bounds, table)
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    # A chunk shorter than a window fills only a part of it.
    least = (COSINE * np.sqrt(block.chunk_size / WINDOW)).astype(np.float32)
    for i in range(0, len(vectors), TILE):
        own = slice(i, i + TILE)
        at = starts[own, None] + np.arange(WINDOW)
        words = np.where(at < bounds[row[own] + 1][:, None], numbers[np.minimum(at, len(hashes) - 1)], 0).astype(np.int32)
        marks = _marks(words)
        for first in range(0, len(block.chunks), TILE // 16):
            part = slice(first, first + TILE // 16)
            near = np.flatnonzero(block.chunks[part] @ vectors[own].T >= least[part, None])
            for j in range(0, len(near), PAIRS):
                chunk, window = np.divmod(near[j : j + PAIRS], len(words))
                chunk += first
                hit = _shared(words, marks, block, window, chunk)
                chunk, window = chunk[hit], window[hit] + i
                yield row[window], block.chunk_item[chunk], starts[window] - block.chunk_at[chunk]


def _phrase_places(hashes, bounds, block: Block):
    """The same of runs of words that stand in an item."""
    for size, (phrase, item, at, known) in block.phrases.items():
        own = _phrases(hashes, size)
        hit = np.flatnonzero(known[own >> np.uint64(64 - LEADING)])
        own = own[hit]
        low = np.searchsorted(phrase, own)
        same = phrase[np.minimum(low, len(phrase) - 1)] == own
        hit, own, low = hit[same], own[same], low[same]
        row = np.searchsorted(bounds, hit, "right") - 1
        inside = hit + size <= bounds[row + 1]
        hit, row, own, low = hit[inside], row[inside], own[inside], low[inside]
        count = np.searchsorted(phrase, own, "right") - low
        which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(row, count), item[which], np.repeat(hit, count) - at[which]


def _search(hashes: np.ndarray, bounds: np.ndarray, block: Block, table: np.ndarray) -> dict[tuple[int, int], float]:
    """Share of each found item by (row, item number)."""
    found: dict[tuple[int, int], float] = {}
    if not len(hashes):
        return found
    numbers = _numbers(hashes, block.vocabulary, block.leading)
    places = [*_phrase_places(hashes, bounds, block), *_close_windows(hashes, bounds, block, table, numbers)]
    rows, items, begins = (np.concatenate([np.zeros(0, np.int64), *own]) for own in zip(*places)) if places else [np.zeros(0, np.int64)] * 3
    # Stretches that begin within a few words of each other are one.
    order = np.lexsort([begins // STRIDE, rows, items])
    keys = np.stack([items, rows, begins // STRIDE])[:, order]
    chosen = order[np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))] if len(order) else order
    cuts = np.flatnonzero(np.diff(items[chosen], prepend=-1))
    member = np.zeros(len(block.vocabulary) + 1, bool)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chosen)]):
        own = chosen[lo:hi]
        item = int(items[own[0]])
        words, answer = block.item_numbers[item].tolist(), block.answers[item]
        masks = _places(words)
        # The stretch that would correspond to the whole item, if the item began there.
        starts = np.maximum(bounds[rows[own]], begins[own] - SLACK)
        stops = np.minimum(bounds[rows[own] + 1], begins[own] + len(words) + SLACK)
        member[words] = True
        for r, a, b in zip(rows[own].tolist(), starts.tolist(), stops.tolist()):
            stretch = numbers[a:b]
            stretch = stretch[member[stretch]]
            # No subsequence is longer than the number of the stretch's words that the item holds.
            if len(stretch) < COVERED_WITH_ANSWER * len(words):
                continue
            stretch = stretch.tolist()
            share = common_words(words, stretch, masks) / len(words)
            if share >= COVERED or share >= COVERED_WITH_ANSWER and answer <= set(stretch):
                found[r, item] = max(share, found.get((r, item), 0.0))
        member[words] = False
    return found


def _tables(column: pa.Array):
    """Passages as ``_passages`` gives them, from rows of one passage's words each or of many packed ones."""
    if pa.types.is_binary(column.type):
        for own in column:
            yield np.frombuffer(own.as_buffer(), np.uint16).reshape(-1, WINDOW)
    else:
        sizes = np.asarray(column.value_lengths(), np.int64)
        words = np.full((len(sizes), WINDOW), SIZE, np.uint16)
        words[np.arange(WINDOW) < sizes[:, None]] = column.flatten().to_numpy()
        yield words


def _images(words: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sum of the words' rows for each passage."""
    out, other = np.empty((len(words), matrix.shape[1]), np.float32), np.empty((CACHED, matrix.shape[1]), np.float32)
    for i in range(0, len(words), CACHED):
        own, to = words[i : i + CACHED], out[i : i + CACHED]
        np.take(matrix, own[:, 0], axis=0, out=to, mode="clip")
        for j in range(1, WINDOW):
            to += np.take(matrix, own[:, j], axis=0, out=other[: len(own)], mode="clip")
    return out


def _sums(rows: np.ndarray, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of rows[index] over consecutive groups of the given sizes (1 at least), sixteen at a time."""
    result, left = np.empty((len(sizes), rows.shape[1]), np.float32), np.arange(len(sizes))
    first, other = np.empty((2, CACHED, rows.shape[1]), np.float32)
    while len(left):
        blocks = -(-sizes // 16)
        ends, last = np.cumsum(sizes), np.cumsum(blocks)
        begin = np.repeat(ends - sizes, blocks) + 16 * (np.arange(last[-1]) - np.repeat(last - blocks, blocks))
        length = np.minimum(16, np.repeat(ends, blocks) - begin)
        order = np.argsort(-length.astype(np.int8), kind="stable")
        out = np.empty((len(order), rows.shape[1]), np.float32)
        for i in range(0, len(order), CACHED):
            own = order[i : i + CACHED]
            at, minus, to = begin[own], -length[own], first[: len(own)]
            np.take(rows, index[at], axis=0, out=to, mode="clip")
            for j in range(1, -int(minus[0])):
                n = int(np.searchsorted(minus, -j))
                to[:n] += np.take(rows, index[at[:n] + j], axis=0, out=other[:n], mode="clip")
            out[own] = to
        done = blocks == 1
        result[left[done]] = out[(last - 1)[done]]
        rows, index, sizes, left = out, np.flatnonzero(np.repeat(~done, blocks)), blocks[~done], left[~done]
    return result


#: Rows of a narrow matrix that stay in a core's cache; passages multiplied at once.
CACHED, MULTIPLIED = 512, 16_384


def _products(passages: DataFrame, idf: np.ndarray, narrow: np.ndarray) -> np.ndarray:
    """Transposed passages times passages times a narrow matrix, added up over all tasks."""
    spark = passages.sparkSession
    weights = np.append(idf, 0).astype(np.float32)
    matrix = np.zeros((SIZE + 1, narrow.shape[1]), np.float32)
    np.multiply(narrow, weights[:-1, None], out=matrix[:-1])
    sent = spark.sparkContext.broadcast((weights**2, matrix))
    del matrix
    width, step = narrow.shape[1], 1024

    def run(batches):
        squares, matrix = sent.value
        total = np.zeros((SIZE, width), np.float32)
        for batch in batches:
            for words in _tables(batch.column(0)):
                for i in range(0, len(words), MULTIPLIED):
                    own = words[i : i + MULTIPLIED]
                    image = _images(own, matrix)
                    image /= np.maximum(1e-9, squares[own].sum(1))[:, None]
                    flat = own.ravel()
                    order = np.argsort(flat, kind="stable")
                    count = np.bincount(flat, minlength=SIZE + 1)[:SIZE]
                    used = np.flatnonzero(count)
                    total[used] += _sums(image, order // WINDOW, count[used])
        for part in range(SIZE // step):
            own = total[part * step : (part + 1) * step]
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": [own.tobytes()]})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(sums.as_buffer(), np.float32)
                total[part] = own + total[part] if part in total else own
        for part, sums in total.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": [sums.tobytes()]})

    schema = "part int, sums binary"
    sums = passages.mapInArrow(run, schema).repartition(8, "part").mapInArrow(add, schema).toArrow()
    out = np.zeros((SIZE, width), np.float32)
    for part, own in zip(sums.column("part").to_pylist(), sums.column("sums")):
        out[part * step : (part + 1) * step] = np.frombuffer(own.as_buffer(), np.float32).reshape(step, width)
    sent.destroy()
    out *= weights[:-1, None]
    del sums
    release(spark)
    return out


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Transposed a times b, in double precision."""
    return sum(a[i : i + 4096].astype(float).T @ b[i : i + 4096].astype(float) for i in range(0, len(a), 4096))


def _roots(square: np.ndarray) -> np.ndarray:
    """Columns that turn a symmetric matrix into the unit one, largest first, without its empty directions."""
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    kept = values > max(1e-30, 1e-9 * values[-1])
    kept[-1] = True
    return (vectors[:, kept] / np.sqrt(np.maximum(values[kept], 1e-30)))[:, ::-1]


def singular_directions(passages: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors (hashed words by RANK) of the TF-IDF passages (Halko et al., 2011)."""
    basis = np.random.Generator(np.random.PCG64(7)).standard_normal((SIZE, RANK + EXTRA), np.float32)
    for _ in range(ROUNDS - 1):
        basis = _products(passages, idf, basis)
        basis = basis @ _roots(_inner(basis, basis)).astype(np.float32)
    image = _products(passages, idf, basis)
    # image times roots, times its own transpose, is what the passages' products come to on this subspace.
    roots = _roots(_inner(basis, image))
    return image @ (roots @ _roots(roots.T @ _inner(image, image) @ roots)[:, :RANK]).astype(np.float32)


def _word_vectors(idf: np.ndarray, basis: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Projected words less the mean one of the passages, so that texts at large have no direction in common.

    The last row is empty.
    """
    words = np.zeros((SIZE + 1, basis.shape[1]), np.float32)
    np.multiply(basis, idf[:, None], out=words[:-1], casting="same_kind")
    words[:-1] -= (counts / max(1, counts.sum())).astype(np.float32) @ words[:-1]
    return words


def find_leaks(documents: DataFrame, benchmark: DataFrame, output: str = "leaks") -> DataFrame:
    """All columns and the items found in every text, as (item_id, share); a column of that name is replaced."""
    spark = importable(documents.sparkSession)
    scratch = Scratch(spark, "leaks")
    found = "array<struct<item_id:bigint,share:double>>"
    own = documents.select([c for c in documents.columns if c.lower() != output.lower()])
    empty = own.withColumn(output, F.expr(f"cast(array() as {found})"))
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND length(text) > 0")
    n_words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    if not n_words:
        return empty

    idf, counts, passages = scan(own, items, scratch)
    table = _word_vectors(idf, singular_directions(passages, idf), counts)

    n_blocks = math.ceil(n_words / BLOCK_WORDS)
    marked = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    out = empty
    kind = T._parse_datatype_string(found)
    schema = T.StructType([*own.schema.fields, T.StructField(output, kind)])
    text = own.columns.index("text")
    arrow_kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())]))
    for b in range(n_blocks):
        rows = marked.where(F.col("block") == b).orderBy("item_id", "text").collect()  # bounded by BLOCK_WORDS
        rows = [(r["item_id"], r["text"]) for r in rows if len(_text_words([r["text"]])[0])]
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((_block([i for i, _ in rows], [t for _, t in rows], idf, table), table))

        def run(batch, sent=sent):
            block, vectors = sent.value
            data, offsets = utf8(batch.column(text))
            for i, j in row_groups(offsets, 500_000):
                hashes, bounds, _, _ = ALNUM.words(data, offsets[i : j + 1])
                part = batch.slice(i, j - i)
                hits = [dict() for _ in range(j - i)]
                for (row, item), share in _search(hashes, bounds, block, vectors).items():
                    name = block.items[item]
                    hits[row][name] = max(share, hits[row].get(name, 0.0))
                before = part.column(part.num_columns - 1).to_pylist()
                merged = [
                    sorted(old + [{"item_id": k, "share": s} for k, s in new.items()], key=lambda x: x["item_id"])
                    for old, new in zip(before, hits)
                ]
                columns = [*part.columns[:-1], pa.array(merged, arrow_kind)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

        out = arrow_map(out, schema, run)
    return out
