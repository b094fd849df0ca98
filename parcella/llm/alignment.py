"""Which tokens of two tokenizers stand for the same bytes, and how usual each pairing is.

Both tokenizers encode a space and the text. Where tokens of both end at the same byte
there is a cut; cuts divide the tokens into groups, and every token of one side is linked
with every token of the other side in its group. Cuts are found by divide and
conquer: in an interval the middle token's end is looked up by bisection among the other
side's ends, then its neighbours' to both sides; at a common end the interval is divided, and one
without any is a group. All intervals of a piece of text advance together as arrays.

Texts are worked off in chunks of about ``CHUNK_BYTES``. A chunk lists its distinct id
pairs, each with the number of its rows that hold it; its rows refer to that list. The
lists, not the rows, are counted over the corpus and get the counts back, so a pair that
stands in every text is one row per chunk, and a count travels once per chunk. No table of
pairs is broadcast or collected.

Defined cases: a null or empty text, and one that a tokenizer does not give back byte for
byte, has no tokens and zeros. Each row is a document of its own, also where ids
repeat or are null. The result has the id column and the outputs only.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcella.llm.common import Scratch, importable, row_groups, utf8

BYTE_MODEL = os.environ.get("BYTE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
PIECE_MODEL = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
CHUNK_BYTES = 8_000_000
#: Neighbours of the middle that are looked up one by one before all of an interval are.
PROBES = 8
#: Groups of more links than this count their ids first.
LARGE_GROUP = 256
#: Entries of a stored row; longer texts take several.
SLICE = 1 << 14
#: Fixed value: how byte-level vocabularies of this kind split text.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Side:
    """A tokenizer and the bytes of its ids."""

    content: list[bytes]

    def __post_init__(self):
        self.lengths = np.array([len(c) for c in self.content], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.content.__getitem__, ids))


class ByteSide(Side):
    """Byte-level merges read from a vocabulary file.

    Where the ids follow the order of the merges they are ranks, and the faster of
    two equal encoders can be used; a text that it refuses goes to the other one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        size = max(model["vocab"].values()) + 1
        content = [b""] * size
        for token, i in model["vocab"].items():
            content[i] = bytes(letters[c] for c in token)
        super().__init__(content)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ordered = [model["vocab"].get(m.replace(" ", "")) for m in merged] == list(range(256, 256 + len(merged)))
        self.fast = None
        if ordered:
            import tiktoken

            ranks = {c: i for i, c in enumerate(content)}
            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(" " + text)
            except ValueError:
                pass
        return self.whole.encode(" " + text, add_special_tokens=False).ids


class PieceSide(Side):
    """A SentencePiece model; it adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        content = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            content.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        super().__init__(content)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


_loaded: dict[tuple[type, str], Side] = {}


def _side(kind: type, path: str) -> Side:
    """A worker reads each vocabulary once."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray):
    """First tokens, on both sides, of all groups, in order.

    Rows are the bounds of texts among the tokens; a text ends at the same byte on both
    sides. Ends grow over all texts.
    """
    a0, a1, b0, b1 = rows_a[:-1], rows_a[1:], rows_b[:-1], rows_b[1:]
    held = a1 > a0
    a0, a1, b0, b1 = a0[held], a1[held], b0[held], b1[held]
    tried = np.zeros(len(a0), np.int64)
    firsts_a, firsts_b = [], []
    while len(a0):
        inner = a1 - a0 - 1
        leaf = (tried >= inner) | (b1 - b0 < 2)
        firsts_a.append(a0[leaf])
        firsts_b.append(b0[leaf])
        a0, a1, b0, b1, tried, inner = (x[~leaf] for x in (a0, a1, b0, b1, tried, inner))
        step = (tried + 1) // 2
        at = a0 + (inner - 1) // 2 + np.where(tried % 2 == 1, step, -step)
        found = np.searchsorted(ends_b, ends_a[at])
        hit = ends_b[found] == ends_a[at]
        tried = tried + 1
        for k in np.flatnonzero(~hit & (tried >= PROBES) & (tried < inner)).tolist():
            # Many neighbours had none: look up all ends of the interval.
            own = ends_a[a0[k] : a1[k] - 1]
            places = np.searchsorted(ends_b, own)
            common = np.flatnonzero(ends_b[places] == own)
            tried[k] = inner[k]
            if len(common):
                best = common[np.argmin(np.abs(common - len(own) // 2))]
                at[k], found[k], hit[k] = a0[k] + best, places[best], True
        miss = ~hit
        zeros = np.zeros(int(hit.sum()), np.int64)
        tried = np.concatenate((tried[miss], zeros, zeros))
        a0, a1 = np.concatenate((a0[miss], a0[hit], at[hit] + 1)), np.concatenate((a1[miss], at[hit] + 1, a1[hit]))
        b0, b1 = np.concatenate((b0[miss], b0[hit], found[hit] + 1)), np.concatenate((b1[miss], found[hit] + 1, b1[hit]))
    if not firsts_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    firsts_a, firsts_b = np.concatenate(firsts_a), np.concatenate(firsts_b)
    order = np.argsort(firsts_a)
    return firsts_a[order], firsts_b[order]


def _links(ids_a, ids_b, bounds_a, bounds_b, width: int):
    """(group, pair, times) of all links; a pair may come several times in a group."""
    x, y = np.diff(bounds_a), np.diff(bounds_b)
    small = np.flatnonzero(x * y <= LARGE_GROUP)
    n = (x * y)[small]
    group = np.repeat(small, n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pairs = ids_a[bounds_a[group] + inside // y[group]] * width + ids_b[bounds_b[group] + inside % y[group]]
    groups, pairs, times = [group], [pairs], [np.ones(len(pairs), np.int64)]
    for g in np.flatnonzero(x * y > LARGE_GROUP).tolist():
        own_a, n_a = np.unique(ids_a[bounds_a[g] : bounds_a[g + 1]], return_counts=True)
        own_b, n_b = np.unique(ids_b[bounds_b[g] : bounds_b[g + 1]], return_counts=True)
        pairs.append((own_a[:, None] * width + own_b).ravel())
        times.append((n_a[:, None] * n_b).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)


def _summed(row: np.ndarray, pair: np.ndarray, times: np.ndarray):
    """Distinct (row, pair), sorted, with their times added up."""
    order = np.lexsort((pair, row))
    row, pair, times = row[order], pair[order], times[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
    first = np.flatnonzero(new)
    return row[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers byte by byte, all lowest bytes first, which compresses small ones well."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(planes: bytes, width: int) -> np.ndarray:
    data = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return np.ascontiguousarray(data).view(f"<u{width}").ravel().astype(np.int64)


@dataclass
class Aligned:
    """Counts of the rows of a piece, and its distinct (row, pair) with their times."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    row: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def align(texts: list[str | None], a: Side, b: Side, labels: list[str]) -> Aligned:
    """Tokens, groups and links of some texts.

    ``labels`` has four strings an id, as :func:`group_labels` gives them.
    """
    rows_a, rows_b, all_a, all_b = [0], [0], [], []
    for text in texts:
        if text:
            own_a, own_b, whole = a.encode(text), b.encode(text), b" " + text.encode()
            if a.joined(own_a) == whole and b.joined(own_b) == whole:
                all_a += own_a
                all_b += own_b
        rows_a.append(len(all_a))
        rows_b.append(len(all_b))
    ids_a, ids_b = np.array(all_a, np.int64), np.array(all_b, np.int64)
    rows_a, rows_b = np.array(rows_a, np.int64), np.array(rows_b, np.int64)
    first_a, first_b = shared_cuts(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]), rows_a, rows_b)
    bounds_a, bounds_b = np.append(first_a, len(ids_a)), np.append(first_b, len(ids_b))
    group_rows = np.searchsorted(first_a, rows_a)
    x, y = np.diff(bounds_a), np.diff(bounds_b)
    links = np.concatenate(([0], np.cumsum(x * y)))
    # Every token's place in the text form: behind the other side's tokens of earlier groups (and, for b, of its own).
    place_a = np.arange(len(ids_a)) + np.repeat(first_b, x)
    place_b = np.arange(len(ids_b)) + np.repeat(bounds_a[1:], y)
    kind_a, kind_b = np.zeros(len(ids_a), np.int64), np.full(len(ids_b), 2)
    kind_a[bounds_a[1:] - 1], kind_b[bounds_b[1:] - 1] = 1, 3
    line = np.empty(len(ids_a) + len(ids_b), np.int64)
    line[place_a], line[place_b] = ids_a * 4 + kind_a, ids_b * 4 + kind_b
    digests = []
    for i, j in zip((rows_a + rows_b)[:-1].tolist(), (rows_a + rows_b)[1:].tolist()):
        form = "".join(map(labels.__getitem__, line[i:j].tolist()))[:-1]
        digests.append(hashlib.sha256(form.encode()).hexdigest() if form else "")
    group, pair, times = _links(ids_a, ids_b, bounds_a, bounds_b, len(b.content))
    row = np.searchsorted(group_rows, group, "right") - 1
    return Aligned(
        np.diff(rows_a), np.diff(rows_b), np.diff(group_rows), np.diff(links[group_rows]), digests, *_summed(row, pair, times)
    )


def group_labels(n: int) -> list[str]:
    """Each number with what may follow it: ``,`` or ``|`` on one side, ``,`` or ``;`` on the other."""
    return [f"{i}{mark}" for i in range(n) for mark in ",|,;"]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _chunk_schema(id_type: T.DataType) -> T.StructType:
    fields = [("chunk", T.StringType()), ("row", T.IntegerType()), ("doc_id", id_type)]
    fields += [(name, T.LongType()) for name in _COUNTS]
    fields += [("groups_sha256", T.StringType()), ("used", T.BinaryType()), ("times", T.BinaryType())]
    fields += [("first", T.IntegerType()), ("pairs", T.ArrayType(T.LongType())), ("n_docs", T.ArrayType(T.IntegerType()))]
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


class _Chunk:
    """Collects rows until their texts are long enough."""

    def __init__(self, name: str, schema: pa.Schema):
        self.name, self.schema, self.size, self.parts, self.ids = name, schema, 0, [], []

    def add(self, part: Aligned, ids: pa.Array, size: int):
        part.row += sum(len(x) for x in self.ids)
        self.size += size
        self.parts.append(part)
        self.ids.append(ids)

    def _batch(self, n: int, **columns) -> pa.RecordBatch:
        arrays = [
            columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array)
            else pa.array(columns[f.name], f.type) if f.name in columns
            else pa.nulls(n, f.type)
            for f in self.schema
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows of the list of pairs, then of the texts."""
        joined = lambda name: np.concatenate([getattr(p, name) for p in self.parts])
        pairs, used, n_docs = np.unique(joined("pair"), return_inverse=True, return_counts=True)
        for i in range(0, len(pairs), SLICE):
            own = pairs[i : i + SLICE].tolist(), n_docs[i : i + SLICE].tolist()
            yield self._batch(1, chunk=[self.name], first=[i], pairs=[own[0]], n_docs=[own[1]])
        ids, times = pa.concat_arrays(self.ids), joined("times")
        ends = np.searchsorted(joined("row"), np.arange(len(ids) + 1))
        head = [joined(name) for name in _COUNTS]
        digests = [d for p in self.parts for d in p.digests]
        at, took, kept = [], [], []
        for k in range(len(ids)):
            # A text of many pairs takes several rows; the first one carries its counts.
            for i in range(ends[k], max(ends[k + 1], ends[k] + 1), SLICE):
                j = min(i + SLICE, ends[k + 1])
                at.append(k)
                took.append(_planes(np.diff(used[i:j], prepend=0), 4))
                kept.append(_planes(times[i:j], 8))
            if len(at) >= 500 or k == len(ids) - 1:
                rows = np.array(at)
                first = np.concatenate(([True], rows[1:] != rows[:-1]))
                own = {name: np.where(first, x[rows], 0) for name, x in zip(_COUNTS, head)}
                sha = [digests[r] if f else None for r, f in zip(at, first)]
                yield self._batch(
                    len(at), chunk=[self.name] * len(at), row=at, doc_id=ids.take(pa.array(rows)), groups_sha256=sha, used=took, times=kept, **own
                )
                at, took, kept = [], [], []


def align_tokens(documents: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """One row a document: counts of tokens, groups and links, and how usual its links are.

    ``n_best`` counts the links whose pair is in as many documents as any pair of its first
    id; ``count_sum`` adds up, over the links, how many documents hold their pair.
    """
    spark = importable(documents.sparkSession)
    own = documents.select("doc_id", "text")
    schema = _chunk_schema(own.schema["doc_id"].dataType)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    width = len(PieceSide(piece_model).content)

    def cut(batches):
        a, b = _side(ByteSide, byte_model), _side(PieceSide, piece_model)
        labels, task, n = group_labels(max(len(a.content), len(b.content))), TaskContext.get(), 0
        chunk = None
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in row_groups(offsets):
                if chunk is None:
                    chunk, n = _Chunk(f"{task.partitionId()}-{n}", arrow), n + 1
                part = align(batch.column(1).slice(i, j - i).to_pylist(), a, b, labels)
                chunk.add(part, batch.column(0).slice(i, j - i), int(offsets[j] - offsets[i]))
                if chunk.size >= CHUNK_BYTES:
                    yield from chunk.rows()
                    chunk = None
        if chunk is not None:
            yield from chunk.rows()

    stored = Scratch(spark, "alignment").write(own.mapInArrow(cut, schema), "chunks")
    held = stored.where("row IS NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("k", "held"), "first")
    held = held.select("chunk", (F.col("first") + F.col("k")).alias("place"), F.col("held.pairs").alias("pair"), "held.n_docs")
    counts = held.groupBy("pair").agg(F.sum("n_docs").alias("n"))
    of_first = Window.partitionBy(F.expr(f"pair div {width}"))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(of_first)).hint("merge")
    known = held.select("chunk", "place", "pair").join(counts, "pair").select(F.col("chunk").alias("of"), "place", "n", "best")

    result = T.StructType(
        [T.StructField("doc_id", own.schema["doc_id"].dataType)]
        + [T.StructField(name, T.LongType()) for name in (*_COUNTS, "n_best", "count_sum")]
        + [T.StructField("groups_sha256", T.StringType())]
    )
    result_arrow = to_arrow_schema(result)

    def finish(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
        used, times, rows = texts.column("used").to_pylist(), texts.column("times").to_pylist(), texts.column("row").to_numpy()
        best_sum, count_sum = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for i in range(len(rows)):
            at, often = np.cumsum(_numbers(used[i], 4)), _numbers(times[i], 8)
            best_sum[i], count_sum[i] = often @ best[at], often @ n[at]
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(rows[order]) > 0)))
        head = [c for c, sha in zip(range(len(rows)), texts.column("groups_sha256").to_pylist()) if sha is not None]
        heads = np.array(head)[np.argsort(rows[head], kind="stable")]
        firsts = texts.take(pa.array(heads))
        summed = {"n_best": np.add.reduceat(best_sum[order], starts), "count_sum": np.add.reduceat(count_sum[order], starts)}
        return pa.table([pa.array(summed[f.name]) if f.name in summed else firsts.column(f.name) for f in result_arrow], schema=result_arrow)

    texts = stored.where("row IS NOT NULL").drop("first", "pairs", "n_docs")
    return texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(finish, result)
