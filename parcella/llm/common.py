"""What the operators share: tables, scratch tables, and words as numpy arrays.

Texts reach Python as Arrow batches. The helpers below look at the UTF-8 bytes
of a batch directly and work in pieces of a few megabytes, so that memory does
not depend on how many rows a batch holds.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcella.session import importable, shared_dir

PIECE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the shared folder that cut lineage; they survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/parcella-{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.option("compression", "zstd").parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored.scratch_path = path
        return stored

    def drop(self, df: DataFrame):
        """Delete a table that no later step reads, recomputation included."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession):
    """Let go of what finished steps hold: Spark drops their shuffle files and broadcasts when the driver collects garbage.

    Called between the jobs of an operator that has many, as the driver's heap else grows with them.
    """
    gc.collect()
    spark._jvm.System.gc()


def fresh_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def arrow_map(df: DataFrame, schema, run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Apply ``run`` to every Arrow batch; a batch may give several."""

    def each(batches):
        for batch in batches:
            yield from run(batch)

    return df.mapInArrow(each, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def row_groups(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, rows)
        yield i, j
        i = j


def _wrap(numbers) -> np.ndarray:
    return np.array([n % 2**64 for n in numbers], np.uint64)


def _stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers from a seed."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, np.uint64)


BYTE_VALUES = _stream(1, 256)
_FACTOR = int(_stream(2, 1)[0]) | 1
_MAX_POWER = 1 << 14
_powers = [1]
for _ in range(_MAX_POWER - 1):
    _powers.append(_powers[-1] * _FACTOR % 2**64)
POWERS = np.array(_powers, np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordRule:
    """Which bytes belong to words; the rest separates them. A-Z is lowered."""

    def __init__(self, is_word: Callable[[int], bool]):
        self.member = np.array([is_word(b) for b in range(256)])
        self.values = np.where(self.member, BYTE_VALUES[LOWER], np.uint64(0))

    def _piece(self, data: np.ndarray, breaks: np.ndarray):
        """Hashes, starts and ends of the words of some bytes; none crosses a break."""
        word = self.member[data]
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        before[breaks] = False
        starts = np.flatnonzero(word & ~before)
        if not len(starts):
            return np.zeros(0, np.uint64), starts, starts
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        after[breaks[breaks > 0] - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        at = np.arange(len(data), dtype=np.int64)
        at[: starts[0]] = 0
        at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        at &= _MAX_POWER - 1
        sums = np.add.reduceat(self.values[data] * POWERS[at], starts)
        return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts, ends

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """Word hashes of consecutive rows, the rows' bounds in them, word starts and ends.

        Works in pieces cut at separators, so a very long row needs memory for
        its words only. Starts and ends are positions in ``data``.
        """
        lo, hi = int(offsets[0]), int(offsets[-1])
        found, a = [], lo
        while a < hi:
            b = min(hi, a + PIECE_BYTES)
            while b < hi and self.member[data[b]]:
                stop = min(hi, b + 4096)
                gaps = np.flatnonzero(~self.member[data[b:stop]])
                b = b + int(gaps[0]) if len(gaps) else stop
            inside = offsets[(offsets >= a) & (offsets < b)] - a
            hashes, starts, ends = self._piece(data[a:b], inside)
            found.append((hashes, starts + a, ends + a))
            a = b
        if not found:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
        hashes, starts, ends = (np.concatenate(x) for x in zip(*found))
        return hashes, np.searchsorted(starts, offsets), starts, ends


#: Words between ASCII white space.
SPACED = WordRule(lambda b: b != 32 and not 9 <= b <= 13)
#: Runs of letters, digits and everything beyond ASCII.
ALNUM = WordRule(lambda b: b > 127 or chr(b).isalnum())


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's ``size``-word shingles.

    A row of fewer words has its whole sequence as its one shingle, an empty
    row none.
    """
    factors = _stream(3, size) | np.uint64(1)
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * factors[j]
    total = mix(total + np.uint64(size))
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(total[a : b - size + 1]))
        elif b > a:
            whole = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64)
            sets.append(mix(np.array([whole + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


BITMAP_BITS = 26


class Bitmap:
    """Which numbers may occur; of fixed size, so its broadcast is bounded. False says never."""

    def __init__(self, rows: DataFrame, column: str):
        block = BITMAP_BITS - 16

        def pack(key, table):
            bits = np.zeros(1 << 16, bool)
            bits[table.column("bit").to_numpy() & 0xFFFF] = True
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(bits).tobytes()]})

        bits = rows.select(F.shiftrightunsigned(column, 64 - BITMAP_BITS).cast("int").alias("bit")).distinct()
        packed = bits.withColumn("block", F.expr("bit >> 16")).groupBy("block").applyInArrow(pack, "block int, bits binary")
        whole = np.zeros((1 << block, 1 << 13), np.uint8)
        found = packed.toArrow()
        for place, own in zip(found.column("block").to_pylist(), found.column("bits")):
            whole[place] = np.frombuffer(own.as_buffer(), np.uint8)
        self.sent = rows.sparkSession.sparkContext.broadcast(whole.ravel())

    def maybe(self, values: np.ndarray) -> np.ndarray:
        bit = (values.astype(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        return (self.sent.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def smallest_reachable(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node it reaches.

    ``links`` has columns a and b. Each round points every node's larger
    neighbours at its smallest one, then every node's smaller neighbours at
    the smallest (the large-star and small-star steps of Kiveris et al.), until
    only stars remain. A round costs two grouped minima and two joins; a node with
    very many links is an ordinary skewed join key, since the minima are
    stored first and both sides of the join are shuffled.
    """
    edges = scratch.write(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, "large")
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for used in (edges, low, large, least):
            scratch.drop(used)
        edges = small
        release(scratch.spark)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger one, or only larger ones."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.where("down > 1 OR (down = 1 AND up = 1)").limit(1).count()
