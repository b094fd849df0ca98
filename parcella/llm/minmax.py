"""Near-duplicate groups by min-max hashing.

Every document becomes the set of its distinct five-word shingles. A fixed
random map orders all shingles anew for each of 64 permutations, and both the smallest and the
largest value under it are kept: 128 signature values for 64 evaluations. A
band is four values of four different permutations (two minima, two maxima), so
its parts are independent and it agrees with probability s^4 at similarity s;
with 32 bands, a pair at 0.75 is missed with probability 6e-6.

Documents with equal sets are merged first: a set is a node, whose number is its smallest
doc_id, or a free number where that id has several sets. In every bucket of a band, each
member is tried against the bucket's smallest document; confirmed pairs
form components. Buckets that then still hold several components are compared
across components, in chunks of members (those of the bucket's largest component
are met only with chunks of the others): pairs whose signatures estimate a similarity of
at least 0.6 (four standard deviations below 0.75) name the members whose full
sets are needed, and the links found on these are written as far as they join
components. Every link is confirmed on the full sets. So what is written grows
with the members of a group and not with its pairs, and no link between
different texts depends on which documents were tried first.

Defined cases: a document without words (or with a null text) has an empty set
and is linked with nothing. Fewer words than five count as one shingle. Rows that repeat a doc_id
are one document (its group is that of all its texts, different ones included); each keeps its own row.
A row without doc_id is kept, with no group. Shingles are compared by 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcella.llm.common import (
    SPACED,
    Bitmap,
    Scratch,
    _stream,
    arrow_map,
    importable,
    lists,
    mix,
    release,
    row_groups,
    shingles,
    smallest_reachable,
    utf8,
)

SHINGLE_WORDS = 5
PERMUTATIONS = 64
BANDS = 32
ESTIMATE = 0.6
#: Members of a bucket, and shingles of theirs, that are about one chunk.
CHUNK = 1_024
CHUNK_SHINGLES = 500_000
#: Rows of such groups that a task takes at once.
GROUP_ROWS = 10_000

_A = _stream(11, PERMUTATIONS) | np.uint64(1)
_B = _stream(12, PERMUTATIONS)


def extremes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of every non-empty set under every permutation."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.concatenate(sets)
    low = np.empty((len(sets), PERMUTATIONS), np.uint64)
    high = np.empty_like(low)
    for k in range(PERMUTATIONS):
        moved = values * _A[k] + _B[k]
        low[:, k] = np.minimum.reduceat(moved, starts)
        high[:, k] = np.maximum.reduceat(moved, starts)
    return low, high


def band_hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One number per band: two minima and two maxima of four permutations."""
    factors = _stream(13, 4) | np.uint64(1)
    bands = np.empty((len(low), BANDS), np.uint64)
    for b in range(BANDS):
        p = [2 * b, 2 * b + 1, (2 * b + 2) % PERMUTATIONS, (2 * b + 3) % PERMUTATIONS]
        parts = mix(low[:, p[0]]) * factors[0] + mix(low[:, p[1]]) * factors[1]
        parts += mix(high[:, p[2]]) * factors[2] + mix(high[:, p[3]]) * factors[3]
        bands[:, b] = mix(parts + np.uint64(b))
    return bands


def _row_sets(batch):
    """Rows and their shingle sets, a group of rows at a time."""
    data, offsets = utf8(batch.column(1))
    for i, j in row_groups(offsets):
        hashes, bounds, _, _ = SPACED.words(data, offsets[i : j + 1])
        yield i, j, shingles(hashes, bounds, SHINGLE_WORDS)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


SIGNATURE = "doc_id long, n_shingles long, same binary, bands array<long>, signature binary"


def _signatures(batch):
    for i, j, sets in _row_sets(batch):
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        bands = np.zeros((0, BANDS), np.uint64)
        signature: list = [None] * len(sets)
        same: list = [None] * len(sets)
        if len(full):
            low, high = extremes([sets[r] for r in full])
            bands = band_hashes(low, high)
            values = np.concatenate([low, high], axis=1) >> np.uint64(32)
            for r, row in zip(full.tolist(), values.astype(np.uint32)):
                signature[r] = row.tobytes()
                same[r] = _digest(sets[r])
        counts = np.where(sizes > 0, BANDS, 0)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(i, j - i),
                pa.array(sizes),
                pa.array(same, pa.binary()),
                lists(bands.ravel().view(np.int64), np.append(0, counts.cumsum()), pa.int64()),
                pa.array(signature, pa.binary()),
            ],
            ["doc_id", "n_shingles", "same", "bands", "signature"],
        )


def _similar(frames):
    """Pairs (a, b) whose signatures estimate a similarity of at least ESTIMATE."""
    for frame in frames:
        if len(frame):
            left = np.frombuffer(b"".join(frame["sa"]), np.uint32).reshape(len(frame), -1)
            right = np.frombuffer(b"".join(frame["sb"]), np.uint32).reshape(len(frame), -1)
            near = (left == right).mean(1) >= ESTIMATE
            yield frame.loc[near, ["a", "b"]]


def _near(rows: pd.DataFrame):
    """For each (bucket, i, j): row numbers and, per row, those of its candidates.

    A group holds chunks i and j of a bucket. Members of one are compared with
    those of the other, or with each other where both are the same chunk, if
    their components differ, and only in the first band that the two share.
    """
    keys = rows[["bucket", "i", "j"]].to_numpy()
    cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    signatures = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(len(rows), -1)
    bands = np.stack(rows["bands"].to_list())
    root, chunk = rows["root"].to_numpy(), rows["chunk"].to_numpy()
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
        bucket, i, j = keys[lo]
        left = np.flatnonzero(chunk[lo:hi] == i) + lo
        right = left if i == j else np.flatnonzero(chunk[lo:hi] == j) + lo
        found = []
        for x in left.tolist():
            other = right[root[right] != root[x]]
            if i == j:
                other = other[other > x]
            other = other[(signatures[other] == signatures[x]).mean(1) >= ESTIMATE]
            if len(other):
                band = (bands[x] == bucket).argmax()
                other = other[(bands[other] == bands[x]).argmax(1) == band]
            if len(other):
                found.append((x, other))
        yield found


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.drop_duplicates(["bucket", "i", "j", "node"]).sort_values(["bucket", "i", "j"], ignore_index=True)


PLACE = "bucket long, i int, j int, chunk int, node long, root long"


def _open_members(rows):
    """Members that have a candidate, with their place."""
    rows = _ordered(rows)
    hit = np.zeros(len(rows), bool)
    for found in _near(rows):
        for x, other in found:
            hit[x] = True
            hit[other] = True
    return rows.loc[hit, ["bucket", "i", "j", "chunk", "node", "root"]]


def _linking(percent: int):
    def run(rows):
        """Confirmed links, as many as join components, of each (bucket, i, j)."""
        rows = _ordered(rows)
        node, sets = rows["node"].to_numpy(), [np.sort(s.view(np.uint64)) for s in rows["shingles"]]
        links = []
        for found in _near(rows):
            head = {}

            def find(r, head=head):
                while head.get(r, r) != r:
                    r = head[r]
                return r

            for x, other in found:
                own = sets[x]
                flat = np.concatenate([sets[y] for y in other])
                starts = np.cumsum([0] + [len(sets[y]) for y in other[:-1]])
                same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                common = np.add.reduceat(same.astype(np.int64), starts)
                union = len(own) + np.array([len(sets[y]) for y in other]) - common
                for y in other[100 * common >= percent * union].tolist():
                    a, b = find(rows["root"][x]), find(rows["root"][y])
                    if a != b:
                        head[a] = b
                        links.append((min(node[x], node[y]), max(node[x], node[y])))
        return pd.DataFrame(links, columns=["a", "b"]).drop_duplicates()

    return run


def _numbered(scratch: Scratch, first: DataFrame, ids: DataFrame) -> DataFrame:
    """(same, doc_id, node) of every set; nodes differ, and those that are no doc_id of the set are no doc_id at all.

    ``first`` has the smallest doc_id of every set; an id that several sets have goes to one of them.
    """
    main = first.groupBy("doc_id").agg(F.min("same").alias("main"))
    split = scratch.write(first.join(main, "doc_id").withColumn("extra", F.expr("same <> main")).drop("main"), "split")
    extra = split.where("extra").select("same")
    for seed in itertools.count():
        # Drawn anew in the rare case that two numbers, or a number and an id, are equal.
        numbers = extra.select("same", F.xxhash64("same", F.lit(seed)).alias("number"))
        twice = numbers.groupBy("number").count().where("count > 1").select("number")
        taken = numbers.join(ids, F.col("number") == F.col("doc_id"), "left_semi").select("number")
        if twice.union(taken).isEmpty():
            break
    node = F.when(F.col("extra"), F.xxhash64("same", F.lit(seed))).otherwise(F.col("doc_id"))
    return scratch.write(split.select("same", "doc_id", node.alias("node")), "numbered")


def near_duplicates(documents: DataFrame, similarity_percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text)."""
    spark = importable(documents.sparkSession)
    scratch = Scratch(spark, "minmax")
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    rows = scratch.write(arrow_map(texts, SIGNATURE, _signatures), "signatures")
    usable = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # A node stands for all documents with the same set.
    first = usable.groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    first = _numbered(scratch, scratch.write(first, "same"), usable.select("doc_id"))
    member = usable.select("same", F.col("doc_id").alias("b")).distinct().join(first, "same")
    member = scratch.write(member.select(F.col("doc_id").alias("a"), "b"), "member")
    extra = first.where("node <> doc_id").select("node", "doc_id")
    nodes = usable.select("doc_id", "same", "n_shingles", "bands").join(first, ["same", "doc_id"])
    nodes = scratch.write(nodes.select("node", "n_shingles", "bands"), "nodes")
    release(spark)

    band = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = band.groupBy("bucket").agg(
        F.min("node").alias("first"),
        F.max("node").alias("last"),
    )
    shared = scratch.write(shared.where("first < last").drop("last"), "shared")
    bucketed = scratch.write(band.join(shared, "bucket"), "bucketed")
    touched = bucketed.select("node").distinct().join(first, "node")
    signatures = usable.select("doc_id", "same", "signature", "bands").join(touched, ["same", "doc_id"])
    signatures = scratch.write(signatures.select("node", "signature", "bands").dropDuplicates(["node"]), "touched")
    release(spark)

    def sets_of(ids: DataFrame) -> DataFrame:
        """(node, shingles) of the given nodes; a bitmap keeps most other texts from being read into sets."""
        ids = scratch.write(ids.join(first, "node"), "wanted")
        wanted = Bitmap(ids.select(F.xxhash64("doc_id").alias("key")), "key")

        def sets(batch):
            batch = batch.filter(pa.array(wanted.maybe(batch.column(2).to_numpy())))
            for i, j, own in _row_sets(batch):
                ends = np.cumsum([0] + [len(s) for s in own])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([_digest(s) for s in own], pa.binary()),
                        lists(np.concatenate(own).view(np.int64), ends, pa.int64()),
                    ],
                    ["doc_id", "same", "shingles"],
                )

        keyed = texts.where("doc_id IS NOT NULL").withColumn("key", F.xxhash64("doc_id"))
        found = arrow_map(keyed, "doc_id long, same binary, shingles array<long>", sets)
        # Rows that repeat an id and its text give one set.
        found = found.join(ids.hint("merge"), ["doc_id", "same"]).dropDuplicates(["doc_id", "same"])
        return scratch.write(found.select("node", "shingles"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those pairs whose full sets are similar enough."""
        pairs = scratch.write(pairs, "pairs")
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}"))
        common = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - common
        linked = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * common >= similarity_percent * union)
        linked = scratch.write(linked.select("a", "b"), "links")
        scratch.drop(sets)
        return linked

    side = lambda name: signatures.select(F.col("node").alias(name), F.col("signature").alias(f"s{name}"))
    stars = bucketed.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
    links = confirmed(stars.mapInPandas(_similar, "a long, b long"))
    release(spark)
    roots = scratch.write(smallest_reachable(scratch, links.union(member).union(extra)), "roots")

    # Buckets that still hold several components.
    placed = bucketed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = scratch.write(placed.select("bucket", "node", "root", "n_shingles"), "placed")
    release(spark)
    several = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    placed = placed.join(scratch.write(several.select("bucket"), "several"), "bucket")
    # Chunks of the largest component come first; they are met with those of the rest, these with all.
    sized = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    largest = F.max(F.struct("n", "root", "s")).alias("top")
    sized = sized.groupBy("bucket").agg(largest, F.sum("n").alias("n"), F.sum("s").alias("s"))
    chunks = lambda n, s: F.greatest(F.ceil(n / CHUNK), F.ceil(s / CHUNK_SHINGLES)).cast("int")
    sized = sized.select(
        "bucket",
        F.col("top.root").alias("top"),
        chunks(F.col("top.n"), F.col("top.s")).alias("inner"),
        chunks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("outer"),
    )
    placed = placed.join(scratch.write(sized, "sized"), "bucket")
    own = "pmod(xxhash64(node), IF(root = top, inner, outer))"
    placed = placed.withColumn("chunk", F.expr(f"CAST({own} + IF(root = top, 0, inner) AS int)"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(IF(root = top, inner, 0), inner + outer - 1)")))
    placed = placed.select(
        "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "root"
    )
    placed = scratch.write(placed, "chunks")
    release(spark)

    def shared_out(rows: DataFrame, n: int) -> DataFrame:
        """Groups (bucket, i, j), whole, dealt to shares of about n rows."""
        shares = max(1, math.ceil(rows.count() / n))
        return rows.withColumn("share", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(shares)))

    open_ = shared_out(placed, GROUP_ROWS).join(signatures, "node").groupBy("share").applyInPandas(_open_members, PLACE)
    open_ = scratch.write(open_, "open")
    release(spark)
    sets = sets_of(open_.select("node").distinct())
    again = shared_out(open_, GROUP_ROWS // 10).join(signatures, "node").join(sets, "node")
    links = links.union(again.groupBy("share").applyInPandas(_linking(similarity_percent), "a long, b long"))
    # Free numbers give way to ids, so that the smallest node of a component is its smallest id.
    for side in ("a", "b"):
        real = extra.select(F.col("node").alias(side), "doc_id")
        links = links.join(real, side, "left").withColumn(side, F.coalesce("doc_id", side)).select("a", "b")
    roots = smallest_reachable(scratch, links.union(member))
    roots = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(roots, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
