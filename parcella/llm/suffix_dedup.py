"""Repeated byte strings across documents, by sharded suffix arrays.

A string of ``length`` bytes that starts anywhere else in the corpus is
removed wherever it stands. Every position of a text starts such a string; it
belongs to the stretch of ``ANCHOR`` bytes inside it whose hash is least. Equal
strings have equal anchors at equal distances, so comparing what shares an anchor
compares everything:

1. Consecutive positions with one anchor form a segment (about 60 positions).
   Anchors that occur once in the corpus are done with; a segment that occurs
   twice, letter for letter, is covered.
2. Different segments with one anchor go to the shard of that anchor. A shard
   of some 300 kB is one string; its suffix array is built by induced sorting
   and the common prefixes of neighbours tell which positions repeat.
3. An anchor with very many different segments (the rim of a passage that a
   large part of the corpus has) is split by the hash of the whole string instead, which is
   its own anchor of full length, so no shard holds a hot group.
4. The covered ranges return to the texts.

Texts are keyed by a 64-bit hash, so copies of a document are handled once.
Two passes send rows only for what a fixed-size bitmap does not rule out; what
it lets through by chance is sorted out by the joins.

Defined cases: a null text is empty; a text shorter than ``length`` keeps
everything. Repeated rows count as copies of each other, and all lose their bytes. Anchors,
segments and strings of hot anchors are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcella.llm.common import BYTE_VALUES, Bitmap, Scratch, arrow_map, importable, lists, mix, utf8
from parcella.llm.sais import permuted_prefixes, suffix_array

LENGTH = 200
ANCHOR = 80
SHARD_BYTES = 300_000
#: Different segments of an anchor beyond which it is split by whole strings.
HOT_SEGMENTS = 2_000
#: Occurrences of an anchor beyond which they are dealt to several shares.
BUSY = 5_000
SHARES = 64
PIECE = 300_000
SEPARATOR = 255  # no byte of UTF-8

_P = 0x5851F42D4C957F2D
_P_BACK = pow(_P, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, at least n of them."""
    if len(_tables.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", _P), ("back", _P_BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["back"]


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums that give the hash of any stretch a:b as (sums[b] - sums[a]) * back[a]."""
    up, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, back[: len(data) + 1]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Pieces of (row, start in row, positions, distance of the anchor, anchor, segment hash)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    for a in range(lo, hi, PIECE):
        b = min(hi, a + PIECE + length - 1)
        n = b - a - length + 1
        if n <= 0:
            continue
        sums, back = prefix_sums(data[a:b])
        hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * back[: len(sums) - ANCHOR])
        # The hash decides, and the first place among equals.
        keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        place = (_least(keys, length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
        at = np.arange(a, a + n)
        row = np.searchsorted(offsets, at, "right") - 1
        valid = at + length <= offsets[row + 1]
        fresh = np.ones(n, bool)
        fresh[1:] = (place[1:] != place[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
        start = np.flatnonzero(valid & fresh)
        if not len(start):
            continue
        stop = np.append(start[1:], n)
        # A segment also ends where its text has no further position.
        stop = np.minimum(stop, offsets[row[start] + 1] - length + 1 - a)
        count = stop - start
        whole = (sums[stop + length - 1] - sums[start]) * back[start]
        # Anchors are small numbers, being least; mixed, they use all of a bitmap.
        yield row[start], start + a - offsets[row[start]], count, place[start] - start, mix(hashes[place[start]]), mix(whole)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def _shard(length: int):
    """Repeated positions of the different segments of a shard."""

    def run(key, table):
        column = table.column("bytes").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in column]
        mark = np.array([SEPARATOR], np.uint8)
        text = np.concatenate([x for p in parts for x in (p, mark)])
        starts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        sums, back = prefix_sums(text)
        order = suffix_array(text)
        shared = permuted_prefixes(text, order, length, sums, back)
        repeated = shared >= length
        repeated[order[:-1][repeated[order[1:]]]] = True
        ranges, sizes = [], []
        for a, n in zip(starts.tolist(), table.column("n").to_pylist()):
            own = np.flatnonzero(np.diff(np.concatenate([[0], repeated[a : a + n].astype(np.int8), [0]])))
            ranges.append(own)
            sizes.append(len(own))
        flat = np.concatenate(ranges) if ranges else np.zeros(0, np.int64)
        out = table.select(["anchor", "segment", "n", "distance"])
        return out.append_column("ranges", lists(flat, np.append(0, np.cumsum(sizes)), pa.int32()))

    return run


ID = ["anchor", "segment", "n", "distance"]
OCCURRENCE = "anchor long, segment long, n int, distance int, key long, start int, share int"


def repeated_ranges(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, ranges) of every distinct text with repeated strings: starts and ends of the covered bytes, merged.

    ``texts`` has columns key and text.
    """
    spark = importable(texts.sparkSession)
    scratch = Scratch(spark, "suffix")

    def anchors(batch):
        data, offsets = utf8(batch.column(0))
        for _, _, _, _, anchor, _ in segments(data, offsets, length):
            yield pa.RecordBatch.from_arrays([_signed(anchor)], ["anchor"])

    often = arrow_map(texts.select("text"), "anchor long", anchors).groupBy("anchor").count().where("count > 1")
    often = scratch.write(often, "often")
    known = Bitmap(often, "anchor")
    # Occurrences of an anchor that has very many are dealt to several shares.
    busy = Bitmap(often.where(F.col("count") > BUSY), "anchor")
    shares = lambda anchor: np.where(busy.maybe(anchor), SHARES, 1)

    def shared_out(batch):
        anchor = batch.column(0).to_numpy()
        n = shares(anchor)
        share = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(anchor, n)), pa.array(share, pa.int32())], ["anchor", "share"])

    def occurrences(batch):
        data, offsets = utf8(batch.column(1))
        key = batch.column(0).to_numpy()
        for row, start, n, distance, anchor, segment in segments(data, offsets, length):
            own = known.maybe(anchor)
            columns = [
                _signed(anchor[own]),
                _signed(segment[own]),
                pa.array(n[own], pa.int32()),
                pa.array(distance[own], pa.int32()),
                pa.array(key[row[own]]),
                pa.array(start[own], pa.int32()),
                pa.array((key[row[own]] + start[own]) % shares(anchor[own]), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*ID, "key", "start", "share"])

    often = arrow_map(often.select("anchor"), "anchor long, share int", shared_out)
    found = arrow_map(texts.select("key", "text"), OCCURRENCE, occurrences).join(often, ["anchor", "share"], "left_semi")
    # Copies of a text count, but are kept once.
    found = scratch.write(found.groupBy(*ID, "key", "start").agg(F.count("*").alias("times")), "found")
    different = found.groupBy(*ID).agg(F.sum("times").alias("times"), F.min(F.struct("key", "start")).alias("one"))
    different = scratch.write(different, "different")
    once = different.where("times = 1").select(*ID, "one.*")
    groups = scratch.write(different.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "groups")
    # An undecided segment is compared with all others of its anchor.
    open_ = once.select("anchor").distinct()
    groups = scratch.write(groups.join(open_, "anchor", "left_semi"), "open")
    wanted = scratch.write(different.select(*ID, "one.*").join(groups, "anchor"), "wanted")

    owners = Bitmap(wanted, "key")

    def owned(batch):
        kept = owners.maybe(batch.column(0).to_numpy())
        yield batch.filter(pa.array(kept))

    carriers = arrow_map(texts.select("key", "text"), "key long, text string", owned)
    stretches = wanted.groupBy("key").agg(F.collect_list(F.struct(*ID, "kinds", "start")).alias("own"))
    carriers = carriers.join(stretches, "key").dropDuplicates(["key"]).select("text", "own")

    def cut(batch):
        data, offsets = utf8(batch.column(0))
        for i in range(batch.num_rows):
            own = batch.column(1)[i].values
            fields = {name: own.field(name) for name in (*ID, "kinds")}
            start = own.field("start").to_numpy() + offsets[i]
            n = own.field("n").to_numpy()
            parts = [data[s : s + k + length - 1].tobytes() for s, k in zip(start.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([*fields.values(), pa.array(parts, pa.binary())], [*fields, "bytes"])

    schema = "anchor long, segment long, n int, distance int, kinds long, bytes binary"
    cuts = scratch.write(arrow_map(carriers, schema, cut), "cuts")
    total = cuts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    ranged = ", ".join(f"{c} {t}" for c, t in zip(ID, ("long", "long", "int", "int"))) + ", ranges array<int>"
    usual = cuts.where(F.col("kinds") <= HOT_SEGMENTS).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    usual = usual.groupBy("shard").applyInArrow(_shard(length), ranged)

    def strings(batch):
        """Hash of every string of a hot anchor's segment, with its place."""
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            rows, hashes, places = [], [], []
            for k, own in enumerate(part.column(4)):
                sums, back = prefix_sums(np.frombuffer(own.as_buffer(), np.uint8))
                count = len(sums) - length
                rows.append(np.full(count, k))
                hashes.append(mix((sums[length:] - sums[:-length]) * back[:count]))
                places.append(np.arange(count))
            if rows:
                ids = part.select(ID).take(pa.array(np.concatenate(rows)))
                columns = [*ids.columns, _signed(np.concatenate(hashes)), pa.array(np.concatenate(places), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*ID, "string", "place"])

    hot = cuts.where(F.col("kinds") > HOT_SEGMENTS).select(*ID, "bytes")
    hot = arrow_map(hot, ranged.replace("ranges array<int>", "string long, place int"), strings)
    twice = scratch.write(hot.groupBy("string").count().where("count > 1").select("string"), "twice")
    hot = hot.join(twice, "string", "left_semi").groupBy(*ID).agg(F.collect_list("place").alias("places"))
    hot = hot.select(*ID, F.expr("flatten(transform(places, p -> array(p, p + 1)))").alias("ranges"))
    partly = scratch.write(usual.unionByName(hot).where("size(ranges) > 0"), "partly")

    # Repeated positions of every occurrence: whole segments, and parts of those that occur once; one row each, however many parts.
    again = different.where("times > 1").select(*ID)
    whole = found.join(again, ID, "left_semi").select("key", "start", F.expr("array(0, n)").alias("ranges"))
    part = found.where("times = 1").join(partly, ID).select("key", "start", "ranges")
    covered = whole.unionByName(part).groupBy("key").agg(F.collect_list(F.struct("start", "ranges")).alias("own"))

    def merged(batch):
        keys, flat, sizes = batch.column(0), [], []
        for own in batch.column(1):
            parts = own.values.field("ranges")
            begin = np.repeat(own.values.field("start").to_numpy(), np.asarray(parts.value_lengths()) // 2)
            bounds = parts.flatten().to_numpy()
            start, stop = begin + bounds[::2], begin + bounds[1::2] + length - 1
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(stop[order])
            # Ranges that touch are one run.
            first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
            ends = reach[np.append(first[1:] - 1, len(reach) - 1)]
            flat.append(np.stack([start[first], ends], axis=1).ravel())
            sizes.append(2 * len(first))
        values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([keys, lists(values, np.append(0, np.cumsum(sizes)), pa.int32())], ["key", "ranges"])

    return scratch.write(arrow_map(covered, "key long, ranges array<int>", merged), "ranges")


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, ``kept`` (the remaining bytes) and ``ranges`` (removed runs) of every row."""
    importable(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    texts = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))
    ranges = repeated_ranges(texts.select("key", "text"), length)
    hit = Bitmap(ranges, "key")
    kept = "doc_id " + dict(documents.dtypes)["doc_id"] + ", text string, key long"
    may = arrow_map(texts, kept, lambda batch: iter([batch.filter(pa.array(hit.maybe(batch.column(2).to_numpy())))]))
    never = arrow_map(texts, kept, lambda batch: iter([batch.filter(pa.array(~hit.maybe(batch.column(2).to_numpy())))]))
    both = may.join(ranges, "key", "left").unionByName(never.withColumn("ranges", F.lit(None).cast("array<int>")))
    both = both.select("doc_id", "text", "ranges")

    def cut(batch):
        data, offsets = utf8(batch.column(1))
        left, spans = [], []
        for i, own in enumerate(batch.column(2)):
            runs = own.values.to_numpy().tolist() if own.is_valid else []
            at, parts, own_text = 0, [], data[offsets[i] : offsets[i + 1]]
            for a, b in zip(runs[::2], runs[1::2]):
                parts.append(own_text[at:a].tobytes())
                at = b
            left.append(b"".join([*parts, own_text[at:].tobytes()]))
            spans.append(runs)
        columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(left, pa.binary()), pa.array(spans, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "kept", "ranges"])

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, kept binary, ranges array<int>"
    return arrow_map(both, schema, cut)
