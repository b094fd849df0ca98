"""Sales and searches in blocks of columns, and the searches that each sale of a block passes.

Every condition of a search is an interval of whole numbers that sort as the values do. A block keeps
its least and largest number of each column, so most conditions hold for all of its sales or for none; the
others are taken once per distinct interval, as one bit a sale, and a search is the conjunction of its bits.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from parcella import schema as S

#: Stands for a missing value, below all others.
MISSING = np.iinfo(np.int64).min
OPEN = np.iinfo(np.int64).max
#: Blocks that meet their searches in one task.
SHARE_BLOCKS = 4
#: Searches whose bits are held at once.
AT_ONCE = 512

SALES = (
    "series string, department string, range long, share long, numbers binary, values binary, "
    "sizes binary, types binary, areas binary, rooms binary"
)
_TYPES = (S.HOUSE, S.APARTMENT)


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers that sort as Spark sorts doubles: NaN is largest, -0.0 is 0.0."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ OPEN, bits)


def _numbers(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.float64())
    found = ordered(column.fill_null(0).to_numpy(zero_copy_only=False))
    found[column.is_null().to_numpy(zero_copy_only=False)] = MISSING
    return found


def _pieces(columns: list[pa.Array]):
    """Ranges of rows that agree in all columns."""
    codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in columns]
    change = np.any([np.diff(c) != 0 for c in codes], axis=0)
    at = [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])]
    return [(a, b) for a, b in zip(at[:-1], at[1:]) if a < b]


def pack_sales(batches):
    """Blocks of sorted sales of one series and department; numbered by value, but for missing values."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        series, department, value = (batch.column(x) for x in ("series", "department", "value"))
        for a, b in _pieces([series, department, value.is_null()]):
            part = batch.slice(a, b - a)
            given = part.column("numbers").flatten()
            numbers = _numbers(given).reshape(b - a, -1).T
            own = part.column("own").fill_null(MISSING).to_numpy(zero_copy_only=False)
            buildings = part.column("buildings")
            flat = buildings.flatten()
            kinds = pc.struct_field(flat, "type")
            areas, rooms = (_numbers(pc.struct_field(flat, x)) for x in ("area_m2", "rooms"))
            types = np.zeros(len(flat), np.int8)
            for code, kind in enumerate(_TYPES, 1):
                types[pc.equal(kinds, kind).fill_null(False).to_numpy(zero_copy_only=False)] = code
            sizes = buildings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            number = task << 32 | made
            made += 1
            yield pa.RecordBatch.from_pydict(
                {
                    "series": series[a:a + 1],
                    "department": department[a:a + 1],
                    "range": pa.array([number if value[a].is_valid else None], pa.int64()),
                    "share": pa.array([number // SHARE_BLOCKS], pa.int64()),
                    "numbers": [np.vstack([numbers, own[None]]).tobytes()],
                    "values": [part.column("value").fill_null(0).to_numpy(zero_copy_only=False).tobytes()],
                    "sizes": [sizes.tobytes()],
                    "types": [types.tobytes()],
                    "areas": [areas.tobytes()],
                    "rooms": [rooms.tobytes()],
                }
            )


def _intervals(low: pa.Array, high: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds as numbers; missing values pass only where neither bound is given."""
    low, high = _numbers(low), _numbers(high)
    least = np.where((low == MISSING) & (high != MISSING), MISSING + 1, low)
    return least, np.where(high == MISSING, OPEN, high)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(rows, axis=0, return_inverse=True)
    return found, at.ravel()


def _conditions(searches: pa.Array) -> dict:
    """The filters of some searches: distinct intervals of each column, distinct building specs."""
    filters = searches.flatten()
    low, high = (pc.struct_field(filters, x) for x in ("low", "high"))
    least, most = (x.reshape(len(filters), -1) for x in _intervals(low.flatten(), high.flatten()))
    own = pc.struct_field(filters, "own")
    given = own.is_valid().to_numpy(zero_copy_only=False)
    code = own.fill_null(0).to_numpy(zero_copy_only=False)
    least = np.column_stack([least, np.where(given, code, MISSING)])
    most = np.column_stack([most, np.where(given, code, OPEN)])
    specs = pc.struct_field(filters, "specs")
    held = specs.value_lengths().to_numpy(zero_copy_only=False)
    flat, spec = specs.flatten(), pc.struct_field(specs.flatten(), "spec")
    kinds = pc.struct_field(spec, "type")
    types = sum((pc.equal(kinds, k).to_numpy(zero_copy_only=False) * c for c, k in enumerate(_TYPES, 1)), np.zeros(len(flat), np.int64))
    rows = [types, pc.struct_field(flat, "n").to_numpy(zero_copy_only=False).astype(np.int64)]
    for name in ("area", "rooms"):
        rows += _intervals(*(pc.struct_field(spec, f"{name}_{end}") for end in ("min", "max")))
    wanted, which = _distinct(np.column_stack(rows))
    first = np.cumsum(held) - held
    return {
        "of": np.repeat(np.arange(len(searches)), searches.value_lengths().to_numpy(zero_copy_only=False)),
        "least": least,
        "most": most,
        "columns": [_distinct(np.column_stack([least[:, j], most[:, j]])) for j in range(least.shape[1])],
        "specs": wanted,
        # For each place in a filter's list of specs: the filters with so many, and their spec there.
        "places": [(at, which[first[at] + i]) for i in range(held.max(initial=0)) for at in [np.flatnonzero(held > i)]],
    }


def pack_searches(keys: list[str], also: list[str]):
    """Searches that agree in ``keys`` as one row; ids and the columns ``also`` as lists."""

    def run(batches):
        for batch in batches:
            for a, b in _pieces([batch.column(x) for x in keys]):
                one = pa.array([0, b - a], pa.int32())
                lists = {f"{x}s": pa.ListArray.from_arrays(one, batch.column(x)[a:b]) for x in ("search_id", *also)}
                packed = pickle.dumps(_conditions(batch.column("filters")[a:b]))
                yield pa.RecordBatch.from_pydict({x: batch.column(x)[a:a + 1] for x in keys} | lists | {"conditions": [packed]})

    return run


class _Block:
    """A block of sales and the bits of conditions on it."""

    def __init__(self, row: dict):
        self.values = np.frombuffer(row["values"], np.float64)
        self.n = len(self.values)
        self.numbers = np.frombuffer(row["numbers"], np.int64).reshape(-1, self.n)
        self.least, self.most = self.numbers.min(1), self.numbers.max(1)
        self.ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.types = np.frombuffer(row["types"], np.int8)
        self.areas, self.rooms = (np.frombuffer(row[x], np.int64) for x in ("areas", "rooms"))
        self.flags = np.zeros(-(-self.n // 64) * 64, bool)
        self.all = self._bits(np.ones(self.n, bool))

    def _bits(self, held: np.ndarray) -> np.ndarray:
        self.flags[: self.n] = held
        return np.packbits(self.flags).view(np.uint64)

    def within(self, j: int, least: int, most: int) -> np.ndarray:
        return self._bits((self.numbers[j] >= least) & (self.numbers[j] <= most))

    def built(self, kind, n, area_min, area_max, rooms_min, rooms_max) -> np.ndarray:
        """Sales with at least n buildings that fit a spec; kind 0 is any."""
        fit = (self.areas >= area_min) & (self.areas <= area_max) & (self.rooms >= rooms_min) & (self.rooms <= rooms_max)
        if kind:
            fit &= self.types == kind
        upto = np.concatenate([[0], np.cumsum(fit)])
        return self._bits(upto[self.ends] - upto[self.starts] >= n)

    def passed(self, c: dict, at_once: int):
        """(filters, their bits) of the filters that some sale may pass, some filters at a time."""
        made: dict[tuple[int, int], np.ndarray] = {}

        def rows(j: int, which: np.ndarray, make) -> np.ndarray:
            found, at = np.unique(which, return_inverse=True)
            for i in found.tolist():
                if (j, i) not in made:
                    made[j, i] = make(i)
            return np.stack([made[j, i] for i in found.tolist()])[at]

        some = np.flatnonzero(((c["least"] <= self.most) & (c["most"] >= self.least)).all(1))
        for i in range(0, len(some), at_once):
            own = some[i : i + at_once]
            bits = np.repeat(self.all[None], len(own), axis=0)
            for j, (distinct, which) in enumerate(c["columns"]):
                part = np.flatnonzero((c["least"][own, j] > self.least[j]) | (c["most"][own, j] < self.most[j]))
                if len(part):
                    bits[part] &= rows(j, which[own[part]], lambda k: self.within(j, *distinct[k].tolist()))
            for filters, specs in c["places"]:
                part = np.flatnonzero(np.isin(own, filters, assume_unique=True))
                if len(part):
                    here = specs[np.searchsorted(filters, own[part])]
                    bits[part] &= rows(-1, here, lambda k: self.built(*c["specs"][k].tolist()))
            yield own, bits


def _pairs(batches):
    """Pairs of a block and packed searches; what one of them shares with the pair before is read once."""
    block = conditions = was = packed = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {x: batch.column(x)[i] for x in batch.schema.names}
            key = (row["series"].as_py(), row["department"].as_py(), row["share"].as_py(), row["range"].as_py())
            if key[-1] is None or key != was:
                block, was = _Block({x: row[x].as_buffer() for x in ("numbers", "values", "sizes", "types", "areas", "rooms")}), key
            if row["conditions"].as_py() != packed:
                packed = row["conditions"].as_py()
                conditions = pickle.loads(packed)
            yield row, block, conditions


def count(batches):
    """(search_id, series, range, n) of every pair with a match."""
    for row, block, c in _pairs(batches):
        for own, bits in block.passed(c, AT_ONCE):
            n = np.bitwise_count(bits).sum(1, dtype=np.int64)
            some = np.flatnonzero(n)
            same = lambda x: pa.array([row[x].as_py()] * len(some), row[x].type)  # noqa: B023, E731
            yield pa.RecordBatch.from_pydict(
                {
                    "search_id": row["search_ids"].values.take(pa.array(c["of"][own[some]])),
                    "series": same("series"),
                    "range": same("range"),
                    "n": pa.array(n[some]),
                }
            )


def pick(batches):
    """(search_id, series, low, high): the values at the wanted places among the matches of a block."""
    for row, block, c in _pairs(batches):
        ids, lows, highs = (row[x].values for x in ("search_ids", "lows", "highs"))
        found: dict[int, np.ndarray] = {}
        for own, bits in block.passed(c, AT_ONCE):
            for i, b in zip(c["of"][own].tolist(), bits):
                n = np.unpackbits(b.view(np.uint8), count=block.n).astype(np.int64)
                found[i] = found[i] + n if i in found else n
        at = sorted(found)
        values = []
        for i in at:
            places = np.repeat(np.arange(block.n), found[i])
            values.append([float(block.values[places[x.as_py()]]) if x.is_valid else None for x in (lows[i], highs[i])])
        low, high = zip(*values) if values else ((), ())
        yield pa.RecordBatch.from_pydict(
            {
                "search_id": ids.take(pa.array(at, pa.int64())),
                "series": pa.array([row["series"].as_py()] * len(at), row["series"].type),
                "low": pa.array(low, pa.float64()),
                "high": pa.array(high, pa.float64()),
            }
        )
