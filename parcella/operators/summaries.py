"""Grouped summaries with exact quantiles that never gather a group in one task.

Spark's ``median``/``percentile`` keep every distinct value of a group in one
aggregation buffer, so a group holding a third of the data ends in one task.
Here an exact quantile is found in three bounded steps instead:

1. count rows per (group, value bucket), where the bucket is a fixed monotone
   function of the value. The number of buckets per group has a fixed bound, so
   one window over the counts locates the bucket holding the wanted rank;
2. cut those buckets into cells and count again, which locates the cell;
3. read only the values of those cells, count the distinct ones, and pick the
   wanted rank among them. A cell is so narrow that only some half a million
   different doubles exist in it.

So no window sees more than about a million rows, however dense the values are.
All steps combine map-side; ties collapse into counts. The whole summary is
one SQL statement, so it is analysed once. It reads its input four times, each
time only the columns needed: meant for stored tables. Store an expensive input
first (``parcella.sources.tables.materialise``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Buckets per factor e of magnitude: about 0.012 % relative width, and at most
# about 280,000 buckets for values up to 1e15.
BUCKETS_PER_E = 1 << 13
# Cells of a bucket: 1.2e-4 / 2**20 in relative width, 500,000 doubles apart.
CELLS = 1 << 20


@dataclass(frozen=True)
class Measure:
    """One output column of :func:`summarise`."""

    kind: str
    column: str | None = None
    p: float | None = None


def count(condition: str | None = None) -> Measure:
    """Rows of the group, or those where the boolean column holds."""
    return Measure("count", condition)


def mean(column: str) -> Measure:
    return Measure("mean", column)


def smallest(column: str) -> Measure:
    return Measure("min", column)


def largest(column: str) -> Measure:
    return Measure("max", column)


def median(column: str) -> Measure:
    return Measure("interpolated", column, 0.5)


def quantile(column: str, p: float) -> Measure:
    """Exact quantile, interpolated between the neighbouring values."""
    return Measure("interpolated", column, p)


def nearest_rank(column: str, p: float) -> Measure:
    """Value at 0-based rank ``floor(n * p)``, the last value at most."""
    return Measure("nearest", column, p)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _list(*parts: str | list[str]) -> str:
    names: list[str] = []
    for part in parts:
        names += part if isinstance(part, list) else [part]
    return ", ".join(names)


def _plain(m: Measure) -> str:
    """A measure that needs no ranking, as an ordinary aggregate."""
    if m.kind == "count":
        return "count(*)" if m.column is None else f"count_if({_quoted(m.column)})"
    function = {"mean": "avg", "min": "min", "max": "max"}[m.kind]
    return f"{function}(CAST({_quoted(m.column)} AS DOUBLE))"


def summarise(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, Measure],
) -> DataFrame:
    """One row per ``keys`` with the given measures (one row in all without keys).

    The wanted buckets, at most two per group and quantile, are broadcast only
    if Spark sees at run time that they are few.
    """
    ks = [_quoted(k) for k in keys]
    by_key = f"GROUP BY {_list(ks)}" if ks else ""
    ranked = {name: m for name, m in measures.items() if m.p is not None}
    # Quantiles of one column share its ranking.
    series = {c: i for i, c in enumerate(dict.fromkeys(m.column for m in ranked.values()))}

    plain = [
        f"{_plain(m) if m.p is None else 'CAST(NULL AS DOUBLE)'} AS {_quoted(name)}"
        for name, m in measures.items()
    ]
    parts = [f"SELECT {_list(ks, plain)} FROM {{df}} {by_key}"]
    ctes = []
    if ranked:
        ctes = _picked(ks, series, ranked)
        value = "_low + (_high - _low) * _share"
        slots = {name: i for i, name in enumerate(ranked)}
        picked = [
            f"CASE WHEN _slot = {slots[name]} THEN {value} END" if name in slots else "NULL"
            for name in measures
        ]
        parts.append(f"SELECT {_list(ks, picked)} FROM picked")
    ctes.append("parts AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)")
    outputs = [f"max({_quoted(name)}) AS {_quoted(name)}" for name in measures]
    statement = (
        "WITH " + ",\n".join(ctes) + f"\nSELECT {_list(ks, outputs)} FROM parts {by_key}"
    )
    return df.sparkSession.sql(statement, df=df)


def _picked(
    ks: list[str], series: dict[str, int], ranked: dict[str, Measure]
) -> list[str]:
    """Statement parts that end in ``picked``: the values at the wanted ranks."""
    group = _list(ks, "_series")
    cell = _list(ks, "_slot")
    rank = "_bucket, _before, _position, _rank_low, _rank_high"
    values = _list([f"CAST({_quoted(c)} AS DOUBLE) AS _v{i}" for c, i in series.items()])
    names = _list([f"_v{i} AS `{i}`" for i in series.values()])
    wanted = _list(
        [
            f"named_struct('s', {slot}, 'o', '{series[m.column]}', 'p', {float(m.p)}D, "
            f"'n', {m.kind == 'nearest'})"
            for slot, m in enumerate(ranked.values())
        ]
    )
    aliased = [f"{k} AS _key{i}" for i, k in enumerate(ks)]
    same = " AND ".join(
        [f"l.{k} <=> t._key{i}" for i, k in enumerate(ks)]
        + ["l._series = t._of_series", "l._bucket = t._of_bucket"]
    )
    position = f"signum(_value) * log1p(abs(_value)) * {BUCKETS_PER_E}"
    return [
        # One row per value and series; rows without a value drop out.
        f"""long AS (
  SELECT {group}, _value, floor({position}) AS _bucket,
         floor(({position} - floor({position})) * {CELLS}) AS _part
  FROM (SELECT {_list(ks, values)} FROM {{df}}) UNPIVOT (_value FOR _series IN ({names}))
)""",
        f"""histogram AS (
  SELECT {group}, _bucket, count(*) AS _n FROM long GROUP BY {group}, _bucket
)""",
        f"""ranked AS (
  SELECT {group}, _bucket, _n,
         sum(_n) OVER (PARTITION BY {group} ORDER BY _bucket
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _n AS _before,
         sum(_n) OVER (PARTITION BY {group}) AS _all
  FROM histogram
)""",
        f"""wanted AS (
  SELECT {group}, _bucket, _n, _before, _all,
         inline(array({wanted})) AS (_slot, _of, _p, _nearest)
  FROM ranked
)""",
        """positions AS (
  SELECT *, CASE WHEN _nearest THEN least(floor(_all * _p), _all - 1)
                 ELSE (_all - 1) * _p END AS _position
  FROM wanted WHERE _series = _of
)""",
        f"""targets AS (
  SELECT {_list(aliased, "_series AS _of_series", "_bucket AS _of_bucket", "_slot", "_before")},
         _position, floor(_position) AS _rank_low, ceil(_position) AS _rank_high
  FROM positions
  WHERE floor(_position) >= _before AND floor(_position) < _before + _n
     OR ceil(_position) >= _before AND ceil(_position) < _before + _n
)""",
        f"""parts_counted AS (
  SELECT {cell}, _series, {rank}, _part, count(*) AS _n
  FROM long l JOIN targets t ON {same}
  GROUP BY {cell}, _series, {rank}, _part
)""",
        # A slot has one bucket or two adjacent ones, so counting on from the
        # first one gives every cell the rank of its first value.
        f"""parts_placed AS (
  SELECT *, min(_before) OVER (PARTITION BY {cell}) - _n
            + sum(_n) OVER (PARTITION BY {cell} ORDER BY _bucket, _part
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _start
  FROM parts_counted
)""",
        f"""fine_targets AS (
  SELECT {_list(aliased, "_series AS _of_series", "_bucket AS _of_bucket", "_part AS _of_part", "_slot")},
         _start AS _before, _position, _rank_low, _rank_high
  FROM parts_placed
  WHERE _rank_low >= _start AND _rank_low < _start + _n
     OR _rank_high >= _start AND _rank_high < _start + _n
)""",
        f"""found AS (
  SELECT {cell}, {rank}, _value, count(*) AS _n
  FROM long l JOIN fine_targets t ON {same} AND l._part = t._of_part
  GROUP BY {cell}, {rank}, _value
)""",
        # The same for the values of one cell or two adjacent ones.
        f"""placed AS (
  SELECT *, min(_before) OVER (PARTITION BY {cell}) - _n
            + sum(_n) OVER (PARTITION BY {cell} ORDER BY _value
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _first
  FROM found
)""",
        f"""picked AS (
  SELECT {cell},
         max(_value) FILTER (WHERE _rank_low >= _first AND _rank_low < _first + _n) AS _low,
         max(_value) FILTER (WHERE _rank_high >= _first AND _rank_high < _first + _n) AS _high,
         max(_position - _rank_low) AS _share
  FROM placed GROUP BY {cell}
)""",
    ]
