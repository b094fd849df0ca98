"""Reusable column expressions over raw rows and sales."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcella import schema as S


def any_of(column: str, when: Column | None = None) -> Column:
    """Smallest non-null value of a field that repeats on every row of a sale.

    Taking the minimum keeps "any value" deterministic across retries.
    """
    value = F.col(column)
    return F.min(value if when is None else F.when(when, value))


def any_is(column: str, value: str) -> Column:
    """Whether :func:`any_of` would give ``value``.

    Two booleans per sale instead of a string keep the aggregation hash-based.
    """
    present = F.coalesce(F.max(F.col(column) == value), F.lit(False))
    smaller = F.coalesce(F.max(F.col(column) < value), F.lit(False))
    return present & ~smaller


def count_where(condition: Column) -> Column:
    """Rows satisfying ``condition``; NULL when it is NULL on every row."""
    return F.sum(condition.cast("int"))


def is_house() -> Column:
    return F.col("type_local") == S.HOUSE


def is_building() -> Column:
    """Rows that describe a measured house or apartment."""
    return F.col("type_local").isin(S.HOUSE, S.APARTMENT) & (F.col("surface_reelle_bati") > 0)


def plausible_ppm2(column: str = "price_per_m2") -> Column:
    """Price per m² where plausible, else NULL."""
    return F.when(F.col(column).between(*S.PPM2_RANGE), F.col(column))


def primary_type(houses: Column, apartments: Column) -> Column:
    return (
        F.when((houses > 0) & (apartments > 0), S.MIXED)
        .when(houses > 0, S.HOUSE)
        .when(apartments > 0, S.APARTMENT)
    )


def composition(houses: Column, apartments: Column) -> Column:
    """Short key such as ``1M``, ``2A`` or ``1M+1A``; NULL without buildings."""
    parts = F.concat_ws(
        "+",
        F.when(houses > 0, F.concat(houses.cast("string"), F.lit("M"))),
        F.when(apartments > 0, F.concat(apartments.cast("string"), F.lit("A"))),
    )
    return F.nullif(parts, F.lit(""))


def price_per_m2(price: Column, area: Column) -> Column:
    return F.when((area > S.MIN_BUILT_AREA) & (price > 0), price / area)


def time_bucket(granularity: str) -> Column:
    """Calendar label of a sale: ``2021``, ``2021-05`` or the ISO week's Monday."""
    if granularity == "year":
        return F.col("year").cast("string")
    if granularity == "month":
        return F.date_format("sale_date", "yyyy-MM")
    if granularity == "week":
        return F.date_format(F.date_trunc("week", "sale_date"), "yyyy-MM-dd")
    raise ValueError(f"unknown granularity {granularity!r}")


def split_category(split: str) -> Column:
    if split == "none":
        return F.lit(None).cast("string")
    if split == "type":
        return primary_type(F.col("n_maisons"), F.col("n_appartements"))
    if split == "n_houses":
        return F.col("n_maisons").cast("string")
    raise ValueError(f"unknown split {split!r}")


def english_label(value: Column) -> Column:
    """English label of a category value, empty when there is none."""
    labels = F.create_map(*[F.lit(x) for x in chain(*S.VALUE_LABELS.items())])
    return F.coalesce(F.try_element_at(labels, value), F.lit(""))
