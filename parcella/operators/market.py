"""Market aggregates over the sales that pass a dashboard filter.

All of them take sales, a :class:`SaleFilter` and an optional :class:`Bbox`.
Counts are 64 bit: at the scale this is meant for, 32 bits overflow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcella import schema as S
from parcella.functions import columns as C
from parcella.functions.filters import Bbox, SaleFilter, in_bbox
from parcella.operators import summaries as Q


def matching(sales: DataFrame, flt: SaleFilter, bbox: Bbox | None = None) -> DataFrame:
    return sales.where(flt.predicate() & in_bbox(bbox))


def price_summary(
    sales: DataFrame, keys: list[str], ppm2_name: str
) -> DataFrame:
    """Number of sales, median price and median plausible price per m²."""
    medians = {"median_price": Q.median("price_eur"), ppm2_name: Q.median("plausible_ppm2")}
    return Q.summarise(
        sales.withColumn("plausible_ppm2", C.plausible_ppm2()),
        keys,
        {"n_sales": Q.count(), **medians},
    ).withColumns({name: F.round(name).cast("bigint") for name in medians})


def summary_stats(sales: DataFrame, flt: SaleFilter, bbox: Bbox | None = None) -> DataFrame:
    return price_summary(matching(sales, flt, bbox), [], "median_per_m2")


def count_sales(sales: DataFrame, flt: SaleFilter, bbox: Bbox | None = None) -> DataFrame:
    return matching(sales, flt, bbox).agg(F.count("*").alias("n"))


def _categorised(sales: DataFrame, flt: SaleFilter, bbox: Bbox | None, split: str) -> DataFrame:
    """Matching sales that have a category of the split."""
    kept = matching(sales, flt, bbox)
    if split == "n_houses":
        kept = kept.where(F.col("n_maisons").between(1, S.MAX_HOUSES_CATEGORY))
    kept = kept.withColumn("category", C.split_category(split))
    return kept if split == "none" else kept.where(F.col("category").isNotNull())


def trend(
    sales: DataFrame,
    flt: SaleFilter,
    bbox: Bbox | None = None,
    granularity: str = "month",
    split: str = "none",
) -> DataFrame:
    """Long trend: one row per calendar bucket and category."""
    kept = _categorised(sales, flt, bbox, split).withColumn("bucket", C.time_bucket(granularity))
    return price_summary(kept, ["bucket", "category"], "median_eur_per_m2").orderBy(
        "bucket", "category"
    )


_METRICS = ("median_price", "median_eur_per_m2", "n_sales")


def trend_wide(long: DataFrame, split: str = "none") -> DataFrame:
    """Trend with one ``category__metric`` column each, one row per bucket.

    The categories are fixed, so the schema is too; absent ones are NULL.
    """
    categories = S.SPLIT_CATEGORIES.get(split, ["__all__"])
    category = F.coalesce("category", F.lit("__all__"))
    cells = [
        F.max(F.when(category == c, F.col(m))).alias(f"{c}__{m}")
        for c in categories
        for m in _METRICS
    ]
    return long.groupBy("bucket").agg(*cells).orderBy("bucket")


def trend_total(
    sales: DataFrame, flt: SaleFilter, bbox: Bbox | None = None, split: str = "none"
) -> DataFrame:
    """Sales that the trend with this split covers, whatever its buckets."""
    return _categorised(sales, flt, bbox, split).agg(F.count("*").alias("total_sales"))
