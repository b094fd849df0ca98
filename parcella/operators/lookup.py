"""Looking up, browsing and paging through sales."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcella import schema as S
from parcella.functions.filters import Bbox, SaleFilter
from parcella.operators.derive import normalise_buildings
from parcella.operators.maps import newest
from parcella.operators.market import matching


def lookup_sale(sales: DataFrame, sale_id: str) -> DataFrame:
    """The sale of an id; the equality reaches the Parquet statistics."""
    return sales.where(F.col("id_mutation") == sale_id.strip()).limit(1)


def browse_commune(sales: DataFrame, term: str = "", limit: int = S.BROWSE_SIZE) -> DataFrame:
    """Newest sales of communes containing ``term`` in any case.

    ``%`` and ``_`` in the term act as wildcards.
    """
    if term.strip():
        name = F.lower("commune_name")
        sales = sales.where(name.like(f"%{term.lower()}%"))
    return sales.orderBy(*newest()).limit(limit)


def sale_detail_like(sales: DataFrame, pattern: str, limit: int = 3) -> DataFrame:
    """Composition and buildings of sales whose id matches a LIKE pattern."""
    return (
        sales.where(F.col("id_mutation").like(pattern))
        .select("id_mutation", "composition", "buildings")
        .orderBy("id_mutation")
        .limit(limit)
    )


def browse_table(sales: DataFrame) -> DataFrame:
    """The seven columns of the browse table."""
    return sales.select(
        "id_mutation",
        F.date_format("sale_date", "yyyy-MM-dd").alias("date"),
        F.concat("commune_name", F.lit(" ("), "department_code", F.lit(")")).alias("commune"),
        F.coalesce("composition", "primary_type").alias("composition"),
        "price_eur",
        "built_area_m2",
        F.round("price_per_m2").alias("price_per_m2"),
    )


def _truthy(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != 0)


def sale_card(sales: DataFrame) -> DataFrame:
    """Fields of a sale card, with a map position when the sale is located."""
    point = F.concat_ws(",", F.col("latitude").cast("string"), F.col("longitude").cast("string"))
    return sales.select(
        "id_mutation",
        F.date_format("sale_date", "yyyy-MM-dd").alias("date"),
        "commune_name",
        "primary_type",
        "composition",
        "price_eur",
        F.round("price_per_m2").alias("price_per_m2"),
        "built_area_m2",
        "land_area_m2",
        F.size(normalise_buildings()).alias("n_buildings"),
        "n_maisons",
        "n_appartements",
        "rooms_total",
        "commune_code",
        "department_code",
        "year",
        (_truthy("latitude") & _truthy("longitude")).alias("has_location"),
        F.when(_truthy("latitude") & _truthy("longitude"), point).alias("location"),
    )


def sales_page(
    sales: DataFrame,
    flt: SaleFilter,
    page: int = 0,
    bbox: Bbox | None = None,
    size: int = S.PAGE_SIZE,
) -> DataFrame:
    """One page, newest first. For deep pages use :func:`sales_after`."""
    return matching(sales, flt, bbox).orderBy(*newest()).offset(page * size).limit(size)


def sales_after(
    sales: DataFrame,
    flt: SaleFilter,
    last_date: date,
    last_id: str,
    bbox: Bbox | None = None,
    size: int = S.PAGE_SIZE,
) -> DataFrame:
    """The page after a given sale; its cost does not grow with the depth."""
    day = F.col("sale_date")
    later = (day < F.lit(last_date)) | (
        (day == F.lit(last_date)) & (F.col("id_mutation") > last_id)
    )
    return matching(sales, flt, bbox).where(later).orderBy(*newest()).limit(size)


def page_total(page_rows: DataFrame, page: int, size: int = S.PAGE_SIZE) -> DataFrame:
    """Total number of sales when a short page reveals it, else NULL."""
    n = F.count("*")
    return page_rows.agg(F.when(n < size, n + page * size).alias("total"))
