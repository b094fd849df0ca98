"""Map views: points, regional medians and their colour scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcella import schema as S
from parcella.functions.filters import FRANCE, Bbox, SaleFilter
from parcella.operators.derive import normalise_buildings
from parcella.operators.market import matching, price_summary

POINT_COLUMNS = [
    "id_mutation",
    "latitude",
    "longitude",
    "price_eur",
    "price_per_m2",
    "composition",
    "primary_type",
    "built_area_m2",
    "land_area_m2",
    "commune_name",
    "department_code",
    "sale_date",
]

# Colour range when there is no price at all.
FALLBACK_LOW = 0.0
FALLBACK_HIGH = 1_000_000.0


def newest(*extra: Column) -> list[Column]:
    """Newest sales first; the id makes pages stable."""
    return [*extra, F.desc_nulls_last("sale_date"), F.col("id_mutation")]


def clamp_to_france(bbox: Bbox | None) -> Bbox:
    """The map never looks outside the box around France."""
    return FRANCE if bbox is None else bbox.clamp(FRANCE)


def map_points(
    sales: DataFrame, flt: SaleFilter, bbox: Bbox | None = None, cap: int = S.MAP_POINT_CAP
) -> DataFrame:
    """The newest ``cap`` located sales; ``capped`` tells whether that is all.

    A top-k keeps ``cap`` rows per task, and only the map's columns are read.
    The window runs over the at most ``cap`` rows left.
    """
    return (
        matching(sales, flt, bbox or FRANCE)
        .select(*POINT_COLUMNS, normalise_buildings().alias("buildings"))
        .orderBy(*newest())
        .limit(cap)
        .withColumn("capped", F.count("*").over(Window.partitionBy()) == cap)
    )


def _choropleth(sales, flt, bbox, code: str, name: str) -> DataFrame:
    regions = matching(sales, flt, bbox or FRANCE).select(
        F.col(code).alias("code"), F.col(name).alias("name"), "price_eur", "price_per_m2"
    )
    return price_summary(regions, ["code", "name"], "median_per_m2")


def choropleth_department(
    sales: DataFrame, flt: SaleFilter, bbox: Bbox | None = None
) -> DataFrame:
    return _choropleth(sales, flt, bbox, "department_code", "department_code")


def choropleth_commune(sales: DataFrame, flt: SaleFilter, bbox: Bbox | None = None) -> DataFrame:
    """By code and name: a commune code with two names gives two rows."""
    return _choropleth(sales, flt, bbox, "commune_code", "commune_name")


def map_mode(zoom: float) -> str:
    if zoom < S.ZOOM_DEPARTMENT:
        return "department"
    return "commune" if zoom < S.ZOOM_COMMUNE else "points"


def map_view(
    sales: DataFrame, flt: SaleFilter, zoom: float, bbox: Bbox | None = None, **options
) -> DataFrame:
    """What the map shows at a zoom level."""
    views = {
        "department": choropleth_department,
        "commune": choropleth_commune,
        "points": map_points,
    }
    return views[map_mode(zoom)](sales, flt, clamp_to_france(bbox), **options)


def with_price_bounds(shown: DataFrame, price: str) -> DataFrame:
    """Add ``p5`` and ``p95``: prices at 0-based rank floor(n·p).

    ``shown`` is what a map displays, so it is bounded (point cap or number of
    regions) and one window without partitions is enough.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(everything.orderBy(F.asc_nulls_last(price))) - 1
    priced = F.count(price).over(everything)

    def at(p: float, fallback: float) -> Column:
        hit = F.when(F.col("_rank") == F.floor(F.col("_priced") * p), F.col(price))
        return F.coalesce(F.max(hit).over(everything).cast("double"), F.lit(fallback))

    return (
        shown.withColumns({"_rank": rank, "_priced": priced})
        .withColumns({"p5": at(0.05, FALLBACK_LOW), "p95": at(0.95, FALLBACK_HIGH)})
        .drop("_rank", "_priced")
    )


def price_rank_bounds(shown: DataFrame, price: str) -> DataFrame:
    """The colour bounds alone, with the fallbacks when nothing is shown."""
    return with_price_bounds(shown.select(price), price).agg(
        F.coalesce(F.max("p5"), F.lit(FALLBACK_LOW)).alias("p5"),
        F.coalesce(F.max("p95"), F.lit(FALLBACK_HIGH)).alias("p95"),
    )


def price_scale(shown: DataFrame, price: str) -> DataFrame:
    """Add the position ``t`` of a price between the bounds and its hue.

    Green (120) is cheap, red (0) is dear; no price (or zero) has no colour.
    """
    width = F.greatest(F.lit(1.0), F.col("p95") - F.col("p5"))
    position = (F.col(price) - F.col("p5")) / width
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), position))
    return (
        with_price_bounds(shown, price)
        .withColumn("t", F.when(F.col(price) != 0, t))
        .withColumn("hue", F.round(120 * (1 - F.col("t"))).cast("int"))
    )


def legend_stops(bounds: DataFrame) -> DataFrame:
    """Five prices evenly spread between the bounds."""
    # Positions of the legend labels.
    positions = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])
    price = F.col("p5") + F.col("t") * (F.col("p95") - F.col("p5"))
    return bounds.select("p5", "p95", F.explode(positions).alias("t")).select(
        "t", F.round(price).alias("price")
    )


def points_extent(points: DataFrame) -> DataFrame:
    """Box around the points."""
    return points.agg(
        F.min("latitude").alias("lat_min"),
        F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"),
        F.max("longitude").alias("lon_max"),
    )


def choropleth_boundaries(boundaries: DataFrame, regions: DataFrame) -> DataFrame:
    """Outlines of the regions that have sales, with figures and colour.

    A code with several names keeps the name with most sales. Both sides are
    small next to the sales; the join strategy is left to Spark.
    """
    order = Window.partitionBy("code").orderBy(F.desc("n_sales"), F.asc_nulls_last("name"))
    scaled = price_scale(regions, "median_price")
    one_name = scaled.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return (
        boundaries.join(one_name, "code")
        .withColumn("grey", F.col("hue").isNull())
        .select(
            "code",
            F.coalesce("nom", "code").alias("nom"),
            "geometry",
            "n_sales",
            "median_price",
            "median_per_m2",
            "hue",
            "grey",
        )
    )
