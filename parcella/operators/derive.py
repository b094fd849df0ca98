"""One row per sale from raw transaction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcella import schema as S
from parcella.functions import columns as C
from parcella.operators.bulk import without_bulk

# Names under which the sale-level facts repeat on the raw rows.
_FACTS = {
    "sale_date": "date_mutation",
    "year": "year",
    "price_eur": "valeur_fonciere",
    "transaction_type": "nature_mutation",
    "department_code": "code_departement",
    "commune_code": "code_commune",
    "commune_name": "nom_commune",
    "postal_code": "code_postal",
}


def _row_counts() -> list[Column]:
    kind = F.col("type_local")
    conditions = {
        "n_maison_rows": kind == S.HOUSE,
        "n_appartement_rows": kind == S.APARTMENT,
        "n_dependances": kind == S.ANNEX,
        "n_commercial": kind == S.COMMERCIAL,
        "n_parcel_rows": kind.isNull(),
    }
    return [C.count_where(c).cast("int").alias(name) for name, c in conditions.items()]


def preferred_point() -> Column:
    """Smallest located point of the houses, else apartments, else any row.

    The rank leads the struct, so one minimum does the preference and keeps
    latitude and longitude of the same row together.
    """
    rank = (
        F.when(F.col("type_local") == S.HOUSE, 0)
        .when(F.col("type_local") == S.APARTMENT, 1)
        .otherwise(2)
    )
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return F.min(F.when(located, F.struct(rank.alias("rank"), "latitude", "longitude")))


def dedup_buildings(rows: DataFrame) -> DataFrame:
    """Distinct (sale, type, area, rooms) of the measured buildings."""
    return (
        rows.where(C.is_building())
        .select("id_mutation", "type_local", "surface_reelle_bati", "nombre_pieces_principales")
        .distinct()
    )


def building_totals(rows: DataFrame) -> DataFrame:
    """Per-sale totals over the distinct buildings of every sale."""
    rooms = "nombre_pieces_principales"
    return (
        dedup_buildings(rows)
        .groupBy("id_mutation")
        .agg(
            C.count_where(F.col("type_local") == S.HOUSE).cast("int").alias("n_maisons"),
            C.count_where(F.col("type_local") == S.APARTMENT).cast("int").alias("n_appartements"),
            F.sum("surface_reelle_bati").alias("built_area_m2"),
            F.sum(rooms).cast("int").alias("rooms_total"),
            F.min(rooms).alias("rooms_min"),
            F.max(rooms).alias("rooms_max"),
        )
    )


def sale_totals(rows: DataFrame) -> DataFrame:
    """Per-sale facts and raw row counts of every sale, bulk sales included."""
    return rows.groupBy("id_mutation").agg(
        *[C.any_of(raw).alias(name) for name, raw in _FACTS.items()],
        F.count("*").alias("n_rows"),
        F.count_distinct("code_commune").alias("n_communes"),
        *_row_counts(),
        F.sum("surface_terrain").alias("land_area_m2"),
    )


def preferred_coordinates(rows: DataFrame) -> DataFrame:
    """Per-sale coordinates by :func:`preferred_point`."""
    return (
        rows.groupBy("id_mutation")
        .agg(preferred_point().alias("point"))
        .select("id_mutation", "point.latitude", "point.longitude")
    )


def residential_policy() -> Column:
    """Plain sales of buildings in one commune, neither bulk nor symbolic."""
    return (
        (F.col("n_rows") <= S.MAX_ROWS_PER_SALE)
        & (F.col("price_eur") >= S.MIN_PRICE)
        & (F.col("n_communes") == 1)
        & (F.col("transaction_type") == S.PLAIN_SALE)
        & ((F.col("n_maisons") > 0) | (F.col("n_appartements") > 0))
    )


def derive_sales(rows: DataFrame) -> DataFrame:
    """Residential sales, one row each, with their distinct buildings nested.

    One aggregation, so one shuffle and no join. The policy rejects sales of
    more than ten rows, hence the hot ones leave before the shuffle and the set
    of buildings of what remains is small.
    """
    # The negated area leads to the wanted order under plain struct sorting.
    building = F.struct(
        F.col("type_local").alias("type"),
        (-F.col("surface_reelle_bati")).alias("minus_area"),
        F.col("nombre_pieces_principales").alias("rooms"),
    )
    facts = {name: raw for name, raw in _FACTS.items() if name != "transaction_type"}
    grouped = (
        without_bulk(rows)
        .groupBy("id_mutation")
        .agg(
            *[C.any_of(raw).alias(name) for name, raw in facts.items()],
            C.any_is(_FACTS["transaction_type"], S.PLAIN_SALE).alias("plain"),
            F.count("*").alias("n_rows"),
            F.max("code_commune").alias("last_commune"),
            *_row_counts(),
            F.sum("surface_terrain").alias("land_area_m2"),
            preferred_point().alias("point"),
            F.collect_set(F.when(C.is_building(), building)).alias("found"),
        )
        # The residential policy on the aggregates, before any work on the
        # buildings. One commune means equal smallest and largest codes.
        .where(
            (F.col("n_rows") <= S.MAX_ROWS_PER_SALE)
            & (F.col("price_eur") >= S.MIN_PRICE)
            & (F.col("commune_code") == F.col("last_commune"))
            & F.col("plain")
            & (F.size("found") > 0)
        )
        .withColumn("transaction_type", F.lit(S.PLAIN_SALE))
        .withColumn("n_communes", F.lit(1).cast("bigint"))
        .withColumn("found", F.sort_array("found"))
    )
    rooms = F.array_compact("found.rooms")
    houses = F.size(F.filter("found.type", lambda t: t == S.HOUSE))
    measured = grouped.withColumns(
        {
            "n_maisons": houses,
            "n_appartements": F.size("found") - houses,
            "built_area_m2": -F.aggregate("found.minus_area", F.lit(0.0), lambda a, x: a + x),
            "rooms_total": F.when(
                F.size(rooms) > 0, F.aggregate(rooms, F.lit(0), lambda a, x: a + x)
            ),
            "rooms_min": F.array_min("found.rooms"),
            "rooms_max": F.array_max("found.rooms"),
            "buildings": F.transform(
                "found",
                lambda b: F.struct(
                    b["type"].alias("type"),
                    F.bround(-b["minus_area"]).cast("int").alias("area_m2"),
                    b["rooms"].alias("rooms"),
                ),
            ),
            "latitude": F.col("point.latitude"),
            "longitude": F.col("point.longitude"),
        }
    )
    counts = F.col("n_maisons"), F.col("n_appartements")
    return measured.withColumns(
        {
            "primary_type": C.primary_type(*counts),
            "composition": C.composition(*counts),
            "price_per_m2": C.price_per_m2(F.col("price_eur"), F.col("built_area_m2")),
        }
    ).select(*S.SALES_SCHEMA.fieldNames())


def unnest_buildings(sales: DataFrame) -> DataFrame:
    """One row per building, in its order within the sale."""
    return sales.select("id_mutation", F.posexplode("buildings").alias("position", "b")).select(
        "id_mutation", "position", "b.type", "b.area_m2", "b.rooms"
    )


def buildings_by_type(sales: DataFrame) -> DataFrame:
    """Number and mean area of the buildings of each type."""
    return (
        sales.select(F.inline("buildings"))
        .groupBy("type")
        .agg(F.count("*").alias("n_buildings"), F.round(F.avg("area_m2")).alias("avg_area_m2"))
    )


def normalise_buildings(column: str = "buildings") -> Column:
    """Building list without NULLs: no list is empty, no field missing."""
    return F.transform(
        F.coalesce(F.col(column), F.array().cast(S.SALES_SCHEMA["buildings"].dataType)),
        lambda b: F.struct(
            F.coalesce(b["type"], F.lit("")).alias("type"),
            F.coalesce(b["area_m2"], F.lit(0)).alias("area_m2"),
            F.coalesce(b["rooms"], F.lit(0)).alias("rooms"),
        ),
    )
