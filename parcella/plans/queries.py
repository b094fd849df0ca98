"""Every operator as a named query over the test data, with its check in SQL.

Each entry is ``name: (query, oracle)``. A query gets a :class:`Store`; the
oracle is SQL for an engine that has the test tables registered by name.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcella.functions import columns as C
from parcella.functions.filters import Bbox, BuildingSpec, SaleFilter
from parcella.operators import (
    derive,
    houses,
    lookup,
    maps,
    market,
    policy,
    quality,
    searches,
)
from parcella.plans.oracle import on_raw, on_sales, on_totals
from parcella.plans.store import SEARCHES_SQL, Store
from parcella.sources import tables as io

Query = Callable[[Store], DataFrame]

# Parameters for the test data; the operators default to the national ones.
YEARS = SaleFilter(year_min=1995, year_max=2001)
BOX = Bbox(45, 46, -2, 6)
POINT_CAP = 500
MIN_DEPARTMENT_SALES = 100
GAP_DEPARTMENTS = ["01", "05", "13", "23"]
GIANT_AREA = 100
TWO_LARGE_HOUSES = (BuildingSpec("Maison", rooms_min=4),) * 2
EVERYTHING = SaleFilter(
    year_min=1996,
    year_max=2000,
    department="05",
    price_min=50_000,
    price_max=400_000,
    area_min=60,
    area_max=400,
    land_area_min=200,
    land_area_max=9_000,
    building_specs=(BuildingSpec("Maison", rooms_min=3), BuildingSpec(area_min=50)),
)

RAW_COLUMNS = (
    "id_mutation, date_mutation, nature_mutation, valeur_fonciere, code_postal, code_commune, "
    "nom_commune, code_departement, ancien_nom_commune, code_type_local, type_local, "
    "surface_reelle_bati, nombre_pieces_principales, nature_culture, surface_terrain, "
    "longitude, latitude, year"
)
SALE_COLUMNS = (
    "id_mutation, sale_date, year, price_eur, transaction_type, department_code, commune_code, "
    "commune_name, postal_code, n_rows, n_communes, n_maisons, n_appartements, n_maison_rows, "
    "n_appartement_rows, n_dependances, n_commercial, n_parcel_rows, built_area_m2, rooms_total, "
    "rooms_min, rooms_max, land_area_m2, latitude, longitude, primary_type, composition, "
    "price_per_m2"
)
POINTS = ", ".join(maps.POINT_COLUMNS)

IN_YEARS = "year BETWEEN 1995 AND 2001"
IN_BOX = "latitude BETWEEN 45 AND 46 AND longitude BETWEEN -2 AND 6"
IN_FRANCE = "latitude BETWEEN 40 AND 52 AND longitude BETWEEN -7 AND 11"
PPM2 = "CASE WHEN price_per_m2 BETWEEN 100 AND 30000 THEN price_per_m2 END"


def names_in(names: str) -> list[str]:
    return [c.strip() for c in names.split(",")]


def flat(sales: DataFrame) -> DataFrame:
    """Sales without the nested list."""
    return sales.select(*names_in(SALE_COLUMNS))


def flat_buildings(df: DataFrame) -> DataFrame:
    """One row per building next to the flat columns."""
    keep = [c for c in df.columns if c != "buildings"]
    return df.select(*keep, F.posexplode("buildings").alias("position", "b")).select(
        *keep, "position", "b.type", "b.area_m2", "b.rooms"
    )


def prices(sql_keys: str, ppm2: str, rest: str) -> str:
    return on_sales(
        f"SELECT {sql_keys} COUNT(*) AS n_sales, "
        f"CAST(ROUND(MEDIAN(price_eur)) AS BIGINT) AS median_price, "
        f"CAST(ROUND(MEDIAN({PPM2})) AS BIGINT) AS {ppm2} FROM sales {rest}"
    )


def ids(predicate: Callable[[], object]) -> Query:
    return lambda t: t.sales.where(predicate()).select(
        "id_mutation", "year", "department_code", "price_eur", "built_area_m2", "land_area_m2"
    )


def ids_sql(where: str) -> str:
    return on_sales(
        "SELECT id_mutation, year, department_code, price_eur, built_area_m2, land_area_m2 "
        f"FROM sales WHERE {where}"
    )


def unnested(select: str, source: str) -> str:
    """Buildings with their position, in the oracle's dialect."""
    return (
        f"SELECT {select}, CAST(i - 1 AS INT) AS position, buildings[i].type AS type, "
        f"buildings[i].area_m2 AS area_m2, buildings[i].rooms AS rooms "
        f"FROM (SELECT *, UNNEST(range(1, len(buildings) + 1)) AS i FROM {source})"
    )


def rewritten_sales(t: Store) -> DataFrame:
    """The sales after one more way through the writer."""
    path = io.workspace(t.spark, "sales-copy")
    io.write_sales(t.sales, path)
    return flat(io.read_table(t.spark, path))


def qualifying(t: Store) -> DataFrame:
    """What the price reports need of the two-house sales, as a stored table."""
    return io.materialise(houses.two_house_sales(t.raw).select("year", "price"), "qualifying")


def long_trend(t: Store, granularity="year", split="none", bbox=None) -> DataFrame:
    return market.trend(t.sales, YEARS, bbox, granularity, split)


def trend_sql(bucket: str, category: str, where: str) -> str:
    return prices(
        f"{bucket} AS bucket, {category} AS category,",
        "median_eur_per_m2",
        f"WHERE {where} GROUP BY 1, 2",
    )


BUCKETS = {
    "year": "CAST(year AS VARCHAR)",
    "month": "STRFTIME(sale_date, '%Y-%m')",
    "week": "STRFTIME(DATE_TRUNC('week', sale_date), '%Y-%m-%d')",
}
NO_SPLIT = "CAST(NULL AS VARCHAR)"

# -- sources and sinks -------------------------------------------------------

SOURCES: dict[str, tuple[Query, str | None]] = {
    "ingest_csv": (
        lambda t: io.read_raw_csv(t.spark, t.csv_path, t.csv_schema).select(*names_in(RAW_COLUMNS)),
        on_raw(f"SELECT {RAW_COLUMNS} FROM raw_rows"),
    ),
    "ingest_dates": (
        lambda t: io.with_year(
            t.raw.select("id_mutation", F.col("date_mutation").cast("string"))
        ).distinct(),
        on_raw("SELECT DISTINCT id_mutation, date_mutation, year FROM raw_rows"),
    ),
    "write_partitioned": (
        lambda t: io.ingest(
            t.spark, t.csv_path, io.workspace(t.spark, "ingested"), t.csv_schema
        ).select(*names_in(RAW_COLUMNS)),
        on_raw(f"SELECT {RAW_COLUMNS} FROM raw_rows"),
    ),
    "scan_partitioned": (
        lambda t: t.raw.select(*names_in(RAW_COLUMNS)),
        on_raw(f"SELECT {RAW_COLUMNS} FROM raw_rows"),
    ),
    "scan_sales": (
        lambda t: flat(t.sales),
        on_sales(f"SELECT {SALE_COLUMNS} FROM sales"),
    ),
    "write_sales": (
        rewritten_sales,
        on_sales(f"SELECT {SALE_COLUMNS} FROM sales"),
    ),
    "ingest_report": (
        lambda t: io.load_report(t.raw).select(
            "year", "rows", "n_columns", (F.col("bytes") > 0).alias("stored")
        ),
        on_raw(
            "SELECT year, COUNT(*) AS rows, CAST(18 AS BIGINT) AS n_columns, TRUE AS stored "
            "FROM raw_rows GROUP BY year"
        ),
    ),
    "materialise": (
        lambda t: io.materialise(
            houses.two_house_sales(t.raw).select("id_mutation", "price"), "qualifying"
        ),
        on_raw(
            "SELECT id_mutation, MIN(valeur_fonciere) AS price FROM raw_rows GROUP BY id_mutation "
            "HAVING COUNT(*) FILTER (WHERE type_local = 'Maison') = 2 "
            "AND MIN(nombre_pieces_principales) FILTER (WHERE type_local = 'Maison') >= 5 "
            "AND MIN(nature_mutation) = 'Vente' AND MIN(valeur_fonciere) IS NOT NULL"
        ),
    ),
    "load_boundaries": (
        lambda t: io.read_boundaries(t.spark, t.boundaries_path).select("code", "nom"),
        "SELECT lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS code, n_name AS nom FROM nation "
        "UNION ALL SELECT '99', 'nowhere'",
    ),
}

# -- filters and look-ups ----------------------------------------------------

SPECS_SQL = "len(list_filter(buildings, lambda b: b.type = 'Maison' AND b.rooms >= 4)) >= 2"
# The same as the address of the dashboard; later values of a key do not count.
EVERYTHING_ADDRESS = (
    "?ymin=1996&ymax=2000&dept=05&pmin=50000&pmax=400000&amin=60&amax=400&lamin=200&lamax=9000"
    "&bs=Maison%3A%3A%3A3%3A%3Bany%3A50%3A%3A%3A&gran=week&ymin=1990"
)
EVERYTHING_SQL = """year BETWEEN 1996 AND 2000 AND department_code = '05'
  AND price_eur >= 50000 AND price_eur <= 400000
  AND built_area_m2 >= 60 AND built_area_m2 <= 400
  AND land_area_m2 >= 200 AND land_area_m2 <= 9000
  AND len(list_filter(buildings, lambda b: b.type = 'Maison' AND b.rooms >= 3)) >= 1
  AND len(list_filter(buildings, lambda b: b.area_m2 >= 50)) >= 1"""


def _filter(**bounds) -> Query:
    return ids(lambda: SaleFilter(**{"year_min": 1995, "year_max": 2001, **bounds}).predicate())


FILTERS: dict[str, tuple[Query, str | None]] = {
    "filter_year": (_filter(year_min=1996, year_max=1998), ids_sql("year BETWEEN 1996 AND 1998")),
    "filter_department": (
        _filter(department="05"),
        ids_sql(f"{IN_YEARS} AND department_code = '05'"),
    ),
    "filter_price": (
        _filter(price_min=100_000, price_max=200_000),
        ids_sql(f"{IN_YEARS} AND price_eur >= 100000 AND price_eur <= 200000"),
    ),
    "filter_built_area": (
        _filter(area_min=100, area_max=250),
        ids_sql(f"{IN_YEARS} AND built_area_m2 >= 100 AND built_area_m2 <= 250"),
    ),
    "filter_land_area": (
        _filter(land_area_min=1_000, land_area_max=2_500),
        ids_sql(f"{IN_YEARS} AND land_area_m2 >= 1000 AND land_area_m2 <= 2500"),
    ),
    "filter_building_specs": (
        _filter(building_specs=TWO_LARGE_HOUSES),
        ids_sql(f"{IN_YEARS} AND {SPECS_SQL}"),
    ),
    "filter_all": (ids(lambda: EVERYTHING.predicate()), ids_sql(EVERYTHING_SQL)),
    "filter_address": (
        ids(lambda: SaleFilter.from_query(EVERYTHING_ADDRESS).predicate()),
        ids_sql(EVERYTHING_SQL),
    ),
    "filter_bbox": (ids(lambda: BOX.predicate()), ids_sql(IN_BOX)),
    "clamp_bbox": (
        ids(lambda: maps.clamp_to_france(Bbox(30, 45, -20, 60)).predicate()),
        ids_sql("latitude BETWEEN 40 AND 45 AND longitude BETWEEN -7 AND 11"),
    ),
    "residential_policy": (
        lambda t: derive.sale_totals(t.raw)
        .join(derive.building_totals(t.raw), "id_mutation")
        .where(derive.residential_policy())
        .select("id_mutation", "n_rows", "price_eur"),
        on_sales("SELECT id_mutation, n_rows, price_eur FROM sales"),
    ),
    "building_rows": (
        lambda t: t.raw.where(C.is_building()).select(
            "id_mutation", "type_local", "surface_reelle_bati", "nombre_pieces_principales"
        ),
        on_raw(
            "SELECT id_mutation, type_local, surface_reelle_bati, nombre_pieces_principales "
            "FROM raw_rows WHERE type_local IN ('Maison', 'Appartement') "
            "AND surface_reelle_bati IS NOT NULL AND surface_reelle_bati > 0"
        ),
    ),
    "lookup_sale": (
        lambda t: flat(lookup.lookup_sale(t.sales, "1995-1000")),
        on_sales(f"SELECT {SALE_COLUMNS} FROM sales WHERE id_mutation = '1995-1000' LIMIT 1"),
    ),
    "browse_commune": (
        lambda t: flat(lookup.browse_commune(t.sales, "nation_1-")),
        on_sales(
            f"SELECT {SALE_COLUMNS} FROM sales WHERE LOWER(commune_name) LIKE '%nation_1-%' "
            "ORDER BY sale_date DESC, id_mutation LIMIT 50"
        ),
    ),
    "browse_newest": (
        lambda t: flat(lookup.browse_commune(t.sales, "  ")),
        on_sales(
            f"SELECT {SALE_COLUMNS} FROM sales ORDER BY sale_date DESC, id_mutation LIMIT 50"
        ),
    ),
    "sale_detail_like": (
        lambda t: flat_buildings(lookup.sale_detail_like(t.sales, "%1997-43%")),
        on_sales(
            unnested(
                "id_mutation, composition",
                "(SELECT * FROM sales WHERE id_mutation LIKE '%1997-43%' "
                "ORDER BY id_mutation LIMIT 3)",
            )
        ),
    ),
    "point_projection": (
        lambda t: t.sales.select(*maps.POINT_COLUMNS, F.size("buildings").alias("n_buildings")),
        on_sales(f"SELECT {POINTS}, CAST(len(buildings) AS INT) AS n_buildings FROM sales"),
    ),
    "browse_table": (
        lambda t: lookup.browse_table(t.sales),
        on_sales(
            "SELECT id_mutation, STRFTIME(sale_date, '%Y-%m-%d') AS date, "
            "commune_name || ' (' || department_code || ')' AS commune, composition, price_eur, "
            "built_area_m2, ROUND(price_per_m2) AS price_per_m2 FROM sales"
        ),
    ),
    "saved_search_report": (
        lambda t: searches.saved_search_report(t.sales, t.searches()),
        on_sales(
            f""", saved AS ({SEARCHES_SQL.format(supplier="supplier")}),
decoded AS (
  SELECT search_id,
         CAST(regexp_extract(query, '(^|&)ymin=([0-9]+)', 2) AS INT) AS ymin,
         CAST(regexp_extract(query, '(^|&)ymax=([0-9]+)', 2) AS INT) AS ymax,
         NULLIF(regexp_extract(query, '&dept=([0-9]+)', 1), '') AS dept,
         CAST(NULLIF(regexp_extract(query, '&pmin=([0-9]+)', 1), '') AS DOUBLE) AS pmin,
         CAST(NULLIF(regexp_extract(query, '&pmax=([0-9]+)', 1), '') AS DOUBLE) AS pmax,
         CAST(NULLIF(regexp_extract(query, '&amin=([0-9]+)', 1), '') AS DOUBLE) AS amin,
         CAST(NULLIF(regexp_extract(query, '&lamax=([0-9]+)', 1), '') AS DOUBLE) AS lamax,
         regexp_extract(query, '&bs=(.*)$', 1) AS bs
  FROM saved
),
matched AS (
  SELECT d.search_id, s.price_eur, s.price_per_m2 FROM decoded d JOIN sales s
    ON s.year BETWEEN d.ymin AND d.ymax AND (d.dept IS NULL OR s.department_code = d.dept)
  WHERE (d.pmin IS NULL OR s.price_eur >= d.pmin) AND (d.pmax IS NULL OR s.price_eur <= d.pmax)
    AND (d.amin IS NULL OR s.built_area_m2 >= d.amin)
    AND (d.lamax IS NULL OR s.land_area_m2 <= d.lamax)
    AND CASE
      WHEN d.bs LIKE 'Maison%' THEN
        len(list_filter(s.buildings, lambda b: b.type = 'Maison' AND b.rooms >= 4)) >= 2
      WHEN d.bs LIKE 'chateau%' THEN
        len(list_filter(s.buildings, lambda b: b.area_m2 >= 60 AND b.area_m2 <= 90)) >= 1
      WHEN d.bs LIKE 'Appartement%' THEN
        len(list_filter(s.buildings, lambda b: b.type = 'Appartement' AND b.rooms <= 6)) >= 1
        AND len(list_filter(s.buildings, lambda b: b.type = 'Maison' AND b.area_m2 >= 50)) >= 1
      ELSE TRUE END
)
SELECT saved.search_id, 'ok' AS status, COALESCE(r.n_sales, 0) AS n_sales, r.median_price, r.median_per_m2
FROM saved LEFT JOIN (
  SELECT search_id, COUNT(*) AS n_sales,
         CAST(ROUND(MEDIAN(price_eur)) AS BIGINT) AS median_price,
         CAST(ROUND(MEDIAN({PPM2})) AS BIGINT) AS median_per_m2
  FROM matched GROUP BY search_id) r USING (search_id)"""
        ),
    ),
}

# -- derivation --------------------------------------------------------------

DERIVATION: dict[str, tuple[Query, str | None]] = {
    "derive_sales": (
        lambda t: flat(derive.derive_sales(t.raw)),
        on_sales(f"SELECT {SALE_COLUMNS} FROM sales"),
    ),
    "dedup_buildings": (
        lambda t: derive.dedup_buildings(t.raw),
        on_totals("SELECT * FROM distinct_buildings"),
    ),
    "building_agg": (
        lambda t: derive.building_totals(t.raw),
        on_totals("SELECT * EXCLUDE (buildings) FROM building_totals"),
    ),
    "building_list": (
        lambda t: derive.unnest_buildings(t.sales),
        on_sales(unnested("id_mutation", "sales")),
    ),
    "sale_agg": (
        lambda t: derive.sale_totals(t.raw),
        on_totals("SELECT * EXCLUDE (latitude, longitude) FROM sale_totals"),
    ),
    "preferred_coords": (
        lambda t: derive.preferred_coordinates(t.raw),
        on_totals("SELECT id_mutation, latitude, longitude FROM sale_totals"),
    ),
    "primary_type": (
        lambda t: t.sales.select("id_mutation", "n_maisons", "n_appartements", "primary_type"),
        on_sales("SELECT id_mutation, n_maisons, n_appartements, primary_type FROM sales"),
    ),
    "composition": (
        lambda t: t.sales.select("id_mutation", "n_maisons", "n_appartements", "composition"),
        on_sales("SELECT id_mutation, n_maisons, n_appartements, composition FROM sales"),
    ),
    "price_per_m2": (
        lambda t: t.sales.select("id_mutation", "price_eur", "built_area_m2", "price_per_m2"),
        on_sales("SELECT id_mutation, price_eur, built_area_m2, price_per_m2 FROM sales"),
    ),
    "unnest_buildings": (
        lambda t: derive.buildings_by_type(t.sales),
        on_sales(
            "SELECT b.type AS type, COUNT(*) AS n_buildings, ROUND(AVG(b.area_m2)) AS avg_area_m2 "
            "FROM (SELECT UNNEST(buildings) AS b FROM sales) GROUP BY 1"
        ),
    ),
    "normalise_buildings": (
        lambda t: flat_buildings(
            t.sales.select("id_mutation", derive.normalise_buildings().alias("buildings"))
        ),
        on_sales(
            "SELECT id_mutation, position, COALESCE(type, '') AS type, "
            "COALESCE(area_m2, 0) AS area_m2, COALESCE(rooms, 0) AS rooms "
            f"FROM ({unnested('id_mutation', 'sales')})"
        ),
    ),
    "sale_card": (
        lambda t: lookup.sale_card(t.sales),
        on_sales(
            "SELECT id_mutation, STRFTIME(sale_date, '%Y-%m-%d') AS date, commune_name, "
            "primary_type, composition, price_eur, ROUND(price_per_m2) AS price_per_m2, "
            "built_area_m2, land_area_m2, CAST(len(buildings) AS INT) AS n_buildings, n_maisons, "
            "n_appartements, rooms_total, commune_code, department_code, year, "
            "COALESCE(latitude <> 0 AND longitude <> 0, FALSE) AS has_location, "
            "CASE WHEN latitude <> 0 AND longitude <> 0 "
            "THEN CAST(latitude AS VARCHAR) || ',' || CAST(longitude AS VARCHAR) END AS location "
            "FROM sales"
        ),
    ),
}

# -- reports and data quality ------------------------------------------------


def varying(column: str, name: str) -> str:
    return on_raw(
        f"SELECT COUNT(*) AS {name} FROM (SELECT id_mutation FROM raw_rows "
        f"GROUP BY id_mutation HAVING COUNT(DISTINCT {column}) > 1)"
    )


RUNDOWN_COLUMNS = [
    "nature_mutation",
    "type_local",
    "code_type_local",
    "ancien_nom_commune",
    "year",
]
LABELS_SQL = """CASE value
  WHEN 'Vente' THEN 'Sale' WHEN 'Echange' THEN 'Exchange / swap'
  WHEN 'Vente terrain à bâtir' THEN 'Sale of building land' WHEN 'Adjudication' THEN 'Auction'
  WHEN 'Maison' THEN 'House' WHEN 'Appartement' THEN 'Apartment'
  WHEN 'Dépendance' THEN 'Outbuilding / annex'
  WHEN 'Local industriel. commercial ou assimilé' THEN 'Commercial / industrial premises'
  ELSE '' END"""
RUNDOWN_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COALESCE(CAST("{c}" AS VARCHAR), '(null)') AS value,
    COUNT(*) AS rows, ROUND(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM raw_rows), 3) AS pct
    FROM raw_rows GROUP BY "{c}" """
    for c in RUNDOWN_COLUMNS
)
LOW_CARDINALITY_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS n_values FROM raw_rows
    HAVING COUNT(DISTINCT {c}) <= 10"""
    for c in names_in(RAW_COLUMNS)
)

REPORTS: dict[str, tuple[Query, str | None]] = {
    "sales_by_year": (
        lambda t: houses.sales_by_year(t.sales),
        on_sales(
            "SELECT year, COUNT(*) AS sales, "
            "COUNT(*) FILTER (WHERE primary_type = 'Maison') AS maison_only, "
            "COUNT(*) FILTER (WHERE primary_type = 'Appartement') AS appt_only, "
            "COUNT(*) FILTER (WHERE primary_type = 'Mixed') AS mixed, "
            "ROUND(MEDIAN(price_eur)) AS median_price, "
            "ROUND(MEDIAN(price_per_m2)) AS median_eur_per_m2 FROM sales GROUP BY year"
        ),
    ),
    "ppm2_by_houses": (
        lambda t: houses.ppm2_by_houses(t.sales),
        on_sales(
            "SELECT n_maisons, COUNT(*) AS n_sales, ROUND(MEDIAN(price_eur)) AS med_price, "
            "ROUND(MEDIAN(built_area_m2)) AS med_built_m2, "
            "ROUND(MEDIAN(price_per_m2)) AS med_eur_per_m2, "
            "ROUND(MEDIAN(built_area_m2 / NULLIF(n_maisons, 0))) AS med_m2_per_house "
            "FROM sales WHERE n_maisons BETWEEN 1 AND 5 AND n_appartements = 0 "
            "AND price_per_m2 BETWEEN 100 AND 30000 GROUP BY n_maisons"
        ),
    ),
    "top_compositions": (
        lambda t: houses.top_compositions(t.sales),
        on_sales(
            "SELECT composition, COUNT(*) AS n_sales, ROUND(MEDIAN(price_eur)) AS med_price, "
            "ROUND(MEDIAN(price_per_m2)) AS med_eur_per_m2 FROM sales GROUP BY composition "
            "ORDER BY n_sales DESC, composition LIMIT 15"
        ),
    ),
    "dedup_impact": (
        lambda t: houses.dedup_impact(t.sales),
        on_sales(
            "SELECT n_maison_rows AS raw_rows, n_maisons AS deduped, COUNT(*) AS n_sales "
            "FROM sales WHERE n_maison_rows BETWEEN 1 AND 5 GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 20"
        ),
    ),
    "rows_per_year": (
        lambda t: quality.rows_per_year(t.raw),
        on_raw(
            "SELECT year, COUNT(*) AS rows, COUNT(DISTINCT id_mutation) AS sales, "
            "ROUND(CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT id_mutation), 3) AS rows_per_sale "
            "FROM raw_rows GROUP BY year"
        ),
    ),
    "rows_per_sale_hist": (
        lambda t: quality.rows_per_sale_histogram(t.raw),
        on_raw(
            "SELECT rows_per_sale, COUNT(*) AS n_sales FROM (SELECT COUNT(*) AS rows_per_sale "
            "FROM raw_rows GROUP BY id_mutation) GROUP BY 1 ORDER BY 1 LIMIT 15"
        ),
    ),
    "largest_sales_by_rows": (
        lambda t: quality.largest_sales_by_rows(t.raw),
        on_raw(
            "SELECT id_mutation, COUNT(*) AS n_rows, MIN(date_mutation) AS date_min, "
            "MAX(date_mutation) AS date_max, MIN(valeur_fonciere) AS price_min, "
            "MAX(valeur_fonciere) AS price_max, COUNT(DISTINCT code_commune) AS n_communes "
            "FROM raw_rows GROUP BY id_mutation ORDER BY n_rows DESC, id_mutation LIMIT 10"
        ),
    ),
    "inconsistent_price": (
        lambda t: quality.inconsistent_price(t.raw),
        varying("valeur_fonciere", "sales_with_inconsistent_price"),
    ),
    "inconsistent_date": (
        lambda t: quality.inconsistent_date(t.raw),
        varying("date_mutation", "sales_with_inconsistent_date"),
    ),
    "multi_commune": (
        lambda t: quality.multi_commune(t.raw),
        varying("code_commune", "sales_spanning_communes"),
    ),
    "consistency_summary": (
        lambda t: quality.consistency_summary(t.raw),
        on_raw(
            """, s AS (SELECT COUNT(DISTINCT valeur_fonciere) AS p,
            COUNT(DISTINCT date_mutation) AS d, COUNT(DISTINCT code_commune) AS c
            FROM raw_rows GROUP BY id_mutation)
            SELECT COUNT(*) FILTER (WHERE p > 1) AS inconsistent_price,
            COUNT(*) FILTER (WHERE d > 1) AS inconsistent_date,
            COUNT(*) FILTER (WHERE c > 1) AS multi_commune FROM s"""
        ),
    ),
    "transaction_types": (
        lambda t: quality.transaction_types(t.raw),
        on_raw(
            "SELECT nature_mutation, COUNT(DISTINCT id_mutation) AS sales FROM raw_rows GROUP BY 1"
        ),
    ),
    "row_types": (
        lambda t: quality.row_types(t.raw),
        on_raw(
            "SELECT COALESCE(type_local, '(null — terrain/parcel)') AS type_local, "
            "COUNT(*) AS rows FROM raw_rows GROUP BY 1"
        ),
    ),
    "missingness": (
        lambda t: quality.missingness(t.raw),
        on_raw(
            "SELECT COUNT(*) AS total_rows, "
            "COUNT(*) FILTER (WHERE valeur_fonciere IS NULL) AS null_price, "
            "COUNT(*) FILTER (WHERE latitude IS NULL) AS null_lat, "
            "COUNT(*) FILTER (WHERE longitude IS NULL) AS null_lon, "
            "COUNT(*) FILTER (WHERE code_commune IS NULL) AS null_commune, "
            "COUNT(*) FILTER (WHERE surface_reelle_bati IS NULL) AS null_built_area, "
            "COUNT(*) FILTER (WHERE type_local IS NULL) AS null_type, "
            "COUNT(*) FILTER (WHERE nombre_pieces_principales IS NULL "
            "OR nombre_pieces_principales = 0) AS null_or_zero_rooms FROM raw_rows"
        ),
    ),
    "price_percentiles": (
        lambda t: quality.price_percentiles(t.raw),
        on_raw(
            """, s AS (SELECT MIN(valeur_fonciere) AS p FROM raw_rows
            WHERE valeur_fonciere IS NOT NULL GROUP BY id_mutation)
            SELECT COUNT(*) AS sales, MIN(p) AS min_price, ROUND(QUANTILE_CONT(p, 0.01)) AS p01,
            ROUND(QUANTILE_CONT(p, 0.5)) AS p50, ROUND(QUANTILE_CONT(p, 0.99)) AS p99,
            ROUND(QUANTILE_CONT(p, 0.999)) AS p999, MAX(p) AS max_price FROM s"""
        ),
    ),
    "biggest_sales": (
        lambda t: quality.biggest_sales(t.raw),
        on_raw(
            "SELECT id_mutation, MIN(valeur_fonciere) AS price, MIN(nom_commune) AS commune, "
            "MIN(date_mutation) AS date, MIN(nature_mutation) AS nature FROM raw_rows "
            "GROUP BY id_mutation ORDER BY price DESC NULLS LAST, id_mutation LIMIT 5"
        ),
    ),
    "geocoding_quality": (
        lambda t: quality.geocoding_quality(t.raw),
        on_raw(
            "SELECT COUNT(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) "
            "AS geocoded_rows, "
            "COUNT(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS missing_coords, "
            "COUNT(*) FILTER (WHERE latitude = 0 AND longitude = 0) AS null_island, "
            "COUNT(*) FILTER (WHERE latitude NOT BETWEEN 41 AND 52) AS lat_out_of_france, "
            "COUNT(*) FILTER (WHERE longitude NOT BETWEEN -5.5 AND 10) AS lon_out_of_france "
            "FROM raw_rows"
        ),
    ),
    "rows_per_sale_hist_20": (
        lambda t: quality.rows_per_sale_histogram(t.raw, 20),
        on_raw(
            "SELECT rows_per_sale, COUNT(*) AS n_sales FROM (SELECT COUNT(*) AS rows_per_sale "
            "FROM raw_rows GROUP BY id_mutation) GROUP BY 1 ORDER BY 1 LIMIT 20"
        ),
    ),
    "biggest_sales_10": (
        lambda t: quality.biggest_sales(t.raw, 10).drop("nature"),
        on_raw(
            "SELECT id_mutation, MIN(valeur_fonciere) AS price, MIN(nom_commune) AS commune, "
            "MIN(date_mutation) AS date FROM raw_rows "
            "GROUP BY id_mutation ORDER BY price DESC NULLS LAST, id_mutation LIMIT 10"
        ),
    ),
    "rooms_hist_1_12": (
        lambda t: quality.rooms_histogram(t.raw, between=(1, 12)),
        on_raw(
            "SELECT nombre_pieces_principales AS rooms, COUNT(*) AS rows FROM raw_rows "
            "WHERE type_local = 'Maison' AND nombre_pieces_principales BETWEEN 1 AND 12 GROUP BY 1"
        ),
    ),
    "dedup_impact_1_4": (
        lambda t: houses.dedup_impact(t.sales, 4),
        on_sales(
            "SELECT n_maison_rows AS raw_rows, n_maisons AS deduped, COUNT(*) AS n_sales "
            "FROM sales WHERE n_maison_rows BETWEEN 1 AND 4 GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 20"
        ),
    ),
    "id_collisions": (
        lambda t: quality.id_collisions(t.raw),
        varying("year", "ids_in_several_years"),
    ),
    "rooms_hist": (
        lambda t: quality.rooms_histogram(t.raw),
        on_raw(
            "SELECT nombre_pieces_principales AS rooms, COUNT(*) AS rows FROM raw_rows "
            "WHERE type_local = 'Maison' AND nombre_pieces_principales IS NOT NULL "
            "GROUP BY 1 ORDER BY 1 LIMIT 20"
        ),
    ),
    "categorical_rundown": (
        lambda t: quality.categorical_rundown(t.raw, RUNDOWN_COLUMNS),
        on_raw(f", r AS ({RUNDOWN_SQL}) SELECT *, {LABELS_SQL} AS english FROM r"),
    ),
    "translate_labels": (
        lambda t: t.raw.select(
            "id_mutation",
            F.col("nature_mutation").alias("value"),
            C.english_label(F.col("nature_mutation")).alias("english"),
        ),
        on_raw(
            f"SELECT id_mutation, value, {LABELS_SQL} AS english FROM "
            "(SELECT id_mutation, nature_mutation AS value FROM raw_rows)"
        ),
    ),
    "low_cardinality_columns": (
        lambda t: quality.low_cardinality_columns(t.raw),
        on_raw(LOW_CARDINALITY_SQL),
    ),
}

# -- two-house question, policy, multi-house study ---------------------------

QUALIFYING = """, q AS (
  SELECT id_mutation, COUNT(*) FILTER (WHERE type_local = 'Maison') AS n_maisons,
         MIN(nombre_pieces_principales) FILTER (WHERE type_local = 'Maison') AS min_pieces,
         MAX(nombre_pieces_principales) FILTER (WHERE type_local = 'Maison') AS max_pieces,
         SUM(surface_reelle_bati) FILTER (WHERE type_local = 'Maison') AS total_bati,
         MIN(year) AS year, MIN(valeur_fonciere) AS price, MIN(nature_mutation) AS nature,
         MIN(nom_commune) AS commune, MIN(code_departement) AS dept
  FROM raw_rows GROUP BY id_mutation
  HAVING n_maisons = 2 AND min_pieces >= 5 AND nature = 'Vente' AND price IS NOT NULL) """
FLAGGED = """, f AS (
  SELECT id_mutation, MIN(date_mutation) AS date, MIN(year) AS year,
         MIN(valeur_fonciere) AS price, MIN(nature_mutation) AS nature,
         MIN(code_departement) AS dept, MIN(nom_commune) AS commune, COUNT(*) AS n_rows,
         COUNT(DISTINCT code_commune) AS n_communes
  FROM raw_rows GROUP BY id_mutation) """
LOOSE = "n_rows <= 10 AND price >= 1000"
DECILES = ((10, 0.10), (25, 0.25), (50, 0.50), (75, 0.75), (90, 0.90))
EXTREME = (
    "SELECT id_mutation, year, commune, dept, ROUND(price) AS price, min_pieces, max_pieces, "
    "total_bati FROM q "
)
SAMPLED = "ORDER BY md5('1:' || id_mutation), id_mutation LIMIT 10"


def deciles(column: str, suffix: str = "") -> str:
    return ", ".join(
        f"ROUND(QUANTILE_CONT({column}, {p})) AS p{n}{suffix}" for n, p in DECILES
    )


def row_types_sql(low: int, high: int) -> str:
    return on_raw(
        FLAGGED
        + "SELECT type_local, COUNT(*) AS rows FROM raw_rows JOIN f USING (id_mutation) "
        + f"WHERE n_rows BETWEEN {low} AND {high} GROUP BY type_local"
    )


STUDIES: dict[str, tuple[Query, str | None]] = {
    "two_house_sales": (
        lambda t: houses.two_house_sales(t.raw),
        on_raw(QUALIFYING + "SELECT * FROM q"),
    ),
    "two_house_by_year": (
        lambda t: houses.two_house_by_year(qualifying(t)),
        on_raw(
            QUALIFYING + "SELECT year, COUNT(*) AS n_sales, ROUND(AVG(price)) AS avg_price_eur, "
            "ROUND(MEDIAN(price)) AS median_price_eur, ROUND(MIN(price)) AS min_price_eur, "
            "ROUND(MAX(price)) AS max_price_eur FROM q GROUP BY year"
        ),
    ),
    "two_house_top10": (
        lambda t: houses.two_house_extremes(t.raw, dearest=True),
        on_raw(QUALIFYING + EXTREME + "ORDER BY q.price DESC, id_mutation LIMIT 10"),
    ),
    "two_house_bottom10": (
        lambda t: houses.two_house_extremes(t.raw, dearest=False),
        on_raw(QUALIFYING + EXTREME + "ORDER BY q.price, id_mutation LIMIT 10"),
    ),
    "two_house_trimmed": (
        lambda t: houses.two_house_trimmed(qualifying(t)),
        on_raw(
            QUALIFYING + "SELECT year, COUNT(*) AS n_sales, ROUND(AVG(price)) AS avg_price_eur, "
            "ROUND(MEDIAN(price)) AS median_price_eur FROM q "
            "WHERE price BETWEEN 20000 AND 20000000 GROUP BY year"
        ),
    ),
    "flagged_sales": (
        lambda t: policy.flagged_sales(t.raw),
        on_raw(FLAGGED + "SELECT * FROM f"),
    ),
    "filter_impact": (
        lambda t: policy.filter_impact(t.raw),
        on_raw(
            FLAGGED + "SELECT COUNT(*) AS all_sales, "
            "CAST(SUM(CAST(n_rows > 10 AS INT)) AS BIGINT) AS drop_bulk, "
            "CAST(SUM(CAST(price < 1000 OR price IS NULL AS INT)) AS BIGINT) AS drop_symbolic, "
            "CAST(SUM(CAST(n_communes > 1 AS INT)) AS BIGINT) AS drop_multi_commune, "
            "CAST(SUM(CAST(nature <> 'Vente' AS INT)) AS BIGINT) AS drop_not_plain, "
            f"CAST(SUM(CAST({LOOSE} AND n_communes = 1 AND nature = 'Vente' AS INT)) AS BIGINT) "
            f"AS keep_strict, CAST(SUM(CAST({LOOSE} AS INT)) AS BIGINT) AS keep_loose FROM f"
        ),
    ),
    "borderline_types": (lambda t: policy.borderline_types(t.raw), row_types_sql(11, 15)),
    "borderline_types_labelled": (
        lambda t: policy.borderline_types(t.raw, "(terrain/parcel)"),
        on_raw(
            FLAGGED
            + "SELECT COALESCE(type_local, '(terrain/parcel)') AS type_local, COUNT(*) AS rows "
            + "FROM raw_rows JOIN f USING (id_mutation) WHERE n_rows BETWEEN 11 AND 15 GROUP BY 1"
        ),
    ),
    "kept_types": (lambda t: policy.kept_types(t.raw), row_types_sql(6, 10)),
    "policy_before_after": (
        lambda t: policy.policy_before_after(t.raw),
        on_raw(
            FLAGGED
            + f""", h AS (SELECT id_mutation FROM raw_rows WHERE type_local = 'Maison'
              GROUP BY id_mutation HAVING COUNT(*) = 2 AND MIN(nombre_pieces_principales) >= 5)
            SELECT year, COUNT(*) AS before_filter,
              COUNT(*) FILTER (WHERE {LOOSE}) AS after_filter,
              ROUND(AVG(price)) AS avg_before,
              ROUND(AVG(CASE WHEN {LOOSE} THEN price END)) AS avg_after,
              ROUND(MEDIAN(price)) AS median_before,
              ROUND(MEDIAN(CASE WHEN {LOOSE} THEN price END)) AS median_after
            FROM f JOIN h USING (id_mutation) WHERE nature = 'Vente' GROUP BY year"""
        ),
    ),
    "biggest_after_policy": (
        lambda t: policy.biggest_after_policy(t.raw),
        on_raw(
            FLAGGED + "SELECT id_mutation, date, ROUND(price) AS price, nature, n_rows, commune, "
            f"dept FROM f WHERE {LOOSE} ORDER BY f.price DESC, id_mutation LIMIT 10"
        ),
    ),
    "single_house_ppm2": (
        lambda t: policy.single_house_ppm2(t.raw),
        on_raw(
            FLAGGED
            + """, h AS (SELECT id_mutation, MIN(surface_reelle_bati) AS area FROM raw_rows
              WHERE type_local = 'Maison' GROUP BY id_mutation HAVING COUNT(*) = 1)
            SELECT year, COUNT(*) AS n_sales, ROUND(MEDIAN(price / area)) AS median_eur_per_m2,
              ROUND(AVG(price / area)) AS avg_eur_per_m2 FROM f JOIN h USING (id_mutation)
            WHERE area > 10 AND nature = 'Vente' AND price BETWEEN 1000 AND 20000000
              AND n_rows <= 10 GROUP BY year"""
        ),
    ),
    "sample_dropped": (
        lambda t: policy.sample_dropped(t.raw),
        on_raw(
            FLAGGED + "SELECT id_mutation, date, ROUND(price) AS price, nature, n_rows, "
            f"n_communes, dept FROM f WHERE n_rows > 10 AND f.price IS NOT NULL {SAMPLED}"
        ),
    ),
    "houses_profile": (
        lambda t: houses.houses_profile(t.sales),
        on_sales(
            "SELECT n_maisons, COUNT(*) AS n_sales, ROUND(MEDIAN(price_eur)) AS med_price, "
            "ROUND(MEDIAN(built_area_m2)) AS med_built_area_m2, "
            "ROUND(MEDIAN(price_per_m2)) AS med_price_per_m2, "
            "ROUND(MEDIAN(built_area_m2 / n_maisons)) AS med_m2_per_house, "
            "ROUND(MEDIAN(price_eur / n_maisons)) AS med_price_per_house FROM sales "
            "WHERE n_maisons BETWEEN 1 AND 5 AND n_appartements = 0 AND built_area_m2 > 10 "
            "AND price_per_m2 BETWEEN 100 AND 30000 GROUP BY n_maisons"
        ),
    ),
    "area_percentiles": (
        lambda t: houses.area_percentiles(t.sales),
        on_sales(
            f"SELECT n_maisons, {deciles('built_area_m2')} FROM sales "
            "WHERE n_maisons BETWEEN 1 AND 3 AND n_appartements = 0 AND built_area_m2 > 10 "
            "GROUP BY n_maisons"
        ),
    ),
    "raw_area_percentiles": (
        lambda t: houses.raw_area_percentiles(t.raw, t.sales),
        on_sales(
            "SELECT s.n_maisons, COUNT(*) AS n_building_rows, "
            f"{deciles('d.surface_reelle_bati', '_bati')} FROM raw_rows d "
            "JOIN sales s USING (id_mutation) WHERE s.n_maisons IN (1, 2) "
            "AND s.n_appartements = 0 AND s.built_area_m2 > 10 AND d.type_local = 'Maison' "
            "AND d.surface_reelle_bati > 0 GROUP BY s.n_maisons"
        ),
    ),
    "dept_two_house_share": (
        lambda t: houses.department_two_house_share(t.sales, MIN_DEPARTMENT_SALES),
        on_sales(
            f""", d AS (SELECT department_code,
              COUNT(*) FILTER (WHERE n_maisons = 1) AS n_1house,
              COUNT(*) FILTER (WHERE n_maisons = 2) AS n_2house
            FROM sales WHERE n_maisons IN (1, 2) AND n_appartements = 0 AND built_area_m2 > 10
            GROUP BY department_code)
            SELECT *, ROUND(100.0::DOUBLE * n_2house / (n_1house + n_2house), 1) AS pct_2house,
              CASE WHEN department_code IN ('75','92','93','94','69','13','31','33','59','67','06')
                   THEN 'urban' ELSE 'rural' END AS urban_rural_proxy
            FROM d WHERE n_1house + n_2house > {MIN_DEPARTMENT_SALES}
            ORDER BY pct_2house DESC, department_code LIMIT 15"""
        ),
    ),
    "dept_two_house_share_all": (
        lambda t: houses.department_two_house_share(
            t.sales, MIN_DEPARTMENT_SALES, min_area=False
        ).drop("urban_rural_proxy"),
        on_sales(
            f""", d AS (SELECT department_code,
              COUNT(*) FILTER (WHERE n_maisons = 1) AS n_1house,
              COUNT(*) FILTER (WHERE n_maisons = 2) AS n_2house
            FROM sales WHERE n_maisons IN (1, 2) AND n_appartements = 0 GROUP BY department_code)
            SELECT *, ROUND(100.0::DOUBLE * n_2house / (n_1house + n_2house), 1) AS pct_2house
            FROM d WHERE n_1house + n_2house > {MIN_DEPARTMENT_SALES}
            ORDER BY pct_2house DESC, department_code LIMIT 15"""
        ),
    ),
    "dept_ppm2_gap": (
        lambda t: houses.department_ppm2_gap(t.sales, GAP_DEPARTMENTS),
        on_sales(
            "SELECT department_code, n_maisons, COUNT(*) AS n, "
            "ROUND(MEDIAN(price_eur)) AS med_price, ROUND(MEDIAN(built_area_m2)) AS med_built_m2, "
            "ROUND(MEDIAN(price_per_m2)) AS med_eur_per_m2 FROM sales "
            "WHERE department_code IN ('01', '05', '13', '23') AND n_maisons IN (1, 2) "
            "AND n_appartements = 0 AND built_area_m2 > 10 "
            "AND price_per_m2 BETWEEN 100 AND 30000 GROUP BY 1, 2"
        ),
    ),
    "giant_houses": (
        lambda t: houses.giant_houses(t.raw, t.sales, GIANT_AREA),
        on_sales(
            "SELECT id_mutation, type_local, surface_reelle_bati, "
            "nombre_pieces_principales AS pieces, valeur_fonciere, nom_commune, code_departement "
            "FROM raw_rows WHERE type_local = 'Maison' "
            f"AND surface_reelle_bati > {GIANT_AREA} AND id_mutation IN (SELECT id_mutation "
            "FROM sales WHERE n_maisons = 2 AND n_appartements = 0 AND built_area_m2 > 10) "
            "ORDER BY surface_reelle_bati DESC, id_mutation, pieces DESC NULLS LAST, "
            "valeur_fonciere DESC NULLS LAST LIMIT 15"
        ),
    ),
    "sampled_sale_rows": (
        lambda t: houses.sampled_sale_rows(t.raw, t.sales),
        on_sales(
            f""", chosen AS (SELECT id_mutation FROM sales WHERE n_maisons = 2
              AND n_appartements = 0 AND price_eur BETWEEN 100000 AND 400000
              AND built_area_m2 > 10 AND rooms_min >= 3 {SAMPLED})
            SELECT id_mutation, type_local, surface_reelle_bati,
              nombre_pieces_principales AS pieces, nature_culture, surface_terrain,
              code_departement AS dept, nom_commune AS commune, valeur_fonciere AS price_total,
              latitude, longitude
            FROM raw_rows WHERE id_mutation IN (SELECT id_mutation FROM chosen)"""
        ),
    ),
    "raw_house_symptom": (
        lambda t: houses.raw_house_symptom(t.raw),
        on_raw(
            """, s AS (SELECT COUNT(*) FILTER (WHERE type_local = 'Maison') AS n_maisons_raw,
              MIN(valeur_fonciere) AS price,
              SUM(surface_reelle_bati) FILTER (WHERE type_local = 'Maison') AS built
            FROM raw_rows GROUP BY id_mutation)
            SELECT n_maisons_raw, COUNT(*) AS n_sales, ROUND(MEDIAN(price)) AS med_price,
              ROUND(MEDIAN(built)) AS med_built_area FROM s
            WHERE n_maisons_raw BETWEEN 1 AND 5 GROUP BY 1"""
        ),
    ),
    "same_surface_share": (
        lambda t: houses.same_surface_share(t.raw),
        on_raw(
            """, m AS (SELECT MIN(surface_reelle_bati) AS lo, MAX(surface_reelle_bati) AS hi
            FROM raw_rows WHERE type_local = 'Maison' GROUP BY id_mutation HAVING COUNT(*) = 2)
            SELECT COUNT(*) AS total_2row_sales,
              CAST(SUM(CAST(lo = hi AS INT)) AS BIGINT) AS same_surface,
              ROUND(100.0::DOUBLE * SUM(CAST(lo = hi AS INT)) / COUNT(*), 1) AS pct_same FROM m"""
        ),
    ),
    "dedup_examples": (
        lambda t: houses.dedup_examples(t.raw, t.sales),
        on_sales(
            """, chosen AS (SELECT id_mutation FROM sales WHERE n_maison_rows = 2
              AND n_maisons = 1 AND price_eur BETWEEN 100000 AND 350000
              ORDER BY id_mutation LIMIT 10)
            SELECT id_mutation, type_local, surface_reelle_bati AS bati_m2,
              nombre_pieces_principales AS pieces, nature_culture, surface_terrain,
              valeur_fonciere, nom_commune
            FROM raw_rows WHERE id_mutation IN (SELECT id_mutation FROM chosen)"""
        ),
    ),
    "corrected_ppm2_by_year": (
        lambda t: houses.corrected_ppm2_by_year(t.sales),
        on_sales(
            "SELECT year, ROUND(MEDIAN(price_per_m2)) AS med_eur_per_m2 FROM sales "
            "WHERE price_per_m2 BETWEEN 100 AND 30000 GROUP BY year"
        ),
    ),
}

# -- dashboard ---------------------------------------------------------------

BOUNDS_SQL = """n AS (SELECT COUNT(price) AS n FROM shown),
ranked AS (SELECT price, ROW_NUMBER() OVER (ORDER BY price) - 1 AS r FROM shown
           WHERE price IS NOT NULL),
bounds AS (SELECT
  COALESCE((SELECT CAST(price AS DOUBLE) FROM ranked, n WHERE r = FLOOR(n.n * 0.05)), 0) AS p5,
  COALESCE((SELECT CAST(price AS DOUBLE) FROM ranked, n WHERE r = FLOOR(n.n * 0.95)), 1000000)
    AS p95)"""
REGIONS_SQL = f"""SELECT department_code AS code, department_code AS name, COUNT(*) AS n_sales,
  CAST(ROUND(MEDIAN(price_eur)) AS BIGINT) AS median_price,
  CAST(ROUND(MEDIAN({PPM2})) AS BIGINT) AS median_per_m2
  FROM sales WHERE {IN_YEARS} AND {IN_FRANCE} GROUP BY 1, 2"""
COMMUNES_SQL = REGIONS_SQL.replace(
    "department_code AS code, department_code AS name",
    "commune_code AS code, commune_name AS name",
)
NEWEST_SQL = (
    f"SELECT * FROM sales WHERE {IN_YEARS} AND {IN_BOX} "
    f"ORDER BY sale_date DESC, id_mutation LIMIT {POINT_CAP}"
)
T_SQL = "GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, (price - p5) / GREATEST(1.0::DOUBLE, p95 - p5)))"


def boxed_points(t: Store) -> DataFrame:
    return maps.map_points(t.sales, YEARS, BOX, POINT_CAP)


def departments(t: Store) -> DataFrame:
    return maps.choropleth_department(t.sales, YEARS)


def wide_sql(category: str, categories: list[str], where: str) -> str:
    cells = ", ".join(
        f"MAX({m}) FILTER (WHERE category = '{c}') AS \"{c}__{m}\""
        for c in categories
        for m in ("median_price", "median_eur_per_m2", "n_sales")
    )
    return on_sales(
        f""", long AS (SELECT CAST(year AS VARCHAR) AS bucket, {category} AS category,
          COUNT(*) AS n_sales, CAST(ROUND(MEDIAN(price_eur)) AS BIGINT) AS median_price,
          CAST(ROUND(MEDIAN({PPM2})) AS BIGINT) AS median_eur_per_m2
        FROM sales WHERE {where} GROUP BY 1, 2)
        SELECT bucket, {cells} FROM long GROUP BY bucket"""
    )


DASHBOARD: dict[str, tuple[Query, str | None]] = {
    "summary_stats": (
        lambda t: market.summary_stats(t.sales, YEARS),
        prices("", "median_per_m2", f"WHERE {IN_YEARS}"),
    ),
    "summary_stats_bbox": (
        lambda t: market.summary_stats(t.sales, YEARS, BOX),
        prices("", "median_per_m2", f"WHERE {IN_YEARS} AND {IN_BOX}"),
    ),
    "summary_stats_specs": (
        lambda t: market.summary_stats(t.sales, EVERYTHING),
        prices("", "median_per_m2", f"WHERE {EVERYTHING_SQL}"),
    ),
    "count_sales": (
        lambda t: market.count_sales(t.sales, YEARS, BOX),
        on_sales(f"SELECT COUNT(*) AS n FROM sales WHERE {IN_YEARS} AND {IN_BOX}"),
    ),
    "sales_page": (
        lambda t: flat(lookup.sales_page(t.sales, YEARS, page=3)),
        on_sales(
            f"SELECT {SALE_COLUMNS} FROM sales WHERE {IN_YEARS} "
            "ORDER BY sale_date DESC, id_mutation LIMIT 10 OFFSET 30"
        ),
    ),
    "sales_page_after": (
        lambda t: flat(lookup.sales_after(t.sales, YEARS, date(2000, 6, 1), "2000-1")),
        on_sales(
            f"SELECT {SALE_COLUMNS} FROM sales WHERE {IN_YEARS} AND (sale_date < DATE '2000-06-01' "
            "OR sale_date = DATE '2000-06-01' AND id_mutation > '2000-1') "
            "ORDER BY sale_date DESC, id_mutation LIMIT 10"
        ),
    ),
    "page_total": (
        lambda t: lookup.page_total(lookup.sales_page(t.sales, EVERYTHING, page=5), page=5),
        on_sales(
            f""", page AS (SELECT id_mutation FROM sales WHERE {EVERYTHING_SQL}
              ORDER BY sale_date DESC, id_mutation LIMIT 10 OFFSET 50)
            SELECT CASE WHEN COUNT(*) < 10 THEN COUNT(*) + 50 END AS total FROM page"""
        ),
    ),
    **{
        f"trend_{g}": (
            lambda t, g=g: long_trend(t, g),
            trend_sql(BUCKETS[g], NO_SPLIT, IN_YEARS),
        )
        for g in BUCKETS
    },
    "trend_bbox": (
        lambda t: long_trend(t, "month", bbox=BOX),
        trend_sql(BUCKETS["month"], NO_SPLIT, f"{IN_YEARS} AND {IN_BOX}"),
    ),
    "trend_by_type": (
        lambda t: long_trend(t, "month", "type"),
        trend_sql(BUCKETS["month"], "primary_type", IN_YEARS),
    ),
    "trend_by_houses": (
        lambda t: long_trend(t, "year", "n_houses"),
        trend_sql(
            BUCKETS["year"],
            "CAST(n_maisons AS VARCHAR)",
            f"{IN_YEARS} AND n_maisons BETWEEN 1 AND 5",
        ),
    ),
    "trend_wide": (
        lambda t: market.trend_wide(long_trend(t, "year", "type"), "type"),
        wide_sql("primary_type", ["Maison", "Appartement", "Mixed"], IN_YEARS),
    ),
    "trend_wide_houses": (
        lambda t: market.trend_wide(long_trend(t, "year", "n_houses"), "n_houses"),
        wide_sql(
            "CAST(n_maisons AS VARCHAR)",
            ["1", "2", "3", "4", "5"],
            f"{IN_YEARS} AND n_maisons BETWEEN 1 AND 5",
        ),
    ),
    "trend_total": (
        lambda t: market.trend_total(t.sales, YEARS, split="type"),
        on_sales(f"SELECT COUNT(*) AS total_sales FROM sales WHERE {IN_YEARS}"),
    ),
    "map_points": (
        lambda t: boxed_points(t).drop("buildings"),
        on_sales(f"SELECT {POINTS}, COUNT(*) OVER () = {POINT_CAP} AS capped FROM ({NEWEST_SQL})"),
    ),
    "choropleth_department": (departments, on_sales(REGIONS_SQL)),
    "choropleth_commune": (
        lambda t: maps.choropleth_commune(t.sales, YEARS),
        on_sales(COMMUNES_SQL),
    ),
    "map_mode_department": (
        lambda t: maps.map_view(t.sales, YEARS, zoom=6),
        on_sales(REGIONS_SQL),
    ),
    "map_mode_commune": (
        lambda t: maps.map_view(t.sales, YEARS, zoom=8),
        on_sales(COMMUNES_SQL),
    ),
    "map_mode_points": (
        lambda t: maps.map_view(t.sales, YEARS, zoom=12, bbox=BOX, cap=POINT_CAP).select(
            *maps.POINT_COLUMNS
        ),
        on_sales(f"SELECT {POINTS} FROM ({NEWEST_SQL})"),
    ),
    "price_rank_bounds": (
        lambda t: maps.price_rank_bounds(boxed_points(t), "price_eur"),
        on_sales(
            f", shown AS (SELECT price_eur AS price FROM ({NEWEST_SQL})), {BOUNDS_SQL} "
            "SELECT * FROM bounds"
        ),
    ),
    "price_rank_bounds_regions": (
        lambda t: maps.price_rank_bounds(departments(t), "median_price"),
        on_sales(
            f", shown AS (SELECT median_price AS price FROM ({REGIONS_SQL})), {BOUNDS_SQL} "
            "SELECT * FROM bounds"
        ),
    ),
    "price_scale": (
        lambda t: maps.price_scale(boxed_points(t), "price_eur").select(
            "id_mutation", "price_eur", "p5", "p95", "t", "hue"
        ),
        on_sales(
            f""", shown AS (SELECT *, price_eur AS price FROM ({NEWEST_SQL})), {BOUNDS_SQL}
            SELECT id_mutation, price_eur, p5, p95, {T_SQL} AS t,
              CAST(ROUND(120 * (1 - {T_SQL})) AS INT) AS hue FROM shown, bounds"""
        ),
    ),
    "legend_stops": (
        lambda t: maps.legend_stops(maps.price_rank_bounds(departments(t), "median_price")),
        on_sales(
            f""", shown AS (SELECT median_price AS price FROM ({REGIONS_SQL})), {BOUNDS_SQL}
            SELECT t, ROUND(p5 + t * (p95 - p5)) AS price FROM bounds,
              (SELECT UNNEST([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS t)"""
        ),
    ),
    "points_extent": (
        lambda t: maps.points_extent(boxed_points(t)),
        on_sales(
            "SELECT MIN(latitude) AS lat_min, MAX(latitude) AS lat_max, "
            f"MIN(longitude) AS lon_min, MAX(longitude) AS lon_max FROM ({NEWEST_SQL})"
        ),
    ),
    "choropleth_boundaries": (
        lambda t: maps.choropleth_boundaries(
            io.read_boundaries(t.spark, t.boundaries_path), departments(t)
        ).drop("geometry"),
        on_sales(
            f""", regions AS ({REGIONS_SQL}),
            shown AS (SELECT *, median_price AS price FROM regions), {BOUNDS_SQL}
            SELECT code, n_name AS nom, n_sales, median_price, median_per_m2,
              CAST(ROUND(120 * (1 - {T_SQL})) AS INT) AS hue, FALSE AS grey
            FROM shown JOIN nation ON lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') = code, bounds"""
        ),
    ),
}

ALL: dict[str, tuple[Query, str | None]] = {
    **SOURCES,
    **FILTERS,
    **DERIVATION,
    **REPORTS,
    **STUDIES,
    **DASHBOARD,
}
