"""Shared parts of the SQL that checks the queries on another engine."""

from __future__ import annotations

from parcella.plans.fixtures import raw_rows_oracle

_SALES = """
sales AS (
  SELECT f.*,
         COALESCE(b.n_maisons, 0) AS n_maisons,
         COALESCE(b.n_appartements, 0) AS n_appartements,
         b.built_area_m2, b.rooms_total, b.rooms_min, b.rooms_max, b.buildings,
         CASE WHEN b.n_maisons > 0 AND b.n_appartements > 0 THEN 'Mixed'
              WHEN b.n_maisons > 0 THEN 'Maison' ELSE 'Appartement' END AS primary_type,
         CASE WHEN b.n_maisons > 0 AND b.n_appartements > 0
                THEN b.n_maisons || 'M+' || b.n_appartements || 'A'
              WHEN b.n_maisons > 0 THEN b.n_maisons || 'M'
              ELSE b.n_appartements || 'A' END AS composition,
         CASE WHEN b.built_area_m2 > 10 AND f.price_eur > 0
              THEN f.price_eur / b.built_area_m2 END AS price_per_m2
  FROM sale_totals f JOIN building_totals b USING (id_mutation)
  WHERE f.n_rows <= 10 AND f.price_eur >= 1000 AND f.n_communes = 1
    AND f.transaction_type = 'Vente'
)"""

_BUILDING_TOTALS = """
distinct_buildings AS (
  SELECT DISTINCT id_mutation, type_local, surface_reelle_bati, nombre_pieces_principales
  FROM raw_rows
  WHERE type_local IN ('Maison', 'Appartement') AND surface_reelle_bati > 0
),
building_totals AS (
  SELECT id_mutation,
         CAST(COUNT(*) FILTER (WHERE type_local = 'Maison') AS INT) AS n_maisons,
         CAST(COUNT(*) FILTER (WHERE type_local = 'Appartement') AS INT) AS n_appartements,
         SUM(surface_reelle_bati) AS built_area_m2,
         CAST(SUM(nombre_pieces_principales) AS INT) AS rooms_total,
         MIN(nombre_pieces_principales) AS rooms_min,
         MAX(nombre_pieces_principales) AS rooms_max,
         LIST({'type': type_local, 'area_m2': CAST(surface_reelle_bati AS INT),
               'rooms': nombre_pieces_principales}
              ORDER BY type_local, surface_reelle_bati DESC,
                       nombre_pieces_principales NULLS FIRST) AS buildings
  FROM distinct_buildings GROUP BY id_mutation
)"""

_SALE_TOTALS = """
located AS (
  SELECT id_mutation, point.latitude AS latitude, point.longitude AS longitude FROM (
    SELECT id_mutation, COALESCE(
      MIN({'latitude': latitude, 'longitude': longitude}) FILTER (WHERE type_local = 'Maison'),
      MIN({'latitude': latitude, 'longitude': longitude}) FILTER (WHERE type_local = 'Appartement'),
      MIN({'latitude': latitude, 'longitude': longitude})) AS point
    FROM raw_rows WHERE latitude IS NOT NULL AND longitude IS NOT NULL
    GROUP BY id_mutation)
),
sale_totals AS (
  SELECT g.*, p.latitude, p.longitude FROM (
    SELECT id_mutation,
           MIN(date_mutation) AS sale_date, MIN(year) AS year, MIN(valeur_fonciere) AS price_eur,
           MIN(nature_mutation) AS transaction_type, MIN(code_departement) AS department_code,
           MIN(code_commune) AS commune_code, MIN(nom_commune) AS commune_name,
           MIN(code_postal) AS postal_code,
           COUNT(*) AS n_rows, COUNT(DISTINCT code_commune) AS n_communes,
           CAST(SUM(CAST(type_local = 'Maison' AS INT)) AS INT) AS n_maison_rows,
           CAST(SUM(CAST(type_local = 'Appartement' AS INT)) AS INT) AS n_appartement_rows,
           CAST(SUM(CAST(type_local = 'Dépendance' AS INT)) AS INT) AS n_dependances,
           CAST(SUM(CAST(type_local = 'Local industriel. commercial ou assimilé' AS INT)) AS INT)
             AS n_commercial,
           CAST(SUM(CAST(type_local IS NULL AS INT)) AS INT) AS n_parcel_rows,
           SUM(surface_terrain) AS land_area_m2
    FROM raw_rows GROUP BY id_mutation) g
  LEFT JOIN located p USING (id_mutation)
)"""


def on_raw(sql: str) -> str:
    """A statement over ``raw_rows``; may start with ``, name AS (...)``."""
    return f"WITH raw_rows AS ({raw_rows_oracle()}) {sql}"


def on_totals(sql: str) -> str:
    """A statement that also uses per-sale and per-building totals."""
    return on_raw(f", {_BUILDING_TOTALS}, {_SALE_TOTALS} {sql}")


def on_sales(sql: str) -> str:
    """A statement over the derived ``sales`` (and ``raw_rows``)."""
    return on_totals(f", {_SALES} {sql}")
