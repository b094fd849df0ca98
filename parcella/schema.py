"""Column names, types and fixed domain values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The column layout of the public yearly transaction files.
# Codes stay strings so that leading zeros survive; measures are doubles even
# when the first rows look like integers.
# ---------------------------------------------------------------------------
_RAW_FIELDS: list[tuple[str, T.DataType]] = [
    ("id_mutation", T.StringType()),
    ("date_mutation", T.DateType()),
    ("numero_disposition", T.StringType()),
    ("nature_mutation", T.StringType()),
    ("valeur_fonciere", T.DoubleType()),
    ("adresse_numero", T.StringType()),
    ("adresse_suffixe", T.StringType()),
    ("adresse_nom_voie", T.StringType()),
    ("adresse_code_voie", T.StringType()),
    ("code_postal", T.StringType()),
    ("code_commune", T.StringType()),
    ("nom_commune", T.StringType()),
    ("code_departement", T.StringType()),
    ("ancien_code_commune", T.StringType()),
    ("ancien_nom_commune", T.StringType()),
    ("id_parcelle", T.StringType()),
    ("ancien_id_parcelle", T.StringType()),
    ("numero_volume", T.StringType()),
    ("lot1_numero", T.StringType()),
    ("lot1_surface_carrez", T.DoubleType()),
    ("lot2_numero", T.StringType()),
    ("lot2_surface_carrez", T.DoubleType()),
    ("lot3_numero", T.StringType()),
    ("lot3_surface_carrez", T.DoubleType()),
    ("lot4_numero", T.StringType()),
    ("lot4_surface_carrez", T.DoubleType()),
    ("lot5_numero", T.StringType()),
    ("lot5_surface_carrez", T.DoubleType()),
    ("nombre_lots", T.IntegerType()),
    ("code_type_local", T.StringType()),
    ("type_local", T.StringType()),
    ("surface_reelle_bati", T.DoubleType()),
    ("nombre_pieces_principales", T.IntegerType()),
    ("code_nature_culture", T.StringType()),
    ("nature_culture", T.StringType()),
    ("code_nature_culture_speciale", T.StringType()),
    ("nature_culture_speciale", T.StringType()),
    ("surface_terrain", T.DoubleType()),
    ("longitude", T.DoubleType()),
    ("latitude", T.DoubleType()),
]

RAW_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in _RAW_FIELDS])

BUILDING_TYPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("area_m2", T.IntegerType()),
        T.StructField("rooms", T.IntegerType()),
    ]
)

SALES_SCHEMA = T.StructType(
    [
        T.StructField("id_mutation", T.StringType()),
        T.StructField("sale_date", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("price_eur", T.DoubleType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("department_code", T.StringType()),
        T.StructField("commune_code", T.StringType()),
        T.StructField("commune_name", T.StringType()),
        T.StructField("postal_code", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_communes", T.LongType()),
        T.StructField("n_maisons", T.IntegerType()),
        T.StructField("n_appartements", T.IntegerType()),
        T.StructField("n_maison_rows", T.IntegerType()),
        T.StructField("n_appartement_rows", T.IntegerType()),
        T.StructField("n_dependances", T.IntegerType()),
        T.StructField("n_commercial", T.IntegerType()),
        T.StructField("n_parcel_rows", T.IntegerType()),
        T.StructField("built_area_m2", T.DoubleType()),
        T.StructField("rooms_total", T.IntegerType()),
        T.StructField("rooms_min", T.IntegerType()),
        T.StructField("rooms_max", T.IntegerType()),
        T.StructField("buildings", T.ArrayType(BUILDING_TYPE)),
        T.StructField("land_area_m2", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("primary_type", T.StringType()),
        T.StructField("composition", T.StringType()),
        T.StructField("price_per_m2", T.DoubleType()),
    ]
)

# ---------------------------------------------------------------------------
# Categories of the source data.
# ---------------------------------------------------------------------------
HOUSE = "Maison"
APARTMENT = "Appartement"
ANNEX = "Dépendance"
COMMERCIAL = "Local industriel. commercial ou assimilé"
MIXED = "Mixed"
PLAIN_SALE = "Vente"

# English labels of the category values.
VALUE_LABELS = {
    "Vente": "Sale",
    "Vente en l'état futur d'achèvement": "Off-plan sale (VEFA, pre-construction)",
    "Echange": "Exchange / swap",
    "Vente terrain à bâtir": "Sale of building land",
    "Adjudication": "Auction",
    "Expropriation": "Expropriation (eminent domain)",
    "Maison": "House",
    "Appartement": "Apartment",
    "Dépendance": "Outbuilding / annex",
    "Local industriel. commercial ou assimilé": "Commercial / industrial premises",
}

# Thresholds of the residential policy and of the reports.
MAX_ROWS_PER_SALE = 10
MIN_PRICE = 1000
MIN_BUILT_AREA = 10
PPM2_RANGE = (100, 30000)
TRIMMED_PRICE_RANGE = (20_000, 20_000_000)
SINGLE_HOUSE_PRICE_RANGE = (1_000, 20_000_000)
DEFAULT_YEARS = (2021, 2025)
MAX_HOUSES_CATEGORY = 5
SPLIT_CATEGORIES = {
    "type": [HOUSE, APARTMENT, MIXED],
    "n_houses": ["1", "2", "3", "4", "5"],
}
URBAN_DEPARTMENTS = ["75", "92", "93", "94", "69", "13", "31", "33", "59", "67", "06"]
GAP_DEPARTMENTS = ["75", "23", "33", "13"]
CATEGORICAL_COLUMNS = [
    "nature_mutation",
    "type_local",
    "code_type_local",
    "ancien_nom_commune",
    "ancien_code_commune",
    "ancien_id_parcelle",
    "year",
]
PAGE_SIZE = 10
BROWSE_SIZE = 50
MAP_POINT_CAP = 5_000
ZOOM_DEPARTMENT = 8
ZOOM_COMMUNE = 12
