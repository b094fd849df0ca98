"""Hand-made raw rows and sales."""

from __future__ import annotations

import datetime

from pyspark.sql import types as T

from parcella import schema as S

DAY = datetime.date(2021, 5, 3)
RAW = T.StructType([*S.RAW_SCHEMA.fields, T.StructField("year", T.IntegerType())])

_RAW_DEFAULTS = {
    "date_mutation": DAY,
    "year": 2021,
    "nature_mutation": "Vente",
    "valeur_fonciere": 200_000.0,
    "code_departement": "01",
    "code_commune": "01004",
    "nom_commune": "Ville",
    "code_postal": "01500",
}


def raw(spark, *rows: dict):
    names = RAW.fieldNames()
    data = [tuple({**_RAW_DEFAULTS, **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, RAW)


def house(sale: str, area: float | None, rooms: int | None, **more) -> dict:
    return {
        "id_mutation": sale,
        "type_local": "Maison",
        "surface_reelle_bati": area,
        "nombre_pieces_principales": rooms,
        **more,
    }


def flat(sale: str, area: float | None, rooms: int | None, **more) -> dict:
    return {**house(sale, area, rooms, **more), "type_local": "Appartement"}


def parcel(sale: str, **more) -> dict:
    return {"id_mutation": sale, **more}


_SALE_DEFAULTS = {
    "sale_date": DAY,
    "year": 2021,
    "price_eur": 200_000.0,
    "department_code": "01",
    "commune_code": "01004",
    "commune_name": "Ville",
    "n_maisons": 1,
    "n_appartements": 0,
    "built_area_m2": 100.0,
    "price_per_m2": 2_000.0,
    "primary_type": "Maison",
    "composition": "1M",
    "buildings": [("Maison", 100, 4)],
}


def sales(spark, *rows: dict):
    names = S.SALES_SCHEMA.fieldNames()
    data = [
        tuple({"id_mutation": f"s{i:03}", **_SALE_DEFAULTS, **r}.get(n) for n in names)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, S.SALES_SCHEMA)
