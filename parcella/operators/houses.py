"""Sales of several houses: the two-house question and the multi-house study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcella import schema as S
from parcella.functions import columns as C
from parcella.operators import summaries as Q
from parcella.operators.bulk import without_bulk
from parcella.operators.policy import sample_order
from parcella.operators.quality import only_ids
from parcella.sources.tables import materialise


def _rounded_summary(df: DataFrame, keys: list[str], counts: dict, rounded: dict) -> DataFrame:
    return Q.summarise(df, keys, {**counts, **rounded}).withColumns(
        {name: F.round(name) for name in rounded}
    )


# -- the two-house question (raw rows) --------------------------------------


def two_house_sales(rows: DataFrame, min_rooms: int = 5) -> DataFrame:
    """Plain sales with exactly two house rows of at least ``min_rooms`` rooms.

    House figures and sale facts come from one aggregation of constant size
    per sale; nothing is joined.
    """
    house = C.is_house()
    rooms = F.when(house, F.col("nombre_pieces_principales"))
    return (
        rows.groupBy("id_mutation")
        .agg(
            F.count_if(house).alias("n_maisons"),
            F.min(rooms).alias("min_pieces"),
            F.max(rooms).alias("max_pieces"),
            F.sum(F.when(house, F.col("surface_reelle_bati"))).alias("total_bati"),
            C.any_of("year").alias("year"),
            C.any_of("valeur_fonciere").alias("price"),
            C.any_is("nature_mutation", S.PLAIN_SALE).alias("plain"),
            C.any_of("nom_commune").alias("commune"),
            C.any_of("code_departement").alias("dept"),
        )
        .where(
            (F.col("n_maisons") == 2)
            & (F.col("min_pieces") >= min_rooms)
            & F.col("plain")
            & F.col("price").isNotNull()
        )
        .drop("plain")
        .withColumn("nature", F.lit(S.PLAIN_SALE))
    )


def two_house_by_year(qualifying: DataFrame) -> DataFrame:
    """Price of the qualifying sales by year: the flagship question.

    Reads its input more than once; pass a stored table (see ``materialise``).
    """
    return _rounded_summary(
        qualifying,
        ["year"],
        {"n_sales": Q.count()},
        {
            "avg_price_eur": Q.mean("price"),
            "median_price_eur": Q.median("price"),
            "min_price_eur": Q.smallest("price"),
            "max_price_eur": Q.largest("price"),
        },
    ).orderBy("year")


def two_house_trimmed(qualifying: DataFrame) -> DataFrame:
    """The same without implausible prices."""
    kept = qualifying.where(F.col("price").between(*S.TRIMMED_PRICE_RANGE))
    return _rounded_summary(
        kept,
        ["year"],
        {"n_sales": Q.count()},
        {"avg_price_eur": Q.mean("price"), "median_price_eur": Q.median("price")},
    ).orderBy("year")


def two_house_extremes(rows: DataFrame, dearest: bool, limit: int = 10) -> DataFrame:
    """The dearest or cheapest qualifying sales of the raw rows.

    Ranked on numbers alone; the details are then read for the winners.
    """
    order = [F.desc("price") if dearest else F.asc("price"), F.col("id_mutation")]
    top = two_house_sales(rows).select("id_mutation", "price").orderBy(*order).limit(limit)
    return (
        two_house_sales(only_ids(rows, top))
        .orderBy(*order)
        .limit(limit)
        .select(
            "id_mutation",
            "year",
            "commune",
            "dept",
            F.round("price").alias("price"),
            "min_pieces",
            "max_pieces",
            "total_bati",
        )
    )


# -- reports on the derived sales -------------------------------------------


def sales_by_year(sales: DataFrame) -> DataFrame:
    kinds = {"maison_only": S.HOUSE, "appt_only": S.APARTMENT, "mixed": S.MIXED}
    flagged = sales.withColumns(
        {name: F.col("primary_type") == kind for name, kind in kinds.items()}
    )
    return _rounded_summary(
        flagged,
        ["year"],
        {"sales": Q.count(), **{name: Q.count(name) for name in kinds}},
        {"median_price": Q.median("price_eur"), "median_eur_per_m2": Q.median("price_per_m2")},
    ).orderBy("year")


def _houses_only(sales: DataFrame, low: int, high: int, min_area: bool = True) -> DataFrame:
    """Sales of ``low``..``high`` houses and no apartment."""
    kept = F.col("n_maisons").between(low, high) & (F.col("n_appartements") == 0)
    if min_area:
        kept &= F.col("built_area_m2") > S.MIN_BUILT_AREA
    return sales.where(kept)


def _plausible() -> Column:
    return F.col("price_per_m2").between(*S.PPM2_RANGE)


def _per_house(sales: DataFrame) -> DataFrame:
    houses = F.nullif(F.col("n_maisons"), F.lit(0))
    return sales.withColumns(
        {
            "m2_per_house": F.col("built_area_m2") / houses,
            "price_per_house": F.col("price_eur") / houses,
        }
    )


def ppm2_by_houses(sales: DataFrame) -> DataFrame:
    kept = _per_house(_houses_only(sales, 1, 5, min_area=False).where(_plausible()))
    return _rounded_summary(
        kept,
        ["n_maisons"],
        {"n_sales": Q.count()},
        {
            "med_price": Q.median("price_eur"),
            "med_built_m2": Q.median("built_area_m2"),
            "med_eur_per_m2": Q.median("price_per_m2"),
            "med_m2_per_house": Q.median("m2_per_house"),
        },
    ).orderBy("n_maisons")


def top_compositions(sales: DataFrame, limit: int = 15) -> DataFrame:
    return (
        _rounded_summary(
            sales,
            ["composition"],
            {"n_sales": Q.count()},
            {"med_price": Q.median("price_eur"), "med_eur_per_m2": Q.median("price_per_m2")},
        )
        .orderBy(F.desc("n_sales"), "composition")
        .limit(limit)
    )


def dedup_impact(sales: DataFrame, max_rows: int = 5) -> DataFrame:
    """Raw house rows against distinct houses."""
    return (
        sales.where(F.col("n_maison_rows").between(1, max_rows))
        .groupBy(F.col("n_maison_rows").alias("raw_rows"), F.col("n_maisons").alias("deduped"))
        .agg(F.count("*").alias("n_sales"))
        .orderBy("raw_rows", "deduped")
    )


def houses_profile(sales: DataFrame) -> DataFrame:
    kept = _per_house(_houses_only(sales, 1, 5).where(_plausible()))
    return _rounded_summary(
        kept,
        ["n_maisons"],
        {"n_sales": Q.count()},
        {
            "med_price": Q.median("price_eur"),
            "med_built_area_m2": Q.median("built_area_m2"),
            "med_price_per_m2": Q.median("price_per_m2"),
            "med_m2_per_house": Q.median("m2_per_house"),
            "med_price_per_house": Q.median("price_per_house"),
        },
    ).orderBy("n_maisons")


_DECILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def area_percentiles(sales: DataFrame) -> DataFrame:
    return _rounded_summary(
        _houses_only(sales, 1, 3),
        ["n_maisons"],
        {"n_sales": Q.count()},
        {name: Q.quantile("built_area_m2", p) for name, p in _DECILES.items()},
    ).drop("n_sales").orderBy("n_maisons")


def raw_area_percentiles(rows: DataFrame, sales: DataFrame) -> DataFrame:
    """Areas on the raw house rows of sales of one or two houses.

    Sales never have more than ten rows, so hot ids leave before the join.
    """
    target = _houses_only(sales, 1, 2).select("id_mutation", "n_maisons")
    houses = without_bulk(
        rows.where(C.is_house() & (F.col("surface_reelle_bati") > 0)).select(
            "id_mutation", "surface_reelle_bati"
        )
    )
    return _rounded_summary(
        materialise(houses.join(target, "id_mutation").drop("id_mutation"), "raw-areas"),
        ["n_maisons"],
        {"n_building_rows": Q.count()},
        {f"{n}_bati": Q.quantile("surface_reelle_bati", p) for n, p in _DECILES.items()},
    ).orderBy("n_maisons")


def department_two_house_share(
    sales: DataFrame,
    min_sales: int = 500,
    urban: list[str] = S.URBAN_DEPARTMENTS,
    limit: int = 15,
    min_area: bool = True,
) -> DataFrame:
    """Departments with the largest share of two-house sales."""
    one, two = F.col("n_1house"), F.col("n_2house")
    return (
        _houses_only(sales, 1, 2, min_area)
        .groupBy("department_code")
        .agg(
            F.count_if(F.col("n_maisons") == 1).alias("n_1house"),
            F.count_if(F.col("n_maisons") == 2).alias("n_2house"),
        )
        .where(one + two > min_sales)
        .withColumn("pct_2house", F.round(F.lit(100.0) * two / (one + two), 1))
        .withColumn(
            "urban_rural_proxy",
            F.when(F.col("department_code").isin(urban), "urban").otherwise("rural"),
        )
        .orderBy(F.desc("pct_2house"), "department_code")
        .limit(limit)
    )


def department_ppm2_gap(
    sales: DataFrame, departments: list[str] = S.GAP_DEPARTMENTS, min_area: bool = True
) -> DataFrame:
    """Price per m² of one- and two-house sales inside single departments."""
    kept = _houses_only(sales, 1, 2, min_area).where(
        F.col("department_code").isin(departments) & _plausible()
    )
    return _rounded_summary(
        kept,
        ["department_code", "n_maisons"],
        {"n": Q.count()},
        {
            "med_price": Q.median("price_eur"),
            "med_built_m2": Q.median("built_area_m2"),
            "med_eur_per_m2": Q.median("price_per_m2"),
        },
    ).orderBy("department_code", "n_maisons")


def giant_houses(
    rows: DataFrame, sales: DataFrame, min_area: float = 500, limit: int = 15
) -> DataFrame:
    """Largest raw house rows among sales of two houses.

    Only rows above the threshold take part in the join, without hot ids.
    """
    two = _houses_only(sales, 2, 2).select("id_mutation")
    large = without_bulk(
        rows.where(C.is_house() & (F.col("surface_reelle_bati") > min_area)).select(
            "id_mutation",
            "type_local",
            "surface_reelle_bati",
            F.col("nombre_pieces_principales").alias("pieces"),
            "valeur_fonciere",
            "nom_commune",
            "code_departement",
        )
    )
    return (
        large.join(two, "id_mutation", "left_semi")
        .orderBy(
            F.desc("surface_reelle_bati"),
            "id_mutation",
            F.desc_nulls_last("pieces"),
            F.desc_nulls_last("valeur_fonciere"),
        )
        .limit(limit)
    )


def sampled_sale_rows(
    rows: DataFrame, sales: DataFrame, size: int = 10, seed: int = 1
) -> DataFrame:
    """All raw rows of a stable random sample of mid-priced two-house sales."""
    chosen = (
        _houses_only(sales, 2, 2)
        .where(F.col("price_eur").between(100_000, 400_000) & (F.col("rooms_min") >= 3))
        .orderBy(sample_order(seed), "id_mutation")
        .limit(size)
    )
    return (
        only_ids(rows, chosen)
        .select(
            "id_mutation",
            "type_local",
            "surface_reelle_bati",
            F.col("nombre_pieces_principales").alias("pieces"),
            "nature_culture",
            "surface_terrain",
            F.col("code_departement").alias("dept"),
            F.col("nom_commune").alias("commune"),
            F.col("valeur_fonciere").alias("price_total"),
            "latitude",
            "longitude",
        )
        .orderBy("id_mutation", F.asc_nulls_last("type_local"))
    )


# -- the double-counting study ----------------------------------------------


def raw_house_symptom(rows: DataFrame) -> DataFrame:
    """Price and built area by the number of raw house rows."""
    house = C.is_house()
    per_sale = (
        rows.groupBy("id_mutation")
        .agg(
            F.count_if(house).alias("n_maisons_raw"),
            C.any_of("valeur_fonciere").alias("price"),
            F.sum(F.when(house, F.col("surface_reelle_bati"))).alias("built"),
        )
        .where(F.col("n_maisons_raw").between(1, 5))
        .drop("id_mutation")
    )
    return _rounded_summary(
        materialise(per_sale, "raw-houses"),
        ["n_maisons_raw"],
        {"n_sales": Q.count()},
        {"med_price": Q.median("price"), "med_built_area": Q.median("built")},
    ).orderBy("n_maisons_raw")


def same_surface_share(rows: DataFrame) -> DataFrame:
    """Share of sales with two house rows where both have the same area."""
    two = (
        rows.where(C.is_house())
        .groupBy("id_mutation")
        .agg(
            F.count("*").alias("n"),
            F.min("surface_reelle_bati").alias("low"),
            F.max("surface_reelle_bati").alias("high"),
        )
        .where(F.col("n") == 2)
    )
    same = C.count_where(F.col("low") == F.col("high"))
    return two.agg(
        F.count("*").alias("total_2row_sales"),
        same.alias("same_surface"),
        F.round(F.try_divide(F.lit(100.0) * same, F.count("*")), 1).alias("pct_same"),
    )


def dedup_examples(rows: DataFrame, sales: DataFrame, limit: int = 10) -> DataFrame:
    """Raw rows of sales where two house rows turned out to be one house."""
    chosen = (
        sales.where(
            (F.col("n_maison_rows") == 2)
            & (F.col("n_maisons") == 1)
            & F.col("price_eur").between(100_000, 350_000)
        )
        .orderBy("id_mutation")
        .limit(limit)
    )
    return (
        only_ids(rows, chosen)
        .select(
            "id_mutation",
            "type_local",
            F.col("surface_reelle_bati").alias("bati_m2"),
            F.col("nombre_pieces_principales").alias("pieces"),
            "nature_culture",
            "surface_terrain",
            "valeur_fonciere",
            "nom_commune",
        )
        .orderBy("id_mutation", F.asc_nulls_last("type_local"))
    )


def corrected_ppm2_by_year(sales: DataFrame) -> DataFrame:
    return _rounded_summary(
        sales.where(_plausible()),
        ["year"],
        {"n_sales": Q.count()},
        {"med_eur_per_m2": Q.median("price_per_m2")},
    ).drop("n_sales").orderBy("year")
