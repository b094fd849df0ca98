"""Which sales a residential filter keeps, and what it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcella import schema as S
from parcella.functions import columns as C
from parcella.operators import summaries as Q
from parcella.operators.quality import only_ids
from parcella.sources.tables import materialise


def _facts() -> list[Column]:
    """Constant-size facts of a sale that all policy reports share."""
    return [
        C.any_of("date_mutation").alias("date"),
        C.any_of("year").alias("year"),
        C.any_of("valeur_fonciere").alias("price"),
        C.any_of("nature_mutation").alias("nature"),
        C.any_of("code_departement").alias("dept"),
        C.any_of("nom_commune").alias("commune"),
        F.count("*").alias("n_rows"),
    ]


def flagged_sales(rows: DataFrame) -> DataFrame:
    """One row per sale with what the policy looks at, nothing filtered."""
    return rows.groupBy("id_mutation").agg(
        *_facts(), F.count_distinct("code_commune").alias("n_communes")
    )


def _loose() -> Column:
    """Neither bulk nor symbolic."""
    return (F.col("n_rows") <= S.MAX_ROWS_PER_SALE) & (F.col("price") >= S.MIN_PRICE)


def filter_impact(rows: DataFrame) -> DataFrame:
    """Sales each rule drops on its own, and what the combinations keep.

    Whether a sale spans communes follows from its smallest and largest code,
    so no distinct aggregation is needed.
    """
    sales = rows.groupBy("id_mutation").agg(
        *_facts(),
        F.min("code_commune").alias("first_commune"),
        F.max("code_commune").alias("last_commune"),
    )
    one_commune = F.coalesce(F.col("first_commune") == F.col("last_commune"), F.lit(False))
    several = F.coalesce(F.col("first_commune") < F.col("last_commune"), F.lit(False))
    plain = F.col("nature") == S.PLAIN_SALE
    return sales.agg(
        F.count("*").alias("all_sales"),
        C.count_where(F.col("n_rows") > S.MAX_ROWS_PER_SALE).alias("drop_bulk"),
        C.count_where((F.col("price") < S.MIN_PRICE) | F.col("price").isNull()).alias(
            "drop_symbolic"
        ),
        C.count_where(several).alias("drop_multi_commune"),
        C.count_where(~plain).alias("drop_not_plain"),
        C.count_where(_loose() & one_commune & plain).alias("keep_strict"),
        C.count_where(_loose()).alias("keep_loose"),
    )


def _row_types_of(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Rows by type of the sales whose number of rows is within bounds.

    Rows shrink to one per (sale, type) before anything is brought together by
    sale, which replaces a join of all rows with the selected sales.
    """
    of_sale = Window.partitionBy("id_mutation")
    return (
        rows.groupBy("id_mutation", "type_local")
        .agg(F.count("*").alias("n"))
        .withColumn("n_rows", F.sum("n").over(of_sale))
        .where(F.col("n_rows").between(low, high))
        .groupBy("type_local")
        .agg(F.sum("n").alias("rows"))
        .orderBy(F.desc("rows"), F.asc_nulls_last("type_local"))
    )


def _labelled(types: DataFrame, label: str | None) -> DataFrame:
    if label is None:
        return types
    return types.withColumn("type_local", F.coalesce("type_local", F.lit(label)))


def borderline_types(rows: DataFrame, null_label: str | None = None) -> DataFrame:
    """Row types of sales just above the bulk threshold."""
    return _labelled(_row_types_of(rows, 11, 15), null_label)


def kept_types(rows: DataFrame, null_label: str | None = None) -> DataFrame:
    """Row types of sales just below the bulk threshold."""
    return _labelled(_row_types_of(rows, 6, 10), null_label)


def policy_before_after(rows: DataFrame) -> DataFrame:
    """The two-house question by year, without and with the loose filter."""
    house = C.is_house()
    sales = (
        rows.groupBy("id_mutation")
        .agg(
            C.any_of("year").alias("year"),
            C.any_of("valeur_fonciere").alias("price"),
            C.any_is("nature_mutation", S.PLAIN_SALE).alias("plain"),
            F.count("*").alias("n_rows"),
            F.count_if(house).alias("n_houses"),
            C.any_of("nombre_pieces_principales", house).alias("min_rooms"),
        )
        .where(
            (F.col("n_houses") == 2)
            & (F.col("min_rooms") >= 5)
            & F.col("plain")
        )
        .withColumn("kept", _loose())
        .withColumn("kept_price", F.when(F.col("kept"), F.col("price")))
    )
    rounded = {
        "avg_before": Q.mean("price"),
        "avg_after": Q.mean("kept_price"),
        "median_before": Q.median("price"),
        "median_after": Q.median("kept_price"),
    }
    return (
        Q.summarise(
            materialise(sales.select("year", "price", "kept", "kept_price"), "two-house-policy"),
            ["year"],
            {"before_filter": Q.count(), "after_filter": Q.count("kept"), **rounded},
        )
        .withColumns({name: F.round(name) for name in rounded})
        .orderBy("year")
    )


def _top_details(rows: DataFrame, top: DataFrame, columns: list[str], limit: int, *order) -> DataFrame:
    return (
        only_ids(rows, top)
        .groupBy("id_mutation")
        .agg(*_facts(), F.count_distinct("code_commune").alias("n_communes"))
        .orderBy(*order)
        .limit(limit)
        .withColumn("price", F.round("price"))
        .select(*columns)
    )


def biggest_after_policy(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Dearest sales the loose filter leaves; numeric ranking, then details."""
    order = [F.desc("price"), F.col("id_mutation")]
    top = (
        rows.groupBy("id_mutation")
        .agg(C.any_of("valeur_fonciere").alias("price"), F.count("*").alias("n_rows"))
        .where(_loose())
        .orderBy(*order)
        .limit(limit)
    )
    columns = ["id_mutation", "date", "price", "nature", "n_rows", "commune", "dept"]
    return _top_details(rows, top, columns, limit, *order)


def sample_order(seed: int) -> Column:
    """Sort key that makes a seeded sample independent of partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("id_mutation")))


def sample_dropped(rows: DataFrame, size: int = 10, seed: int = 1) -> DataFrame:
    """A stable random sample of the priced bulk sales."""
    top = (
        rows.groupBy("id_mutation")
        .agg(C.any_of("valeur_fonciere").alias("price"), F.count("*").alias("n_rows"))
        .where((F.col("n_rows") > S.MAX_ROWS_PER_SALE) & F.col("price").isNotNull())
        .orderBy(sample_order(seed), "id_mutation")
        .limit(size)
    )
    columns = ["id_mutation", "date", "price", "nature", "n_rows", "n_communes", "dept"]
    return _top_details(rows, top, columns, size, sample_order(seed))


def single_house_ppm2(rows: DataFrame) -> DataFrame:
    """Price per m² by year of sales with exactly one house row."""
    house = C.is_house()
    low, high = S.SINGLE_HOUSE_PRICE_RANGE
    sales = (
        rows.groupBy("id_mutation")
        .agg(
            C.any_of("year").alias("year"),
            C.any_of("valeur_fonciere").alias("price"),
            C.any_is("nature_mutation", S.PLAIN_SALE).alias("plain"),
            F.count("*").alias("n_rows"),
            F.count_if(house).alias("n_houses"),
            C.any_of("surface_reelle_bati", house).alias("area"),
        )
        .where(
            (F.col("n_houses") == 1)
            & (F.col("area") > S.MIN_BUILT_AREA)
            & F.col("plain")
            & F.col("price").between(low, high)
            & (F.col("n_rows") <= S.MAX_ROWS_PER_SALE)
        )
        .withColumn("ppm2", F.col("price") / F.col("area"))
    )
    rounded = {"median_eur_per_m2": Q.median("ppm2"), "avg_eur_per_m2": Q.mean("ppm2")}
    return (
        Q.summarise(
            materialise(sales.select("year", "ppm2"), "single-house"),
            ["year"],
            {"n_sales": Q.count(), **rounded},
        )
        .withColumns({name: F.round(name) for name in rounded})
        .orderBy("year")
    )
